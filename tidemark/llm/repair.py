"""Repair of the role order of conversations: a run-length dynamic program over min-plus transitions.

A repaired conversation is a system turn or none, then pairs of a user and an assistant turn, or
nothing. Four states say what came last. A row is a symbol: its role's initial and its fault. What
a symbol does to the four states is a four by four matrix of least costs, insertions before the row included;
a run of equal symbols is a power of that matrix, put together from its cached binary powers. Costs to
the end are carried backward over the runs, then the choices of each run are unrolled forward: at each step the first
of Delete, Insert, Keep and Rerole that still reaches the least cost, which gives the ASCII-least audit.

Matrices multiply in any grouping, so a conversation needs no task of its own. Rows are sorted into ranges
of conversation and turn; a range repairs the conversations that lie inside it, and only those that meet
its two ends may go on in another range. Of these each range gives one matrix; costs to the end, then
the state at each border, are passed along the ranges, and each range unrolls its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import cut, part_count

START, SYSTEM, USER, ASSISTANT = range(4)  # states: what came last
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that may follow, but for a system turn
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)  # faults
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
KEPT_TRUNCATED = 5  # for each truncated row that stays
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FAR = 1 << 60

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
Symbol = tuple[str, int]


def keeps(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, None if it may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    follows = USER if initial == "u" else ASSISTANT if initial == "a" else None
    return follows if follows is not None and NEXT[state] == follows else None


def _choices(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in ASCII order, but Insert: letter, cost, state after it."""
    initial, fault = symbol
    out = [("D", COSTS["D"], state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = KEPT_TRUNCATED if fault == TRUNCATED else 0
    kept = keeps(state, initial)
    if kept is not None:
        out.append(("K", COSTS["K"] + more, kept))
    out.append(("R", COSTS["R"] + more, NEXT[state]))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(x + y[q] for x, y in zip(row, b)) for q in range(4)) for row in a)


def after(matrix: Matrix, cost: Vector) -> Vector:
    """Least costs to the end before a stretch, given those after it."""
    return tuple(min(x + y for x, y in zip(row, cost)) for row in matrix)


UNIT: Matrix = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))


def _insertions() -> Matrix:
    one = tuple(tuple(0 if p == q else COSTS["I"] if NEXT[p] == q else FAR for q in range(4)) for p in range(4))
    return times(times(one, one), one)


INSERTIONS = _insertions()
END: Vector = tuple(min(row[START] if p == START else FAR, row[ASSISTANT]) for p, row in enumerate(INSERTIONS))


@lru_cache(maxsize=4096)
def power(symbol: Symbol, exponent: int) -> Matrix:
    """Transition of ``2 ** exponent`` rows of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    rows = []
    for state in range(4):
        row = [FAR] * 4
        for _, cost, to in _choices(symbol, state):
            row[to] = min(row[to], cost)
        rows.append(tuple(row))
    return times(INSERTIONS, tuple(rows))


def symbol_of(role: str, fault: int) -> Symbol:
    """Rows that must go are one symbol, and so are roles that no state lets pass."""
    if fault in (BLANK, DUPLICATE):
        return "", BLANK
    return role[:1] if role[:1] in ("s", "u", "a") else "", fault


def runs_of(symbols: list[Symbol]) -> list[tuple[Symbol, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def costs_before(symbol: Symbol, n: int, cost: Vector) -> Vector:
    """Least costs to the end before a run, given those after it."""
    for k in _bits(n):
        cost = after(power(symbol, k), cost)
    return cost


def matrix_of(symbols: list[Symbol]) -> Matrix:
    out = UNIT
    for symbol, n in runs_of(symbols):
        for k in _bits(n):
            out = times(out, power(symbol, k))
    return out


def unroll(symbols: list[Symbol], state: int, cost: Vector, last: bool) -> tuple[list[tuple[str, int]], int]:
    """Edits and the state after each, for rows entered in ``state`` with costs ``cost`` after them, and the final state.

    Insertions after the last row belong to the next part, or here if this is the ``last``.
    """
    runs = runs_of(symbols)
    at_end = [cost]
    for symbol, n in reversed(runs[1:]):
        at_end.append(costs_before(symbol, n, at_end[-1]))
    edits: list[tuple[str, int]] = []
    for (symbol, n), behind in zip(runs, reversed(at_end)):
        step = power(symbol, 0)
        costs = [behind]
        for _ in range(n):
            costs.append(after(step, costs[-1]))
        for left in range(n, 0, -1):
            while True:
                todo = costs[left][state]
                delete, *others = _choices(symbol, state)
                if delete[1] + costs[left - 1][state] == todo:
                    edits.append(("D", state))
                    break
                if COSTS["I"] + costs[left][NEXT[state]] == todo:
                    state = NEXT[state]
                    edits.append(("I", state))
                    continue
                letter, _, state = next(c for c in others if c[1] + costs[left - 1][c[2]] == todo)
                edits.append((letter, state))
                break
    while last and state not in (START, ASSISTANT):
        state = NEXT[state]
        edits.append(("I", state))
    return edits, state


def faults_of(roles: list[str], texts: list[str]) -> list[int]:
    """First fault of each row of a conversation: blank, role and text seen earlier, no sentence end."""
    seen: set[tuple[str, bytes]] = set()
    out = []
    for role, text in zip(roles, texts):
        stripped = text.rstrip(BLANKS)
        key = (role, hashlib.sha256(text.encode()).digest())
        if not stripped:
            out.append(BLANK)
        elif key in seen:
            out.append(DUPLICATE)
        else:
            out.append(FINE if stripped.endswith(ENDS) else TRUNCATED)
        seen.add(key)
    return out


def edited(roles: list, texts: list, edits: list[tuple[str, int]]) -> Iterator[tuple[int | None, str, str | None, str]]:
    """Index of the row (None if inserted), edit, role and text after it (None if deleted)."""
    k = 0
    for letter, state in edits:
        if letter == "I":
            yield None, letter, ROLE_OF[state], ""
            continue
        if letter == "D":
            yield k, letter, None, texts[k]
        else:
            yield k, letter, ROLE_OF[state] if letter == "R" else roles[k], texts[k]
        k += 1


@dataclass
class Report:
    """What is known of a conversation after some of its rows, in order."""

    distinct: int = 0
    least: int | None = None
    most: int | None = None
    before: str | None = None
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    hash: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def original(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.faults[fault] += 1

    def edit(self, letter: str, role: str | None, text: str, fault: int) -> None:
        self.audit.append(letter)
        self.cost += COSTS[letter] + (KEPT_TRUNCATED if fault == TRUNCATED and letter != "D" else 0)
        if letter != "D":
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def values(self) -> dict:
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
TURNS = "turn long, role string, text string, edit string, new_role string, fault int"
_REPORT = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    ("audit", pa.string()), ("repaired_sha256", pa.string())]
_TURNS = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
          ("new_role", pa.string()), ("fault", pa.int32())]
_PLACE = [("piece", pa.int64()), ("position", pa.int64())]
BATCH = 1 << 22  # characters of an output batch


class _Out:
    """Rows put together to batches of about ``BATCH`` characters; the key's type is that of the input."""

    def __init__(self, fields: list):
        self.fields, self.schema, self.rows, self.size = fields, None, [], 0

    def reading(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            self.schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *self.fields])
            yield batch

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + len(row.get("text") or "") + len(row.get("audit") or "")
        if self.size >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.size = [], 0


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, list, list]]:
    """Key, turns, roles and texts of the consecutive rows of each conversation."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
    for key, group in groupby(rows, key=lambda r: r[0]):
        _, turns, roles, texts = zip(*group)
        yield key, turns, roles, texts


def _turn_rows(turns, roles, texts, faults, edits) -> Iterator[dict]:
    for n, (k, letter, role, text) in enumerate(edited(roles, texts, edits)):
        yield {"position": n, "turn": None if k is None else turns[k], "role": None if k is None else roles[k],
               "text": text, "edit": letter, "new_role": role, "fault": FINE if k is None else faults[k]}


def _inside(batches: Iterator[pa.RecordBatch], fields: list, report: bool) -> Iterator[pa.RecordBatch]:
    """Repaired conversations of a sorted range; rows of its first and last are passed on with ``piece``."""
    part = TaskContext.get().partitionId()
    out = _Out(fields)

    def open_rows(conversation, piece: int) -> Iterator[dict]:
        key, *columns = conversation
        for n, (turn, role, text) in enumerate(zip(*columns)):
            yield {"conv_id": key, "piece": piece, "position": n, "turn": turn, "role": role, "text": text}

    held, first = None, True
    for conversation in _conversations(out.reading(batches)):
        if held is None:
            held = conversation
            continue
        if first:
            rows = open_rows(held, 2 * part)
            first = False
        else:
            rows = _finished(held, report)
        for row in rows:
            yield from out.add(row)
        held = conversation
    if held is not None:
        for row in open_rows(held, 2 * part + 1):
            yield from out.add(row)
    yield from out.flush()


def _finished(conversation, report: bool) -> Iterator[dict]:
    key, turns, roles, texts = conversation
    faults = faults_of(roles, texts)
    symbols = [symbol_of(r, f) for r, f in zip(roles, faults)]
    edits, _ = unroll(symbols, START, END, True)
    if not report:
        yield from ({"conv_id": key, **row} for row in _turn_rows(turns, roles, texts, faults, edits))
        return
    told = Report()
    for turn, role, fault in zip(turns, roles, faults):
        told.original(turn, role, fault)
    for k, letter, role, text in edited(roles, texts, edits):
        told.edit(letter, role, text, FINE if k is None else faults[k])
    yield {"conv_id": key, **told.values()}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations from their edited rows in order; a task holds no more than the audit."""
    out = _Out(_REPORT)
    rows = (dict(zip(batch.schema.names, values)) for batch in out.reading(batches)
            for values in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, key=lambda r: r["conv_id"]):
        told = Report()
        for r in group:
            if r["edit"] != "I":
                told.original(r["turn"], r["role"], r["fault"])
            told.edit(r["edit"], r["new_role"], r["text"], r["fault"])
        yield from out.add({"conv_id": key, **told.values()})
    yield from out.flush()


def _symbols(piece: pa.Table) -> list[Symbol]:
    return [symbol_of(r, f) for r, f in zip(piece.column("role").to_pylist(), piece.column("fault").to_pylist())]


def _in_order(piece: pa.Table) -> pa.Table:
    return piece.sort_by("position")


def _matrices(piece: pa.Table) -> pa.Table:
    matrix = matrix_of(_symbols(_in_order(piece)))
    return piece.slice(0, 1).select(["conv_id", "piece"]).append_column(
        "matrix", pa.array([[x for row in matrix for x in row]], pa.list_(pa.int64())))


def _exits(piece: pa.Table) -> pa.Table:
    """The state after a piece for each state before it."""
    symbols, cost = _symbols(_in_order(piece)), tuple(piece.column("cost")[0].as_py())
    return piece.slice(0, 1).select(["conv_id", "piece", "cost", "last"]).append_column(
        "exits", pa.array([[unroll(symbols, s, cost, False)[1] for s in range(4)]], pa.list_(pa.int64())))


def _costs_along(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to the end after each piece of a conversation; it has at most one piece a range."""
    pieces = pieces.sort_values("piece", ascending=False, ignore_index=True)
    cost, costs = END, []
    for flat in pieces["matrix"]:
        costs.append(list(cost))
        flat = [int(x) for x in flat]
        cost = after(tuple(tuple(flat[4 * p: 4 * p + 4]) for p in range(4)), cost)
    return pd.DataFrame({"piece": pieces["piece"], "cost": costs, "last": pieces.index == 0})


def _states_along(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("piece", ignore_index=True)
    state, states = START, []
    for exits in pieces["exits"]:
        states.append(state)
        state = int(exits[state])
    return pd.DataFrame({"piece": pieces["piece"], "cost": pieces["cost"], "last": pieces["last"], "state": states})


def _edits(piece: pa.Table) -> pa.Table:
    piece = _in_order(piece)
    cost, last, state = (piece.column(c)[0].as_py() for c in ("cost", "last", "state"))
    edits, _ = unroll(_symbols(piece), state, tuple(cost), last)
    columns = (piece.column(c).to_pylist() for c in ("turn", "role", "text", "fault"))
    about = {c: piece.column(c)[0].as_py() for c in ("conv_id", "piece")}
    schema = pa.schema([piece.schema.field("conv_id"), *map(pa.field, *zip(*_PLACE)), *map(pa.field, *zip(*_TURNS))])
    return pa.Table.from_pylist([{**about, **row} for row in _turn_rows(*columns, edits)], schema)


def _spanning(rows: DataFrame, kind: str) -> DataFrame:
    """Edited rows of conversations that may lie in several ranges: ``conv_id, piece, position`` and the turn."""
    digest = F.sha2("text", 256)
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    keyed = rows.select("conv_id", "piece", "position", "turn", "role", "text", digest.alias("digest"))
    firsts = keyed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("piece", "position")).alias("first")).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    fault = F.when(bare == "", BLANK).when(F.col("first") != F.struct("piece", "position"), DUPLICATE).when(
        F.right(bare, F.lit(1)).isin(*ENDS), FINE).otherwise(TRUNCATED)
    marked = cut(keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                            & (F.col("digest") == F.col("_digest"))).select(
        "conv_id", "piece", "position", "turn", "role", "text", fault.cast("int").alias("fault")))
    symbols = marked.select("conv_id", "piece", "position", "role", "fault")
    costs = cut(symbols.groupBy("conv_id", "piece").applyInArrow(
        _matrices, f"conv_id {kind}, piece long, matrix array<long>").groupBy("conv_id").applyInPandas(
        _costs_along, "piece long, cost array<long>, last boolean"))
    states = cut(symbols.join(costs, "piece").groupBy("conv_id", "piece").applyInArrow(
        _exits, f"conv_id {kind}, piece long, cost array<long>, last boolean, exits array<long>").groupBy(
        "conv_id").applyInPandas(_states_along, "piece long, cost array<long>, last boolean, state int"))
    return marked.join(states, "piece").groupBy("conv_id", "piece").applyInArrow(
        _edits, f"conv_id {kind}, piece long, position long, {TURNS}")


def _repaired(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, report: bool) -> DataFrame:
    kind = turns.schema[conv_id].dataType.simpleString()
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ordered = rows.repartitionByRange(part_count(turns), *order).sortWithinPartitions(*order)
    wanted, arrow = (REPORT, _REPORT) if report else ("edit string, new_role string, fault int", _TURNS[3:])
    fields = [*_PLACE, *_TURNS[:3], *arrow]
    done = cut(ordered.mapInArrow(
        lambda it: _inside(it, fields, report),
        f"conv_id {kind}, piece long, position long, turn long, role string, text string, {wanted}"))
    spanning = _spanning(done.where("piece is not null"), kind)
    done = done.where("piece is null")
    if not report:
        spanning = cut(spanning)
        # positions of a later piece follow those of the earlier ones
        sizes = spanning.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).select(
            "conv_id", "piece", F.expr("sum(n) OVER (PARTITION BY conv_id ORDER BY piece) - n").alias("skip"))
        spanning = spanning.join(cut(sizes).select("piece", "skip"), "piece").withColumn(
            "position", F.col("position") + F.col("skip"))
        names = ["conv_id", "position", "turn", "role", "text", "edit", "new_role", "fault"]
        return done.select(*names).unionByName(spanning.select(*names))
    reports = spanning.repartition(part_count(turns), "conv_id").sortWithinPartitions(
        "conv_id", "piece", "position").mapInArrow(_summed, f"conv_id {kind}, {REPORT}")
    return done.select(*reports.columns).unionByName(reports)


def repair_report(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    Rows are taken by turn, nulls first; rows of one turn by role, then by a hash of the text, equal
    rows as they are. Null roles and texts are one space; a null key is a conversation of its own; gaps leave null
    turns out; repeated rows are duplicates; an empty table gives no rows; other columns are not read.

    Texts are shuffled once, into sorted ranges; a task holds one conversation's part of one range. A conversation
    over several ranges is repaired part by part; its digest, which only a sequence gives, is updated
    row by row by one task that holds none of them.
    """
    return _repaired(turns, conv_id, turn, role, text, True)


def repaired_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """``conv_id, position, turn, role, text, edit, new_role, fault``: every row and every inserted one, in order.

    ``edit`` is D, I, K or R; deleted rows have a null ``new_role``, inserted ones a null ``turn`` and ``role``.
    ``fault`` is 0 for none, 1 truncated, 2 blank, 3 duplicate. Cases as in ``repair_report``.
    """
    return _repaired(turns, conv_id, turn, role, text, False)
