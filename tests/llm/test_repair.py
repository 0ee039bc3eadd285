"""Repair of conversations against a search over all edit scripts."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries, repair

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and kept ``role:text`` of the cheapest, then ASCII-least script; ``rows`` have role, text, fault.

    A best-first search over scripts that only asks at the end whether the roles fit.
    """
    def prefix_ok(roles):
        return re.fullmatch(r"(s?(ua)*u?)?", roles) is not None

    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, k, roles, kept = heapq.heappop(heap)
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(kept)
        state = (k, roles[-1:] if len(roles) < 2 else "ua"[roles[-1] == "a"])
        if state in seen:
            continue
        seen.add(state)
        for role in ("user", "assistant"):
            if prefix_ok(roles + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", k, roles + role[0], (*kept, f"{role}:")))
        if k == len(rows):
            continue
        role, text, fault = rows[k]
        heapq.heappush(heap, (cost + 2, audit + "D", k + 1, roles, kept))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if role[:1] and prefix_ok(roles + role[:1]):
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + role[:1], (*kept, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if prefix_ok(roles + new[0]):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, roles + new[0], (*kept, f"{new}:{text}")))


def expected(rows):
    """All columns of a conversation from ``turn, role, text`` rows in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(
        faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def as_damaged(rows):
    """The contract's damage of ``conv, turn, role, text`` rows, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


ROLES = ["user", "assistant", "system", "tool", "", "unit", " "]
symbols = st.tuples(st.sampled_from(ROLES), st.sampled_from(["", "truncated", "blank", "duplicate"]))
CODES = {"": repair.FINE, "truncated": repair.TRUNCATED, "blank": repair.BLANK, "duplicate": repair.DUPLICATE}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(symbols, st.integers(1, 6)), max_size=5), st.integers(0, 20))
def test_least_script(parts, border):
    rows = [(role, "x.", fault) for (role, fault), n in parts for _ in range(n)]
    cost, audit, text = cheapest(rows)
    symbols = [repair.symbol_of(r, CODES[f]) for r, _, f in rows]
    edits, state = repair.unroll(symbols, repair.START, repair.END, True)
    assert "".join(e for e, _ in edits) == audit and state in (repair.START, repair.ASSISTANT)
    assert repair.after(repair.matrix_of(symbols), repair.END)[repair.START] == cost
    # in two parts
    left, right = symbols[:border], symbols[border:]
    at = repair.after(repair.matrix_of(right), repair.END)
    first, state = repair.unroll(left, repair.START, at, False)
    second, _ = repair.unroll(right, state, repair.END, True)
    assert "".join(e for e, _ in first + second) == audit
    kept = [f"{role}:{t}" for _, _, role, t in repair.edited([r for r, _, _ in rows], [t for _, t, _ in rows], edits)
            if role is not None]
    assert "\n".join(kept) == text


def conversations(rng, many):
    words = ["Yes.", "no", "Why?", "", " \n", "Well!  ", "a. b", "end.\t"]
    rows = []
    for conv in [None, *range(many)]:
        turns = rng.sample(range(30), rng.choice([1, 1, rng.randint(2, 14)]))
        if conv == 3:
            turns = range(500)  # lies in several ranges
        if conv == 4:
            turns = [None]
        for turn in turns:
            rows.append((conv, turn, rng.choice([*ROLES[:4], None]), rng.choice([*words, f"text {turn}.", None])))
    return rows


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_against_search(spark, tmp_path):
    rows = conversations(random.Random(2), 120)
    spark.createDataFrame(rows, queries.CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    want = {conv: expected(part) for conv, part in as_damaged(rows).items()}
    assert got == want
    assert any(not part for part in as_damaged(rows).values())


def test_one_conversation_over_all_ranges(spark):
    rng = random.Random(4)
    roles = ["user"] * 5 + ["assistant"] * 3 + ["system", "tool"]
    rows = [("all", t // 2, rng.choice(roles), rng.choice([f"{t}.", f"{t}", "", "same.", "again!"]), "clash")
            for t in range(600)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, piece string")
    assert turns.repartitionByRange(4, "turn").select("turn").distinct().count() == 300
    place = {}
    hashes = {r.text: r.h for r in turns.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    for _, turn, role, text, _ in rows:
        place.setdefault(turn, []).append((role, hashes[text], text))
    ordered = [(t, role, text) for t in sorted(place) for role, _, text in sorted(place[t])]
    want = expected(ordered)
    (row,) = repair.repair_report(turns).collect()
    assert row.conv_id == "all" and tuple(row[n] for n in NAMES) == want
    after = sorted(repair.repaired_turns(turns).collect(), key=lambda r: r.position)
    assert "".join(r.edit for r in after) == want[6]
    kept = "\n".join(f"{r.new_role}:{r.text}" for r in after if r.edit != "D")
    assert hashlib.sha256(kept.encode()).hexdigest() == want[7]
    assert [(r.turn, r.role, r.text) for r in after if r.edit != "I"] == ordered
    assert repair.repair_report(turns.limit(0)).count() == 0
    assert repair.repaired_turns(turns.limit(0)).count() == 0
