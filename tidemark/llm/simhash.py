"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints link when at most ``budget`` of 64 bits differ. Then at least one of
``budget + 1`` bit blocks is equal, so every pair meets in a trie that starts with that block. For
each block, fingerprints are dealt by its value; a task sorts its tries and walks pairs of
nodes down together: differing bits add up, and a pair over the budget is pruned. A cell with
very many fingerprints is cut into chunks, and pairs of chunks are walked.

A task returns a spanning forest of its links and not the links, so a dense group costs one
row a member.

Three differing bits are far fewer than those of texts with, say, four fifths of their shingles in common, so
``similar_documents`` walks the tries of several independent word fingerprints, which near copies
hardly change. A wide fingerprint of the distinct shingles drops pairs that are clearly too far apart; what
hangs together after that is a candidate group, in which the same tries are walked again and each
pair is verified by its shingle sets. The tries find most links cheaply but not all, so an exact search by
set prefixes follows, which leaves out only pairs that are in one component already. Prefixes go once, packed,
to where their shingles are met; only shingles that several sets have there are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, unite
from tidemark.llm import words as W
from tidemark.llm.rows import DOC, PLACE, ROW, cut, numbered, part_count, placed, released, scratch, without

BITS = 64
SLICE = 1 << 15  # shingles whose bits are counted at once
FRONT = 1 << 19  # node pairs that are expanded at once
PAIRS = 1 << 21  # fingerprint pairs that are compared at once
LEAF = 16  # node pairs with as many fingerprint pairs or fewer are compared directly
WIDE = 4 * BITS  # bits that estimate the similarity of shingles
CHUNK = 8192  # fingerprints of one cell that a task takes from each side
GROUP_CHUNK = 1024  # members of one candidate group that a task takes from each side
CHUNK_BYTES = 1 << 24  # and their shingle sets, about
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27  # bits that tell the rows whose texts are wanted: 16 a row, at most 16 MB
SLOT = 1 << 19  # bits that are put together at once
MOST_COUNTS = 1 << 23  # counters that put rare shingles first
COUNT_SLOT = 1 << 14
# fixed values: least counts of the levels that a counter is rounded to, each half as much again
LEVELS = np.unique(np.round(1.5 ** np.arange(32)).astype(np.int64))
SHINGLE_BYTES = 8  # bytes of text for each shingle, about
LEAST_RANGES, MOST_RANGES = 1 << 6, 1 << 12  # ranges of shingles that postings are dealt by
RANGE_BYTES = 1 << 22  # bytes of text for each of them, about
POSTED = 1 << 18  # postings that a task packs at once
SEEN = 1 << 17  # texts that a task remembers to have posted
POSTINGS = 1 << 19  # candidate pairs of a task that are made at once
FAMILY = 1 << 17  # postings of one family of shingles that a task takes from each side
DEVIATIONS = 3  # standard deviations of the wide bits that a similar pair may be off


def text_fingerprint(text: str | None, shingle: int) -> int:
    """Fingerprint as a signed long: bit b is set if over half the shingle hashes have it.

    Words are runs of non-blank characters after lower-casing A-Z; a text with fewer words than
    a shingle is one shingle, and one without words has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    counts, total = np.zeros(BITS, np.int64), 0
    last = max(len(words) - shingle + 1, 1)
    for lo in range(0, last, SLICE):
        part = words[lo: lo + SLICE + shingle - 1]
        size = min(SLICE, last - lo)
        joined = map(b" ".join, zip(*(part[j: j + size] for j in range(shingle)))) \
            if len(words) >= shingle else (b" ".join(words),)
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in joined), np.uint64, size)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += size
    packed = np.packbits(2 * counts > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = 5) -> DataFrame:
    """``_row, doc_id, fingerprint`` (signed long) of every row, stored."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return numbered(docs, F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fingerprint"))


def _leaf_links(fp: np.ndarray, a: tuple, b: tuple, same: np.ndarray, budget: int):
    """Index pairs within the budget of node pairs given by their ranges."""
    na, nb = a[1] - a[0], b[1] - b[0]
    n = na * nb
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        k = np.repeat(np.arange(lo, hi), n[lo:hi])
        within = np.arange(len(k)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi])
        i, j = a[0][k] + within // nb[k], b[0][k] + within % nb[k]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= budget
        close &= ~same[k] | (i < j)
        yield i[close], j[close]
        lo = hi


def walk_tries(fp: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]], budget: int,
               link: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``link`` with index arrays of all pairs within the budget in the node pairs of ``cells``.

    ``cells`` has the ranges of both sides, in ``fp`` sorted within each range; a pair of equal
    ranges is a self-join. Node pairs go down one bit at a time, at most ``FRONT`` together.
    """
    (alo, ahi), (blo, bhi) = cells
    stack = [(np.stack([alo, ahi, blo, bhi, np.zeros_like(alo)]), 0)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        front, depth = stack.pop()
        if front.shape[1] > FRONT:
            stack += [(front[:, k: k + FRONT], depth) for k in range(0, front.shape[1], FRONT)]
            continue
        alo, ahi, blo, bhi, diff = front
        same = alo == blo
        pairs = (ahi - alo) * (bhi - blo)
        leaf = (pairs <= LEAF) | (depth == BITS)
        if leaf.any():
            for i, j in _leaf_links(fp, (alo[leaf], ahi[leaf]), (blo[leaf], bhi[leaf]), same[leaf], budget):
                link(i, j)
            alo, ahi, blo, bhi, diff = front[:, ~leaf]
            same = same[~leaf]
        if not len(alo):
            continue
        if depth not in ones:
            bit = (fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        count = ones[depth]
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        down = [
            np.stack([alo, amid, blo, bmid, diff]),
            np.stack([amid, ahi, bmid, bhi, diff]),
            np.stack([alo, amid, bmid, bhi, diff + 1]),
            np.stack([amid, ahi, blo, bmid, diff + 1])[:, ~same],
        ]
        children = np.concatenate(down, axis=1)
        size_a, size_b = children[1] - children[0], children[3] - children[2]
        keep = (children[4] <= budget) & (size_a > 0) & (size_b > 0)
        keep &= ~((children[0] == children[2]) & (size_a == 1))
        stack.append((children[:, keep], depth + 1))


def _alike(wide: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Whether at most ``limit`` bits of all columns differ."""
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in wide) <= limit


def _forest(batches: Iterator[pa.RecordBatch], budget: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the links in the cells of one partition."""
    read = [[np.asarray(c) for c in b.columns] for b in batches]
    if not read:
        return
    block, turn, low, high, part, node, raw, *wide = (np.concatenate(c) for c in zip(*read))
    raw = raw.view(np.uint64)
    width, turn = BITS // (budget + 1), turn.astype(np.uint64)
    fp = np.where(turn > 0, (raw << turn) | (raw >> ((np.uint64(BITS) - turn) % np.uint64(BITS))), raw)
    # a range is a cell and chunk pair, and one side of it
    head = fp >> np.uint64(BITS - width)
    order = np.lexsort((fp, part, high, low, head, block))
    fp, node = fp[order], node[order]
    keys = np.stack([x[order].astype(np.int64) for x in (block, head, low, high, part)])
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(fp))
    cell = keys[:, lo]
    own = cell[2] == cell[3]
    other = np.zeros(len(lo), dtype=bool)  # the first side of two, its second side follows
    other[:-1] = (cell[:4, 1:] == cell[:4, :-1]).all(axis=0)
    first = np.flatnonzero(other)
    a = np.concatenate([lo[own], lo[first]]), np.concatenate([hi[own], hi[first]])
    b = np.concatenate([lo[own], lo[first + 1]]), np.concatenate([hi[own], hi[first + 1]])
    root = np.arange(len(fp))
    several = (a[1] - a[0]) * (b[1] - b[0]) > (a[0] == b[0])
    wide = [w.view(np.uint64)[order] for w in wide]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        near = _alike(wide, i, j, limit) if wide else slice(None)
        unite(root, i[near], j[near])

    walk_tries(fp, [(a[0][several], a[1][several]), (b[0][several], b[1][several])], budget, link)
    member = np.flatnonzero(root != np.arange(len(fp)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(node[root[member]]), pa.array(node[member])], names=["a", "b"])


def _chunk_pairs(rows: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    """``rows`` with ``low, high, part``: every chunk of a group meets itself and every other one.

    ``chunks`` is an aggregate over a group. A row of a group with n chunks is there n times.
    """
    sizes = cut(rows.groupBy(*keys).agg(chunks.cast("int").alias("chunks")).where("chunks > 1"))
    count = F.coalesce("chunks", F.lit(1))
    rows = rows.join(sizes, keys, "left").select(
        *rows.columns, count.alias("chunks"), F.pmod(F.xxhash64("node"), count).cast("int").alias("part"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return rows.withColumns({
        "low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("chunks", "other")


def near_links(prints: DataFrame, budget: int, wide: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Links ``a, b`` that connect all nodes with at most ``budget`` differing bits in some table.

    ``prints`` has ``node``, ``table`` (a small number) and ``fingerprint``; with ``wide`` columns a pair
    is linked only if at most ``limit`` of their bits differ. Each row goes once to every block's cell, and to
    as many chunk pairs as its cell has chunks; no pair within the budget is left out.
    """
    blocks = budget + 1
    width = BITS // blocks

    def head(block: Column) -> Column:
        shift = (F.lit(BITS - width) - block * width).cast("int")
        return F.call_function("shiftrightunsigned", F.col("fingerprint"), shift).bitwiseAND(
            F.lit((1 << width) - 1))

    kept = ["node", "fingerprint", *wide]
    dealt = prints.select("table", *kept, F.explode(F.array(*map(F.lit, range(blocks)))).alias("block"))
    dealt = dealt.select((F.col("table") * blocks + F.col("block")).alias("block"), *kept,
                         (F.col("block") * width).alias("turn"), head(F.col("block")).alias("head"))
    dealt = _chunk_pairs(dealt, ["block", "head"], F.ceil(F.count("*") / CHUNK)).select(
        "block", "turn", "low", "high", "part", *kept, "head")
    dealt = dealt.repartition(part_count(prints), "block", "head", "low", "high").drop("head")
    return dealt.mapInArrow(lambda batches: released(_forest(batches, budget, limit)), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 5, budget: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id, copies`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links of at most ``budget`` differing
    bits, ``copies`` the rows with the same fingerprint. Null and blank texts have fingerprint zero and link
    like any other; a null key never becomes a component's name unless all of its keys are
    null; repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    rows = fingerprints(docs, doc_id, text, shingle)
    classes = cut(rows.groupBy("fingerprint").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    prints = classes.select(F.col("fingerprint").alias("node"), F.lit(0).alias("table"), "fingerprint")
    roots = connected_components(near_links(prints, budget))
    linked = cut(roots.withColumnRenamed("node", "fingerprint").join(classes, "fingerprint"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = cut(linked.select("fingerprint", "root").join(names, "root").select("fingerprint", "component_id"))
    named = cut(classes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id"), "copies"))
    return rows.drop(ROW).join(named, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", "copies")


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes as a signed long."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), SLICE):
        part = hashes[lo: lo + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


# fixed values: one number for each independent hash
_WORD_SALTS = tuple(np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(16))
_WIDE_SALTS = tuple(np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) % 2**64) for k in range(WIDE // BITS))
_DIGEST_SALT = np.uint64(0xA0761D6478BD642F)
_WIDE_NAMES = tuple(f"wide{k}" for k in range(WIDE // BITS))


def _shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """First row, word hashes and sorted distinct shingles of some rows at a time."""
    data, offsets = W.text_bytes(column)
    for lo, hi in W.row_groups(offsets):
        found = W.words_of(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        words = [found.hash[a:b] for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist())]
        yield lo, words, [np.unique(W.shingle_hashes(w, min(shingle, len(w)))) if len(w) else w for w in words]


def _digest(shingles: np.ndarray) -> np.uint64:
    return np.add.reduce(W.mix(shingles ^ _DIGEST_SALT), dtype=np.uint64)


def _cells_of(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _has(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _add(bits: np.ndarray, cell: np.ndarray) -> None:
    np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))


def _prints(batches: Iterator[pa.RecordBatch], shingle: int, tables: int, counters: int) -> Iterator[pa.RecordBatch]:
    """Row number, place, key, word fingerprints, digest of the shingles and wide fingerprint of each row.

    Last come, packed by slot, counts of the rows that shingles occur in.
    """
    counts = np.zeros(counters, np.uint32)
    schema = None
    for batch in batches:
        for lo, words, sets in _shingle_sets(batch.column(3), shingle):
            prints, digests, wide = [], [], []
            for own, shingles in zip(words, sets):
                prints.append([_majority(W.mix(own ^ salt)) for salt in _WORD_SALTS[:tables]])
                digests.append(_digest(shingles))
                wide.append([_majority(W.mix(shingles ^ salt)) for salt in _WIDE_SALTS])
            np.add.at(counts, _cells_of(np.concatenate(sets), counters), 1)
            part = batch.slice(lo, len(sets))
            out = pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(prints, pa.list_(pa.int64())),
                 pa.array(np.array(digests, np.uint64).view(np.int64)),
                 *[pa.array([w[k] for w in wide], pa.int64()) for k in range(len(_WIDE_NAMES))],
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=[ROW, PLACE, "doc_id", "prints", "digest", *_WIDE_NAMES, "slot", "counts"])
            schema = out.schema
            yield out
    if schema is not None:
        many = min(COUNT_SLOT, counters)
        used = np.flatnonzero(counts.reshape(-1, many).any(axis=1)).tolist()
        packed = [zlib.compress(counts[k * many: (k + 1) * many].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(used), f.type) for f in list(schema)[:-2]], pa.array(used, pa.int32()), pa.array(packed, pa.binary())],
            schema=schema)


def similar_bits(similarity: float) -> int:
    """Most differing wide bits of a pair with this share of shingles in common.

    A Jaccard similarity s is a cosine of at least 2s / (1 + s); its angle over pi is the expected share
    of differing bits. The bound is ``DEVIATIONS`` standard deviations above.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE * share + DEVIATIONS * math.sqrt(WIDE * share * (1 - share)))


def is_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is that or more; two empty sets are equal."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    at = np.searchsorted(b, a)
    common = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
    return common >= similarity * (len(a) + len(b) - common)


def _verified(group: pa.Table, budget: int, limit: int, similarity: float) -> pa.Table:
    """Spanning forest of the similar pairs within one chunk, or between two, of a candidate group."""
    node, part = (np.asarray(group.column(c)) for c in ("node", "part"))
    own = group.column("low")[0] == group.column("high")[0]
    prints = np.array(group.column("prints").to_pylist(), np.int64).view(np.uint64)
    wide = [np.asarray(group.column(c)).view(np.uint64) for c in _WIDE_NAMES]
    sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
    root = np.arange(len(node))
    for fp in prints.T:
        order = np.lexsort((fp, part))
        first = len(node) if own else int(np.count_nonzero(part == part.min()))
        ranges = ((0, first), (0, first)) if own else ((0, first), (first, len(node)))

        def link(i: np.ndarray, j: np.ndarray) -> None:
            for lo in range(0, len(i), CHUNK):
                a, b = order[i[lo: lo + CHUNK]], order[j[lo: lo + CHUNK]]
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
                near = _alike(wide, a, b, limit)
                for x, y in zip(a[near].tolist(), b[near].tolist()):
                    if root[x] != root[y] and is_similar(sets[x], sets[y], similarity):
                        unite(root, np.array([x]), np.array([y]))

        walk_tries(fp[order], [tuple(np.array([v]) for v in r) for r in ranges], budget, link)
    member = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[root[member]]), "b": pa.array(node[member])})


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slot the levels of its counters."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, packed in zip(*(c.to_pylist() for c in batch.columns)):
            counts[slot] = counts.get(slot, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
    for k, c in counts.items():
        levels = np.searchsorted(LEVELS, c, "right").astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels], pa.binary())], names=["slot", "told"])


def shingle_levels(packed: DataFrame, counters: int) -> np.ndarray:
    """Levels that order shingles by frequency, at most ``MOST_COUNTS`` bytes; shingles that share a counter cost time and no pair."""
    levels = np.zeros(counters, np.uint8)
    for r in packed.repartition(part_count(packed), "slot").mapInArrow(_added_up, "slot int, told binary").toLocalIterator():
        levels[r.slot * len(r.told): (r.slot + 1) * len(r.told)] = np.frombuffer(r.told, np.uint8)
    return levels


def prefix_of(shingles: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of that similarity share one of them."""
    size = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, levels[_cells_of(shingles, len(levels))]))[:size]]


def _packed(values: np.ndarray) -> bytes:
    """64-bit values by byte, the lowest bytes of all first; leading zeros are left out."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(packed: list[bytes], counts: list[int]) -> np.ndarray:
    out = np.zeros((sum(counts), 8), np.uint8)
    at = 0
    for x, n in zip(packed, counts):
        out[at: at + n, : len(x) // n] = np.frombuffer(x, np.uint8).reshape(-1, n).T
        at += n
    return out.view("<u8").reshape(-1)


def _postings(batches: Iterator[pa.RecordBatch], shingle: int, levels, similarity: float, ranges: int) -> Iterator[pa.RecordBatch]:
    """Shingle, node, size and place of the prefixes, packed by ranges of shingles.

    A text that the task has seen just before is not posted again.
    """
    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []

    def dealt() -> pa.RecordBatch:
        posted, node, size, place = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(posted)
        posted, node, size, place = (x[order] for x in (posted, node, size, place))
        at = _cells_of(posted, ranges)
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(begins[1:], len(at))
        # of a range the first shingle, then differences
        step = np.append(np.uint64(0), posted[1:] - posted[:-1])
        step[begins] = posted[begins]
        return pa.RecordBatch.from_arrays(
            [pa.array(at[begins], pa.int32()), pa.array(ends - begins, pa.int32()),
             *[pa.array([_packed(x[a:b]) for a, b in zip(begins, ends)], pa.binary()) for x in (step, node, size, place)]],
            names=["part", "count", "shingle", "node", "size", "place"])

    for batch in batches:
        for _, _, sets in _shingle_sets(batch.column(0), shingle):
            for shingles in sets:
                digest = _digest(shingles)
                if int(digest) in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(int(digest))
                if len(shingles):
                    found = prefix_of(shingles, levels.value, similarity)
                    held.append((found, np.full(len(found), digest), np.full(len(found), len(shingles), np.uint64),
                                 np.arange(len(found), dtype=np.uint64)))
            if sum(len(x[0]) for x in held) > POSTED:
                yield dealt()
                held.clear()
    if held:
        yield dealt()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, size, place, shingle`` of the shingles that several nodes have, once a node. Rows come by range."""

    def told(rows: list[list]) -> pa.RecordBatch:
        counts, shingle, *rest = zip(*rows)
        # differences start anew in each row
        shingle = np.concatenate([np.cumsum(_unpacked([x], [n]), dtype=np.uint64) for x, n in zip(shingle, counts)])
        node, size, place = (_unpacked(x, counts) for x in rest)
        order = np.lexsort((node, shingle))
        shingle, node, size, place = (x[order] for x in (shingle, node, size, place))
        same = np.append(shingle[1:] == shingle[:-1], False)  # as the next one
        first = np.append(True, ~same[:-1])
        again = same & np.append(node[1:] == node[:-1], False)
        # a shingle's nodes are several if its first is not its last
        begins = np.flatnonzero(first)
        last = np.append(begins[1:], len(node)) - 1
        several = np.repeat(node[begins] != node[last], last - begins + 1)
        keep = several & ~again
        return pa.RecordBatch.from_arrays(
            [pa.array(x[keep].view(np.int64)) for x in (node, size, place, shingle)], names=["node", "size", "place", "shingle"])

    part, rows = None, []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if own != part and rows:
                yield told(rows)
                rows = []
            part = own
            rows.append(row)
    if rows:
        yield told(rows)


_PAIR = ["a", "b", "size_a", "size_b", "met", "place_a", "place_b"]


def _across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots that share prefix shingles and whose sizes leave room for the similarity.

    In the chunk pairs of a partition, with the number of shingles met and the last places, a row for a pair of a family as a rule.
    """
    read = [[np.asarray(c) for c in b.columns] for b in batches]
    if not read:
        return
    rows = [np.concatenate(c) for c in zip(*read)]
    order = np.lexsort(tuple(rows[::-1]))
    star, low, high, shingle, root, node, size, place, part = (x[order] for x in rows)
    cell = np.ones(len(node), bool)
    cell[1:] = (shingle[1:] != shingle[:-1]) | (star[1:] != star[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new = cell.copy()
    new[1:] |= root[1:] != root[:-1]

    def ends(begins: np.ndarray) -> np.ndarray:
        """The end of the stretch each row lies in."""
        at = np.append(np.flatnonzero(begins), len(begins))
        return at[np.cumsum(begins)]

    # the partners of a row are those behind its root's stretch, to the end of its cell
    first, end = ends(new), ends(cell)
    n = end - first
    total = np.cumsum(n)
    held: list[np.ndarray] = []

    def merged() -> np.ndarray:
        """The rows held, one for a pair: shingles met are added up, places are the last."""
        every = np.concatenate(held, axis=1)
        every = every[:, np.lexsort((every[1], every[0]))]
        begins = np.flatnonzero(np.append(True, (every[:2, 1:] != every[:2, :-1]).any(axis=0)))
        out = every[:, begins]
        out[4] = np.add.reduceat(every[4], begins)
        out[5], out[6] = np.maximum.reduceat(every[5], begins), np.maximum.reduceat(every[6], begins)
        return out

    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + POSTINGS, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        # two rows of one part meet in that part's own cell
        keep = (low[i] == high[i]) | (part[i] != part[j])
        keep &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[keep], j[keep]
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if len(i):
            held.append(np.stack([node[i], node[j], size[i], size[j], np.ones_like(i), place[i], place[j]]))
        if held and sum(x.shape[1] for x in held) > POSTINGS:
            held = [merged()]
            if held[0].shape[1] > POSTINGS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=_PAIR)
        lo = hi
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=_PAIR)


def _similar_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            x, y = (c.to_pylist() for c in part.columns[2:])
            near = [is_similar(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), similarity) for p, q in zip(x, y)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in part.columns[:2]], names=["a", "b"])


def _told(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """For each slot the cells of all hashes; rows are a slot and a hash."""
    bits: dict[int, np.ndarray] = {}
    size = min(SLOT, cells)
    for batch in batches:
        slot, cell = np.asarray(batch.column(0)), _cells_of(np.asarray(batch.column(1)).view(np.uint64), cells) % size
        for k in np.unique(slot).tolist():
            _add(bits.setdefault(k, np.zeros(size // 8, np.uint8)), cell[slot == k])
    for k, x in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slot", "told"])


def hash_bits(hashes: DataFrame, cells: int) -> np.ndarray:
    """Bits that the hashes in ``spot`` have; another hash has one by chance, and is then taken for one of them."""
    size = min(SLOT, cells)
    slot = F.call_function("shiftrightunsigned", "spot", F.lit(65 - (cells // size).bit_length())) if cells > size else F.lit(0)
    dealt = hashes.select(slot.cast("int").alias("slot"), "spot").repartition(part_count(hashes), "slot")
    bits = np.zeros(cells // 8, np.uint8)
    for r in dealt.mapInArrow(lambda it: released(_told(it, cells)), "slot int, told binary").collect():
        bits[r.slot * len(r.told): (r.slot + 1) * len(r.told)] = np.frombuffer(r.told, np.uint8)
    return bits


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, bits) -> Iterator[pa.RecordBatch]:
    """``node, shingles`` of the rows whose hash has its bit."""
    for batch in batches:
        has = _has(bits.value, _cells_of(np.asarray(batch.column(0)).view(np.uint64), 8 * len(bits.value)))
        texts = batch.column(1).filter(pa.array(has))
        for _, _, sets in _shingle_sets(texts, shingle):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([_digest(x) for x in sets], np.uint64).view(np.int64)),
                 pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["node", "shingles"])


def possible_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of those pairs whose prefixes leave room for the similarity, from all shingles met.

    Sets share no more than the shingles met, and the fewer of those that follow the last one met in either. Nor do they share
    more than the shingles met, and those behind the prefix that ends first: up to there all have met.
    """
    met = pairs.groupBy("a", "b").agg(
        F.sum("met").alias("met"), F.first("size_a").alias("m"), F.first("size_b").alias("n"),
        F.max("place_a").alias("i"), F.max("place_b").alias("j"))
    behind = F.greatest(*(F.ceil(similarity * F.col(c) - 1e-9) for c in "mn"))
    most = F.col("met") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"), behind) - 1
    return met.where(most * (1 + similarity) >= similarity * (F.col("m") + F.col("n")) - 1e-9).select("a", "b")


def all_roots(sets_of: Callable[[DataFrame], DataFrame], posted: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of all nodes that are linked by ``links`` or by a pair of that similarity; no pair is missed.

    ``sets_of`` gives ``node, shingles`` of the nodes in a table, ``posted`` has the prefix shingles that several nodes
    have. First nodes meet the least one of each of their shingles, which joins dense groups
    without all of their pairs; then all pairs that are still in different components are verified. Shingles with the same
    least node are a family, whose pairs are put together in one place; one with very many postings is cut into chunks.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(possible_pairs(pairs, similarity))
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))

        def side(name: str, value: str) -> DataFrame:
            """The sets of one side of the pairs alone."""
            named = pairs.select(F.col(name).alias("node")).distinct()
            return sets.join(named.hint("merge"), "node", "left_semi").select(
                F.col("node").alias(name), F.col("shingles").alias(value))

        return cut(pairs.hint("merge").join(side("a", "x"), "a").join(side("b", "y").hint("merge"), "b").select(
            "a", "b", "x", "y").mapInArrow(lambda it: released(_similar_pairs(it, similarity)), "a long, b long"))

    def rooted(roots: DataFrame) -> DataFrame:
        return posted.join(roots, "node", "left").select(*posted.columns, F.coalesce("root", "node").alias("root"))

    links = cut(links.select("a", "b"))
    own = rooted(connected_components(links))
    stars = own.groupBy("shingle").agg(F.min(F.struct("node", "size", "place", "root")).alias("star"))
    met = own.join(stars, "shingle").where("root <> star.root")
    links = links.unionByName(verified(met.select(
        F.col("star.node").alias("a"), F.col("node").alias("b"), F.col("star.size").alias("size_a"),
        F.col("size").alias("size_b"), F.lit(1).alias("met"), F.col("star.place").alias("place_a"),
        F.col("place").alias("place_b"))))
    own = cut(rooted(connected_components(links)))
    open_ = own.groupBy("shingle").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.min("node").alias("star")).where("least <> most")
    own = own.join(open_.select("shingle", "star"), "shingle")
    cells = _chunk_pairs(own, ["star"], F.ceil(F.count("*") / FAMILY)).select(
        "star", "low", "high", "shingle", "root", "node", "size", "place", "part")
    across = cells.repartition(part_count(posted), "star", "low", "high").mapInArrow(
        lambda it: released(_across(it, similarity)), ", ".join(f"{c} long" for c in _PAIR))
    links = links.unionByName(verified(across))
    return connected_components(links)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                      similarity: float = 0.8, tables: int = 3, budget: int = 3) -> DataFrame:
    """``_row, doc_id, component, is_first`` for every row of ``docs``.

    Rows link if their sets of shingles have a Jaccard similarity of ``similarity`` or more. Pairs within ``budget``
    bits in one of ``tables`` word fingerprints are found by tries, all others by the prefixes of their sets.
    ``component`` is a number that linked rows share, ``is_first`` marks
    its row with the smallest key (then row number; null keys last). Null, blank and wordless texts
    are equal to each other; repeated rows are copies; an empty table gives no rows; other columns are not read.

    Texts are scanned for their fingerprints, then for their prefixes, then for those whose sets are compared: members of
    candidate groups and pairs with room for the similarity. A large group is cut into chunks, and a task holds two chunks.
    """
    return _similar(placed(docs.select(doc_id, text), False), doc_id, text, shingle, similarity, tables, budget).drop(PLACE)


def _similar(docs: DataFrame, doc_id: str, text: str, shingle: int = 5, similarity: float = 0.8, tables: int = 3,
             budget: int = 3) -> DataFrame:
    """``similar_documents`` of placed rows, with their places."""
    of = F.col(DOC)
    kind = docs.schema[DOC].dataType[doc_id].dataType.simpleString()
    place = docs.schema[PLACE].dataType.simpleString()
    letters, count = docs.agg(F.coalesce(F.sum(F.octet_length(of[text])), F.lit(0)), F.count("*")).first()
    cells = min(max(1 << (16 * count).bit_length(), LEAST_CELLS), MOST_CELLS)
    counters = min(max(1 << int(letters // SHINGLE_BYTES).bit_length(), LEAST_CELLS), MOST_COUNTS)
    source = docs.select(F.monotonically_increasing_id().alias(ROW), PLACE, of[doc_id].alias("doc_id"), of[text].alias("text"))
    told = cut(source.mapInArrow(
        lambda it: released(_prints(it, shingle, tables, counters)),
        ", ".join([f"{ROW} bigint, {PLACE} {place}, doc_id {kind}, prints array<bigint>, digest bigint",
                   *(f"{w} bigint" for w in _WIDE_NAMES), "slot int, counts binary"])))
    rows = told.where("slot is null")
    share = docs.sparkSession.sparkContext.broadcast
    levels = share(shingle_levels(told.where("slot is not null").select("slot", "counts"), counters))
    # equal sets are one node, named by their digest
    classes = cut(rows.groupBy(F.col("digest").alias("node")).agg(
        F.min_by(F.struct("prints", PLACE, *_WIDE_NAMES), ROW).alias("of"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("least")))
    prints = classes.select("node", "of.prints", *(f"of.{w}" for w in _WIDE_NAMES))
    limit = similar_bits(similarity)
    near = near_links(prints.select("node", *_WIDE_NAMES, F.posexplode("prints").alias("table", "fingerprint")),
                      budget, _WIDE_NAMES, limit)
    groups = connected_components(near)

    ranges = min(max(1 << int(letters // RANGE_BYTES).bit_length(), LEAST_RANGES), MOST_RANGES)
    posted = docs.select(of[text].alias("text")).mapInArrow(
        lambda it: released(_postings(it, shingle, levels, similarity, ranges)),
        "part int, count int, shingle binary, node binary, size binary, place binary")
    posted = cut(posted.repartition(part_count(docs), "part").sortWithinPartitions("part").mapInArrow(
        lambda it: released(_met(it)), "node long, size long, place long, shingle long"))

    def spot(at: Column) -> Column:
        return F.xxhash64(at["file"], at["at"]).alias("spot")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The sets of some nodes, made anew from the texts: nothing but them is shuffled."""
        wanted = nodes.distinct().join(classes.select("node", spot(F.col("of")[PLACE])), "node")
        bits = share(hash_bits(wanted, cells))
        sets = cut(docs.select(spot(F.col(PLACE)), of[text].alias("text")).mapInArrow(
            lambda it: released(_sets(it, shingle, bits)), "node long, shingles binary"))
        bits.destroy()
        return sets

    members = groups.join(prints, "node").join(sets_of(groups.select("node")).hint("merge"), "node")
    chunks = F.ceil(F.greatest(F.count("*") / GROUP_CHUNK, F.sum(F.length("shingles")) / CHUNK_BYTES))
    links = _chunk_pairs(members, ["root"], chunks).groupBy("root", "low", "high").applyInArrow(
        lambda group: _verified(group, budget, limit, similarity), "a long, b long")
    roots = all_roots(sets_of, posted, links, similarity)
    named = cut(classes.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("component")))
    firsts = named.groupBy("component").agg(F.min(F.col("least")).alias("first"))
    firsts = cut(firsts.select("component", F.col(f"first.{ROW}").alias("first_row")))
    of_class = cut(named.join(firsts, "component").select(F.col("node").alias("digest"), "component", "first_row"))
    return rows.select(ROW, PLACE, "doc_id", "digest").join(of_class, "digest").select(
        ROW, PLACE, "doc_id", "component", (F.col(ROW) == F.col("first_row")).alias("is_first"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stored: bool = False, **options) -> DataFrame:
    """One row of each group of similar documents, all columns kept.

    Rows are told apart by their place, so one of several equal rows stays, and keys may be null or repeat. ``stored``: ``docs``
    is a table as read from Parquet, which need not be copied.
    """
    rows = placed(docs, stored)
    with scratch(docs.sparkSession) as keep:
        found = _similar(rows, doc_id, text, **options)
        gone = keep(found.where("not is_first").select(f"{PLACE}.*"))
    return without(rows, gone)
