"""Document fingerprints by a randomised edit embedding.

All texts are walked by the same random coins. At each step the walk notes the character it stands on, then a coin
of that step and character says whether it goes on to the next one. Two walks that part at an edit drift
against each other at random and, where they meet again on equal text, stay together; so a small
edit distance becomes a small Hamming distance between the noted strings.

A fingerprint samples the noted string: one position of each block of ``2 ** rate`` steps, the rate growing
with the string so that at most ``SAMPLES`` are kept. The positions of a rate are among those of every
smaller one, so fingerprints of any two lengths compare at the positions of the longer. A sample is one byte.

``near_texts`` deals texts by bands of sampled positions and verifies each pair that meets by its exact edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import connected_components
from tidemark.llm.rows import ROW, cut, numbered, part_count

SAMPLES = 128  # most samples of a fingerprint, a byte each
COINS = 1 << 13  # steps after which the coins come again
HEAD = 8  # bytes of the walk's length that begin a fingerprint
NARROW = 24  # texts that are worth walking together
BANDS, BAND = 48, 6  # bands of a text, and sampled positions of each
_SEED = 0x5851F42D4C957F2D  # fixed value of the coins and sample positions


@lru_cache(maxsize=8)
def _dwell(coins: int) -> np.ndarray:
    """Steps that a walk by these coins stays on a character of each class, by the step it comes at."""
    step = np.arange(COINS, dtype=np.uint64) + np.uint64(coins << 32)
    out = np.empty((256, COINS), np.uint8)
    for kind in range(256):
        heads = (W.mix(step * np.uint64(256) + np.uint64(kind) ^ np.uint64(_SEED)) >> np.uint64(40)) & np.uint64(1)
        heads[-1] = 1
        at = np.where(heads == 1, np.arange(COINS), COINS - 1)
        going = np.minimum.accumulate(at[::-1])[::-1]
        out[kind] = np.minimum(going - np.arange(COINS) + 1, 255)
    return out


def classes_of(text: str) -> np.ndarray:
    """A byte for each code point: itself up to U+00FF, a hash above."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points) or points.max() < 256:
        return points.astype(np.uint8)
    return np.where(points < 256, points, W.mix(points.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


@lru_cache(maxsize=8)
def _dwell_bytes(coins: int) -> list[bytes]:
    return [row.tobytes() for row in _dwell(coins)]


def walks(texts: list[np.ndarray], begin: list[int] | None = None, coins: int = 0) -> list[np.ndarray]:
    """For each text the step at which its walk comes to each character, and the one after the last.

    All texts go on together, a character at a time; the few that are longer than the others go on alone.
    """
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    at = np.cumsum(size + 1) - size - 1
    flat = np.empty(int((size + 1).sum()), np.uint8)
    for t, a in zip(texts, at.tolist()):
        flat[a: a + len(t)] = t
    steps = np.empty(len(flat), np.int64)
    now = np.zeros(len(texts), np.int64) if begin is None else np.array(begin, np.int64)[order]
    place, longest = at[order], -size[order]
    dwell, last = _dwell(coins).reshape(-1), COINS - 1
    done = 0
    together = int(-longest[NARROW - 1]) if len(texts) >= NARROW else 0
    widths = np.searchsorted(longest, -np.arange(together), "left").tolist()
    for done, wide in enumerate(widths, 1):
        here, j = place[:wide], now[:wide]
        steps[here] = j
        j += dwell[flat[here].astype(np.int64) * COINS + (j & last)]
        here += 1
    slow = _dwell_bytes(coins)
    for k in np.flatnonzero(size[order] > done).tolist():
        a, left = int(place[k]), int(size[order[k]]) - done
        rest = accumulate(flat[a: a + left].tobytes(), lambda j, c: j + slow[c][j & last], initial=int(now[k]))
        steps[a: a + left + 1] = np.fromiter(rest, np.int64, left + 1)
    ended = size[order] <= done
    steps[place[ended]] = now[ended]
    return [steps[a: a + n + 1] for a, n in zip(at.tolist(), size.tolist())]


def rate_of(length: int) -> int:
    """The least rate whose blocks number at most ``SAMPLES``."""
    return max(0, -(-length // SAMPLES) - 1).bit_length()


def positions(rate: int, many: int) -> np.ndarray:
    """The sampled step of each of the first blocks of ``2 ** rate`` steps: a hash chooses a half, then its half."""
    at = np.arange(many, dtype=np.uint64)
    for level in range(rate, 0, -1):
        at = at * np.uint64(2) + (W.mix(at * np.uint64(64) + np.uint64(level) ^ np.uint64(_SEED)) & np.uint64(1))
    return at.astype(np.int64)


@dataclass
class Print:
    """Length of a walk and the sampled characters; blocks whose position lies beyond the end have none."""

    length: int
    sample: np.ndarray

    def raw(self) -> bytes:
        return self.length.to_bytes(HEAD, "big") + self.sample.tobytes()


def print_of(classes: np.ndarray, steps: np.ndarray) -> Print:
    length = int(steps[-1])
    rate = rate_of(length)
    at = positions(rate, -(-length >> rate))
    at = at[at < length]  # only the last block's position may lie beyond the end
    return Print(length, classes[np.searchsorted(steps, at, "right") - 1])


def text_print(text: str | None) -> Print:
    classes = classes_of(text or "")
    return print_of(classes, walks([classes])[0])


def thinned(mark: Print, rate: int) -> np.ndarray:
    """The samples that belong to a higher rate."""
    own = rate_of(mark.length)
    if rate == own:
        return mark.sample
    at = positions(rate, -(-mark.length >> rate))
    return mark.sample[at[at < mark.length] >> own]


def likeness(a: Print, b: Print) -> float:
    """Estimated share of equal steps of the two walks, the longer one's length taken; two empty ones are equal."""
    rate = rate_of(max(a.length, b.length))
    x, y = thinned(a, rate), thinned(b, rate)
    most = max(len(x), len(y))
    if not most:
        return 1.0 if a.length == b.length else 0.0
    common = min(len(x), len(y))
    return float(np.count_nonzero(x[:common] == y[:common])) / most


# --- a text and the text of the next row ---


@dataclass
class _Walked:
    key: object
    text: str
    classes: np.ndarray
    steps: np.ndarray
    mark: Print


def _walked(rows: list[tuple[object, str]]) -> list[_Walked]:
    classes = [classes_of(text) for _, text in rows]
    return [_Walked(key, text, c, steps, print_of(c, steps))
            for (key, text), c, steps in zip(rows, classes, walks(classes))]


def _spliced(pairs: list[tuple[_Walked, _Walked]]) -> list[dict]:
    """The first of each pair with its second half taken from the beginning of the other."""
    halves = [after.classes[: len(row.text) // 2] for row, after in pairs]
    kept = [len(row.text) - len(row.text) // 2 for row, _ in pairs]
    # the walk of the half that stays is known
    tails = walks(halves, [int(row.steps[n]) for (row, _), n in zip(pairs, kept)])
    out = []
    for (row, after), n, half, tail in zip(pairs, kept, halves, tails):
        edited = print_of(np.concatenate([row.classes[:n], half]), np.concatenate([row.steps[:n], tail]))
        text = row.text[:n] + after.text[: len(row.text) // 2]
        out.append({"doc_id": row.key, "n_chars": len(row.text),
                    "edited_sha256": hashlib.sha256(text.encode()).digest(),
                    "fingerprint": row.mark.raw(), "edited_fingerprint": edited.raw(),
                    "near_edited": likeness(row.mark, edited), "near_next": likeness(row.mark, after.mark)})
    return out


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
           ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SPLICED = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ENDS = [("part", pa.int64()), ("place", pa.string()), ("text", pa.string())]
BATCH = 1 << 22  # bytes of texts that are walked together


def _schema(key: pa.Field, *fields) -> pa.Schema:
    return pa.schema([pa.field("doc_id", key.type), *(pa.field(*f) for f in fields)])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range, each spliced with its next; the text of the first and last goes on."""
    part = TaskContext.get().partitionId()
    before, schema = None, None

    def at_end(row: _Walked, place: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc_id": row.key, "part": part, "place": place, "text": row.text}], schema)

    for batch in batches:
        schema = _schema(batch.schema.field(0), *_ENDS, *_FIELDS)
        _, offsets = W.text_bytes(batch.column(1))
        for lo, hi in W.row_groups(offsets, BATCH):
            keys, texts = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
            rows = _walked([(k, t or "") for k, t in zip(keys, texts)])
            if before is None:
                yield at_end(rows[0], "first")
            else:
                rows.insert(0, before)
            before = rows[-1]
            yield pa.RecordBatch.from_pylist(_spliced(list(pairwise(rows))), schema)
    if before is not None:
        yield at_end(before, "last")


def _bordering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_spliced([tuple(_walked([(key, text), (None, after)]))])[0]
                for key, text, after in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_pylist(rows, _schema(batch.schema.field(0), *_FIELDS))


def spliced_prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edit of it: its second half (rounded down) replaced by the next text's beginning.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (binary), ``near_edited, near_next``: the
    likeness of the text's fingerprint to that of the edited text and of the next. The next row has the next larger
    key; the first one follows the last. Null keys come first, rows of one key go by a hash of the text, then by
    their place in the table. Null texts are empty; a table of one row follows itself; an empty table gives none;
    repeated rows each get a row; other columns are not read.

    Texts are shuffled once, into ranges of the key; a task walks its range row by row and holds two texts. Only the
    two rows at the ends of each range meet their neighbour in a second, small job.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias(ROW))
    order = ["doc_id", F.xxhash64("text"), ROW]
    ranges = rows.repartitionByRange(part_count(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = cut(ranges.mapInArrow(_chained, f"doc_id {kind}, part long, place string, text string, {SPLICED}"))
    names = [f[0] for f in _FIELDS]
    firsts = cut(done.where("place = 'first'").select("part", "text"))
    # one row a range: the part that follows, the first after the last
    parts = firsts.select("part").selectExpr(
        "part", "coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ()) AS next_part")
    lasts = done.where("place = 'last'").select("doc_id", "text", "part").join(parts, "part")
    firsts = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    borders = lasts.join(firsts, "next_part").select("doc_id", "text", "after").mapInArrow(
        _bordering, f"doc_id {kind}, {SPLICED}")
    return done.where("place is null").select("doc_id", *names).unionByName(borders)


# --- near texts ---


@lru_cache(maxsize=1)
def _band_samples() -> tuple[np.ndarray, np.ndarray]:
    """The samples a fingerprint must have for each band, ascending, and which of them the band takes."""
    rng = np.random.default_rng(_SEED)
    spans = np.sort(np.resize([SAMPLES * k // 8 for k in (2, 3, 4, 5, 6, 8)], BANDS))
    return spans, np.stack([rng.choice(s, BAND, replace=False) for s in spans])


def bands_of(mark: Print, coins: int = 0) -> list[int]:
    """Hashes of the sampled bits of each band, at the fingerprint's own rate and the next one.

    Texts whose walks differ in length by less than a factor of two share a rate. A text with fewer samples than
    the least band asks for has the two halves of its sample as bands.
    """
    spans, taken = _band_samples()
    own = rate_of(mark.length)
    out: list[int] = []
    for rate in (own, own + 1):
        sample = thinned(mark, rate).astype(np.uint64)
        many = int(np.searchsorted(spans, len(sample), "right"))
        if many:
            rows, salt = sample[taken[:many]], np.arange(many, dtype=np.uint64)
        else:
            half = (len(sample) + 1) // 2
            rows = np.zeros((2, max(half, 1)), np.uint64)
            rows[0, :half], rows[1, : len(sample) - half] = sample[:half], sample[half:]
            salt = np.array([BANDS, BANDS + 1], np.uint64)
        key = W.mix((salt * np.uint64(256) + np.uint64(rate)) * np.uint64(64) + np.uint64(coins) ^ np.uint64(_SEED))
        for x in rows.T:
            key = W.mix(key * np.uint64(257) + x)
        out += key.view(np.int64).tolist()
    return out


def edit_distance(a: str, b: str, limit: int) -> int | None:
    """Insertions, deletions and replacements between two texts, None above ``limit``.

    One column of the table at a time as bit vectors in whole numbers, common ends set aside.
    """
    lead = 0
    shorter = min(len(a), len(b))
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    differ = np.flatnonzero(x[:shorter] != y[:shorter])
    lead = int(differ[0]) if len(differ) else shorter
    x, y = x[lead:], y[lead:]
    shorter = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:shorter] != y[::-1][:shorter])
    tail = int(differ[0]) if len(differ) else shorter
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > limit:
        return None
    if not len(x):
        return len(y)
    m, n = len(x), len(y)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    up, down, score = full, 0, m
    for k, c in enumerate(y.tolist()):
        same = where.get(c, 0)
        level = same | down
        across = ((((same & up) + up) ^ up) | same) & full
        more, less = down | (full & ~(across | up)), up & across
        score += bool(more & top) - bool(less & top)
        if score - (n - 1 - k) > limit:
            return None
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(level | more)), more & level
    return score if score <= limit else None


def _marked(batches: Iterator[pa.RecordBatch], embeddings: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = W.text_bytes(batch.column(1))
        for lo, hi in W.row_groups(offsets, BATCH):
            nodes, texts = (c.slice(lo, hi - lo) for c in batch.columns)
            classes = [classes_of(t) for t in texts.to_pylist()]
            bands: list[list[int]] = [[] for _ in classes]
            for coins in range(embeddings):
                for found, c, steps in zip(bands, classes, walks(classes, coins=coins)):
                    found += bands_of(print_of(c, steps), coins)
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.array([len(c) for c in classes], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["node", "n_chars", "bands"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            near.append(edit_distance(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) is not None)
        keep = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8,
               embeddings: int = 4) -> DataFrame:
    """``doc_id, component_id, copies`` of every row of ``docs``.

    Two texts link if their edit distance is at most ``1 - similarity`` of the longer one's length and they share a
    band of one of ``embeddings`` independent walks; ``component_id`` is the smallest key over such links (a null key never names a component unless all its keys are null),
    ``copies`` the rows of equal text. Equal texts are one node, null is empty. Pairs that meet are verified
    exactly; which pairs meet is a matter of chance, the surer the fewer the edits (see README). An empty table gives no rows;
    other columns are not read.

    First each text of a band meets the band's smallest row only, which joins copies without all of their pairs; then pairs
    of a band that are still in different components are verified.
    """
    rows = numbered(docs, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    classes = cut(rows.groupBy("digest").agg(
        F.min(ROW).alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    texts = rows.select(F.col(ROW).alias("node"), "text").join(classes.select("node"), "node", "left_semi")
    marks = texts.mapInArrow(lambda it: _marked(it, embeddings), "node long, n_chars long, bands array<long>")
    posted = cut(marks.select("node", "n_chars", F.explode(F.array_distinct("bands")).alias("band")))
    stars = posted.groupBy("band").agg(F.min_by(F.struct("node", "n_chars"), "node").alias("star"), F.count("*").alias("n"))
    stars = cut(stars.where("n > 1").select("band", "star"))

    def verified(pairs: DataFrame) -> DataFrame:
        far = F.abs(F.col("m") - F.col("n")) > (1 - similarity) * F.greatest("m", "n") + 1e-9
        pairs = cut(pairs.where(~far).select("a", "b").distinct())
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
            lambda it: _verified(it, similarity), "a long, b long"))

    links = verified(posted.join(stars, "band").where("node <> star.node").select(
        F.col("star.node").alias("a"), F.col("star.n_chars").alias("m"), F.col("node").alias("b"), F.col("n_chars").alias("n")))
    roots = connected_components(links)
    placed = cut(posted.join(stars.select("band"), "band").join(roots, "node", "left").select(
        "band", "node", "n_chars", F.coalesce("root", "node").alias("root")))
    left = placed.select("band", F.col("node").alias("a"), F.col("n_chars").alias("m"), F.col("root").alias("_a"))
    right = placed.select("band", F.col("node").alias("b"), F.col("n_chars").alias("n"), F.col("root").alias("_b"))
    links = links.unionByName(verified(left.join(right, "band").where("a < b AND _a <> _b")))
    roots = connected_components(links)
    named = classes.join(roots, "node", "left").select(
        "digest", "least", "copies", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("digest", "component_id", "copies"))
    return rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id", "copies")
