"""Exact top-k inner products by norm buckets.

Vectors are grouped by length. The longest ones give each query a first threshold, its k-th best
score so far. A bucket whose longest vector cannot reach the threshold is skipped for that query.
In the others the threshold, divided by the query's and the bucket's length, is a local cosine
threshold: a low one prunes by length alone (a prefix of the bucket, sorted by length), a high one
by coordinates (on a query's largest coordinates, only an interval of values is possible). What is
left is multiplied out in doubles, which are exact for products of lengths below 2**53; beyond that they only
bound a score, and candidates that the bounds leave open are multiplied out in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import ROW, cut, numbered

BUCKETS = 64
CELL = 16_384  # vectors of one bucket in a block, at most about twice as many
QUERIES = 2_048  # queries in a block
FOCUS = 3  # coordinates looked at
COORDINATE = 0.5  # local cosine threshold from which coordinates are looked at

EXACT = 2.0**53 * (1 - 1e-9)  # products of lengths up to which doubles hold every partial sum
ROUNDING = 2.0**-52  # relative error of a term and of a step of a sum, with a margin
MOST = 2.0**500  # components beyond this have no square
LONG = 2**63 - 1

NO_ID = 2**63 - 1  # stands for a null key inside the blocks: largest, so last among ties

FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint, row bigint, place binary, low double"


def place_of(score: int) -> bytes:
    """Bytes that sort as whole numbers do, of any size: the sign and length, then the digits."""
    n = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return bytes([128 + n]) + score.to_bytes(n, "big")
    return bytes([128 - n]) + (256**n - 1 + score).to_bytes(n, "big")


def _best_of(q: np.ndarray, p: np.ndarray, score: np.ndarray, slack: np.ndarray, least: float, k: int) -> tuple[np.ndarray, list[int]]:
    """Rows of ``p`` that can be among the k best, with their exact scores; ``slack`` bounds the error of ``score``."""
    keep = score + slack >= least
    if np.count_nonzero(keep) > k:
        low = (score - slack)[keep]
        keep &= score + slack >= np.partition(low, len(low) - k)[len(low) - k]
    at = np.flatnonzero(keep)
    if not slack.any():
        return at, score[at].astype(np.int64).tolist()
    whole = [int(x) for x in q]
    return at, [sum(a * int(b) for a, b in zip(whole, p[i])) for i in at.tolist()]


def _best(query: pd.DataFrame, cand: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query in one block, among those that reach its threshold."""
    out: list[list] = [[] for _ in range(7)]
    if len(query) and len(cand):
        norm = cand["norm"].to_numpy()
        order = np.argsort(-norm, kind="stable")
        norm = norm[order]
        # the components are whole numbers that doubles hold
        p = np.stack(cand["v"].to_numpy()).astype(np.float64)[order]
        ids, rows = cand["vec_id"].to_numpy()[order], cand["_row"].to_numpy()[order]
        q = np.stack(query["v"].to_numpy()).astype(np.float64)
        q_norm, least = query["norm"].to_numpy(), query["least"].to_numpy()
        directions = p / np.where(norm > 0, norm, 1)[:, None]
        for lo in range(0, len(query), 64):
            part = slice(lo, lo + 64)
            reach = q_norm[part] * norm[0]
            local = np.where(reach > 0, least[part] / np.where(reach > 0, reach, 1), -1.0)
            # a margin for the rounding of lengths; the exact product decides
            local = np.where(least[part] > 0, local - 1e-9, -1.0)
            by_length = np.flatnonzero(local < COORDINATE)
            scores = q[part][by_length] @ p.T if len(by_length) else None
            for n in range(len(q[part])):
                at = lo + n
                if local[n] < COORDINATE:
                    # shorter vectors than this cannot reach a positive threshold
                    end = len(p)
                    if least[at] > 0 and q_norm[at] > 0:
                        end = int(np.searchsorted(-norm, -(least[at] / q_norm[at]) * (1 - 1e-9), side="right"))
                    alive = np.arange(end)
                    score = scores[np.searchsorted(by_length, n), :end]
                else:
                    unit = q[at] / q_norm[at]
                    alive = np.arange(len(p))
                    for f in np.argsort(-np.abs(unit))[:FOCUS]:
                        alive = alive[cosine_bound(directions[alive, f], unit[f]) >= local[n] - 1e-9]
                    score = p[alive] @ q[at]
                others = rows[alive] != query["_row"].iat[at]
                alive, score = alive[others], score[others]
                size = q_norm[at] * norm[alive]
                slack = np.where(size < EXACT, 0.0, size * (len(q[at]) + 2) * ROUNDING)
                near, exact = _best_of(q[at], p[alive], score, slack, least[at], k)
                alive = alive[near]
                pick = sorted(range(len(alive)), key=lambda i: (-exact[i], ids[alive[i]], rows[alive[i]]))[:k]
                out[0] += [query["_row"].iat[at]] * len(pick)
                out[1] += [query["vec_id"].iat[at]] * len(pick)
                out[2] += [ids[alive[i]] for i in pick]
                out[3] += [max(-LONG - 1, min(LONG, exact[i])) for i in pick]
                out[4] += [rows[alive[i]] for i in pick]
                out[5] += [place_of(exact[i]) for i in pick]
                out[6] += [float(np.nextafter(float(exact[i]), -np.inf)) for i in pick]
    names = ["query", "query_id", "vec_id", "score", "row"]
    table = pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip(names, out)})
    return table.assign(place=pd.Series(out[5], dtype=object), low=pd.Series(out[6], dtype="float64"))


def cosine_bound(x: np.ndarray, u: float) -> np.ndarray:
    """Largest cosine of two unit vectors with ``x`` and ``u`` on one coordinate."""
    return u * x + np.sqrt(np.maximum(0.0, 1 - x * x)) * np.sqrt(max(0.0, 1 - u * u))


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, taken and given as a double: all of them are whole from 2**52 on."""
    def floor(y: Column) -> Column:
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(embedding, lambda x: floor(x.cast("double") * scale))


def _search(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The k best of each query in every block that both sides name."""
    keys = ["dim", "q_part", "bucket", "part"]

    def best(query: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        return _best(query, cand, k)

    return queries.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(best, FOUND)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` picks, the k best other rows.

    Scores are inner products of the components times 256, rounded down; ties go to the smaller
    ``vec_id``. A query meets every row but itself, so a repeated row finds its copies. Vectors that
    are null or hold a null or non-finite component take no part, vectors of another dimension do
    not meet, and empty ones meet with score 0. Scores are exact for components of any size; one beyond the range of a long is
    ranked by its value and shown as the nearest long. Doubles of 2**492 and more end the query with an error. An empty
    table gives no rows; other columns are not read, and rows with a null key are candidates with a null ``vec_id``.
    """
    raw = F.col(embedding)
    whole = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = vectors.where(whole).select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("vec_id"), whole_numbers(raw).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(F.abs(x) < MOST, x * x).otherwise(
        F.raise_error(F.lit("a component has no finite square")).cast("double")))
    rows = numbered(picked, "vec_id", "v", "asks", F.sqrt(square).alias("norm"), F.size("v").alias("dim"))
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    if not totals.n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.col("vec_id").alias("score"))

    # length buckets: at most BUCKETS, the longest vectors first; one with very many rows has several parts
    cuts = rows.agg(F.percentile_approx(
        "norm", [(i + 1) / BUCKETS for i in range(BUCKETS - 1)], 10_000).alias("c")).first().c
    cuts = sorted(set(cuts), reverse=True)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("norm"))) if cuts else F.lit(0)
    placed = rows.withColumn("bucket", bucket.cast("int"))
    sizes = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    sizes = cut(sizes.select("dim", "bucket", "longest",
                             F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int")
    cells = cut(placed.join(sizes, ["dim", "bucket"]).select(
        ROW, "vec_id", "v", "norm", "dim", "bucket", part.alias("part")))
    q_parts = -(-int(totals.q or 0) // QUERIES) or 1
    asked = cut(rows.where("asks").select(
        ROW, "vec_id", "v", "norm", "dim",
        F.pmod(F.xxhash64(ROW), F.lit(q_parts)).cast("int").alias("q_part")))

    def dealt(of: DataFrame) -> DataFrame:
        """Blocks of candidates, once for each block of queries."""
        return of.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"))

    # first thresholds: the first part of the longest bucket of each dimension
    first = cut(sizes.groupBy("dim").agg(F.min("bucket").alias("bucket")))
    seeds = cells.join(first, ["dim", "bucket"]).where("part = 0")
    seeded = asked.join(first, "dim").withColumn("part", F.lit(0)).withColumn(
        "least", F.lit(float("-inf")))
    found = cut(_search(seeded, dealt(seeds), k))
    bars = found.groupBy(F.col("query").alias(ROW)).agg(
        F.count("*").alias("n"), F.min("low").alias("bar"))
    asked = asked.join(bars, ROW, "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("bar")).otherwise(F.lit(float("-inf"))))

    # the rest: buckets that can still reach the threshold
    blocks = sizes.join(first.withColumnRenamed("bucket", "top"), "dim").select(
        "dim", "bucket", "longest", "top", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.where("not (bucket = top and part = 0)").groupBy("dim").agg(
        F.collect_list(F.struct("bucket", "part", "longest")).alias("blocks"))
    reach = lambda b: F.col("norm") * b.longest * (1 + 1e-9) >= F.col("least")
    rest = asked.join(blocks, "dim").select(
        ROW, "vec_id", "v", "norm", "dim", "q_part", "least",
        F.explode(F.filter("blocks", reach)).alias("b")).select(
            "*", F.col("b.bucket").alias("bucket"), F.col("b.part").alias("part")).drop("b")
    more = _search(rest, dealt(cells), k)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(
        F.col("place").desc(), "vec_id", "row"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return found.unionByName(more).withColumn("rank", nth).where(F.col("rank") <= k).select(
        known("query_id"), F.col("rank").cast("int").alias("rank"), known("vec_id"), "score")
