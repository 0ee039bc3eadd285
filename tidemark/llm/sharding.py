"""Shards along a Hilbert curve, in DataFrame functions only.

Size, language and source are quantised to 16 steps each, and a row's place on the
three-dimensional Hilbert curve is computed from the steps. Rows in curve order are cut into
runs whose counts differ by at most one; neighbours on the curve are close in every dimension,
so the minimum and maximum of each column prune whole shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.llm.rows import ROW, numbered

BITS = 4


def byte_size(text: Column) -> Column:
    """Stored size: UTF-8 bytes of the text and 8 for the key; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def steps_of_size(size: Column) -> Column:
    """Size on a logarithmic scale from 8 bytes to 256 KiB in 16 steps."""
    return F.greatest(F.lit(0), F.least(F.lit(2**BITS - 1), F.floor(F.log2(size) - 3))).cast("int")


def steps_of_name(name: Column) -> Column:
    """A category in one of 16 steps."""
    return F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(2**BITS)).cast("int")


def with_curve_index(df: DataFrame, x: str, y: str, z: str, name: str) -> DataFrame:
    """Add the place of (x, y, z) on the Hilbert curve of ``2**BITS`` steps a side.

    From the top bit down, each axis with a set bit flips the lower bits of the first axis, one
    with a clear bit swaps them with the first; the bits are then Gray-decoded and interleaved.
    Each round is a projection of its own, so that the expressions stay small.
    """
    kept = [F.col(c) for c in df.columns]
    axes = ("_h0", "_h1", "_h2")
    df = df.select(*kept, *[F.col(c).alias(a) for c, a in zip((x, y, z), axes)])
    first = F.col("_h0")
    for bit in range(BITS - 1, 0, -1):
        low, high = (1 << bit) - 1, 1 << bit
        for a in axes:
            axis = F.col(a)
            is_set = axis.bitwiseAND(F.lit(high)) != 0
            if a == "_h0":
                changed = {a: F.when(is_set, axis.bitwiseXOR(F.lit(low))).otherwise(axis)}
            else:
                swap = first.bitwiseXOR(axis).bitwiseAND(F.lit(low))
                changed = {
                    "_h0": F.when(is_set, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap)),
                    a: F.when(is_set, axis).otherwise(axis.bitwiseXOR(swap)),
                }
            df = df.select(*kept, *[changed.get(c, F.col(c)).alias(c) for c in axes])
    df = df.select(*kept, F.col("_h0"), F.col("_h1").bitwiseXOR(F.col("_h0")).alias("_h1"), "_h2")
    df = df.select(*kept, "_h0", "_h1", F.col("_h2").bitwiseXOR(F.col("_h1")).alias("_h2"))
    turn = F.lit(0)
    for bit in range(BITS - 1, 0, -1):
        turn = turn.bitwiseXOR(
            F.when(F.col("_h2").bitwiseAND(F.lit(1 << bit)) != 0, (1 << bit) - 1).otherwise(0))
    df = df.select(*kept, *axes, turn.alias("_turn"))
    index = F.lit(0)
    for bit in range(BITS - 1, -1, -1):
        for a in axes:
            one = F.shiftright(F.col(a).bitwiseXOR(F.col("_turn")), bit).bitwiseAND(F.lit(1))
            index = index * 2 + one
    return df.select(*kept, index.cast("int").alias(name))


def hilbert_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
                   lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, curve, shard, slot``.

    Ranks are exact without sorting everything in one place: rows are counted per curve cell
    (at most 4,096) and per 256 slices of a cell, 8 by the text's checksum times 32 by the key; a
    row's rank is the rows of earlier cells, of earlier slices and its number within its slice.
    Slices split a cell with very many rows. Equal texts of one language and source lie in
    neighbouring slices, and a very large group of them spreads over 32.

    Null texts count as empty, null categories as the empty name. Repeated rows and null keys
    each get a slot. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    size = byte_size(F.col(text))
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        steps_of_size(size).alias("_x"), steps_of_name(F.col(lang)).alias("_y"),
        steps_of_name(F.col(source)).alias("_z"))
    rows = numbered(with_curve_index(rows, "_x", "_y", "_z", "curve"),
                    "doc_id", "size", "text_crc32", "curve")
    # slices follow the text first and then the key: copies lie together, in 32 slices
    order = F.pmod(F.col("text_crc32"), F.lit(8)) * 32 + F.pmod(F.hash("doc_id"), F.lit(32))
    placed = rows.withColumn("_slice", order.cast("int"))
    counts = cut(placed.groupBy("curve", "_slice").agg(F.count("*").alias("_n")))
    cells = counts.groupBy("curve").agg(F.sum("_n").alias("_cell"))
    before_cell = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "curve", F.coalesce(F.sum("_cell").over(before_cell), F.lit(0)).alias("_before"),
        F.sum("_cell").over(Window.partitionBy()).alias("_total"))
    within = Window.partitionBy("curve").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.join(cells, "curve").select(
        "curve", "_slice", "_total",
        (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start")))
    nth = F.row_number().over(
        Window.partitionBy("curve", "_slice").orderBy("text_crc32", "doc_id", ROW))
    ranked = placed.join(starts, ["curve", "_slice"]).withColumn("_rank", F.col("_start") + nth - 1)
    shard = F.expr(f"_rank * {int(shards)} div _total")
    # the first rank of shard s is the least r with r * shards div total = s
    begin = F.expr(f"(_shard * _total + {int(shards) - 1}) div {int(shards)}")
    return ranked.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - begin).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write ``docs`` with unique keys as one folder a shard, rows in slot order."""
    joined = docs.join(placed.select(F.col("doc_id").alias(doc_id), "curve", "shard", "slot"), doc_id)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
