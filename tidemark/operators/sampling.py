"""Reproducible samples and processing orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.defaults import STAGES
from tidemark.functions.evidence import bind
from tidemark.functions.hashing import PROCESSING_SALT, order_hash
from tidemark.functions.months import key_of_index, month_index
from tidemark.operators.lineage import cut
from tidemark.operators.topk import rank_in_slices, slice_counts, top_per_group


def month_quotas(counts: DataFrame, size: str = "sample_size") -> DataFrame:
    """Quota per product and month, proportional and rounded up.

    ``counts`` has ``product_id, month_idx, n`` and the size column (null or zero
    means everything). Adds ``total`` and ``quota``; a quota never exceeds ``n``.
    """
    total = F.sum("n").over(Window.partitionBy("product_id"))
    wanted = F.coalesce(F.col(size), F.lit(0))
    whole = (wanted == 0) | (wanted >= F.col("total"))
    # ceil(size * n / total) on integers
    scaled = F.expr(f"(cast({size} as bigint) * n + total - 1) div total")
    return counts.withColumn("total", total).withColumn(
        "quota", F.when(whole, F.col("n")).otherwise(F.least(F.col("n"), scaled))
    )


def month_sample(
    reviews: DataFrame, sizes: DataFrame, salt: str = PROCESSING_SALT
) -> DataFrame:
    """The sample of each product: the first ``quota`` reviews by hash in each month.

    ``sizes`` has ``product_id, sample_size``; a product without a size takes part
    with every review. Adds ``month_idx, order_hash, n,
    quota, rank`` and ``position``, the review's place in an order whose every
    prefix fills the months in proportion.
    """
    hashed = reviews.filter("eligible").select(
        "product_id", "review_id", month_index(F.col("reviewed_at")).alias("month_idx")
    ).withColumn("order_hash", order_hash(salt, F.col("review_id")))
    group = ["product_id", "month_idx"]
    # one scan counts the slices of every month; quotas and the slices that can reach them follow from that
    slices = cut(slice_counts(hashed, group, "order_hash"))
    counts = slices.groupBy(*group).agg(F.sum("_n").alias("n"))
    quotas = month_quotas(counts.join(sizes, "product_id", "left"))
    reached = cut(slices.join(quotas, group).filter(F.col("_before") < F.col("quota")))
    return rank_in_slices(hashed, reached, group, "order_hash", "review_id", "quota").withColumn(
        "position", (F.col("rank") - 0.5) / F.col("quota"))


def processing_order(sample: DataFrame) -> list[F.Column]:
    """Sort columns of the balanced processing order inside a product."""
    return [F.col("position"), F.col("month_idx"), F.col("review_id")]


def round_robin_order(sample: DataFrame) -> list[F.Column]:
    """Sort columns that take one review of each month in turn."""
    return [F.col("rank"), F.col("month_idx")]


def product_month_order(
    reviews: DataFrame, months: Sequence[str], salt: str = PROCESSING_SALT
) -> DataFrame:
    """Every review of the chosen months with its rank in the month's hash order.

    Sorting by :func:`round_robin_order` gives the order of work.
    """
    chosen = reviews.filter("eligible").withColumn(
        "month_idx", month_index(F.col("reviewed_at"))
    )
    if months:
        chosen = chosen.filter(key_of_index(F.col("month_idx")).isin(*sorted(set(months))))
    hashed = chosen.select("product_id", "review_id", "month_idx").withColumn(
        "order_hash", order_hash(salt, F.col("review_id"))
    )
    group = ["product_id", "month_idx"]
    whole = Window.partitionBy(*group)
    slices = cut(slice_counts(hashed, group, "order_hash").withColumn("n", F.sum("_n").over(whole)))
    return rank_in_slices(hashed, slices, group, "order_hash", "review_id")


def with_stage(ordered: DataFrame, rank: str, size: str, stages: Sequence[int] = STAGES) -> DataFrame:
    """First stage (20, 30, ... then everything) that reaches each review.

    A numbered stage takes ``min(stage, size)`` reviews of a product. The last
    stage, which takes whatever rounding added, is ``len(stages) + 1``.
    """
    stage = F.when(F.lit(False), F.lit(0))
    for number, prefix in enumerate(stages, start=1):
        reach = F.least(F.lit(prefix).cast("bigint"), F.col(size).cast("bigint"))
        stage = stage.when(F.col(rank) <= reach, F.lit(number))
    return ordered.withColumn("stage", stage.otherwise(F.lit(len(stages) + 1)))


def staged_sample(sample: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sample members with their processing rank and stage.

    A product's sample is bounded by its size plus one review a month, so ranking
    it in one place is bounded too. Products without a size are not staged.
    """
    sized = sample.join(sizes.filter(F.col("sample_size") > 0), "product_id")
    window = Window.partitionBy("product_id").orderBy(*processing_order(sample))
    ranked = sized.withColumn("process_rank", F.row_number().over(window))
    return with_stage(ranked, "process_rank", "sample_size")


def official_order(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Eligible reviews sorted by category, product, time and id."""
    return (
        reviews.filter("eligible")
        .join(products.select("product_id", "category"), "product_id")
        .orderBy("category", "product_id", "reviewed_at", "review_id")
    )


RATINGS = (1, 2, 3, 4, 5)
SPARE_ROWS = 20  # rows of a group beyond three a turn that are expected below its hash bound


def _greedy_picks(candidates: Column, per_product: int, product: Column, picks_type: str) -> Column:
    """``array<struct<turn, review_id, rating, month_idx>>``: one pick a turn, from the turn's candidates.

    ``candidates`` is an array of ``turn, turn_hash, review_id, rating, month_idx``. The picks made so far are the state.
    """
    def best_of(turn: Column, picks: Column) -> Column:
        def is_free(c: Column) -> Column:
            return (c["turn"] == turn) & ~F.exists(picks, lambda p: p["review_id"] == c["review_id"])

        def load(c: Column) -> Column:
            return F.size(F.filter(picks, lambda p: p["month_idx"] == c["month_idx"]))

        # another rating only if none of the wanted one is left; the least of the rest wins
        ranked = F.transform(F.filter(candidates, is_free), lambda c: F.struct(
            (c["rating"] != F.pmod(turn, F.lit(len(RATINGS))) + RATINGS[0]).alias("other"), load(c).alias("load"),
            c["turn_hash"].alias("turn_hash"), c["review_id"].alias("review_id"),
            c["rating"].alias("rating"), c["month_idx"].alias("month_idx"),
        ))
        return F.array_min(ranked)

    def add(picks: Column, turn: Column) -> Column:
        def put(best: Column) -> Column:
            short = F.raise_error(F.concat(
                product.cast("string"), F.lit(f": fewer than {per_product} reviews to choose from")))
            pick = F.struct(
                turn.alias("turn"), best["review_id"].alias("review_id"), best["rating"].alias("rating"),
                best["month_idx"].alias("month_idx"),
            )
            return F.when(best.isNull(), short.cast(picks_type)).otherwise(F.concat(picks, F.array(pick)))

        return bind(best_of(turn, picks), put)

    return F.aggregate(F.sequence(F.lit(0), F.lit(per_product - 1)), F.array().cast(picks_type), add)


def _first_by_hash(pool: DataFrame, group: list[str], turns: int, seed: str) -> DataFrame:
    """The first ``turn + 1`` rows of each group by hash, for every turn, with ``turn, turn_hash, rank``.

    A bound on the hash that some three times as many rows are expected to pass keeps nearly all of a large group out of
    the sort. Where fewer rows than a turn needs passed, all rows of the group are sorted, so the cut is exact.
    """
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")) for c in group]
    own = [F.col(f"p.{c}").alias(c) for c in pool.columns]
    sizes = cut(pool.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))

    def first(rows: DataFrame, *kept: str) -> DataFrame:
        salted = F.concat_ws(":", F.lit(seed), F.col("product_id").cast("string"), F.col("turn"))
        hashed = rows.withColumn("turn_hash", order_hash(salted, F.col("review_id")))
        if kept:
            hashed = hashed.filter(F.col("_all") | (F.col("turn_hash") < F.col("_bound")))
        ranked = top_per_group(hashed, [*group, "turn"], [F.col("turn_hash"), F.col("review_id")], turns)
        return ranked.filter(F.col("rank") <= F.col("turn") + 1).select(*pool.columns, *kept, "turn", "turn_hash", "rank")

    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    wanted = (3 * turns + SPARE_ROWS) / F.col("_n")
    bound = F.lower(F.lpad(F.hex((F.least(wanted, F.lit(1.0)) * (2**32 - 1)).cast("bigint")), 8, "0"))
    bounded = sizes.select("*", (wanted >= 1).alias("_all"), bound.alias("_bound"))
    found = cut(first(pool.alias("p").join(bounded.alias("g"), same).select(
        *own, "_n", "_all", "_bound", turn), "_n", "_all", "_bound"))
    # turns of groups that may lack rows: none passed, or fewer than the group has and the turn needs
    passed = found.groupBy(*group, "turn").agg(F.count(F.lit(1)).alias("_passed")).alias("f")
    due = sizes.select("*", turn).alias("g")
    met = [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*group, "turn"]]
    short = cut(due.join(passed, met, "left").filter(
        F.coalesce("_passed", F.lit(0)) < F.least(F.col("_n"), F.col("g.turn") + 1)).select("g.*"))
    if short.isEmpty():
        return found.drop("_n", "_all", "_bound")
    gone = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*group, "turn"]]
    whole = first(pool.alias("p").join(short.alias("g"), same).select(*own, "g.turn"))
    return found.drop("_n", "_all", "_bound").alias("f").join(short.alias("s"), gone, "left_anti").unionByName(whole)


def stratified_sample(
    reviews: DataFrame,
    per_product: int,
    seed: str,
    exclude: DataFrame | None = None,
    products: DataFrame | None = None,
) -> DataFrame:
    """A fixed number of reviews per product, spread over ratings and months.

    ``exclude`` holds reviews that may not be picked again, ``products`` the products
    to sample (all without it).

    Turn ``i`` wants rating ``1 + i mod 5``, or any rating when none is left, from
    the least used month, first by a hash of (seed, product, turn, review). Each
    turn depends on the earlier ones, so the turns of a product are folded over in one row, but
    only over the reviews that can win: before turn ``i`` at most ``i`` reviews are
    gone, hence the winner is among the first ``i + 1`` by hash of its rating and
    month. That cut is exact and is made before a product's candidates are gathered: no
    more than its ratings and months times half the turns squared.
    """
    pool = reviews.filter("eligible").select(
        "product_id", "review_id", "rating", month_index(F.col("reviewed_at")).alias("month_idx")
    )
    if products is not None:
        pool = pool.join(products.select("product_id"), "product_id", "left_semi")
    if exclude is not None:
        pool = pool.join(exclude.select("review_id"), "review_id", "left_anti")
    pool = cut(pool)
    cells = _first_by_hash(pool, ["product_id", "rating", "month_idx"], per_product, seed)
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    picks_type = f"array<struct<turn: int, review_id: {kinds['review_id']}, rating: int, month_idx: int>>"
    offers = cells.groupBy("product_id").agg(F.collect_list(F.struct(
        "turn", "turn_hash", "review_id", F.col("rating").cast("int").alias("rating"), "month_idx")).alias("offers"))
    picks = _greedy_picks(F.col("offers"), per_product, F.col("product_id"), picks_type)
    return offers.select("product_id", F.inline(picks)).select(
        "product_id", "review_id", "rating", "month_idx", "turn")


def sample_summary(sample: DataFrame) -> DataFrame:
    """Sample size by category, product, rating and month, and in total."""
    dims = ["category", "product_id", "rating", "month"]
    sets = [[F.col(d)] for d in dims] + [[]]
    counted = sample.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id(*dims).alias("gid"), F.count(F.lit(1)).alias("n")
    )
    # grouping_id has one bit per column, set when the column is aggregated away
    everything = 2 ** len(dims) - 1
    kind = F.when(F.col("gid") == everything, "total")
    value = F.when(F.col("gid") == everything, "all")
    for place, d in enumerate(dims):
        only = everything - 2 ** (len(dims) - 1 - place)
        kind = kind.when(F.col("gid") == only, d)
        value = value.when(F.col("gid") == only, F.col(d).cast("string"))
    return counted.select(kind.alias("dimension"), value.alias("value"), "n")


def overlap(a: DataFrame, b: DataFrame, key: str = "review_id") -> DataFrame:
    """How many keys two samples share; independent samples share none."""
    return (
        a.select(key).distinct().join(b.select(key), key, "left_semi")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )
