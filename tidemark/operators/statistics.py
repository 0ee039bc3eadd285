"""One-sided Fisher test, Benjamini-Hochberg correction, nearest-rank percentiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import defaults as D
from tidemark.operators.lineage import cut
from tidemark.operators.topk import cumulative_counts


def _stirling_rest(n: int) -> float:
    """``ln n!`` less its leading terms ``(n + 1/2) ln n - n + ln sqrt(2 pi)``."""
    if n == 0:
        return -0.5 * math.log(2 * math.pi)
    return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)


# below 16 the series is not exact enough
_SMALL = ", ".join(f"{_stirling_rest(i)!r}D" for i in range(16))


def _rest(n: str) -> str:
    """SQL text of the part of ``ln n!`` that Stirling's leading terms leave."""
    n = f"({n})"
    return (
        f"CASE WHEN {n} < 16 THEN get(array({_SMALL}), cast({n} AS int)) "
        f"ELSE 1 / (12 * {n}) - 1 / (360 * power({n}, 3)) + 1 / (1260 * power({n}, 5)) END"
    )


def _half_log(n: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN 0.5D * ln({n}) ELSE 0D END"


def _surprise(cell: str, row: str, column: str) -> str:
    """``x ln(x / expected)`` of one cell of the two-by-two table."""
    return (
        f"CASE WHEN ({cell}) > 0 THEN ({cell}) * ln(({cell}) * _size / (({row}) * ({column}))) "
        "ELSE 0D END"
    )


def _log_hypergeometric(k: str) -> str:
    """SQL text of ``ln P(k hits in the target)`` from columns of :func:`with_fisher_p`.

    Written with each cell against its expectation, so that the large logarithms of
    the factorials never appear and cannot cancel; no lookup table is needed either.
    """
    missed = "_size - _hits"
    cells = {
        k: ("_hits", "_tt"), f"_hits - {k}": ("_hits", "_bt"),
        f"_tt - {k}": (missed, "_tt"), f"{missed} - _tt + {k}": (missed, "_bt"),
    }
    margins = ["_hits", missed, "_tt", "_bt"]
    parts = [f"- {0.5 * math.log(2 * math.pi)!r}D"]
    for m in margins:
        parts.append(f"+ {_half_log(m)} + {_rest(m)}")
    for x in ["_size", *cells]:
        parts.append(f"- {_half_log(x)} - {_rest(x)}")
    for x, (row, column) in cells.items():
        parts.append(f"- {_surprise(x, row, column)}")
    return " ".join(parts)


FISHER_COUNTS = ["baseline_count", "baseline_total", "target_count", "target_total"]


def with_fisher_p(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """P(at least the target count in the target period) under equal rates.

    The one-sided Fisher exact test: the upper hypergeometric tail. Terms follow
    from each other by a ratio, so the first is evaluated with logarithms and the
    others by multiplication. Terms more than ten deviations (and forty steps) from
    both the mode and the observed count sum to less than 2^-53 of the result (a
    hypergeometric tail of ten deviations is below e^-50, and past the observed count
    terms fall at least that fast), so they cannot change a double and are not
    visited, which keeps the work near the square root of the counts. The
    intermediate columns are projected in stages so that none is evaluated twice.
    """
    b, bt, t, tt = FISHER_COUNTS
    numbers = tests.selectExpr(
        "*", f"cast({t} AS double) AS _t", f"cast({tt} AS double) AS _tt",
        f"cast({bt} AS double) AS _bt", f"cast({b} + {t} AS double) AS _hits",
        f"cast({bt} + {tt} AS double) AS _size",
    )
    reach = numbers.selectExpr(
        "*", "cast(floor((_tt + 1) * (_hits + 1) / (_size + 2)) AS double) AS _mode",
        "ceil(10 * sqrt(coalesce(try_divide(_hits * _tt * (_size - _hits), _size * _size), 0D)))"
        " + 40D AS _reach",
    )
    bounds = reach.selectExpr(
        "*", "greatest(_t, _mode - _reach) AS _first",
        "least(greatest(_t, _mode) + _reach, _hits, _tt) AS _last",
    )
    log_first = _log_hypergeometric("_first")
    terms = bounds.selectExpr(
        "*", f"CASE WHEN _tt > 0 AND _bt > 0 AND _hits > 0 THEN {log_first} END AS _log",
        """aggregate(
             CASE WHEN _last > _first THEN
               sequence(cast(_first AS bigint) + 1, cast(_last AS bigint)) END,
             struct(1D AS term, 1D AS sum),
             (acc, k) -> struct(
               acc.term * (_hits - k + 1) * (_tt - k + 1) / (k * (_size - _hits - _tt + k)) AS term,
               acc.sum + acc.term * (_hits - k + 1) * (_tt - k + 1)
                 / (k * (_size - _hits - _tt + k)) AS sum)).sum AS _scale""",
    )
    return terms.selectExpr(
        *tests.columns, f"coalesce(least(1D, exp(_log) * coalesce(_scale, 1D)), 1D) AS {p}"
    )


def bh_q_by_p(p_counts: DataFrame, p: str = "p_value", count: str = "n") -> DataFrame:
    """Benjamini-Hochberg q for each distinct p: ``p, q_value``.

    ``p_counts`` has one row per distinct p with its number of tests. Both the rank
    and the running minimum are kept per value range, with only range summaries
    combined across ranges.
    """
    ranked = cumulative_counts(p_counts, [], p, count)
    raw = ranked.withColumn("_raw", F.col(p) * F.col("total") / F.col("at_most"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("piece")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    later = (
        raw.groupBy("piece").agg(F.min("_raw").alias("_low"))
        .select("piece", F.coalesce(F.min("_low").over(after), F.lit(1.0)).alias("_later"))
    )
    inner = Window.partitionBy("piece").orderBy(F.desc(p))
    q = F.least(F.lit(1.0), F.min("_raw").over(inner), F.col("_later"))
    return raw.join(later, "piece").select(p, q.alias("q_value"))


def with_bh_q(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Add ``q_value`` to every test; all rows form one family.

    The counts per distinct p are stored, since ranks and minima read them several
    times. Tests with p = 1, often a large share, have q = 1 and take no part in a join.
    """
    p_counts = cut(tests.groupBy(p).agg(F.count(F.lit(1)).alias("n")))
    below = tests.where(F.col(p) < 1).join(bh_q_by_p(p_counts, p, "n"), p)
    ones = tests.where(F.col(p) >= 1).withColumn("q_value", F.lit(1.0))
    return below.unionByName(ones)


def anomaly_level(
    p_value: Column,
    q_value: Column,
    change: Column,
    target_count: Column,
    q_threshold: float = D.RADAR_Q,
    watch_p: float = D.RADAR_WATCH_P,
    min_increase_pp: float = D.RADAR_MIN_INCREASE_PP,
    min_target: int = D.RADAR_MIN_NEGATIVE,
) -> Column:
    """``anomaly``, ``watch`` or null."""
    change = F.coalesce(change, F.lit(0.0))
    return F.when(
        (q_value < q_threshold) & (change >= min_increase_pp) & (target_count >= min_target),
        "anomaly",
    ).when((p_value < watch_p) & (change > 0), "watch")


SKETCH = 4096  # items of a quantile sketch; with it a rank is off by a thousandth part
RANK_ERROR = 0.002  # half the width of a bracket, about twice that


def nearest_rank_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float],
    aggregates: Sequence[Column] = (),
) -> DataFrame:
    """Percentiles by nearest rank: the element at ``round_half_even((n - 1) * f)``, nulls left out.

    Also gives ``median``: the mean of the two middle elements. ``aggregates`` are further aggregates of all
    rows by key; with them a key without a value has its row, otherwise it has none.

    Two scans. The first makes a quantile sketch of each key, whose items bracket each wanted
    rank; the second counts what lies between the brackets, and value by value what lies inside, so only
    a few thousandths of the values are ever sorted. Whether each rank fell into its bracket is known from the
    counts; a key where one did not, which is rare, is counted value by value in a third.
    """
    keys, v = list(keys), F.col(value)
    whole = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    kind, sql_type = ("bigint", "bigint") if whole else ("double", "double")
    ranks = {name: f for name, f in fractions.items()}

    number = v.cast(sql_type)
    sketched = cut(df.groupBy(*keys).agg(
        F.count(v).alias("_total"),
        F.call_function(f"kll_sketch_agg_{kind}", number, F.lit(SKETCH)).alias("_sketch"),
        F.min(number).alias("_least"), F.max(number).alias("_most"), *aggregates))
    last = F.col("_total") - 1
    wanted = {name: F.bround(last * F.lit(f)).cast("bigint") for name, f in ranks.items()}
    wanted |= {"_lower": F.floor(last / 2), "_upper": F.floor(F.col("_total") / 2)}

    def bracket(share: float) -> Column:
        def at(inner: float) -> Column:
            return F.call_function(f"kll_sketch_get_quantile_{kind}", F.col("_sketch"), F.lit(inner))

        # few values are all inside, and the ends stand for everything beyond them
        few = F.col("_total") <= SKETCH
        low = at(share - RANK_ERROR) if share > RANK_ERROR else F.col("_least")
        high = at(share + RANK_ERROR) if share < 1 - RANK_ERROR else F.col("_most")
        return F.struct(F.when(few, F.col("_least")).otherwise(low).alias("low"),
                        F.when(few, F.col("_most")).otherwise(high).alias("high"))

    shares = sorted({*ranks.values(), 0.5})
    filled = sketched.where("_total > 0")
    brackets = cut(filled.select(*keys, F.array(*map(bracket, shares)).alias("_brackets")))
    picked = _picks(df, keys, number, filled, brackets, wanted)
    lost = cut(picked.where(" OR ".join(f"`{name}` IS NULL" for name in wanted)).select(*keys))
    if not lost.isEmpty():
        wide = filled.join(lost, keys, "left_semi").select(
            *keys, F.array(F.struct(F.col("_least").alias("low"), F.col("_most").alias("high"))).alias("_brackets"))
        again = _picks(df.join(lost, keys, "left_semi"), keys, number, filled, wide, wanted)
        picked = picked.join(lost, keys, "left_anti").unionByName(again)
    picked = picked.select(
        *keys, *[F.col(name).cast(df.schema[value].dataType).alias(name) for name in ranks],
        ((F.col("_lower") + F.col("_upper")) / 2).alias("median"))
    if not aggregates:
        return picked
    told = [c for c in sketched.columns if c not in (*keys, "_total", "_sketch", "_least", "_most")]
    return sketched.select(*keys, *told).join(picked, keys, "left")


def _picks(
    df: DataFrame, keys: list[str], number: Column, totals: DataFrame, brackets: DataFrame, wanted: Mapping[str, Column]
) -> DataFrame:
    """The element at each wanted rank; null where the rank lies outside all brackets."""
    inside = F.exists("_brackets", lambda b: number.between(b["low"], b["high"]))
    above = F.filter("_brackets", lambda b: b["low"] > number)
    # values between two brackets go by the lower end of the upper one, ahead of it; above all of them by none
    anchor = F.when(inside, number).otherwise(F.get(above, F.lit(0))["low"])
    counted = df.where(number.isNotNull()).join(brackets, keys).select(
        *keys, anchor.alias("_anchor"), inside.alias("_inside")
    ).where("_anchor IS NOT NULL").groupBy(*keys, "_anchor", "_inside").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_anchor", "_inside")
    ranked = counted.withColumn("_at_most", F.sum("_n").over(order)).join(totals.select(*keys, "_total"), keys)

    def at(rank: Column) -> Column:
        here = F.col("_inside") & (rank < F.col("_at_most")) & (rank >= F.col("_at_most") - F.col("_n"))
        return F.max(F.when(here, F.col("_anchor")))

    return ranked.groupBy(*keys).agg(*[at(rank).alias(name) for name, rank in wanted.items()])
