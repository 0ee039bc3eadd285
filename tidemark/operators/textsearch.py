"""Many free-text searches at once over an inverted index of letter groups.

The index has the groups of up to five letters of every text. A search is cut at its wildcards
into literal pieces; its rarest group names the only rows that can match, and those are verified with the
pattern itself. Rows and searches meet by an equality on the group, never all with all. Equal searches are
looked for once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.session import partitions

GRAM = 5
# searches with one query that meet the items it finds in one place
SLICE = 500


def _grams(small: Column, least: int) -> Column:
    """All groups of ``least`` to ``GRAM`` neighbouring letters, and the empty one."""
    length = F.char_length(small)

    def of_size(size: int) -> Column:
        places = F.sequence(F.lit(1), length - size + 1)
        return F.when(length >= size, F.transform(places, lambda i: F.substr(small, i, F.lit(size))))

    none = F.array().cast("array<string>")
    sizes = [F.coalesce(of_size(size), none) for size in range(least, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *sizes))


def gram_index(items: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """``key, field, gram``: the groups of letters of every text, small letters; null texts have none.

    To be stored when several searches use it. A small file makes a large index, so items are dealt over all tasks first.
    """
    texts = F.array(*[F.struct(F.lit(name).alias("field"), F.lower(text).alias("small")) for name, text in fields.items()])
    return (
        items.repartition(partitions(items.sparkSession), key).select(key, F.explode(texts).alias("t")).where("t.small IS NOT NULL")
        .select(key, F.col("t.field").alias("field"), F.explode(_grams(F.col("t.small"), 1)).alias("gram"))
    )


def search_grams(query: Column) -> Column:
    """The groups that every match of a query has: of each literal piece its groups of ``GRAM``, or all of a shorter piece.

    ``%`` and ``_`` are wildcards unless a backslash precedes them.
    """
    pieces = F.transform(
        F.regexp_extract_all(F.lower(query), F.lit(r"((?:[^%_\\]|\\[\s\S])+)"), F.lit(1)),
        lambda p: F.regexp_replace(p, r"\\([\s\S])", "$1"),
    )
    grams = F.flatten(F.transform(pieces, lambda p: F.when(
        F.char_length(p) < GRAM, F.array(p)).otherwise(F.filter(_grams(p, GRAM), lambda g: g != ""))))
    return F.when(F.size(grams) > 0, F.array_distinct(grams)).otherwise(F.array(F.lit("")))


def search_many(
    items: DataFrame,
    key: str,
    fields: Mapping[str, Column],
    searches: DataFrame,
    index: DataFrame | None = None,
) -> DataFrame:
    """``search_id, key`` of every item that a search finds in one of its fields, in any letter case.

    ``searches`` has ``search_id, query``, one query an id; queries are stripped, and a null or empty one finds nothing.
    A query without any literal letter finds every item with a text.
    """
    index = gram_index(items, key, fields) if index is None else index
    asked = searches.select("search_id", strip(F.col("query")).alias("query")).where("query <> ''").distinct()
    queries = asked.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    wanted = queries.select("query", "slices", F.explode(search_grams(F.col("query"))).alias("gram"))
    # a query goes by its rarest group; one that no text has leaves nothing to verify
    spread = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(spread, "gram", "left").groupBy("query", "slices").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    chosen = rarest.where("least.n > 0").select("query", "slices", F.col("least.gram").alias("gram"))
    # the planner takes the index to be as small as the items it is made of: neither may go to the driver to be broadcast
    met = index.hint("merge").join(chosen, "gram").select("query", "slices", key, "field")
    texts = F.element_at(F.create_map(*[x for name, text in fields.items() for x in (F.lit(name), text)]), F.col("field"))
    pattern = F.concat(F.lit("%"), F.col("query"), F.lit("%"))
    found = met.join(items.hint("merge"), key).where(F.call_function("ilike", texts, pattern)).select("query", "slices", key).distinct()
    # many searches with one query are dealt over slices, each of which meets all that it finds
    sliced = asked.join(queries, "query").select(
        "search_id", "query", F.pmod(F.xxhash64("search_id"), F.col("slices")).alias("slice"))
    dealt = found.select(
        "query", key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    # the pairs are many more than the rows that make them, so adaptive execution may not put these partitions together
    place = (partitions(items.sparkSession), "query", "slice")
    return dealt.repartition(*place).join(sliced.repartition(*place), ["query", "slice"]).select("search_id", key)
