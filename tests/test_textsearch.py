"""Many searches through the index of letter groups against the pattern on every pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import textsearch

def fields():
    return {"title": F.col("title"), "other": F.col("other")}


def test_searches_against_every_pair(spark):
    rng = random.Random(4)
    letters = "aAbBcé%_ 😀"
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))),
              rng.choice([None, "", "Straße", "İstanbul", "x" * 200 + "needle"])) for k in range(120)]
    queries = ["a", "ab", "a%b", "_", "%", "", "  ", None, "a_c", "NEEDLE", "xxx%need", "\\%", "\\_a", "é", "😀", "none such",
               " straße ", "istanbul", "%%", "a b"]
    queries += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    queries = [q for q in queries if q is None or not q.rstrip().endswith("\\")]
    things = spark.createDataFrame(items, "id long, title string, other string")
    searches = spark.createDataFrame(list(enumerate(queries)), "search_id int, query string")
    got = sorted(tuple(r) for r in textsearch.search_many(things, "id", fields(), searches).collect())
    asked = searches.withColumn("q", F.concat(F.lit("%"), F.trim("query"), F.lit("%"))).where("trim(query) <> ''")
    want = things.join(asked, F.expr("title ILIKE q OR coalesce(other ILIKE q, false)"))
    assert got == sorted((r.search_id, r.id) for r in want.select("search_id", "id").collect())
    assert len({s for s, _ in got}) > 20
    assert textsearch.search_many(things.limit(0), "id", fields(), searches).count() == 0
    assert textsearch.search_many(things, "id", fields(), searches.limit(0)).count() == 0


def test_no_nested_loop(spark):
    things = spark.range(10).select("id", F.lit("some title").alias("title"), F.lit(None).cast("string").alias("other"))
    searches = spark.createDataFrame([(1, "title")], "search_id int, query string")
    found = textsearch.search_many(things, "id", fields(), searches)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 10


def test_equal_searches_are_looked_for_once(spark, monkeypatch):
    """A thousand searches with one query verify each item once, and lose none in the slices they are dealt over."""
    monkeypatch.setattr(textsearch, "SLICE", 7)
    things = spark.range(40).select("id", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("other"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    watched = {"title": F.col("title"), "other": F.col("other")}
    index = textsearch.gram_index(things, "id", watched).localCheckpoint()
    searches = spark.range(1000).select(F.col("id").alias("search_id"), F.lit(" ITLE 1").alias("query"))
    found = textsearch.search_many(things, "id", {"title": counted(F.col("title")), "other": F.col("other")}, searches.union(searches), index)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 1000 * 11
    assert seen.value <= 80


def test_neither_index_nor_items_are_broadcast(spark, tmp_path):
    """A small file makes a large index, which the planner takes to be as small as the file."""
    spark.range(500).select("id", F.concat(F.lit("some long title "), F.col("id").cast("string")).alias("title"),
                            F.lit(None).cast("string").alias("other")).write.parquet(f"{tmp_path}/things")
    spark.range(300).select(F.col("id").alias("search_id"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("query")
                            ).write.parquet(f"{tmp_path}/searches")
    found = textsearch.search_many(
        spark.read.parquet(f"{tmp_path}/things"), "id", fields(), spark.read.parquet(f"{tmp_path}/searches"))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            under = []
            for x in lines[at + 1:]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                under.append(x)
            # the groups' counts may be, one row a group that is looked for
            assert "things" not in "".join(under) or "Aggregate" in under[0], line
    assert found.count() == sum(str(k).startswith(str(s)) for s in range(300) for k in range(500))
