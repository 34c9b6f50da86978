"""Samples, splits and negatives."""

from collections import Counter

from pyspark.sql import functions as F

from quillgraph.operators import sampling as M


def test_sample_rows_and_groups(spark, rows):
    df = spark.range(1000).select("id", (F.col("id") % 40).alias("g"))
    a, b = rows(M.sample_rows(df, 50, ["id"])), rows(M.sample_rows(df.repartition(7), 50, ["id"]))
    assert a == b and len(set(a)) == 50
    groups = Counter(r[0] for r in rows(M.sample_groups(df, 5, "g"), "g"))
    assert len(groups) == 5 and set(groups.values()) == {25}
    other = rows(M.sample_rows(df, 50, ["id"], salt="other"))
    assert other != a


def test_bernoulli_and_shuffle(spark):
    df = spark.range(10000)
    assert 350 < M.bernoulli(df, 0.05, ["id"]).count() < 650
    order = [r.id for r in M.shuffled(df.limit(100), ["id"]).collect()]
    assert sorted(order) != order and len(order) == 100


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(20000)
    got = Counter(r["split"] for r in M.split(df, {"a": 0.8, "b": 0.1, "c": 0.1}, ["id"]).collect())
    assert sum(got.values()) == 20000 and 15500 < got["a"] < 16500 and 1700 < got["c"] < 2300


def test_both_directions_fall_in_one_part(spark):
    e = spark.range(500).select(F.col("id").alias("src"), (F.col("id") * 7 % 501).alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts = (M.split_edges(both).groupBy(F.least("src", "dst"), F.greatest("src", "dst"))
             .agg(F.count_distinct("split").alias("n")))
    assert parts.filter("n > 1").count() == 0


def test_negatives(spark, rows):
    edges = spark.range(60).select((F.col("id") % 20).alias("src"),
                                   (F.col("id") % 20 + 1 + F.col("id") % 3).alias("dst")).distinct()
    n = edges.count()
    drawn = M.random_negatives(edges, 24, 4)
    assert drawn.count() == 4 * n
    assert drawn.filter("src < 0 OR src >= 24 OR dst < 0 OR dst >= 24").count() == 0
    kept = M.corrupt_targets(edges, F.lit(24), 2)
    assert set(rows(kept, "src")) == set(rows(edges, "src")) and kept.count() == 2 * n
    hard = rows(M.hard_negatives(edges, edges, 24), "src", "dst")
    assert len(hard) == n and len(set(hard)) == len(hard)
    assert not set(hard) & set(rows(edges, "src", "dst")) and all(a < b for a, b in hard)
    both = M.labelled(edges, spark.createDataFrame(hard, "src bigint, dst bigint"))
    assert Counter(r.label for r in both.collect()) == {1: n, 0: len(hard)}


def test_neighbor_sample_cuts_hubs(spark, rows):
    hub = [(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 200)]
    edges = spark.createDataFrame(hub, "src int, dst int").repartition(4)
    seeds = spark.createDataFrame([(0,)], "node int")
    sampled = M.neighbor_sample(edges, seeds, (10, 3))
    got = rows(sampled)
    first = {d for h, _, d in got if h == 1}
    assert len(first) == 10 and {(s, d) for h, s, d in got if h == 2} == {(f, 0) for f in first}
    assert "WindowGroupLimit" in sampled._jdf.queryExecution().toString()
