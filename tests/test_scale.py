"""Steps whose disk, time or memory grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import graph, linkpred, ordering, sampling
from quillgraph.operators.skew import groups_of_size
from quillgraph.sinks import writers


def test_negatives_beyond_the_wanted_are_not_written(spark, monkeypatch):
    edges = spark.range(600).select(F.col("id").alias("src"), (F.col("id") + 1 + F.col("id") % 7).alias("dst"))
    written, plain = [], sampling.materialize

    def noted(df, label):
        out = plain(df, label)
        written.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(sampling, "materialize", noted)
    monkeypatch.setattr(ordering, "materialize", noted)
    few = sampling.hard_negatives(edges, edges, 5_000).collect()
    assert max(n for n, _ in written) < 1.3 * 600  # three pairs are drawn for each edge
    assert not any("_h" in columns for _, columns in written)
    monkeypatch.setattr(sampling, "_SPARE", 100)  # the whole round
    assert sorted(few) == sorted(sampling.hard_negatives(edges, edges, 5_000).collect())
    assert sorted(r.ix for r in few) == list(range(600))


def test_pairs_are_counted_in_as_many_parts_as_asked_for(spark, rows):
    edges = spark.range(3_000).select((F.col("id") % 50).alias("src"), (F.col("id") % 70).alias("dst"))
    many = graph.undirected_edges(edges, parts=37)
    assert many.rdd.getNumPartitions() == 37
    assert rows(many) == rows(graph.undirected_edges(edges))
    assert rows(graph.symmetric_edges(edges, parts=37)) == rows(graph.symmetric_edges(edges))


def test_cut_groups_are_handed_on_in_as_many_parts_as_asked_for(spark, rows):
    df = spark.range(5_000).select(F.when(F.col("id") < 2_000, 0).otherwise(F.col("id") % 900).alias("work"),
                                   F.col("id").alias("author"))
    many = groups_of_size(df, "work", ["author"], 2, 5, parts=23)
    assert many.rdd.getNumPartitions() == 23 and rows(many) == rows(groups_of_size(df, "work", ["author"], 2, 5))
    text = many._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "HashAggregate" not in text


def test_equal_rows_are_dropped_without_hash_tables(spark, rows):
    df = spark.createDataFrame([(w, a, 4) for w in range(6) for a in ("x", "y", "x", None, None)],
                               "work int, author string, team_size int")
    edges = graph.bipartite_edges(df, dedup=True)
    assert rows(edges) == sorted([(a, w) for w in range(6) for a in ("x", "y", None)], key=repr)
    assert "HashAggregate" not in edges._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_neighbours_move_no_digests(spark, rows):
    edges = graph.symmetric_edges(spark.range(4_000).select(
        (F.col("id") % 90).alias("src"), (F.col("id") * 7 % 110).alias("dst")))
    seeds = spark.range(60).withColumnRenamed("id", "node")
    one = sampling.neighbor_sample(edges, seeds, (4,), parts=11)
    assert rows(one) == rows(sampling.neighbor_sample(edges, seeds, (4,)))
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and text.index("Window") < text.index("REPARTITION_BY_NUM")
    assert one.rdd.getNumPartitions() == 11
    both = [rows(sampling.neighbor_sample(edges, seeds, (3, 2), parts=p)) for p in (None, 5)]
    assert both[0] == both[1]


def test_training_rows_are_one_row_a_part(spark):
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(i, v.tolist(), [1.0, 2.0], i % 2) for i, v in enumerate(rng.normal(size=(500, 2)))],
                                  "id long, a array<double>, b array<double>, label int")
    packed = linkpred.newton_rows(pairs, ["id"], 100)
    assert packed.count() <= 5  # rounds shuffle a matrix for each of these, no training rows
    sizes = [len(r.label) // 8 for r in packed.collect()]
    assert sum(sizes) == 500 and all(len(r.x) == 2 * len(r.label) for r in packed.collect())


def test_rows_of_one_file_are_dealt_out(spark):
    df = spark.range(100_000).coalesce(1).withColumn("x", F.col("id") * 2)
    dealt = writers.dealt_out(df, 8)
    parts = dealt.rdd.glom().map(lambda part: [r.id for r in part]).collect()
    assert len(parts) == 8 and sorted(i for p in parts for i in p) == list(range(100_000))
    assert all(p == sorted(p) for p in parts) and max(map(len, parts)) < 2 * 100_000 / 8
    assert dealt.columns == df.columns


def test_negatives_are_drawn_in_parts_by_their_number(spark, monkeypatch):
    edges = spark.range(600).select(F.col("id").alias("src"), (F.col("id") + 1 + F.col("id") % 7).alias("dst"))
    seen, plain = [], sampling.random_negatives
    monkeypatch.setattr(sampling, "random_negatives", lambda positives, *a, **k: seen.append(
        positives.rdd.getNumPartitions()) or plain(positives, *a, **k))
    want = sorted(sampling.hard_negatives(edges, edges, 5_000).collect())
    one = edges.coalesce(1)
    assert sorted(sampling.hard_negatives(one, one, 5_000).collect()) == want
    assert min(seen) >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sampling, "parts_of", lambda rows, df: 37)
    assert sorted(sampling.hard_negatives(one, one, 5_000).collect()) == want and seen[-1] == 37
