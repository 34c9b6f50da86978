"""Vectors along edges, by blocks of nodes."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import blocks, linkpred, partners, skew


@pytest.fixture
def joins_of_tables(spark):
    """Nothing counts as small enough for a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def made(spark, key):
    rng = np.random.default_rng(7)
    name = (lambda i: f"n{i}") if key == "string" else int
    vectors = {name(i): rng.normal(size=3).round(3).tolist() for i in range(40)}
    edges = [(name(a), name(b)) for a, b in rng.integers(0, 45, (600, 2))]  # some ends have no vector
    edges += [(name(0), name(i)) for i in range(1, 40)] * 20 + [(None, name(1)), (name(1), None)]
    nodes = spark.createDataFrame(list(vectors.items()), f"node {key}, features array<double>")
    return vectors, edges, nodes, spark.createDataFrame(edges, f"src {key}, dst {key}").repartition(5)


@pytest.mark.parametrize("key", ["int", "bigint", "string"])
@pytest.mark.parametrize("mean", [False, True])
def test_neighbour_vectors_equal_brute_force(spark, joins_of_tables, key, mean):
    vectors, edges, nodes, df = made(spark, key)
    want = collections.defaultdict(list)
    for src, dst in edges:
        if src in vectors and dst is not None:
            want[dst].append(vectors[src])
    got = {r.node: r.h for r in blocks.neighbour_vectors(df, nodes, 3, "h", mean).collect()}
    assert set(got) == set(want)
    for node, found in want.items():
        assert np.allclose(got[node], np.mean(found, axis=0) if mean else np.sum(found, axis=0))
    assert blocks.neighbour_vectors(df.limit(0), nodes, 3, "h").count() == 0


def test_a_vector_travels_once_for_a_block(spark, joins_of_tables):
    _, edges, nodes, df = made(spark, "int")
    routed = blocks._routed(df, nodes, 4)
    assert routed.count() <= 40 * 4 < len(edges) / 5
    assert routed.groupBy("features").agg(F.count_distinct("block").alias("n"), F.count("*").alias("m")) \
        .filter("n <> m").count() == 0


@pytest.mark.parametrize("key", ["int", "string"])
@pytest.mark.parametrize("block_bytes", [2**29, 400])
def test_gathered_pairs_equal_joins(spark, joins_of_tables, key, block_bytes):
    vectors, edges, nodes, df = made(spark, key)
    rows = sorted((a, b, vectors[a], vectors[b]) for a, b in edges if a in vectors and b in vectors)
    found = blocks.gather_blocks(df.withColumn("x", F.lit(1)), nodes, block_bytes=block_bytes)
    assert found.columns == ["src", "dst", "x", "a", "b"]
    assert sorted((r.src, r.dst, r.a, r.b) for r in found.collect()) == rows
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for r in linkpred.cosine_scores(df.distinct(), nodes).collect():
        assert abs(r.score - (unit(vectors[r.src]) @ unit(vectors[r.dst]) + 1) / 2) < 1e-12


def test_zero_and_null_vectors(spark, joins_of_tables):
    nodes = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, None)], "node int, features array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "src int, dst int")
    got = {(r.src, r.dst): r.score for r in linkpred.cosine_scores(pairs, nodes).collect()}
    assert got[(0, 1)] == 0.5 and got[(1, 1)] == 1.0 and got[(1, 2)] is None


def test_pairs_and_vectors_are_not_joined_one_by_one(spark, joins_of_tables):
    nodes = spark.createDataFrame([(0, [1.0])], "node int, features array<double>")
    pairs = spark.createDataFrame([(0, 0)], "src int, dst int")
    plan = linkpred.gather(pairs, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_filter_of_keys_holds_for_all_of_them_and_few_others(spark):
    keys = spark.range(0, 200_000, 20).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    holds = skew.may_hold(keys, "id", 10_000)
    found = spark.range(200_000).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).filter(holds(F.col("id")))
    assert found.filter("id % 20 = 0").count() == 10_000 and found.filter("id IS NULL").count() == 0
    assert found.count() < 16_000
    none = skew.may_hold(keys.limit(0), "id", 0)
    assert spark.range(1_000).filter(none(F.col("id"))).count() == 0


def test_partners_with_more_targets_than_are_broadcast(spark, rows):
    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))],
                                  "node long, features array<double>")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))],
                                  "src long, dst long")
    targets = spark.range(0, 60, 3).withColumnRenamed("id", "node")
    want = rows(partners.top_partners(nodes, edges, targets, 3))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(partners.top_partners(nodes, edges, targets, 3)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_layer_sends_vectors_as_short_as_its_weights_make_them(spark, monkeypatch):
    sent = []
    added = linkpred.neighbour_vectors
    monkeypatch.setattr(linkpred, "neighbour_vectors",
                        lambda e, n, width, *a, **k: sent.append(width) or added(e, n, width, *a, **k))
    rng = np.random.default_rng(6)
    x, weight, bias = rng.normal(size=(5, 8)), rng.normal(size=(2, 8)), np.array([0.5, -0.5])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (1, 0)], "src long, dst long")
    made = linkpred.sage_layer(edges, nodes, 8, own_weight=weight, hood_weight=weight, bias=bias, activate=False)
    got = {r.node: np.array(r.features) for r in made.collect()}
    mean = np.array([x[1], x[[0, 2, 3]].mean(0), *np.zeros((3, 8))])
    assert sent == [2]
    for i in range(5):
        np.testing.assert_allclose(got[i], weight @ x[i] + weight @ mean[i] + bias)
