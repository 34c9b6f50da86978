"""Top partners, vector sums, files bounded by bytes, counted and inferred reading, batch
commits, rank selection, sketches."""

import collections
import glob
import gzip
import os
import random
import re

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import vectors as V
from quillgraph.functions.columns import ID_PREFIX
from quillgraph.operators import graph, linkpred, partners, stats
from quillgraph.plans import graph_queries, works_queries
from quillgraph.sinks import writers
from quillgraph.sources import inferred, snapshot, tables
from quillgraph.sources.testtables import Tables
from quillgraph.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


# --- vectors ---------------------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 559])
def test_sums_and_means_of_wide_vectors(spark, width):
    rng = np.random.default_rng(1)
    keys = ["hot"] * 300 + [None] * 5 + [f"k{i % 40}" for i in range(200)]
    values = rng.normal(size=(len(keys), width))
    rows = [(k, None if i % 50 == 7 else v.tolist()) for i, (k, v) in enumerate(zip(keys, values))]
    df = spark.createDataFrame(rows, "key string, v array<float>").repartition(7)
    want = collections.defaultdict(list)
    for key, v in rows:
        if v is not None:
            want[key].append(np.float32(v).astype(float))
    sums = {r["key"]: (r["s"], r["n"]) for r in V.sum_vectors(df, "key", "v", width, "s", "n").collect()}
    means = {r["key"]: r["m"] for r in V.mean_vectors(df, "key", "v", width, "m").collect()}
    assert set(sums) == set(means) == set(want)
    for key, vectors in want.items():
        assert sums[key][1] == len(vectors)
        assert np.allclose(sums[key][0], np.sum(vectors, axis=0))
        assert np.allclose(means[key], np.mean(vectors, axis=0))
    assert V.sum_vectors(df.limit(0), "key", "v", width, "s").count() == 0


def test_vectors_of_another_width_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0])], "key string, v array<double>")
    with pytest.raises(Exception, match="vectors of 2 elements"):
        V.sum_vectors(df, "key", "v", 2, "s").collect()


def test_pair_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0]), ([], []), ([1.0], None),
                                ([None, 2.0], [5.0, 5.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.pair_dot(F.col("a"), F.col("b"))).collect()] == [
        11.0, None, 0.0, None, 10.0]


# --- partners ----------------------------------------------------------------------------

def brute_partners(vectors, edges, targets, k):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = set()
    for t in targets:
        if t in vectors:
            scored = sorted((-round(float(vectors[t] @ v), 9), n) for n, v in vectors.items()
                            if n != t and n not in near[t])
            out |= {(t, rank + 1, n) for rank, (_, n) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block, target_block", [(4_096, 1_024), (16, 8)])
def test_top_partners_equal_brute_force(spark, block, target_block):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=4) * (i % 7) / 3 for i in range(150)}
    vectors |= {i: vectors[3] for i in (150, 151)} | {152: np.zeros(4), 153: np.zeros(4)}
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 160, (900, 2)) if a != b}
    edges |= {(5, n) for n in range(150)}  # nearly everybody is known
    targets = [*range(0, 155, 5), 3, 999]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(500, None)],
                                  "node long, features array<double>").repartition(3)
    got = partners.top_partners(nodes, spark.createDataFrame(list(edges), "src long, dst long"),
                                spark.createDataFrame([(t,) for t in targets], "node long"), 10,
                                block, target_block)
    assert {(r.target, r["rank"], r.node) for r in got.collect()} == \
        brute_partners(vectors, edges, targets, 10)


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    asked = []
    real = partners.materialize
    monkeypatch.setattr(partners, "materialize", lambda df, label: asked.append(label) or real(df, label))
    nodes = spark.createDataFrame([(i, [100.0 / (1 + i), 0.1]) for i in range(400)],
                                  "node long, features array<double>")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    targets = spark.createDataFrame([(0,), (1,)], "node long")
    partners.top_partners(nodes, edges, targets, 3, block=10).count()
    assert asked.count("best") < 3  # of six rounds


def test_partner_plan_has_no_nested_loop(spark):
    plan = graph_queries.predict_partners(Tables(spark, FOLDER))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_layers_chain(spark):
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)],
                                  "node long, features array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "ix long, term string")
    layer = lambda x: linkpred.sage_layer(edges, x, 2, activate=False)
    got = partners.predict_partners(nodes, edges, nodes.filter("node = 0"), [layer, layer], names, 2)
    assert [(r["rank"], r["node"], r["name"]) for r in got.orderBy("rank").collect()] == [
        (1, 2, "n2"), (2, 3, "n3")]  # equal vectors: the smaller node first


# --- files bounded by bytes ---------------------------------------------------------------

@pytest.mark.parametrize("bound", [3_000, 20_000, 10_000_000])
def test_files_stay_below_the_bound(spark, tmp_path, bound):
    rng = random.Random(3)
    rows = [(i, "x" * (i % 40) if i < 3_000 else "".join(rng.choices("abcdef", k=60))) for i in range(5_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartitionByRange(4, "id").sortWithinPartitions("id")
    target = str(tmp_path / "out")
    files = writers.write_bounded(df, target, bound, codec="snappy")
    sizes = [os.path.getsize(f) for f in glob.glob(f"{target}/*.parquet")]
    assert len(sizes) == files and max(sizes) <= bound
    assert len(sizes) == 1 if bound == 10_000_000 else len(sizes) > 3
    back = spark.read.parquet(target)
    assert sorted(map(tuple, back.collect())) == rows
    firsts = back.groupBy(F.input_file_name().alias("f")).agg(F.min("id"), F.max("id"), F.count("id"))
    assert all(high - low + 1 == n for _, low, high, n in firsts.collect())  # rows keep their order


def test_a_task_writes_many_files_of_alike_rows(spark, tmp_path, monkeypatch):
    asked = []
    real = writers.write_parquet
    monkeypatch.setattr(writers, "write_parquet", lambda df, target, **k: asked.append(
        df.rdd.getNumPartitions()) or real(df, target, **k))
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdef", k=60))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartitionByRange(3, "id").sortWithinPartitions("id")
    files = writers.write_bounded(df, str(tmp_path / "out"), 6_000, codec="snappy")
    sizes = [os.path.getsize(f) for f in glob.glob(f"{tmp_path}/out/*.parquet")]
    assert len(sizes) == files > 100 and max(sizes) <= 6_000 and files <= 1.3 * sum(sizes) / 6_000
    assert max(asked) < files / 4
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == rows
    firsts = back.groupBy(F.input_file_name().alias("f")).agg(F.min("id"), F.max("id"), F.count("id"))
    assert all(high - low + 1 == n for _, low, high, n in firsts.collect())


def test_a_row_above_the_bound_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(os.urandom(9_000).hex(),)] * 3, "text string")
    with pytest.raises(ValueError, match="at most 2000 bytes"):
        writers.write_bounded(df, str(tmp_path / "out"), 2_000, attempts=2)
    empty = str(tmp_path / "empty")
    writers.write_bounded(df.limit(0), empty, 2_000)
    assert spark.read.schema("text string").parquet(empty).count() == 0


# --- counted, inferred and batched reading ----------------------------------------------------

def deliver(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with (gzip.open if name.endswith(".gz") else open)(f"{folder}/{name}", "wt") as f:
        f.write("\n".join(lines) + "\n")


GOOD = ['{"id": "%sW%d", "title": "t%d"}' % (ID_PREFIX, i, i) for i in range(5)]


def test_dropped_lines_and_skipped_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    deliver(folder, "a.gz", *GOOD, '{"id": "broken', "", "no json")
    deliver(folder, "b.json", GOOD[0])
    rows, seen = snapshot.read_counted(spark, folder)
    assert snapshot.compact_work(rows).collect() and seen.get == {"lines": 7, "dropped": 2}
    skipped = snapshot.skipped_files(spark, folder).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in skipped] == ["b.json"] and skipped[0]["bytes"] > 0


def test_inferred_reading_settles_conflicts(spark, tmp_path):
    folder = str(tmp_path / "in")
    deliver(folder, "a.gz", '{"a": 1, "b": {"c": "x", "d": [1, 2]}, "e": null, "l": [{"k": 1}]}',
            '{"a": "2", "b": {"c": 3, "d": ["7", "y"]}, "new": true, "l": "none"}', "[1]", '{"a": ',
            '{"a": {"deep": 1}, "b": {"d": null}, "l": [{"k": "5"}, {}]}')
    found = inferred.merged_schema(snapshot.read_lines(spark, folder))
    assert sorted(inferred.conflicts(found)) == ["a", "b.c", "b.d[]", "l"]
    wanted = T.StructType.fromDDL("a bigint, b struct<c: string, d: array<int>>, e string,"
                                  " l array<struct<k: bigint>>, never double")
    got = inferred.read_inferred(spark, folder, wanted=wanted)
    assert got.schema == wanted
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([
        (1, ("x", [1, 2]), None, [(1,)], None), (2, ("3", [7, None]), None, None, None),
        (None, (None, None), None, [(5,), (None,)], None)], key=repr)
    deliver(str(tmp_path / "none"), "a.gz", "nothing", "1")
    assert inferred.read_inferred(spark, str(tmp_path / "none"), wanted=wanted).collect() == []


def test_batches_that_fail_are_replaced(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def fail(number):
        raise RuntimeError("lost")

    deliver(source, "a.gz", *GOOD[:2], "{broken")
    with pytest.raises(StreamingQueryException):
        ingest.ingest_batches(spark, source, target, state, before_commit=fail)
    assert os.path.isdir(f"{target}/batch=0") and not os.path.isdir(f"{target}/_manifest")
    deliver(source, "b.gz", *GOOD[2:])  # arrives before the batch is taken again
    for _ in range(2):
        ingest.ingest_batches(spark, source, target, state)
    done = ingest.read_ingested(spark, target)
    assert sorted((r["batch"], r["id"]) for r in done.collect()) == [
        (0, "W0"), (0, "W1"), (1, "W2"), (1, "W3"), (1, "W4")]
    assert sorted(map(tuple, ingest.manifest(spark, target).collect())) == [(0, 3, 1), (1, 3, 0)]
    deliver(source, "c.gz", GOOD[0])
    with pytest.raises(StreamingQueryException):
        ingest.ingest_batches(spark, source, target, state, before_commit=fail)
    assert ingest.read_ingested(spark, target).count() == 5  # written, not entered


# --- statistics ---------------------------------------------------------------------------------

@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2, 2], [None, 7, 7, 1, 9, 4], list(range(101)), []])
def test_box_equals_interpolated_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    got = tuple(stats.box_summary(df, "v").first())
    known = [v for v in values if v is not None]
    assert got == (tuple(np.quantile(known, [0, 0.25, 0.5, 0.75, 1])) if known else (None,) * 5)


def test_box_plan_gathers_no_values(spark):
    plan = works_queries.citation_box(Tables(spark, FOLDER))._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_sketches_of_slices_merge(spark):
    rows = spark.range(30_000).select((F.col("id") % 9_000).alias("x"), F.floor(F.col("id") / 10_000).alias("s"))
    sketches = stats.distinct_sketches(rows, "x", "s")
    assert sketches.count() == 3
    assert abs(stats.distinct_estimate(sketches).first()["n"] / 9_000 - 1) < 0.03
    assert stats.distinct_estimate(sketches.limit(0)).first()["n"] == 0


# --- words, slices, kept works ---------------------------------------------------------------------

def test_word_index_finds_whole_words_from_their_lists(spark, tmp_path):
    titles = [(1, "Deep sea life"), (2, "Life, deep down: the SEA!"), (3, "seaside life deep"), (4, None),
              (5, ""), (6, "sea sea deep Été2 life")]
    index = str(tmp_path / "index")
    tables.write_word_index(spark.createDataFrame(titles, "id int, title string"), index, buckets=8)

    def found(text):
        return sorted(r["id"] for r in tables.word_search(spark, index, text, buckets=8).collect())

    assert found("sea LIFE deep") == [1, 2, 6] and found("été2") == [6] and found("seas") == []
    assert found(" ,") == [] and found("sea sea") == [1, 2, 6]
    plan = tables.word_search(spark, index, "sea", buckets=8)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(word,sea\)", plan)
    assert "ReadSchema: struct<id:int,word:string>" in plan


def test_slice_range_reads_its_folders_only(spark, tmp_path):
    target = str(tmp_path / "s")
    rows = tables.with_slice(spark.range(95).withColumnRenamed("id", "row_id"), step=10)
    writers.write_slices(rows, target, 3)
    got = tables.read_slice_range(spark, target, 17, 40, step=10)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(17, 40))
    assert sorted(r[0] for r in got.select("slice_head").distinct().collect()) == [10, 20, 30]
    assert re.search(r"PartitionFilters: \[[^\]]*slice_head", got._jdf.queryExecution().toString())
    assert tables.read_slice_range(spark, target, 20, 20, step=10).count() == 0


def test_kept_works_do_not_move(spark, tmp_path):
    works = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 9)], "doi string, n int")
    kept = graph.keep_keyed(works, "doi", "kept_works_test", str(tmp_path / "kept"), 4)
    papers = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "b")], "paper int, key string")
    done = graph.enrich_kept(papers, kept, "key")
    assert {r["paper"]: r["alex"] and r["alex"]["n"] for r in done.collect()} == {1: 1, 2: None, 3: None, 4: 5}
    again = graph.enrich_kept(done.withColumn("alex", F.when(F.col("paper") == 1, F.col("alex"))), kept, "key")
    assert {r["paper"]: r["alex"] and r["alex"]["n"] for r in again.collect()} == {1: 1, 2: None, 3: None, 4: 5}
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 1  # the papers' side only
    assert "Exchange" not in plan[plan.index("kept_works_test") - 200:plan.index("kept_works_test")]


# --- a trainer whose weights don't depend on the run -------------------------------------------------

def test_newton_weights_are_the_same_on_every_partitioning(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    label = (rng.random(900) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))).astype(int)
    rows = [(i, v.tolist(), [1.0] * 3, int(y)) for i, (v, y) in enumerate(zip(x, label))]
    made = []
    for parts in (1, 7):
        pairs = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, label int") \
            .repartition(parts)
        made.append(linkpred.train_newton(linkpred.newton_rows(pairs, ["id"], 100), ["id"], 3, 1e-6))
    assert (made[0] == made[1]).all()
    full = np.hstack([x, np.ones((900, 1))])
    chance = 1 / (1 + np.exp(-full @ made[0]))
    assert np.abs(full.T @ (chance - label)).max() < 1e-3  # at the optimum
    weights, area = linkpred.best_newton(pairs, pairs, ["id"], 3)
    assert area > 0.8
    scored = linkpred.newton_scores(pairs, weights).toPandas().set_index("id").loc[range(900)]
    assert np.allclose(scored["score"], 1 / (1 + np.exp(-full @ weights)))
