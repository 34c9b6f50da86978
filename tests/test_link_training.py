"""Training of the link model on packed cells of pairs."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quillgraph.operators import linkpred as L
from quillgraph.operators.blocks import cell_products, pair_cells
from quillgraph.session import materialize

WIDTH = 32


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, WIDTH)) * np.linspace(0.1, 4, WIDTH) + 1
    x[:, 3] = 1.0  # without deviation
    weight = rng.normal(size=WIDTH)
    pairs = [(i, j, int((x[i] * x[j]) @ weight + 30 * rng.normal() > 0))
             for i in range(160) for j in range(160) if i != j]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                  "node int, features array<double>")
    return spark.createDataFrame(pairs, "src int, dst int, label int").coalesce(1), nodes


def test_training_rows_are_small_and_give_the_weights_of_spark_ml(spark, graph):
    pairs, nodes = graph
    cells = L.training_cells(pairs, nodes)
    written = sum(f.stat().st_size for path in cells.inputFiles()
                  for f in [Path(path.removeprefix("file://").removeprefix("file:"))])
    assert written < pairs.count() * WIDTH * 8 / 3  # before, a vector for every pair
    rows = materialize(L.pair_features(L.gather(pairs, nodes)).select("x", "label"), "rows")
    fit = LogisticRegression(featuresCol="x", labelCol="label", maxIter=5, regParam=0.01).fit(rows)
    model = L.train_link_model(cells, (0.01,), max_iter=5)
    made = model.bestModel.stages[0]
    assert np.allclose(made.coefficients.toArray(), fit.coefficients.toArray(), rtol=0, atol=1e-9)
    assert abs(made.intercept - fit.intercept) < 1e-9
    assert 0.5 < model.validationMetrics[0] <= 1
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_cells_hold_each_pair_with_both_vectors_once(spark, graph):
    pairs, nodes = graph
    more = pairs.unionByName(spark.createDataFrame([(0, 999, 1), (None, 1, 1)], pairs.schema))
    some = nodes.withColumn("features", F.when(F.col("node") > 1, F.col("features")))
    cells = pair_cells(more.withColumn("held", F.col("src") % 2 == 0), some, cell_pairs=50)
    vectors = {r.node: np.array(r.features) for r in nodes.collect()}
    want = sorted((*np.round(vectors[r.src] * vectors[r.dst], 9), float(r.label), r.src % 2 == 0)
                  for r in pairs.collect() if min(r.src, r.dst) > 1)
    found = sorted((*np.round(x, 9), y, bool(h)) for batch in cells.toArrow().to_batches()
                   for part in cell_products(batch, 7) for x, y, h in zip(*part, strict=True))
    assert found == want


def test_newton_on_cells_equals_newton_on_rows_on_every_partitioning(spark, graph):
    """link_model_test trains on cells; before, a vector was written and shuffled for every pair."""
    pairs, nodes = graph
    validate = F.pmod(F.xxhash64("src", "dst"), F.lit(10)) == 0
    rows = L.newton_rows(L.gather(pairs.filter(~validate), nodes), ["src", "dst"])
    want = L.train_newton(rows, ["src", "dst"], WIDTH, 100.0, rounds=2)
    cells = [L.training_cells(some, nodes, held=validate) for some in (pairs, pairs.repartition(5))]
    made = [L.train_newton(some, [], WIDTH, 100.0, rounds=2) for some in cells]
    assert np.allclose(made[0], want, rtol=1e-7, atol=1e-9) and (made[0] == made[1]).all()
    weights, area = L.best_newton(cells[0], None, [], WIDTH, (1.0,))
    assert len(weights) == WIDTH + 1 and 0.5 < area <= 1


def test_what_was_shuffled_for_a_table_is_given_back(spark):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in every.getAllFiles().mkString(" ").split() if name.endswith(".data")}

    before = files()
    kept = materialize(spark.range(100_000).repartition(3, "id"), "kept")
    assert not files() - before
    assert kept.groupBy((F.col("id") % 7).alias("k")).count().count() == 7 and kept.count() == 100_000
