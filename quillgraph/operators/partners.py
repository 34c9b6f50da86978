"""The best new partners of many authors at once: exact top-k by inner product.

Nodes are numbered by falling vector norm and cut into blocks. The product of two norms
bounds an inner product, so once a target has k partners, blocks whose largest norm times
the target's own stays below the k-th score can't change its answer, nor can any block
after them. Blocks are therefore taken in rounds of doubling size; in each, only targets
that a block can still serve meet it, as one matrix product of a block of targets and a
block of nodes. Known partners are taken out inside the product; a filter of the targets
leaves out other edges before these are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators.ordering import dense_index
from quillgraph.operators.skew import as_build_side, is_small, may_hold
from quillgraph.session import materialize

# Nodes travel once for each block of targets, targets once for each block of nodes.
BLOCK, TARGET_BLOCK = 4_096, 16_384
_SLICE = 512
# Scores that agree to so many decimals are ties; the smaller node comes first.
DECIMALS = 9
_SLACK = 2 * 10.0 ** -DECIMALS


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    whole = column.combine_chunks()
    flat = pc.fill_null(whole.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1)


def _block_best(nodes: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of one block of nodes for one block of targets. ``asked`` has the
    targets (with ``at_least``) and, where ``known`` is set, what they know already."""
    empty = pa.table({"target": pa.array([], pa.int64()), "node": pa.array([], pa.int64()),
                      "dot": pa.array([], pa.float64())})
    known = asked.filter(pc.is_valid(asked["known"]))
    targets = asked.filter(pc.is_null(asked["known"])).sort_by("target")
    if not len(nodes) or not len(targets):
        return empty
    nodes = nodes.sort_by("node")
    ids, own, vectors = nodes["node"].to_numpy(), targets["target"].to_numpy(), _rows(nodes["features"]).T
    asking, least = _rows(targets["features"]), targets["at_least"].to_numpy()
    hidden = [_places(own, ids, known["target"].to_numpy(), known["known"].to_numpy()),
              _places(own, ids, own, own)]
    out = []
    for low in range(0, len(own), _SLICE):  # so many rows of scores at a time
        scores = np.round(asking[low:low + _SLICE] @ vectors, DECIMALS)
        for row, column in hidden:
            here = (row >= low) & (row < low + _SLICE)
            scores[row[here] - low, column[here]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, best, 1)
        row, place = np.nonzero(np.isfinite(found) & (found >= least[low:low + _SLICE, None]))
        out.append(pa.table({"target": own[low + row], "node": ids[best[row, place]],
                             "dot": found[row, place]}))
    return pa.concat_tables(out)


def _places(own: np.ndarray, ids: np.ndarray, target: np.ndarray, node: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs among the targets and nodes of a block (both sorted)."""
    row, column = np.searchsorted(own, target), np.searchsorted(ids, node)
    inside = (row < len(own)) & (column < len(ids))
    row, column, target, node = row[inside], column[inside], target[inside], node[inside]
    hit = (own[row] == target) & (ids[column] == node)
    return row[hit], column[hit]


def top_partners(nodes: DataFrame, edges: DataFrame, targets: DataFrame, k: int = 10,
                 block: int = BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """``(target, rank, node, score)``: for each ``node`` of ``targets`` its ``k`` best nodes
    by ``sigmoid(inner product)`` among those it has no edge with, in either direction.

    ``nodes`` is ``(node, features)`` with one row per node and vectors of one length;
    targets without a vector get no rows. Targets with fewer candidates get them all.
    """
    norm = F.sqrt(V.pair_dot(F.col("features"), F.col("features")))
    ranked = dense_index(
        nodes.select("node", "features").filter(F.col("features").isNotNull()).withColumn("norm", norm),
        [F.desc("norm"), F.col("node")], "at", "norm-order")
    ranked = materialize(ranked.withColumn("block", F.floor(F.col("at") / block).cast("int")), "ranked")
    wanted = targets.select(F.col("node").alias("target")).distinct()
    asking = wanted.count()
    count = max(1, -(-asking // target_block))
    own = materialize(
        wanted.join(ranked, F.col("target") == F.col("node")).select(
            "target", "features", "norm",
            F.pmod(F.xxhash64("target"), F.lit(count)).cast("int").alias("part")), "targets")
    either = edges.select(F.col("src").alias("target"), F.col("dst").alias("node")).unionByName(
        edges.select(F.col("dst").alias("target"), F.col("src").alias("node")))
    part_of = own.select("target", "part")
    if not is_small(part_of) and either.schema["target"].dataType == own.schema["target"].dataType:
        # Only edges of targets are shuffled, not all edges in both directions.
        either = either.filter(may_hold(part_of, "target", asking)(F.col("target")))
    near = either.join(as_build_side(part_of), "target").distinct()
    known = materialize(near.join(ranked.select("node", "block"), "node").select(
        "target", "part", "block", F.col("node").alias("known")), "known")
    last = ranked.agg(F.max("block")).first()[0]
    best = None
    low, step = 0, 1
    while last is not None and low <= last:
        high = min(last, low + step - 1)
        most = ranked.filter(F.col("block") == low).agg(F.max("norm")).first()[0]
        alive = own.withColumn("at_least", F.lit(-float("inf")))
        if best is not None:
            full = best.filter(F.col("rank") == k).select("target", F.col("dot").alias("kth"))
            alive = own.join(full, "target", "left").withColumn(
                "at_least", F.coalesce("kth", F.lit(-float("inf")))).drop("kth")
            alive = alive.filter(F.col("norm") * F.lit(most) + _SLACK >= F.col("at_least"))
        alive = materialize(alive, "alive")
        if not alive.take(1):
            break
        blocks = F.sequence(F.lit(low), F.lit(high))
        asked = alive.select("target", "part", "features", "at_least",
                             F.lit(None).cast("bigint").alias("known"), F.explode(blocks).alias("block"))
        hidden = known.filter(F.col("block").between(low, high)).join(
            alive.select("target"), "target", "left_semi").select(
            "target", "part", F.lit(None).cast(alive.schema["features"].dataType).alias("features"),
            F.lit(None).cast("double").alias("at_least"), "known", "block")
        served = ranked.filter(F.col("block").between(low, high)).select(
            "node", "features", "block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"))
        found = served.groupBy("block", "part").cogroup(
            asked.unionByName(hidden).groupBy("block", "part")).applyInArrow(
            lambda left, right: _block_best(left, right, k), "target bigint, node bigint, dot double")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("target").orderBy(F.desc("dot"), "node")
        best = materialize(found.withColumn("rank", F.row_number().over(order))
                           .filter(F.col("rank") <= k), "best")
        low, step = high + 1, 2 * step
    if best is None:
        best = ranked.sparkSession.createDataFrame([], "target bigint, node bigint, dot double, rank int")
    return best.select("target", "rank", "node", V.sigmoid(F.col("dot")).alias("score"))


def predict_partners(nodes: DataFrame, edges: DataFrame, targets: DataFrame,
                     layers: Sequence[Callable[[DataFrame], DataFrame]], names: DataFrame,
                     k: int = 10) -> DataFrame:
    """From features to names: ``layers`` (functions of the nodes, such as a SAGE layer with
    its weights) are applied one after the other to the whole graph, each written out, then
    every target gets its ``k`` likeliest new partners with their names (``ix``, ``term``).
    """
    for number, layer in enumerate(layers):
        nodes = materialize(layer(nodes), f"layer-{number + 1}")
    found = top_partners(nodes, edges, targets, k)
    named = names.select(F.col("ix").alias("node"), F.col("term").alias("name"))
    return found.join(as_build_side(named), "node", "left").select(
        "target", "rank", "node", "name", "score")
