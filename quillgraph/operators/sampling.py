"""Reproducible samples, splits and negative edges from md5 keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hashing import below, digest, number60, uniform32
from quillgraph.operators.ordering import dense_index
from quillgraph.operators.skew import as_build_side, parts_of
from quillgraph.session import materialize


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def bernoulli(df: DataFrame, fraction: float, keys: Sequence[str],
              salt: str = "sample") -> DataFrame:
    """Keep about ``fraction`` of the rows, decided by their keys."""
    return df.filter(below(fraction, salt, *_cols(keys)))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], salt: str = "rows") -> DataFrame:
    """Exactly ``n`` rows without replacement (top-n by digest, no full sort)."""
    return df.orderBy(digest(salt, *_cols(keys)), *keys).limit(n)


def sample_groups(df: DataFrame, n: int, group: str, salt: str = "groups") -> DataFrame:
    """All rows of ``n`` sampled groups."""
    chosen = sample_rows(df.select(group).distinct(), n, [group], salt)
    return df.join(as_build_side(chosen), group, "left_semi")


def shuffled(df: DataFrame, keys: Sequence[str], salt: str = "order") -> DataFrame:
    return df.orderBy(digest(salt, *_cols(keys)), *keys)


def split(df: DataFrame, parts: Mapping[str, float], keys: Sequence[Column | str],
          salt: str = "split", name: str = "split") -> DataFrame:
    """Add the part each row falls in; the last part takes what remains."""
    number = uniform32(salt, *[F.col(k) if isinstance(k, str) else k for k in keys])
    labels = list(parts)
    chosen, bound = None, 0.0
    for label in labels[:-1]:
        bound += parts[label]
        test = number < F.lit(int(round(bound * 2**32)))
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    last = F.lit(labels[-1])
    return df.withColumn(name, last if chosen is None else chosen.otherwise(last))


def split_edges(edges: DataFrame, parts: Mapping[str, float] | None = None,
                salt: str = "edge") -> DataFrame:
    """Split edges so that both directions of a pair fall in the same part."""
    return split(edges, parts or {"train": 0.8, "val": 0.1, "test": 0.1},
                 [F.least("src", "dst"), F.greatest("src", "dst")], salt)


def random_negatives(positives: DataFrame, nodes: Column | int, k: int = 1,
                     salt: str = "neg", first: int = 1) -> DataFrame:
    """``k`` uniform random node pairs per positive edge; may hit real edges.

    ``nodes`` is the number of nodes, indexed from 0; draws are numbered from
    ``first``. Rows ``(pos_src, pos_dst, draw, src, dst)``.
    """
    keys = (F.col("pos_src"), F.col("pos_dst"))
    edges = positives.select(F.col("src").alias("pos_src"), F.col("dst").alias("pos_dst"),
                             (nodes if isinstance(nodes, Column) else F.lit(nodes)).alias("_n"))
    # Drawn inside the generator, one digest per draw: later filters and
    # projections then use the numbers instead of computing digests again.
    hashed = F.transform(F.sequence(F.lit(first), F.lit(first + k - 1)), lambda draw: F.struct(
        draw.alias("draw"), digest(salt, *keys, draw).alias("h")))
    drawn = F.transform(hashed, lambda x: F.struct(
        x.getField("draw").alias("draw"),
        F.pmod(number60(x.getField("h"), 0), F.col("_n")).alias("src"),
        F.pmod(number60(x.getField("h"), 1), F.col("_n")).alias("dst")))
    return (edges.select("pos_src", "pos_dst", F.explode(drawn).alias("d"))
            .select("pos_src", "pos_dst", "d.draw", "d.src", "d.dst"))


def corrupt_targets(positives: DataFrame, nodes: Column | int, k: int = 5,
                    salt: str = "rank") -> DataFrame:
    """``k`` negatives per positive that keep its source, for ranking."""
    return (random_negatives(positives, nodes, k, salt)
            .select(F.col("pos_src").alias("src"), "pos_dst", "draw", "dst"))


_SPARE = 1.1  # pairs taken for each wanted one, as some are edges or drawn twice


def hard_negatives(positives: DataFrame, edges: DataFrame, nodes: Column | int,
                   ratio: float = 1.0, k: int = 3, salt: str = "hard",
                   most_rounds: int = 40) -> DataFrame:
    """``(src, dst, ix)``: exactly ``round(ratio * positives)`` distinct unordered pairs
    that are neither edges nor self pairs, numbered from 0 in random order.

    A round draws ``k`` pairs per positive and keeps those that are new; rounds go on until
    there are enough, and what is too much is cut by a digest of the pair (ranks over
    ranges, no single task); where most of the first round would be cut, before it is
    shuffled. Pairs found before are only looked up, not drawn or joined again.
    ``edges`` hold each unordered pair with ``src <= dst``, see ``undirected_edges``.
    Positives are dealt out for drawing, and pairs for the lookup, in partitions by their
    number, so that a task stays small and all cores are busy to the end.
    Fails if the graph has too few free pairs to find them in ``most_rounds``.
    """
    size = positives.count()
    wanted = round(ratio * size)
    order = [digest(f"{salt}-order", F.col("src"), F.col("dst")), F.col("src"), F.col("dst")]
    parts = parts_of(k * size, positives)
    dealt = positives.select("src", "dst").repartition(parts, "src", "dst")
    there = edges.select("src", "dst").repartition(parts, "src", "dst")

    def free(number: int, below: Column | None = None) -> DataFrame:
        drawn = random_negatives(dealt, nodes, k, salt, first=number * k + 1)
        pairs = (drawn.select(F.least("src", "dst").alias("src"),
                              F.greatest("src", "dst").alias("dst"))
                 .filter(F.col("src") != F.col("dst")))
        pairs = pairs if below is None else pairs.filter(below)
        pairs = pairs.repartition(parts, "src", "dst").distinct()
        return pairs.join(there.hint("merge"), ["src", "dst"], "left_anti")

    def first(found: DataFrame) -> DataFrame:
        # Ordered by an expression: the digests are not shuffled or written.
        ranked = dense_index(found, order)
        return ranked.filter(F.col("ix") < wanted).select("src", "dst", "ix")

    # The wanted pairs are those of the smallest digests. If a share of the first round that
    # the digests cut off has enough of them, the rest of the round can't matter.
    share = _SPARE * wanted / (k * size) if size else 1.0
    if share < 0.9:
        # Hex digits are compared as they are, which takes less than their number.
        few = materialize(free(0, order[0] < F.lit(f"{int(share * 2**32):08x}")), "negatives")
        if few.count() >= wanted:
            return first(few)
    found, count = None, 0
    for number in range(most_rounds):
        pairs = free(number)
        if found is not None:
            pairs = pairs.join(found, ["src", "dst"], "left_anti")
        fresh = materialize(pairs, "negatives")
        count += fresh.count()
        found = fresh if found is None else found.unionByName(fresh)
        if count >= wanted:
            return first(found)
    raise ValueError(f"no {wanted} free pairs found in {most_rounds} rounds")


def split_negatives(splits: DataFrame, edges: DataFrame, nodes: Column | int, ratio: float = 1.0,
                    k: int = 3, salt: str = "hard", name: str = "split") -> DataFrame:
    """``(src, dst, split)``: for each part of ``split_edges`` exactly
    ``round(ratio * edges of the part)`` negatives; no pair is in two parts."""
    counts = {r[name]: r["n"] for r in splits.groupBy(name).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per part
    sizes = {part: round(ratio * n) for part, n in counts.items()}
    total = sum(sizes.values())
    count = sum(counts.values())
    drawn = hard_negatives(splits, edges, nodes, total / count if count else 0.0, k, salt)
    label, bound = F.lit(None).cast("string"), total
    for part in sorted(sizes, reverse=True):
        label = F.when(F.col("ix") < bound, part).otherwise(label)
        bound -= sizes[part]
    return drawn.select("src", "dst", label.alias(name))


def labelled(positives: DataFrame, negatives: DataFrame, label: str = "label") -> DataFrame:
    """Positives (1) and negatives (0) in one table ``(src, dst, label)``."""
    return (positives.select("src", "dst", F.lit(1).alias(label))
            .unionByName(negatives.select("src", "dst", F.lit(0).alias(label))))


def neighbor_sample(edges: DataFrame, seeds: DataFrame, fanout: Sequence[int] = (10, 10),
                    salt: str = "hop", parts: int | None = None) -> DataFrame:
    """Sampled subgraph ``(hop, src, dst)``: up to ``fanout[h]`` neighbours per node.

    ``edges`` hold both directions; ``seeds`` has one column ``node``. Only edges of the
    frontier are ranked, and the rank filter lets Spark cut each node's list on the map
    side, so a hub sends only a few rows to its task. Each hop is written out, since the
    next one starts from it. With ``parts``, edges are dealt out by source in so many
    partitions instead and ranked there: for very many edges, whose nodes have far fewer
    each than a task takes rows; neither digests nor rows ranked in several tasks move.
    """
    frontier = seeds.select("node").distinct()
    hops = None
    for hop, limit in enumerate(fanout, start=1):
        order = Window.partitionBy("src").orderBy(
            digest(f"{salt}{hop}", F.col("src"), F.col("dst")), "dst")
        ends = edges.select("src", "dst")
        near = (ends if parts is None else ends.repartition(parts, "src")).join(
            as_build_side(frontier), F.col("src") == F.col("node"), "left_semi")
        rows = near.withColumn("_rank", F.row_number().over(order)).filter(
            F.col("_rank") <= limit).select(F.lit(hop).alias("hop"), "src", "dst")
        if hop < len(fanout):
            rows = materialize(rows, "hop")
        hops = rows if hops is None else hops.unionByName(rows)
        frontier = rows.select(F.col("dst").alias("node")).distinct()
    return hops
