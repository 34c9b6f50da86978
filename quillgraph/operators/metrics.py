"""Classification and ranking metrics as DataFrame aggregates.

All take rows with a 0/1 ``label`` and a ``score``. Scores are first counted
per distinct value; running totals are then taken over a range-partitioned
table, so neither a score nor a group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.ordering import running_sum
from quillgraph.operators.skew import skew_join


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(df: DataFrame, label: str = "label",
                           predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall and F1; a ratio over nothing is 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counted = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                     F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def at_threshold(df: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    return df.withColumn("predicted", (F.col(score) > threshold).cast("int"))


def _by_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") != 1).alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties by half; 0 when a class is missing."""
    running = running_sum(_by_score(df, []), ["score"], ["pos", "neg"], "roc-auc")
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return running.agg(F.coalesce(F.when(pairs > 0, won / pairs), F.lit(0.0)).alias("roc_auc"))


def average_precision(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Step-form average precision over all rows or per group; tied scores are
    one step; 0 without positives.

    Groups are laid out one after the other in a single total order, so a group
    of any size is spread over many partitions.
    """
    keys = list(groups)
    counted = (_by_score(df, keys).withColumn("n", F.col("pos") + F.col("neg"))
               .withColumn("_down", -F.col("score")))
    running = running_sum(counted, [*keys, "_down"], ["pos", "n"], "average-precision")
    if keys:
        start = running.groupBy(*keys).agg(
            F.min(F.col("cum_pos") - F.col("pos")).alias("_pos0"),
            F.min(F.col("cum_n") - F.col("n")).alias("_n0"))
        running = (skew_join(running, start, keys)
                   .withColumn("cum_pos", F.col("cum_pos") - F.col("_pos0"))
                   .withColumn("cum_n", F.col("cum_n") - F.col("_n0")))
    gain = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    ap = F.coalesce(F.when(F.sum("pos") > 0, gain / F.sum("pos")), F.lit(0.0))
    out = ap.alias("average_precision")
    return running.groupBy(*keys).agg(out) if keys else running.agg(out)


def _discounts(first: Column, last: Column) -> Column:
    """Sum of 1 / log2(rank + 1) over ranks first..last (at most k terms)."""
    return F.when(last < first, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(first, last), F.lit(0.0),
        lambda acc, r: acc + F.lit(1.0) / F.log2(r.cast("double") + 1)))


def _dcg(df: DataFrame, groups: Sequence[str], by: str, k: int, name: str) -> DataFrame:
    """DCG@k per group with rows ordered by ``by`` descending, ties averaged.

    Rows are counted per distinct value first. Only the ``k`` highest values of
    a group can reach rank ``k``; the rank filter cuts the rest on the map side.
    """
    keys = list(groups)
    tied = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.col("label").cast("double")).alias("gain"))
    best = Window.partitionBy(*keys).orderBy(F.desc(by))
    kept = tied.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    last = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = kept.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("n") + 1)
    share = _discounts(F.col("_first"), F.least(F.col("_last"), F.lit(k)))
    return kept.groupBy(*keys).agg(F.sum(F.col("gain") / F.col("n") * share).alias(name))


def ndcg_at_k(df: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """NDCG@k per group; 0 where a group has no relevant row."""
    keys = list(groups)
    dcg = _dcg(df, keys, "score", k, "_dcg")
    # The best possible order is by relevance itself.
    ideal = _dcg(df.withColumn("_relevance", F.col("label")), keys, "_relevance", k, "_ideal")
    return (dcg.join(ideal, keys)
            .select(*keys, _ratio(F.col("_dcg"), F.col("_ideal")).alias("ndcg")))


def ranking_metrics(df: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """Mean NDCG@k and mean average precision over groups with both classes and
    at least ``k`` rows."""
    keys = list(groups)
    sizes = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                   F.sum("label").alias("_pos"))
             .filter((F.col("_n") >= k) & (F.col("_pos") > 0) & (F.col("_pos") < F.col("_n"))))
    scored = ndcg_at_k(df, keys, k).join(average_precision(df, keys), keys)
    return (scored.join(sizes, keys, "left_semi")
            .agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"),
                 F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map_at_k")))
