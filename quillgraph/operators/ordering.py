"""Dense indexes and running totals over a whole table, range-partitioned.

A window without ``partitionBy`` sends the table to one task. These operators
range-partition by the order instead, work inside each partition, and add what
lies in the partitions before. Only per-partition totals (one row per
partition) are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def _before(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums over all earlier partitions; the input has one row per partition."""
    earlier = (Window.partitionBy(F.lit(0)).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("_part", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "ix",
                label: str = "dense-index") -> DataFrame:
    """Number the rows 0, 1, 2, … in the given total order."""
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
          .withColumn("_row", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = _before(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (placed.join(F.broadcast(before), "_part")
            .withColumn(name, local + F.col("_before_rows"))
            .drop("_row", "_part", "_before_rows"))


def running_sum(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str],
                label: str = "running-sum") -> DataFrame:
    """Add ``cum_<c>``, the inclusive running sum of each column in total order."""
    placed = materialize(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = _before(placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]), columns)
    running = placed.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in columns])
    running = running.join(F.broadcast(before), "_part")
    for c in columns:
        running = running.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.col(f"_before_{c}"))
    return running.drop("_part", *[f"_before_{c}" for c in columns])
