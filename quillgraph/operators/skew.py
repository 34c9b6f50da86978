"""Group filters and joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark cuts ranked groups on the map side up to this rank
# (spark.sql.optimizer.windowGroupLimitThreshold).
_MAP_SIDE_RANK = 1000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def count_rows(df: DataFrame, key: str | Sequence[str], n: str = "n") -> DataFrame:
    """Rows per key; combined on the map side, so a hot key costs nothing."""
    return df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias(n))


def is_small(df: DataFrame) -> bool:
    """Whether the planner's size of ``df`` is within ``spark.sql.autoBroadcastJoinThreshold``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def as_build_side(df: DataFrame) -> DataFrame:
    """Hint how to join the lookup table ``df``: broadcast it if the planner's
    size is within ``spark.sql.autoBroadcastJoinThreshold``, else sort and merge.

    The size is that of the files for a table and an upper estimate for a join.
    The hint also keeps Spark from broadcasting the other side, which may look
    small to the planner and still grow, as pairs expanded from teams do.
    """
    return F.broadcast(df) if is_small(df) else df.hint("merge")


# Rows of a few numbers that a task sorts or groups in some hundred MB.
TASK_ROWS = 1_000_000


def parts_of(rows: int, df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Partitions that ``rows`` rows need so that a task's share stays the same whatever
    their number; at least as many as ``df``'s session has tasks at a time."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))


def skew_join(left: DataFrame, right: DataFrame, key: str | Sequence[str],
              how: str = "inner") -> DataFrame:
    """Join ``left``, which may have hot keys, with an aggregate over the same key.

    An aggregate is already partitioned by its key. Spark would reuse that, and
    the adaptive skew join, which splits plain shuffles only, could not split
    the rows of a hot key. One more key column, equal for equal keys and not
    known to the planner as such, makes both inputs plain shuffles.
    """
    keys = _keys(key)
    if how == "left_anti":
        # Rows with a null key match nothing; they need no shuffle at all.
        some_null = F.lit(False)
        for k in keys:
            some_null = some_null | F.col(k).isNull()
        return (skew_join(left.filter(~some_null), right, keys, "_anti")
                .unionByName(left.filter(some_null)))

    def fresh(df: DataFrame) -> DataFrame:
        return df.withColumn("_fresh", F.pmod(F.xxhash64(*keys), F.lit(1)))

    joined = fresh(left).join(fresh(right), [*keys, "_fresh"], how.replace("_anti", "left_anti"))
    return joined.drop("_fresh")


# Bits of a filter: so many a key, and so many at most (8 MB in the driver and in each worker).
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def may_hold(keys: DataFrame, key: str, count: int) -> Callable[[Column], Column]:
    """A test that holds for every value of ``keys[key]`` (about ``count``, of one type with
    what is tested) and for one in some seventy others, more beyond ``MOST_BITS``.

    A Bloom filter, made of bitmaps that Spark puts together: rows that can't find a partner
    in a join that follows need not be shuffled for it, where the keys are too many to be
    broadcast. Null is false.
    """
    bits = 1 << max(15, min(int(math.log2(MOST_BITS)), math.ceil(math.log2(max(1, count) * BITS_A_KEY))))
    at = F.col("at") + 1  # the functions for bitmaps count from 1
    hashed = F.xxhash64(key)
    first, second = hashed.bitwiseAND(F.lit(bits - 1)), F.shiftright(hashed, 32).bitwiseAND(F.lit(bits - 1))
    parts = (keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(first, second)).alias("at"))
             .groupBy(F.bitmap_bucket_number(at).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect())
    flags = np.zeros(bits // 8, np.uint8)
    for part in parts:
        low = (part["bucket"] - 1) * len(part["bitmap"])
        flags[low:low + len(part["bitmap"])] = np.frombuffer(part["bitmap"], np.uint8)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        hashes = hashes.to_numpy(zero_copy_only=False)
        one, two = hashes & (bits - 1), (hashes >> 32) & (bits - 1)
        return pa.array((flags[one >> 3] >> (one & 7) & flags[two >> 3] >> (two & 7) & 1).astype(bool))

    return lambda value: value.isNotNull() & test(F.xxhash64(value))


def groups_of_size(df: DataFrame, key: str, order: Sequence[Column | str], smallest: int,
                   largest: int | None, n: str = "n", parts: int | None = None) -> DataFrame:
    """Rows of groups with ``smallest`` to ``largest`` rows, and that size as ``n``.

    With an upper bound, one row more than the bound tells that a group is too
    large: each task keeps at most ``largest + 1`` rows of a key before the
    shuffle, and exactly the groups within the bound survive. Without one, the
    rows are counted and the count is joined back. ``parts`` is the number of partitions in
    which groups that were cut are counted and handed on, for very many rows.
    """
    if largest is None or largest >= _MAP_SIDE_RANK:
        counts = count_rows(df, key, n).filter(F.col(n) >= smallest)
        return skew_join(df, counts if largest is None else counts.filter(F.col(n) <= largest), key)
    group = Window.partitionBy(key)
    cut = (df.withColumn("_rank", F.row_number().over(group.orderBy(*order)))
           .filter(F.col("_rank") <= largest + 1))
    if parts is not None:
        cut = cut.repartition(parts, key)
    return (cut.withColumn(n, F.count(F.lit(1)).over(group))
            .filter(F.col(n).between(smallest, largest))
            .drop("_rank"))
