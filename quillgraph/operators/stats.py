"""Descriptive statistics over compact works.

Field paths such as ``authors.id`` are used instead of ``authors`` so that the
Parquet scan reads only those leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.columns import last_count, team, total_count
from quillgraph.operators.ordering import running_sum
from quillgraph.session import materialize


def dataset_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("size"))


def _distinct(c: Column, name: str, approx: bool) -> Column:
    return (F.approx_count_distinct(c) if approx else F.count_distinct(c)).alias(name)


def unique_works(works: DataFrame, approx: bool = False) -> DataFrame:
    return works.agg(_distinct(F.col("id"), "works", approx))


def unique_authors(works: DataFrame, approx: bool = False) -> DataFrame:
    return (works.select(F.explode("authors.id").alias("author"))
            .agg(_distinct(F.col("author"), "authors", approx)))


def unique_teams(works: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct sets of authors; a null array is no team, an empty one is a team."""
    return (works.select(team(F.col("authors")).alias("team"))
            .agg(_distinct(F.col("team"), "teams", approx)))


def unique_teams_of(rows: DataFrame) -> DataFrame:
    """Distinct teams of flat authorships ``(work, author)``, however many a work has: a
    team is its size and two sums of 44 bits of hashes of its members, combined on the map
    side, so no team is put together."""
    def total(salt: int) -> Column:
        return F.sum(F.pmod(F.xxhash64(F.lit(salt), "author"), F.lit(1 << 44)))

    teams = rows.groupBy("work").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
    return teams.select("n", "a", "b").distinct().agg(F.count(F.lit(1)).alias("teams"))


def _count_works(rows: DataFrame, key: str, distinct_works: bool) -> DataFrame:
    if distinct_works:
        rows = rows.select("work", key).distinct()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("works"))


def works_by_country(works: DataFrame, distinct_works: bool = False) -> DataFrame:
    """Rows per country over (work, author, institution); null is a group.

    ``distinct_works`` counts each work once per country instead.
    """
    rows = (works.select(F.col("id").alias("work"),
                         F.explode("authors.institutions").alias("institutions"))
            .select("work", F.explode("institutions.country").alias("country")))
    return _count_works(rows, "country", distinct_works)


def works_by_concept(works: DataFrame, distinct_works: bool = False) -> DataFrame:
    rows = works.select(F.col("id").alias("work"), F.explode("concepts.name").alias("concept"))
    return _count_works(rows, "concept", distinct_works)


def works_by_topic(works: DataFrame, topic: str = "primary_topic_flat") -> DataFrame:
    return (works.select(F.col(topic).alias("topic"))
            .groupBy("topic").agg(F.count(F.lit(1)).alias("works")))


def citation_distribution(works: DataFrame, keep_id: bool = False) -> DataFrame:
    """Per work: the last yearly count (``citation_count``) and the sum of all."""
    columns = [last_count(F.col("citations")).alias("citation_count"),
               total_count(F.col("citations")).alias("total_citations")]
    return works.select(*([F.col("id").alias("work")] if keep_id else []), *columns)


def in_order(counts: DataFrame, key: str, n: str = "works") -> DataFrame:
    """Ascending by count, the key breaking ties."""
    return counts.orderBy(n, key)


def top(counts: DataFrame, key: str, limit: int = 20, n: str = "works") -> DataFrame:
    return counts.orderBy(F.desc(n), key).limit(limit)


def over(counts: DataFrame, minimum: int, n: str = "works") -> DataFrame:
    return counts.filter(F.col(n) > minimum)


def merge_small(counts: DataFrame, key: str, minimum: int, other: str = "other",
                n: str = "works") -> DataFrame:
    """Groups below ``minimum`` become one group ``other``."""
    merged = F.when(F.col(n) < minimum, F.lit(other)).otherwise(F.col(key))
    return counts.groupBy(merged.alias(key)).agg(F.sum(n).alias(n))


def shares(counts: DataFrame, n: str = "works", share: str = "share") -> DataFrame:
    """Each group's part of the whole (null if that is zero); one scalar subquery."""
    return counts.withColumn(share, F.try_divide(F.col(n), counts.select(F.sum(n)).scalar()))


def histogram(df: DataFrame, column: str, width: float = 1.0) -> DataFrame:
    """``(bucket, works)``: lower bound of each bucket and its rows."""
    return (df.select((F.floor(F.col(column) / width) * width).alias("bucket"))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("works")))


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """Exact minimum, quartiles (interpolated between neighbouring ranks) and maximum.

    Values are counted, and counts summed up in order over range partitions. The value of
    a rank is then the smallest one whose running count exceeds it: a minimum, combined on
    the map side. Nulls don't count.
    """
    counted = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"))
               .agg(F.count(F.lit(1)).alias("n")))
    placed = materialize(running_sum(counted, ["v"], ["n"], "box"), "box")
    last = placed.select((F.max("cum_n") - 1).alias("last")).scalar()
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("cum_n") > rank, F.col("v")))

    rows = placed.withColumn("_last", last)
    parts = []
    for name, share in quarters.items():
        place = F.col("_last") * share
        parts += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"),
                  F.max(place - F.floor(place)).alias(f"{name}_part")]
    found = rows.agg(F.min("v").alias("minimum"), *parts, F.max("v").alias("maximum"))
    return found.select("minimum", *[
        (F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * F.col(f"{q}_part")).alias(q)
        for q in quarters], "maximum")


def distinct_sketches(rows: DataFrame, column: str, by: str, log_k: int = 14) -> DataFrame:
    """``(by, sketch)``: a HyperLogLog sketch of the distinct values per slice, some 16 kB
    each, to be stored beside the slices."""
    return rows.groupBy(by).agg(F.hll_sketch_agg(column, log_k).alias("sketch"))


def distinct_estimate(sketches: DataFrame, name: str = "n") -> DataFrame:
    """The distinct values of all slices together, within about 2 %, from their sketches
    alone; a new slice adds its sketch and no old row is read again."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
                        .cast("bigint").alias(name))


def mean_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def per_capita(papers: DataFrame, population: DataFrame, key: str, per: int = 1000) -> DataFrame:
    """``works`` per ``per`` persons, largest first; population in ``persons``. Null
    (and last) where nobody lives."""
    return (papers.join(population, key)
            .withColumn("papers_per_capita", F.try_divide("works", "persons") * per)
            .orderBy(F.desc("papers_per_capita"), key))
