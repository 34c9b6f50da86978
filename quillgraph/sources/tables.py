"""Table scans: Parquet collections, row ranges, pending documents, matrices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.columns import metadata_name, parse_day, rename_columns
from quillgraph.operators.skew import as_build_side
from quillgraph.schemas import COMPACT_WORK, narrow

# Rows per slice of the document collection.
SLICE_ROWS = 500_000


def read_works(spark: SparkSession, *paths: str, leaves: list[str] | None = None,
               schema: T.StructType = COMPACT_WORK) -> DataFrame:
    """Compact works from any number of Parquet paths or globs.

    ``leaves`` names the only fields to read, nested ones by dotted path.
    """
    reader = spark.read if leaves is None else spark.read.schema(narrow(schema, leaves))
    return reader.parquet(*paths)


def read_metadata(df: DataFrame, prefix: str = "arxiv_",
                  date_column: str = "update_date") -> DataFrame:
    """Preprint metadata: text date to timestamp, all columns renamed."""
    dated = df.withColumn(date_column, parse_day(F.col(date_column)))
    return rename_columns(dated, metadata_name(prefix))


def read_slice(df: DataFrame, head: int, tail: int, row_id: str = "row_id") -> DataFrame:
    """Rows of the half-open range [head, tail)."""
    return df.filter((F.col(row_id) >= head) & (F.col(row_id) < tail))


def read_slice_range(spark: SparkSession, path: str, head: int, tail: int,
                     row_id: str = "row_id", step: int = SLICE_ROWS) -> DataFrame:
    """Rows of [head, tail) from a collection stored by ``slice_head``: the range of rows
    is also a range of folders, and only these are listed and read."""
    folders = (F.col("slice_head") >= head - head % step) & (F.col("slice_head") < tail)
    return read_slice(spark.read.parquet(path).filter(folders), head, tail, row_id)


def with_slice(df: DataFrame, row_id: str = "row_id", step: int = SLICE_ROWS) -> DataFrame:
    """Add ``slice_head``, the first row id of each row's slice."""
    return df.withColumn("slice_head", F.col(row_id) - F.pmod(F.col(row_id), F.lit(step)))


def slices(df: DataFrame, row_id: str = "row_id", step: int = SLICE_ROWS) -> DataFrame:
    """The plan of half-open slices covering all row ids: ``(slice_head, slice_tail)``."""
    end = df.agg((F.max(row_id) + 1).alias("end"))
    return (end.filter(F.col("end").isNotNull())
            .select("end", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end") - 1,
                                                F.lit(step).cast("bigint"))).alias("slice_head"))
            .select("slice_head",
                    F.least(F.col("slice_head") + step, F.col("end")).alias("slice_tail")))


def slice_status(plan: DataFrame, done: DataFrame) -> DataFrame:
    """One row ``(total, done, backlog)`` from the plan and the finished slices."""
    finished = done.select("slice_head").distinct().withColumn("_done", F.lit(1))
    return (plan.join(finished, "slice_head", "left")
            .agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("done"))
            .withColumn("backlog", F.col("total") - F.col("done")))


def pending(papers: DataFrame, key: str = "arxiv_doi", attached: str = "alex") -> DataFrame:
    """Papers that have a key but nothing attached yet."""
    missing = F.col(attached).isNull() if attached in papers.columns else F.lit(True)
    return papers.filter(F.col(key).isNotNull() & missing)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Vectors ``(id, features)`` or edges ``(src, dst)`` as written by the sinks."""
    return spark.read.parquet(path)


def lookup_terms(rows: DataFrame, vocabulary: DataFrame, ix: str, term: str = "term",
                 name: str | None = None) -> DataFrame:
    """Inverse lookup: add the term of each index, null where there is none.

    The vocabulary is cut to the asked indexes first, so that a few rows (a top k) don't
    sort all of it.
    """
    terms = vocabulary.select(F.col("ix").alias(ix), F.col(term).alias(name or term))
    asked = rows.select(ix).distinct()
    return rows.join(terms.join(as_build_side(asked), ix, "left_semi"), ix, "left")


# Folders of a word index; a word's folder follows from its hash.
WORD_BUCKETS = 64


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_word_index(works: DataFrame, target: str, *, key: str = "id", column: str = "title",
                     buckets: int = WORD_BUCKETS, splits: int = 4) -> None:
    """``(bucket, word, key)``: the distinct words (runs of letters and digits, lower case)
    of each work, in folders by bucket, sorted by word in every file, so that a reader
    skips folders, and row groups by their word range. ``splits`` tasks share a bucket, so
    that a word of a third of all works is not one task's."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)")))
    rows = works.select(key, F.explode(words).alias("word")).withColumn(
        "bucket", _bucket(F.col("word"), buckets))
    (rows.repartition(buckets * splits, "bucket", F.pmod(F.xxhash64(key), F.lit(splits)))
     .sortWithinPartitions("bucket", "word").write.mode("overwrite")
     .partitionBy("bucket").parquet(target))


def word_search(spark: SparkSession, index: str, text: str, *, key: str = "id",
                buckets: int = WORD_BUCKETS) -> DataFrame:
    """Keys of the works that have every word of ``text`` as a whole word, found by
    counting the asked words per work; only the words' own lists are read."""
    words = sorted(set(re.findall(r"[^\W_]+", text.lower())))
    if not words:
        return spark.read.parquet(index).select(key).limit(0)
    asked = F.lit(False)
    for word in words:
        asked = asked | ((F.col("bucket") == _bucket(F.lit(word), buckets)) & (F.col("word") == word))
    found = spark.read.parquet(index).filter(asked).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") == len(words)).select(key)


def title_search(works: DataFrame, text: str, column: str = "title") -> DataFrame:
    """Works whose title contains every word of ``text`` (also inside a word), ignoring case."""
    found = F.lit(True)
    for word in text.lower().split():
        found = found & F.lower(F.col(column)).contains(word)
    return works.filter(found)
