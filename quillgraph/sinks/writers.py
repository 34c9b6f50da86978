"""Writers for works, slices, graphs, vocabularies and models."""

from __future__ import annotations

import math
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import graph_edges, graph_nodes
from quillgraph.operators.ordering import running_sum
from quillgraph.operators.skew import as_build_side
from quillgraph.session import materialize, new_path

# Level chosen for the published collection.
ZSTD_LEVEL = 17
_LEVEL_OPTION = "parquet.compression.codec.zstd.level"


def write_parquet(df: DataFrame, target: str, *, mode: str = "overwrite",
                  codec: str | None = None, zstd_level: int | None = None,
                  rows_per_file: int | None = None) -> None:
    """Parquet writer; ``mode="errorifexists"`` refuses an existing target.

    ``zstd_level`` implies the zstd codec. ``rows_per_file`` bounds file sizes.
    """
    writer = df.write.mode(mode)
    if zstd_level is not None:
        writer = writer.option("compression", "zstd").option(_LEVEL_OPTION, str(zstd_level))
    elif codec is not None:
        writer = writer.option("compression", codec)
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(target)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes)`` of the Parquet files below a path, from their listing."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(path))
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"),
                         F.col("length").alias("bytes"))


# Files that one task writes, where equally many rows fill them, and how many more files than
# the bytes need are few enough for that.
TASK_FILES, SPARE_FILES = 64, 1.25


def write_bounded(df: DataFrame, target: str, max_bytes: int, *, codec: str | None = None,
                  zstd_level: int | None = None, fill: float = 0.95, attempts: int = 6) -> int:
    """Parquet files of at most ``max_bytes`` bytes as stored; returns how many.

    A first write below the work folder shows how many bytes the rows of each of its files
    take, and running sums give every row its place in the whole. Files get equally many rows
    first, ``TASK_FILES`` of them from each task, fewer rows as long as one is too large. If
    rows differ so much that this takes ``SPARE_FILES`` times the files that the bytes need,
    files are cut by bytes: each output partition is one file of about ``fill`` of the bound,
    cut again, smaller, should one still be larger. Rows keep their order. A single row above
    the bound is an error.
    """
    spark = df.sparkSession
    first = new_path(spark, "sized")
    write_parquet(df, first, codec=codec, zstd_level=zstd_level)
    rows = spark.read.schema(df.schema).parquet(first)
    counted = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"))
    sizes = counted.join(as_build_side(file_sizes(spark, first)), "name")
    placed = running_sum(sizes, ["name"], ["bytes", "rows"], "file-places").select(
        "name", (F.col("cum_bytes") - F.col("bytes")).alias("_before"),
        (F.col("cum_rows") - F.col("rows")).alias("_first"),
        (F.col("bytes") / F.col("rows")).alias("_each"))
    placed = materialize(placed, "file-places")
    total, count, each = sizes.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)),
        F.coalesce(F.max(F.col("bytes") / F.col("rows")), F.lit(0.0))).first()
    at = rows.select("*", F.col("_metadata.file_name").alias("name"),
                     F.col("_metadata.row_index").alias("_row"))
    at = at.join(as_build_side(placed), "name")

    def written(parts: int, part: Column, rows_per_file: int | None = None) -> tuple[int, int, int]:
        """Files, bytes and the largest file of a write in ``parts`` tasks."""
        out = at.repartitionById(parts, F.least(F.floor(part), F.lit(parts - 1)).cast("int"))
        write_parquet(out.sortWithinPartitions("_first", "_row").select(*df.columns), target,
                      codec=codec, zstd_level=zstd_level, rows_per_file=rows_per_file)
        return file_sizes(spark, target).agg(F.count(F.lit(1)), *[
            F.coalesce(f("bytes"), F.lit(0)) for f in (F.sum, F.max)]).first()

    per_file = max(1, int(max_bytes * fill / each)) if each else 1
    for _ in range(attempts):
        together = min(TASK_FILES, max(1, math.ceil(
            count / per_file / spark.sparkContext.defaultParallelism))) * per_file
        files, stored, largest = written(max(1, math.ceil(count / together)),
                                         (F.col("_first") + F.col("_row")) / together, per_file)
        if largest <= max_bytes:
            if files <= SPARE_FILES * math.ceil(stored / (max_bytes * fill)):
                return files
            break
        if per_file == 1 or not count:
            break
        per_file = max(1, int(per_file * fill * max_bytes / largest))
    place = F.col("_before") + F.col("_row") * F.col("_each")
    fill *= min(1.0, total / max(stored, 1))  # small files take more bytes than the first ones
    for _ in range(attempts if largest <= max_bytes or per_file > 1 else 0):
        bound = F.lit(max_bytes * fill)
        files, _, largest = written(max(1, math.ceil(total / (max_bytes * fill))), place / bound)
        if largest <= max_bytes:
            return files
        fill *= 0.95 * max_bytes / largest
    raise ValueError(f"files of at most {max_bytes} bytes can't hold these rows: {largest} needed")


def write_slices(df: DataFrame, target: str, zstd_level: int = ZSTD_LEVEL) -> None:
    """One folder per ``slice_head``; writing a slice again replaces just that slice."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").option(_LEVEL_OPTION, str(zstd_level))
     .partitionBy("slice_head").parquet(target))


def append(df: DataFrame, target: str, rows_per_file: int | None = None) -> None:
    """Add rows to a collection."""
    write_parquet(df, target, mode="append", rows_per_file=rows_per_file)


def write_graph(edges: DataFrame, folder: str) -> None:
    """CSV export: ``graph`` with (target, source), ``metadata`` with (id, color)."""
    graph_edges(edges).write.mode("overwrite").option("header", "true").csv(f"{folder}/graph")
    graph_nodes(edges).write.mode("overwrite").option("header", "true").csv(f"{folder}/metadata")


def write_vocabulary(vocab: DataFrame, target: str, form: str = "parquet") -> None:
    """``(term, ix)`` as Parquet or JSON lines."""
    vocab.select("term", "ix").write.mode("overwrite").format(form).save(target)


def save_model(model, target: str) -> None:
    """Save a fitted ``pyspark.ml`` model."""
    model.write().overwrite().save(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(location).getLength())


_RUN = 4_096  # rows that stay together when rows are dealt out


def dealt_out(df: DataFrame, parts: int) -> DataFrame:
    """``df`` in ``parts`` partitions of about equal size, in runs that keep their order."""
    at = F.monotonically_increasing_id()
    dealt = df.withColumn("_at", at).repartitionById(
        parts, F.pmod(F.floor(F.col("_at") / _RUN), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("_at").drop("_at")


def codec_profile(df: DataFrame, levels: Iterable[int] = range(1, 23),
                  repeats: int = 1) -> DataFrame:
    """Mean bytes and nanoseconds of a zstd write per level.

    Compression takes nearly all the time, so the rows are dealt out once over files that
    keep all cores busy at every level, whatever the files they came from.
    """
    spark = df.sparkSession
    df = materialize(dealt_out(df, 2 * spark.sparkContext.defaultParallelism), "profiled")
    rows = []
    for level in levels:
        for _ in range(repeats):
            target = new_path(spark, f"zstd-{level}")
            begun = time.time_ns()
            write_parquet(df, target, mode="errorifexists", zstd_level=level)
            rows.append((level, stored_bytes(spark, target), time.time_ns() - begun))
    measured = spark.createDataFrame(rows, "level int, size bigint, time bigint")
    return (measured.groupBy("level").agg(F.avg("time").alias("time"), F.avg("size").alias("size"))
            .orderBy("level"))
