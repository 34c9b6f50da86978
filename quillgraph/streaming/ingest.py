"""Incremental, restartable ingestion of a growing snapshot folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.schemas import RAW_WORK
from quillgraph.sinks.writers import write_parquet
from quillgraph.sources.snapshot import compact_work, count_dropped, json_options

# Below the target; readers of the target pass over names that begin so.
MANIFEST = "_manifest"


def stream_snapshot(spark: SparkSession, source: str, *, schema: T.StructType = RAW_WORK,
                    pattern: str = "*.gz", files_per_batch: int | None = None,
                    counted: bool = False) -> DataFrame:
    """Streaming scan of the folder; new files are taken once. ``counted`` keeps lines that
    don't parse, for :func:`count_dropped`."""
    reader = json_options(spark.readStream, pattern, schema=schema, counted=counted)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(source)


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, *,
               transform: Callable[[DataFrame], DataFrame] = compact_work,
               files_per_batch: int | None = None, zstd_level: int = 17) -> None:
    """Process every file not seen before, then stop.

    The checkpoint holds what is planned and what is committed: a run that
    fails or is stopped is taken up where it was, and files are written exactly
    once. A failing task fails the call.
    """
    rows = transform(stream_snapshot(spark, source, files_per_batch=files_per_batch))
    query = (rows.writeStream.format("parquet").outputMode("append")
             .option("path", target).option("checkpointLocation", checkpoint)
             .option("compression", "zstd")
             .option("parquet.compression.codec.zstd.level", str(zstd_level))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def ingest_batches(spark: SparkSession, source: str, target: str, checkpoint: str, *,
                   transform: Callable[[DataFrame], DataFrame] = compact_work,
                   schema: T.StructType = RAW_WORK, pattern: str = "*.gz",
                   files_per_batch: int | None = None, zstd_level: int = 17,
                   before_commit: Callable[[int], None] | None = None) -> None:
    """Process every file not seen before, batch by batch, then stop.

    A batch is written to a folder of its own, named by its number, and counts once its
    entry in the manifest is there: lines read, lines that didn't parse. The number of a
    batch and its files are fixed in the checkpoint before it is processed, so a batch
    that is processed again, after a failure at any point, replaces its folder and its
    entry. ``before_commit`` runs between both. Read the result by :func:`read_ingested`.
    """
    rows = stream_snapshot(spark, source, schema=schema, pattern=pattern,
                           files_per_batch=files_per_batch, counted=True)

    def process(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        write_parquet(transform(count_dropped(batch, seen)), f"{target}/batch={number}",
                      zstd_level=zstd_level)
        if before_commit is not None:
            before_commit(number)
        counts = seen.get
        entry = batch.sparkSession.createDataFrame(
            [(counts["lines"], counts["dropped"])], "lines bigint, dropped bigint")
        entry.coalesce(1).write.mode("overwrite").json(f"{target}/{MANIFEST}/batch={number}")

    query = (rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """``(batch, lines, dropped)`` of the batches that are done."""
    return (spark.read.schema("lines bigint, dropped bigint, batch bigint")
            .json(f"{target}/{MANIFEST}").select("batch", "lines", "dropped"))


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all batches that are done, with their ``batch``; folders of others are
    pruned."""
    rows = spark.read.parquet(target)
    done = manifest(spark, target).select(F.col("batch").cast(rows.schema["batch"].dataType))
    return rows.join(done, "batch", "left_semi")
