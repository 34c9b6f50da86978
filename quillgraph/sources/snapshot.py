"""Snapshot ingestion: JSON lines → compact nested works."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.columns import (DOI_PREFIX, ID_PREFIX, null_to_empty, path, pluck,
                                          reshape, strip_each, strip_prefix)
from quillgraph.functions.spec import WORK_SPEC, Spec, clean_extracted, extract
from quillgraph.schemas import RAW_WORK


def read_snapshot(spark: SparkSession, source: str | list[str], *,
                  schema: T.StructType = RAW_WORK, pattern: str = "*.gz",
                  partitions: int | None = None) -> DataFrame:
    """Recursive scan of JSON lines under a fixed schema, malformed lines dropped.

    gz files cannot be split, so parallelism equals the number of files.
    ``partitions`` spreads the rows again when the files are few and large.
    """
    df = json_options(spark.read, pattern, schema=schema).json(source)
    return df.repartition(partitions) if partitions else df


# Holds the text of a line that doesn't parse while lines are counted.
CORRUPT = "_corrupt_line"


def json_options(reader, pattern: str = "*.gz", *, schema: T.StructType, counted: bool = False):
    """The options that batch and streaming readers of JSON lines share."""
    reader = (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
              .option("mode", "PERMISSIVE" if counted else "DROPMALFORMED"))
    if not counted:
        return reader.schema(schema)
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(whole).option("columnNameOfCorruptRecord", CORRUPT)


def count_dropped(rows: DataFrame, seen: Observation) -> DataFrame:
    """``rows`` without the lines that don't parse; ``seen`` gets ``lines`` and ``dropped``
    of the same pass, once an action has run."""
    return (rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(CORRUPT).alias("dropped"))
            .filter(F.col(CORRUPT).isNull()).drop(CORRUPT))


def read_counted(spark: SparkSession, source: str | list[str], *, schema: T.StructType = RAW_WORK,
                 pattern: str = "*.gz") -> tuple[DataFrame, Observation]:
    """Like :func:`read_snapshot`, with the count of lines and of dropped ones: after the
    first action on the rows ``observation.get`` holds ``lines`` and ``dropped``. Blank
    lines are no lines."""
    seen = Observation("snapshot-lines")
    rows = json_options(spark.read, pattern, schema=schema, counted=True).json(source)
    return count_dropped(rows, seen), seen


def skipped_files(spark: SparkSession, source: str | list[str], pattern: str = "*.gz") -> DataFrame:
    """``(path, bytes)`` of the files in the folders that ``pattern`` leaves out."""
    def listed(**options: str) -> DataFrame:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .options(**options).load(source).select("path", F.col("length").alias("bytes")))

    return listed().join(listed(pathGlobFilter=pattern).select("path"), "path", "left_anti")


def read_lines(spark: SparkSession, source: str | list[str], pattern: str = "*.gz") -> DataFrame:
    """The raw text lines of the same files, one ``value`` each."""
    return (spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).text(source))


def compact_work(raw: DataFrame, columns: Iterable[str] | None = None, *,
                 strip: Callable[[Column, str], Column] = strip_prefix,
                 null_doi_as_empty: bool = False) -> DataFrame:
    """Pick, rename and shorten the fields of raw works; one narrow projection.

    Null arrays stay null. ``columns`` names the compact columns wanted, all by
    default. ``strip=trim_prefix_legacy`` gives the older ids.
    """
    def short(c: Column) -> Column:
        return strip(c, ID_PREFIX)

    def at(dotted: str) -> Callable[[Column], Column]:
        return lambda x: path(x, dotted)

    def id_at(dotted: str) -> Callable[[Column], Column]:
        return lambda x: short(path(x, dotted))

    def institutions(author: Column) -> Column:
        return reshape(author.getField("institutions"), id=id_at("id"),
                       name=at("display_name"), country=at("country_code"))

    def doi() -> Column:
        bare = strip(F.col("doi"), DOI_PREFIX)
        return null_to_empty(bare) if null_doi_as_empty else bare

    def same(name: str) -> Callable[[], Column]:
        return lambda: F.col(name)

    def topic() -> Column:
        main = F.col("primary_topic")
        return F.struct(path(main, "display_name").alias("name"),
                        path(main, "domain.display_name").alias("domain"),
                        path(main, "field.display_name").alias("field"))

    makers: dict[str, Callable[[], Column]] = {
        "id": lambda: short(F.col("id")),
        "doi": doi,
        "title": same("title"),
        "publication_date": same("publication_date"),
        "country_codes": same("country_codes"),
        "authors": lambda: reshape(
            F.col("authorships"), id=id_at("author.id"), name=at("author.display_name"),
            institutions=institutions),
        "concepts": lambda: reshape(
            F.col("concepts"), id=id_at("id"), name=at("display_name"), score=at("score")),
        "topics": lambda: reshape(
            F.col("topics"), id=id_at("id"), name=at("display_name"),
            domain=at("domain.display_name"), field=at("field.display_name")),
        "primary_topic": topic,
        "referenced_works": lambda: strip_each(F.col("referenced_works"), short),
        "related_works": lambda: strip_each(F.col("related_works"), short),
        "keywords": lambda: pluck(F.col("keywords"), "display_name"),
        "citations": lambda: reshape(
            F.col("counts_by_year"), year=at("year"), count=at("cited_by_count")),
    }
    wanted = makers if columns is None else [c for c in makers if c in set(columns)]
    return raw.select(*[makers[name]().alias(name) for name in wanted])


def add_flat_columns(works: DataFrame, concept_score: float = 0.5) -> DataFrame:
    """``primary_topic_flat`` (the topic's field) and ``high_concepts_flat``
    (names of concepts scoring at least ``concept_score``). Our definitions;
    each is added where its source column is there."""
    added = {}
    if "primary_topic" in works.columns:
        added["primary_topic_flat"] = F.col("primary_topic.field")
    if "concepts" in works.columns:
        high = F.filter(F.col("concepts"), lambda c: c.getField("score") >= concept_score)
        added["high_concepts_flat"] = F.array_join(high.getField("name"), ", ")
    return works.withColumns(added) if added else works


def extract_strict(lines: DataFrame, spec: Spec = WORK_SPEC) -> tuple[DataFrame, DataFrame]:
    """Strict mode: (clean works, rejected lines with reasons)."""
    good, rejects = extract(lines, spec)
    return (clean_extracted(good) if spec is WORK_SPEC else good), rejects


def ingest(spark: SparkSession, source: str | list[str], mode: str = "lenient",
           pattern: str = "*.gz") -> DataFrame:
    """Snapshot folder → compact works, ``lenient`` (nulls kept) or ``strict``."""
    if mode == "lenient":
        return compact_work(read_snapshot(spark, source, pattern=pattern))
    if mode == "strict":
        return extract_strict(read_lines(spark, source, pattern))[0]
    raise ValueError(f"unknown mode {mode!r}")


def infer_schema(spark: SparkSession, source: str | list[str],
                 sampling_ratio: float = 1.0) -> DataFrame:
    """Inferred schema of JSON lines as rows ``(path, type)``."""
    schema = spark.read.option("samplingRatio", sampling_ratio).json(source).schema
    rows: list[tuple[str, str]] = []

    def visit(prefix: str, kind: T.DataType) -> None:
        rows.append((prefix, kind.typeName()))
        if isinstance(kind, T.ArrayType):
            visit(prefix + "[]", kind.elementType)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{prefix}.{f.name}", f.dataType)

    for f in schema.fields:
        visit(f.name, f.dataType)
    return spark.createDataFrame(rows, "path string, type string")
