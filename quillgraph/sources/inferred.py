"""JSON lines under a schema found in the lines themselves, brought to a wanted shape.

The schemas of all lines are merged by Spark's aggregate over VARIANT. Where lines differ
in the type of a field, the merged type is a variant: such a field is read as text and cast,
so that a number that sometimes stands in quotes is still a number, and what can't be cast
is null. Fields that no line has are null; fields that nobody asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.schemas import RAW_WORK
from quillgraph.sources.snapshot import read_lines

IS_OBJECT = "schema_of_variant({}) LIKE 'OBJECT<%'"


def merged_schema(lines: DataFrame, sample: float = 1.0) -> T.StructType:
    """The merged schema of all lines (``value``) that hold a JSON object; fields of
    conflicting types are VARIANT, fields that are always null VOID. Combined on the map
    side; one row comes to the driver. ``sample`` reads a share of the lines only."""
    some = lines if sample >= 1 else lines.sample(sample, seed=42)
    found = (some.select(F.try_parse_json("value").alias("parsed")).filter(IS_OBJECT.format("parsed"))
             .agg(F.schema_of_variant_agg("parsed")).first()[0])
    if found is None or not found.startswith("OBJECT<"):
        return T.StructType()
    return T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))


def conflicts(found: T.DataType, prefix: str = "") -> list[str]:
    """Paths whose type differs between lines."""
    if isinstance(found, T.VariantType):
        return [prefix]
    if isinstance(found, T.ArrayType):
        return conflicts(found.elementType, prefix + "[]")
    if isinstance(found, T.StructType):
        return [p for f in found.fields
                for p in conflicts(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return []


def reading(found: T.DataType | None, wanted: T.DataType) -> T.DataType:
    """The type under which a field is parsed: of the wanted shape, scalars as found, and as
    text below a conflict, where nothing is known."""
    unknown = found if isinstance(found, T.VariantType) else None
    if isinstance(wanted, T.StructType):
        held = {f.name: f.dataType for f in found.fields} if isinstance(found, T.StructType) else {}
        return T.StructType([T.StructField(f.name, reading(held.get(f.name, unknown), f.dataType))
                             for f in wanted.fields])
    if isinstance(wanted, T.ArrayType):
        inner = found.elementType if isinstance(found, T.ArrayType) else unknown
        return T.ArrayType(reading(inner, wanted.elementType))
    if found is None or isinstance(found, T.NullType):
        return wanted
    if isinstance(found, (T.StructType, T.ArrayType, T.VariantType)):
        return T.StringType()
    return T.DoubleType() if isinstance(found, T.DecimalType) else found


def shaped(value: Column, read: T.DataType, wanted: T.DataType) -> Column:
    """``value`` of type ``read`` as ``wanted``: scalars are cast, null where they can't be."""
    if read == wanted:
        return value
    if isinstance(wanted, T.StructType):
        held = {f.name: f.dataType for f in read.fields}
        made = F.struct(*[shaped(value.getField(f.name), held[f.name], f.dataType).alias(f.name)
                          for f in wanted.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: shaped(x, read.elementType, wanted.elementType))
    return value.try_cast(wanted)


def read_inferred(spark: SparkSession, source: str | list[str], *,
                  wanted: T.StructType = RAW_WORK, pattern: str = "*.gz",
                  sample: float = 1.0) -> DataFrame:
    """The lines of a folder in the shape ``wanted``. Lines that hold no JSON object are
    dropped. Two passes over the files: one merges the schemas, one reads."""
    lines = read_lines(spark, source, pattern)
    parse = reading(merged_schema(lines, sample), wanted)
    objects = lines.filter(IS_OBJECT.format("try_parse_json(value)"))
    rows = objects.select(F.from_json("value", parse).alias("r"))
    return rows.select(*[shaped(F.col("r").getField(f.name), parse[f.name].dataType, f.dataType)
                         .alias(f.name) for f in wanted.fields])
