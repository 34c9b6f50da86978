"""Adapter: the given relational test tables as scholarly works.

work = order, author = part, authorship = line item, institution = supplier,
country = nation, concept = part type, topic = (part type, brand).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.columns import DOI_PREFIX, ID_PREFIX
from quillgraph.operators.graph import TEAM_SIZE
from quillgraph.operators.skew import groups_of_size, parts_of
from quillgraph.schemas import RAW_WORK
from quillgraph.sources.snapshot import add_flat_columns, compact_work

DOI_STEM = "10.1000/"


# Schemas already read from a table's footer; saves one small job per use.
_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    """Test tables of one scale factor, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)


def mentions(t: Tables) -> DataFrame:
    """``(work, author)``, one row per line item."""
    return t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("author"))


def positioned(t: Tables) -> DataFrame:
    """``(work, author, position)``; equal positions are told apart by the author."""
    return t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("author"),
                             F.col("l_linenumber").alias("position"))


def authorships(t: Tables, smallest: int = 1, largest: int | None = None) -> DataFrame:
    """``(work, author, team_size)`` of works with a team size in the range.

    Nested works know their team size; the flat line items are counted here, and dealt
    out over more tasks than run at a time if they are that many.
    """
    parts = parts_of(t.lineitem.count(), t.lineitem)
    many = parts > t.spark.sparkContext.defaultParallelism
    return groups_of_size(mentions(t), "work", ["author"], smallest, largest, "team_size",
                          parts if many else None)


def small_teams(t: Tables, largest: int = TEAM_SIZE[1]) -> DataFrame:
    """``(work, team)`` of works with at most ``largest`` line items.

    Larger works are left out before teams are put together, so no array is
    longer than ``largest``.
    """
    return (authorships(t, 1, largest).groupBy("work")
            .agg(F.collect_list("author").alias("team")))


def team_works(t: Tables) -> DataFrame:
    """Compact works with ``id`` and ``authors.id`` only, one per order with lines."""
    return (mentions(t).groupBy("work").agg(F.collect_list(F.struct(
        F.col("author").alias("id"))).alias("authors")).withColumnRenamed("work", "id"))


def lines(t: Tables, fields: Iterable[str]) -> DataFrame:
    """Line items with the given fields, joined with the tables these are in."""
    fields = sorted(set(fields))
    rows = t.lineitem.withColumn("year", F.year("l_shipdate").cast("bigint"))
    if any(f.startswith("p_") for f in fields):
        rows = rows.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    if any(f.startswith(("s_", "n_")) for f in fields):
        rows = rows.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    if any(f.startswith("n_") for f in fields):
        rows = rows.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("l_orderkey", *fields)


def mention_works(t: Tables, institutions: bool = True) -> DataFrame:
    """Compact works with one authorship each, so an order is several rows.

    For counts over authorships or distinct ids, which do not depend on how the
    lines of an order are split into rows. Nothing is grouped.
    """
    fields = [F.col("l_partkey").alias("id")]
    if institutions:
        fields.append(F.array(F.struct(
            F.col("l_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.col("n_name").alias("country"))).alias("institutions"))
    rows = lines(t, ["l_partkey", *(["l_suppkey", "s_name", "n_name"] if institutions else [])])
    return rows.select(F.col("l_orderkey").alias("id"), F.array(F.struct(*fields)).alias("authors"))


def _ident(kind: str, c: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX + kind), c.cast("string"))


def _named(c: Column) -> Column:
    return F.struct(c.alias("display_name"), _ident("F", c).alias("id"))


def _topic(x: Column) -> Column:
    kind, brand = x.getField("p_type"), x.getField("p_brand")
    name = F.concat_ws("/", kind, brand)
    return F.struct(name.alias("display_name"), _named(kind).alias("domain"),
                    _named(brand).alias("field"), _ident("T", name).alias("id"),
                    F.lit(None).cast("double").alias("score"), _named(brand).alias("subfield"))


def _share(e: Column, name: str, v: Column) -> Column:
    return F.size(F.filter(e, lambda x: x.getField(name) == v))


def _authorship(x: Column) -> Column:
    return F.struct(
        F.struct(x.getField("p_name").alias("display_name"),
                 _ident("A", x.getField("l_partkey")).alias("id"),
                 F.lit(None).cast("string").alias("orcid")).alias("author"),
        F.array(x.getField("n_name")).alias("countries"),
        F.array(F.struct(x.getField("n_name").alias("country_code"),
                         x.getField("s_name").alias("display_name"),
                         _ident("I", x.getField("l_suppkey")).alias("id"))).alias("institutions"))


def _concepts(e: Column) -> Column:
    return F.transform(F.array_distinct(e.getField("p_type")), lambda v: F.struct(
        v.alias("display_name"), _ident("C", v).alias("id"),
        F.lit(0).cast("bigint").alias("level"),
        (_share(e, "p_type", v) / F.size(e)).alias("score"),
        F.lit(None).cast("string").alias("wikidata")))


def _keywords(e: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(e.getField("l_returnflag"))), lambda v:
                       F.struct(v.alias("display_name"), _ident("K", v).alias("id"),
                                F.lit(1.0).alias("score")))


def _counts_by_year(e: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(e.getField("year"))), lambda v: F.struct(
        _share(e, "year", v).cast("bigint").alias("cited_by_count"), v.alias("year")))


def _primary_topic(e: Column) -> Column:
    return F.array_min(F.transform(e, lambda x: F.struct(
        x.getField("l_partkey").alias("k"), _topic(x).alias("t")))).getField("t")


def _topics(e: Column) -> Column:
    return F.transform(F.array_distinct(F.transform(e, lambda x: F.struct(
        x.getField("p_type").alias("p_type"), x.getField("p_brand").alias("p_brand")))), _topic)


def _suppliers(e: Column) -> Column:
    return F.transform(F.array_distinct(e.getField("l_suppkey")), lambda v: _ident("W", v))


# List columns of a raw record: the line fields they need and how they are made.
_NESTED = {
    "authorships": (("l_partkey", "l_suppkey", "p_name", "s_name", "n_name"),
                    lambda e: F.transform(e, _authorship)),
    "concepts": (("p_type",), _concepts),
    "counts_by_year": (("year",), _counts_by_year),
    "keywords": (("l_returnflag",), _keywords),
    "primary_topic": (("l_partkey", "p_type", "p_brand"), _primary_topic),
    "topics": (("p_type", "p_brand"), _topics),
    "country_codes": (("n_name",), lambda e: F.array_distinct(e.getField("n_name"))),
    "referenced_works": (("l_suppkey",), _suppliers),
    "related_works": (("l_suppkey",), _suppliers),
}


def raw_works(t: Tables, columns: Iterable[str] | None = None) -> DataFrame:
    """Raw records in the snapshot's schema, one per order.

    The lines of an order are put in one row because one row is what a record
    of the source format is; real snapshots arrive so. Orders without lines
    have null lists. Lists not named in ``columns`` are left out, and so are the
    tables only they need.
    """
    wanted = set(_NESTED if columns is None else columns) & set(_NESTED)
    fields = {"l_linenumber", "l_partkey", "l_suppkey"}.union(*(_NESTED[c][0] for c in wanted))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    entry = F.struct(*order, *sorted(fields - set(order)))
    nested = (lines(t, fields).groupBy("l_orderkey")
              .agg(F.array_sort(F.collect_list(entry)).alias("e")))
    e, key = F.col("e"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title = F.concat(F.lit("Order "), key.cast("string"))
    scalars = {
        "id": _ident("W", key), "title": title, "display_name": title,
        "doi": F.concat(F.lit(DOI_PREFIX + DOI_STEM), key.cast("string")),
        "publication_date": day, "created_date": day,
    }
    joined = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    made = {**scalars, **{c: _NESTED[c][1](e) for c in wanted}}
    return joined.select(*[made[f.name].cast(f.dataType).alias(f.name)
                           for f in RAW_WORK.fields if f.name in made])


# Lists whose entries are counts of a value with few different ones.
_COUNTED = {"concepts": "p_type", "counts_by_year": "year"}


def _counted_list(t: Tables, column: str) -> DataFrame:
    """``(l_orderkey, column)``: lines are counted by order and value first, so a list has
    an entry per value, whatever the number of lines."""
    field = _COUNTED[column]
    counts = lines(t, [field]).groupBy("l_orderkey", field).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(field, "n"))).alias("e"), F.sum("n").alias("total"))
    if column == "concepts":
        made = F.transform("e", lambda x: F.struct(
            x["p_type"].alias("display_name"), _ident("C", x["p_type"]).alias("id"),
            F.lit(0).cast("bigint").alias("level"), (x["n"] / F.col("total")).alias("score"),
            F.lit(None).cast("string").alias("wikidata")))
    else:
        made = F.transform("e", lambda x: F.struct(x["n"].alias("cited_by_count"), x["year"].alias("year")))
    return whole.select("l_orderkey", made.alias(column))


def _first_topic(t: Tables) -> DataFrame:
    """``(l_orderkey, primary_topic)``: the topic of the smallest author, a minimum."""
    best = F.min(F.struct("l_partkey", "p_type", "p_brand")).alias("x")
    return (lines(t, ["l_partkey", "p_type", "p_brand"]).groupBy("l_orderkey").agg(best)
            .select("l_orderkey", _topic(F.col("x")).alias("primary_topic")))


def counted_works(t: Tables, column: str) -> DataFrame:
    """Compact works with ``id`` and one of ``concepts``, ``citations``, ``primary_topic``:
    like :func:`works`, without putting the lines of an order in one row."""
    raw = _RAW_OF.get(column, column)
    made = _first_topic(t) if raw == "primary_topic" else _counted_list(t, raw)
    kind = RAW_WORK[raw].dataType
    rows = t.orders.join(made, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        _ident("W", F.col("o_orderkey")).alias("id"), F.col(raw).cast(kind).alias(raw))
    return add_flat_columns(compact_work(rows, ["id", column]))


# Raw column behind each nested compact column.
_RAW_OF = {"authors": "authorships", "citations": "counts_by_year"}


def works(t: Tables, columns: Iterable[str] | None = None) -> DataFrame:
    """Compact works (``id`` and the given columns) with the flat helper columns."""
    if columns is None:
        return add_flat_columns(compact_work(raw_works(t)))
    raw = raw_works(t, [_RAW_OF.get(c, c) for c in columns])
    return add_flat_columns(compact_work(raw, ["id", *columns]))
