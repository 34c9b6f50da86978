"""Schemas of the snapshot record and of the two compact forms."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _F, _I = (T.StringType(), T.LongType(), T.DoubleType(), T.FloatType(),
                      T.IntegerType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_NAMED = _struct(display_name=_S, id=_S)
_TOPIC = _struct(display_name=_S, domain=_NAMED, field=_NAMED, id=_S, score=_D, subfield=_NAMED)

# One JSON line of the snapshot. Field names and types are given by the format.
RAW_WORK = _struct(
    authorships=T.ArrayType(_struct(
        author=_struct(display_name=_S, id=_S, orcid=_S),
        countries=T.ArrayType(_S),
        institutions=T.ArrayType(_struct(country_code=_S, display_name=_S, id=_S)),
    )),
    concepts=T.ArrayType(_struct(display_name=_S, id=_S, level=_L, score=_D, wikidata=_S)),
    counts_by_year=T.ArrayType(_struct(cited_by_count=_L, year=_L)),
    created_date=_S,
    display_name=_S,
    doi=_S,
    id=_S,
    keywords=T.ArrayType(_struct(display_name=_S, id=_S, score=_D)),
    primary_topic=_TOPIC,
    publication_date=_S,
    referenced_works=T.ArrayType(_S),
    country_codes=T.ArrayType(_S),
    related_works=T.ArrayType(_S),
    title=_S,
    topics=T.ArrayType(_TOPIC),
)

_COMPACT_TOPIC = _struct(id=_S, name=_S, domain=_S, field=_S)

# What the statistics and graph operators read.
COMPACT_WORK = _struct(
    id=_S, doi=_S, title=_S, publication_date=_S,
    country_codes=T.ArrayType(_S),
    authors=T.ArrayType(_struct(
        id=_S, name=_S,
        institutions=T.ArrayType(_struct(id=_S, name=_S, country=_S)))),
    concepts=T.ArrayType(_struct(id=_S, name=_S, score=_D)),
    topics=T.ArrayType(_COMPACT_TOPIC),
    primary_topic=_struct(name=_S, domain=_S, field=_S),
    referenced_works=T.ArrayType(_S),
    related_works=T.ArrayType(_S),
    keywords=T.ArrayType(_S),
    citations=T.ArrayType(_struct(year=_L, count=_L)),
)

# What the strict extraction by field spec gives.
EXTRACTED_WORK = _struct(
    work_id=_S, doi=_S, title=_S, date=_S,
    authors=T.ArrayType(_struct(
        id=_S, name=_S, raw_name=_S,
        country_codes=T.ArrayType(_S),
        institutions=T.ArrayType(_struct(id=_S, name=_S, country_code=_S)))),
    concepts=T.ArrayType(_struct(id=_S, name=_S, score=_F)),
    topics=T.ArrayType(_COMPACT_TOPIC),
    referenced_works=T.ArrayType(_S),
    related_works=T.ArrayType(_S),
    keywords=T.ArrayType(_S),
    citations=T.ArrayType(_struct(year=_I, count=_I)),
)


def narrow(schema: T.StructType, leaves: list[str]) -> T.StructType:
    """The part of a schema that holds the given dotted leaves.

    Spark prunes one level of array elements by itself; an explicit read schema
    also prunes arrays inside array elements (``authors.institutions.country``).
    """
    def cut(kind: T.DataType, paths: list[str]) -> T.DataType:
        if "" in paths:
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(cut(kind.elementType, paths), kind.containsNull)
        kept = {}
        for p in paths:
            head, _, rest = p.partition(".")
            kept.setdefault(head, []).append(rest)
        return T.StructType([T.StructField(f.name, cut(f.dataType, kept[f.name]), f.nullable)
                             for f in kind.fields if f.name in kept])

    return cut(schema, leaves)
