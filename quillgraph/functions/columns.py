"""Column → Column building blocks; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the snapshot format.
ID_PREFIX = "https://openalex.org/"
DOI_PREFIX = "https://doi.org/"


def strip_prefix(c: Column, prefix: str) -> Column:
    """Remove the whole prefix; a value without it stays as it is."""
    return F.when(c.startswith(prefix),
                  c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def trim_prefix_legacy(c: Column, prefix: str) -> Column:
    """Like :func:`strip_prefix`, but the last prefix character stays (``/A5``).

    Reproduces ids of older data sets; they do not join with stripped ids.
    """
    return F.when(c.startswith(prefix), strip_prefix(c, prefix[:-1])).otherwise(c)


def strip_each(arr: Column, strip: Callable[[Column], Column]) -> Column:
    """Apply a prefix rule to every element of an array of strings."""
    return F.transform(arr, strip)


def reshape(arr: Column, **fields: Callable[[Column], Column]) -> Column:
    """Array of structs → array of new structs with the named fields."""
    return F.transform(arr, lambda x: F.struct(*[f(x).alias(k) for k, f in fields.items()]))


def update_field(arr: Column, name: str, change: Callable[[Column], Column]) -> Column:
    """Change one field of every struct in an array."""
    return F.transform(arr, lambda x: x.withField(name, change(x.getField(name))))


def pluck(arr: Column, name: str) -> Column:
    """One field of every struct in an array; nested pruning keeps the scan narrow."""
    return arr.getField(name)


def path(c: Column, dotted: str) -> Column:
    """``a.b.c`` inside a struct; ``[i]`` indexes an array. Null where absent."""
    for step in dotted.replace("[", ".[").split("."):
        if step.startswith("["):
            c = F.get(c, F.lit(int(step[1:-1])))
        elif step:
            c = c.getField(step)
    return c


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_day(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to timestamp; null where the text does not fit."""
    return F.try_to_timestamp(c, F.lit(pattern))


def doi_url(c: Column) -> Column:
    """Join key: full DOI address, whether or not the value already has it. A blank
    DOI is no key: null."""
    bare = F.trim(F.lower(strip_prefix(c, DOI_PREFIX)))
    return F.when(bare != "", F.concat(F.lit(DOI_PREFIX), bare))


def last_count(citations: Column) -> Column:
    """``count`` of the last array element, 0 for an empty or null array."""
    return F.when(F.size(citations) > 0,
                  F.element_at(citations, -1).getField("count")).otherwise(F.lit(0))


def total_count(citations: Column) -> Column:
    """Sum of all counts in the array."""
    return F.coalesce(F.aggregate(citations.getField("count"), F.lit(0).cast("bigint"),
                                  lambda acc, x: acc + F.coalesce(x, F.lit(0))), F.lit(0))


def team(authors: Column) -> Column:
    """Canonical team: author ids sorted, nulls last."""
    return F.array_sort(authors.getField("id"))


def rename_columns(df: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rename(c) for c in df.columns])


def metadata_name(prefix: str = "arxiv_") -> Callable[[str], str]:
    """Column renamer: prefix, ``-`` to ``_``, lower case."""
    return lambda name: prefix + name.replace("-", "_").lower()


def drop_technical(df: DataFrame, columns: tuple[str, ...] = ("_id", "rowId")) -> DataFrame:
    return df.drop(*columns)
