"""Seeded, order-free pseudo-random numbers from md5.

The same row gives the same number on every run, partitioning and engine, so
samples and splits are reproducible and can be recomputed after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(salt: str, *keys: Column) -> Column:
    """md5 hex text of ``salt:key:key…``."""
    return F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in keys]))


def number32(hexadecimal: Column, part: int = 0) -> Column:
    """The given run of eight hex digits of a digest as BIGINT in [0, 2³²)."""
    return F.conv(F.substring(hexadecimal, 8 * part + 1, 8), 16, 10).cast("bigint")


def number60(hexadecimal: Column, part: int = 0) -> Column:
    """The given run of fifteen hex digits of a digest as BIGINT in [0, 2⁶⁰): wide
    enough to number the nodes of any graph without bias."""
    return F.conv(F.substring(hexadecimal, 15 * part + 1, 15), 16, 10).cast("bigint")


def uniform32(salt: str, *keys: Column) -> Column:
    """Number in [0, 2³²) as BIGINT."""
    return number32(digest(salt, *keys))


def below(fraction: float, salt: str, *keys: Column) -> Column:
    """True for about ``fraction`` of the keys."""
    return uniform32(salt, *keys) < F.lit(int(fraction * 2**32))
