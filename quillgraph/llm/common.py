"""What the text operators share: columns, ids, work tables, and prefix hashes of bytes.

Conventions of all operators here: a null text counts as empty, a null ``doc_id``
is allowed (ordered after all others), rows that repeat an id share its verdict,
and columns other than those named in an operator's docstring are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts: space and the controls 9 to 13.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so that other columns can't clash."""
    return docs.select("doc_id", text_column().alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``dropped`` (ids are spread
    evenly, so the join has no hot key)."""
    gone = dropped.select(F.col("doc_id").alias("__gone"))
    return docs.alias("d").join(gone, F.col("d.doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))


# --- texts of Arrow batches as bytes -------------------------------------------------

def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (uint8) and where each begins, with the
    end. Nulls are empty."""
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int,
                  column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of text each (one row at least)."""
    import pyarrow.compute as pc
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) // max_bytes
        starts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(sizes)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if high > low:
                yield batch.slice(low, high - low)


# --- hashes of any substring from one running sum -----------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


class PowerTable:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, np.uint64)
                steps[0] = 1
                self.up = np.multiply.accumulate(steps)
                steps = np.full(size, _INVERSE, np.uint64)
                steps[0] = 1
                self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


POWERS = PowerTable()


class PrefixHash:
    """Hashes of substrings of ``data`` (uint8) in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]; equal bytes have equal hashes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts]
                   + (ends - starts).astype(np.uint64) * _MIX2)

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of all substrings of one width."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:len(self.sums) - width])
