"""Lines found in several documents, by two Bloom filters: once seen and twice seen.

1. Every line that is long enough becomes a 128-bit digest of its key (white space at both
   ends deleted, A-Z lowered); a document keeps its distinct digests, 16 bytes a line.
2. Each task puts its digests into two filters: bits of digests seen, and of digests seen
   again. Filters of tasks are merged by segments: twice seen is what one task saw twice
   or two tasks saw once. A digest of two documents always has all its bits there.
3. Digests that are not in the twice-seen filter occur once and go nowhere. The suspected
   rest is shuffled: exact counts of documents by digest, and the document that stays.

The filter's size follows the number of digests up to ``MOST_BITS``; beyond, the digests
are cut into slices by hash, each with a filter of its own, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import id_and_text, small_batches
from quillgraph.operators.skew import skew_join
from quillgraph.session import materialize, new_path

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCH_BYTES = 4 << 20
BITS_A_KEY = 8
MOST_BITS = 1 << 29  # of one filter: 64 MB in the driver and in each worker
SEGMENT = 1 << 20    # bits
_BLANK = b" \t\n\x0b\x0c\r"
_KEYS = "doc_id long, digests binary"


# --- keys ------------------------------------------------------------------------------

def line_digest(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The digest of a line's key; None for keys of fewer code points."""
    key = line.strip(_BLANK).lower()  # of bytes: A-Z only
    if len(key) < least_chars or (len(key) < 4 * least_chars
                                  and len(key.decode("utf-8", "replace")) < least_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, digests (distinct, 16 bytes each) of the rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                digests = {line_digest(line, least_chars)
                           for line in text.as_buffer().to_pybytes().split(b"\n")}
                digests.discard(None)
                if digests:
                    ids.append(doc_id)
                    found.append(b"".join(digests))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "digests"])

    return id_and_text(docs).mapInArrow(run, _KEYS)


def _halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All digests of a batch as two 64-bit words each, and the row of each."""
    rows = [x.as_buffer() for x in batch["digests"]]
    words = np.frombuffer(b"".join(rows), np.uint64).reshape(-1, 2)
    return words, np.repeat(np.arange(len(rows)), [len(x) // 16 for x in rows])


def _sliced(found: DataFrame, slices: int) -> DataFrame:
    """The digests again, stored apart by slice of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row = _halves(batch)
            part = ((words[:, 0] >> np.uint64(40)) % np.uint64(slices)).astype(np.int64)
            order = np.lexsort((part, row))
            words, row, part = words[order], row[order], part[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(row))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row[starts])),
                 pa.array([words[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                          pa.binary()), pa.array(part[starts].astype(np.int32))],
                names=["doc_id", "digests", "slice"])

    path, schema = new_path(found.sparkSession, "frequent-slices"), f"{_KEYS}, slice int"
    found.mapInArrow(run, schema).write.partitionBy("slice").parquet(path)
    return found.sparkSession.read.schema(schema).parquet(path)


# --- filters ----------------------------------------------------------------------------

def _places(words: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each digest."""
    return (words & np.uint64(bits - 1)).astype(np.int64)


def _merged(segment: pa.Table, width: int) -> pa.Table:
    """The twice-seen bits of one segment of ``width`` bits from the bits of all tasks."""
    once = [np.frombuffer(x.as_buffer(), np.uint32) for x in segment["once"]]
    twice = [np.frombuffer(x.as_buffer(), np.uint32) for x in segment["twice"]]
    places, tasks = np.unique(np.concatenate(once), return_counts=True)
    flags = np.zeros(width, bool)
    flags[places[tasks > 1]] = True
    flags[np.concatenate(twice)] = True
    return pa.table({"segment": segment["segment"][:1], "bits": pa.array(
        [np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def twice_seen(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of digests that more than one row may hold, as bytes (``bits`` / 8)."""
    width = min(SEGMENT, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_halves(batch)[0] for batch in batches]
        words = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
        words = words[np.lexsort((words[:, 1], words[:, 0]))]
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]).all(axis=1)
        seen = [np.unique(_places(w, bits)) for w in (words[~again], words[again])]
        segments = np.unique(seen[0] // width)
        cuts = [np.searchsorted(s, np.append(segments, bits // width + 1) * width) for s in seen]
        rows = [[(s[a:b] % width).astype(np.uint32).tobytes()
                 for a, b in zip(c[:-1], c[1:], strict=True)] for s, c in zip(seen, cuts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(segments, pa.int64()), *(pa.array(r, pa.binary()) for r in rows)],
            names=["segment", "once", "twice"])

    merged = found.mapInArrow(run, "segment long, once binary, twice binary") \
        .groupBy("segment")\
        .applyInArrow(lambda segment: _merged(segment, width), "segment long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # bits / 8 bytes, at most MOST_BITS / 8
        at = row["segment"] * width // 8
        out[at:at + width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def suspects(found: DataFrame, marks: np.ndarray, bits: int) -> DataFrame:
    """doc_id, digest of the digests in the filter ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row = _halves(batch)
            at = _places(words, bits)
            hit = ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            flat = np.ascontiguousarray(words[hit]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row[hit])),
                 pa.array([flat[i:i + 16] for i in range(0, len(flat), 16)], pa.binary())],
                names=["doc_id", "digest"])

    return found.mapInArrow(run, "doc_id long, digest binary")


# --- the operator -----------------------------------------------------------------------

def repeated(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
             most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, digest of the lines that go: found in ``least_docs`` documents or more (two
    at least), for all of these documents but the one with the largest id."""
    if least_docs < 2:
        raise ValueError("a repeat needs two documents")
    found = materialize(keys(docs, least_chars), "frequent-keys")
    total = found.agg(F.coalesce(F.sum(F.octet_length("digests")), F.lit(0))).first()[0] // 16
    bits = min(SEGMENT, most_bits)
    while bits < min(BITS_A_KEY * total, most_bits):
        bits *= 2
    slices = max(1, -(-BITS_A_KEY * total // (2 * bits)))
    parts = [found]
    if slices > 1:
        cut = _sliced(found, slices)
        parts = [cut.where(F.col("slice") == k).select("doc_id", "digests") for k in range(slices)]
    pairs = [materialize(suspects(part, twice_seen(part, bits), bits).distinct(), "frequent-suspects")
             for part in parts]
    held = pairs[0]
    for more in pairs[1:]:
        held = held.union(more)
    last = F.max(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    often = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), last.alias("last")) \
        .where(F.col("n") >= least_docs).select("digest", "last")
    return skew_join(held, often, "digest").where(
        ~F.col("doc_id").eqNullSafe(F.col("last.doc_id"))).select("doc_id", "digest")


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
          most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, text (what stays), n_lines (before), n_dropped per row.

    A line goes with its line end, so the rest is joined by one line end again. Null and
    empty texts have one empty line and lose nothing. Rows that repeat an id are one
    document; rows without an id are one more, with the largest id. An empty table gives
    no rows.
    """
    lost = repeated(docs, least_docs, least_chars, most_bits).groupBy("doc_id").agg(
        F.collect_list("digest").alias("lost"))
    joined = id_and_text(docs).alias("d").join(
        lost.withColumnRenamed("doc_id", "lost_id"),
        F.col("d.doc_id").eqNullSafe(F.col("lost_id")), "left").select("d.doc_id", "d.text", "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            texts, totals, dropped = [], [], []
            for text, gone in zip(batch["text"], batch["lost"].to_pylist(), strict=True):
                whole = text.as_buffer().to_pybytes()
                totals.append(whole.count(b"\n") + 1)
                if gone:
                    gone = set(gone)
                    stays = [x for x in whole.split(b"\n") if line_digest(x, least_chars) not in gone]
                    dropped.append(totals[-1] - len(stays))
                    whole = b"\n".join(stays)
                else:
                    dropped.append(0)
                texts.append(whole)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")
