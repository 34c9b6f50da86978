"""Repeated lines and paragraphs: each goes after the first of its kind, whichever document
it is in.

Units are the lines that hold a word, and the paragraphs (lines between lines without one).
They are normalised (lower case, single spaces) and stand as 128-bit digests with their
offsets in the original text; a paragraph cut into other lines has the same digest. Digests
are grouped globally with map-side combination; the occurrence with the smallest (doc_id,
line) stays. Only digests that occur twice go back to the units, in a join that the planner
can split where one line is very common.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import id_and_text, small_batches
from quillgraph.operators.skew import skew_join
from quillgraph.session import materialize

# Removed words in a row that make a passage; short lines repeat by chance.
PASSAGE_WORDS = 20
BATCH_BYTES = 4 << 20
_OTHER = re.compile("[\t\x0b\x0c\r]")
_TO_SPACE = {ord(c): " " for c in "\t\x0b\x0c\r"}
# SQL lowers each letter alone; Python adds a dot to the one and looks at the end of a word
# for the other.
_ALONE = {ord("İ"): "i", ord("Σ"): "σ"}
_SCHEMA = ("doc_id long, text string, n_lines long, n_removed long, n_removed_words long,"
           " n_passages long, spans array<struct<start: bigint, end: bigint>>")


def normal(line: str) -> str:
    """Words in lower case with one space between."""
    if "Σ" in line or "İ" in line:
        line = line.translate(_ALONE)
    line = line.lower()
    if _OTHER.search(line):
        line = line.translate(_TO_SPACE)
    if "  " in line or line[:1] == " " or line[-1:] == " ":
        line = " ".join([w for w in line.split(" ") if w])
    return line


def _digest(kind: bytes, unit: str) -> bytes:
    return hashlib.blake2b(unit.encode(), digest_size=16, person=kind).digest()


def units(docs: DataFrame) -> DataFrame:
    """doc_id, line (the unit's first), last (its last), digest: of each line with a word
    and of each paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            ids, lines, lasts, digests = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(),
                                    strict=True):
                block: list[str] = []
                whole = [*map(normal, text.split("\n")), ""]
                for k, line in enumerate(whole):
                    if line:
                        ids.append(doc_id)
                        lines.append(k)
                        lasts.append(k)
                        digests.append(_digest(b"line", line))
                        block.append(line)
                    elif block:
                        ids.append(doc_id)
                        lines.append(k - len(block))
                        lasts.append(k - 1)
                        digests.append(_digest(b"block", " ".join(block)))
                        block = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lines, pa.int32()),
                 pa.array(lasts, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "line", "last", "digest"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, line int, last int, digest binary")


def repeats(found: DataFrame) -> DataFrame:
    """The units that are not the first of their digest, with the first's first_doc and
    first_line. Null ids come last."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line")
    firsts = found.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("digest", "first")
    return skew_join(found, firsts, "digest").where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
          & (F.col("line") == F.col("first.line")))) \
        .select("doc_id", "line", "last", F.col("first.doc_id").alias("first_doc"),
                F.col("first.line").alias("first_line"))


def dedup(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, text (what stays), n_lines (all), n_removed, n_removed_words, n_passages
    (runs of removed lines, lines without a word aside, of ``passage_words`` words or more),
    spans (array of start, end in code points, end exclusive, of the removed lines in the
    original text) per row.

    A removed line goes with its line end, so the rest is joined by one line end again.
    Rows that repeat an id are the same document: each of its lines counts once. Null
    and empty texts have one empty line and lose nothing; an empty table gives no rows.
    """
    found = materialize(units(docs), "line-units")
    lost = repeats(found).select("doc_id", "line", "last").distinct().groupBy("doc_id").agg(
        F.collect_list(F.struct("line", "last")).alias("lost"))
    joined = id_and_text(docs).alias("d").join(
        lost.withColumnRenamed("doc_id", "lost_id"),
        F.col("d.doc_id").eqNullSafe(F.col("lost_id")), "left").select("d.doc_id", "d.text", "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            rows: list[tuple] = []
            for text, gone in zip(batch["text"].to_pylist(), batch["lost"].to_pylist(),
                                  strict=True):
                lines = text.split("\n")
                drop = {k for g in gone or () for k in range(g["line"], g["last"] + 1)}
                spans, at, words, run_words, passages = [], 0, 0, 0, 0
                for k, line in enumerate(lines if drop else ()):
                    if k in drop:
                        spans.append({"start": at, "end": at + len(line)})
                        own = normal(line).count(" ") + 1
                        words += own
                        passages += run_words < passage_words <= run_words + own
                        run_words += own
                    elif normal(line):
                        run_words = 0
                    at += len(line) + 1
                rows.append(("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop
                             else text, len(lines), len(drop), words, passages, spans))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "text", "n_lines", "n_removed", "n_removed_words", "n_passages",
                       "spans"])

    return joined.mapInArrow(cut, _SCHEMA)
