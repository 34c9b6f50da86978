"""Exact dedup against a minimal perfect hash of the digests seen before.

History (distinct digests of earlier documents) is kept as an index of buckets. Each
bucket is a minimal perfect hash: levels of bit arrays map n digests onto the slots
0..n-1, and a slot holds the whole digest and the locator of its winner. New documents
are pre-aggregated to distinct digests, looked up in their bucket and compared byte by
byte with the slot; members are repeats, the rest form groups of their own.

Buckets are cut by digest and hold distinct digests only, so they are even however
often one text occurs: a hot text is one row per map task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BLANK, buckets_for, id_and_text, mix
from quillgraph.session import materialize

PER_BUCKET = 100_000
_INDEX = ("bucket int, n long, level_sizes array<long>, bits binary, digests binary,"
          " neg_chars binary, no_id binary, id binary, size binary")
_GROUPS = ("digest binary, neg_chars long, no_id long, id long, size long, in_history boolean")


# --- the hash itself (one bucket) -----------------------------------------------------

class PerfectHash:
    """Levels of bit arrays; a key sits at the first level where its bit is set."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            return (mix(keys[:, level % 4] ^ mix(keys[:, (level + 1) % 4] + salt))
                    % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct digests as rows of four 64-bit words."""
        sizes, parts, level = [], [], 0
        while len(keys):
            size = 2 * len(keys)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            keys = keys[~alone[at]]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit (surely no member)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._place(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)


def _columns(data: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    digests = np.frombuffer(b"".join(data["digest"].to_pylist()), np.uint8).reshape(-1, 32)
    return digests, {c: data[c].to_numpy() for c in ("neg_chars", "no_id", "id", "size")}


def _build_bucket(data: pa.Table) -> pa.Table:
    digests, cols = _columns(data)
    hashed = PerfectHash.build(_words(digests))
    order = np.empty(len(digests), np.int64)
    order[hashed.slots(_words(digests))] = np.arange(len(digests))
    row = {"bucket": data["bucket"][0].as_py(), "n": len(digests), "level_sizes": hashed.sizes,
           "bits": np.packbits(hashed.bits).tobytes(), "digests": digests[order].tobytes(),
           **{c: v[order].astype(np.int64).tobytes() for c, v in cols.items()}}
    kinds = {"bucket": pa.int32(), "n": pa.int64(), "level_sizes": pa.list_(pa.int64())}
    return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()})


def _lookup_bucket(index: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of the bucket: the slots, with what their members add, then the rest."""
    names = ("neg_chars", "no_id", "id", "size")
    digests, cols = _columns(batch)
    if len(index):
        row = index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:sum(row["level_sizes"])]
        hashed = PerfectHash(row["level_sizes"], bits.astype(bool))
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        slots = {c: np.frombuffer(row[c], np.int64).copy() for c in names}
        at = hashed.slots(_words(digests))
        member = at >= 0
        member[member] = (held[at[member]] == digests[member]).all(axis=1)
        where, new = at[member], {c: v[member] for c, v in cols.items()}
        old = {c: slots[c][where] for c in names}
        better = np.zeros(len(where), bool)
        tied = np.ones(len(where), bool)
        for c in ("neg_chars", "no_id", "id"):
            better |= tied & (new[c] < old[c])
            tied &= new[c] == old[c]
        for c in ("neg_chars", "no_id", "id"):
            slots[c][where] = np.where(better, new[c], old[c])
        slots["size"][where] += new["size"]
    else:
        held, slots = np.zeros((0, 32), np.uint8), {c: np.zeros(0, np.int64) for c in names}
        member = np.zeros(len(digests), bool)
    rows = np.concatenate([held, digests[~member]])
    flat = rows.tobytes()
    out = {"digest": pa.array([flat[i:i + 32] for i in range(0, len(flat), 32)], pa.binary())}
    out |= {c: pa.array(np.concatenate([slots[c], cols[c][~member]]), pa.int64()) for c in names}
    out["in_history"] = pa.array(np.arange(len(rows)) < len(held))
    return pa.table(out)


# --- the operator ----------------------------------------------------------------------

def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, SHA-256 of the text without white space."""
    bare = F.regexp_replace("text", BLANK + "+", "")
    return id_and_text(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2(bare, 256)).alias("digest"))


def _groups(prints: DataFrame) -> DataFrame:
    """One row per distinct digest: winner (most code points, then smallest id), size."""
    best = F.min(F.struct((-F.col("n_chars")).alias("neg_chars"),
                          F.col("doc_id").isNull().cast("long").alias("no_id"),
                          F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")))
    return prints.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size")) \
        .select("digest", "best.*", "size")


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index of documents' fingerprints: one row per bucket, ready to be stored."""
    return _bucketed(_groups(history), buckets).groupBy("bucket").applyInArrow(
        _build_bucket, _INDEX)


def lookup(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Groups of history and batch together, by lookups of the batch's digests."""
    probes = _bucketed(_groups(batch), buckets).groupBy("bucket")
    return index.groupBy("bucket").cogroup(probes).applyInArrow(_lookup_bucket, _GROUPS)


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, seen_before for each row of ``docs``.

    Texts are equal if they are after removal of white space. Of equal texts the one
    with most code points stays, then the smallest doc_id (null ids last). ``history``
    holds documents that came earlier and compete likewise; without it the lower half
    of the id range counts as the earlier delivery. Rows with one id and one text
    are the same document and share the verdict; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "exact-prints")
    if history is None:
        middle = prints.agg(((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0]
        early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
        earlier, later = prints.where(early), prints.where(~early)
    else:
        earlier, later = materialize(fingerprints(history), "exact-history"), prints
    buckets = buckets_for(earlier.count() + later.count(), PER_BUCKET)
    index = materialize(build_index(earlier, buckets), "exact-index")
    groups = lookup(index, later, buckets).select(
        "digest", F.when(F.col("no_id") == 0, F.col("id")).alias("keep_id"),
        F.col("size").alias("group_size"), F.col("in_history").alias("seen_before"))
    return prints.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest", "seen_before")


def unique_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat another text; all columns stay."""
    lost = dedup(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest"))
    bare = F.sha2(F.regexp_replace(F.coalesce(F.col("d.text"), F.lit("")), BLANK + "+", ""), 256)
    return docs.alias("d").join(lost, F.col("d.doc_id").eqNullSafe(F.col("__gone"))
                                & (F.unhex(bare) == F.col("__digest")), "left_anti")


__all__ = ["PerfectHash", "build_index", "dedup", "fingerprints", "lookup", "unique_documents"]
