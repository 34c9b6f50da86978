"""Near-duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

1. A document's set is its distinct word shingles (64-bit hashes). Its signature is a
   SuperMinHash: in round j each element goes to the j-th place of its own permutation of
   the slots with rank j plus a random fraction; a slot keeps the lowest. Rounds end as
   soon as no later one can change a slot. Equal sets collapse to one representative.
2. Signatures are cut into bands; representatives with an equal band share a bucket. Each
   member is paired with the bucket's smallest member only, and the pair is confirmed on
   the full sets. A bucket whose members are all linked to its smallest one is resolved.
3. The members of the other buckets (three or more, some not linked to the smallest) are
   compared exactly with each other inside tasks, in blocks of bounded size; a task gives
   the connected groups it found, not their pairs.
4. Links are contracted to components by alternating star steps, in Spark.

No group is gathered whole: pivots come from map-side minima, joins on hot keys can be
split, and a large bucket is cut into blocks whose pairs are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import PrefixHash, flat_bytes, id_and_text, mix, small_batches, without
from quillgraph.session import materialize

BATCH_BYTES = 1 << 19  # of text; a signature needs some 100 times that while it is made
BLOCK_DOCS, BLOCK_SHINGLES = 1_000, 4_000_000
_BITS = 1 << 24
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90),
                  np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_C1, _C2, _C3 = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@dataclass(frozen=True)
class Near:
    """What counts as near: shingles of ``words``, an intersection of at least
    ``percent`` of the union. A pair at the threshold shares one of ``bands`` of
    ``rows`` slots with probability 1 - 5e-8 by default."""
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    def linked(self, common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (left + right - common)


# --- sets and signatures -------------------------------------------------------------------

def shingle_sets(data: np.ndarray, begins: np.ndarray, words: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts given as bytes in a row, sorted by text and hash,
    and each text's count. Texts with fewer words than a shingle have one, of all words;
    texts without words have none."""
    texts = len(begins) - 1
    low = _LOWER[data]
    solid = np.zeros(len(low) + 1, bool)
    solid[:-1] = ~_BLANK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[begins] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    with np.errstate(over="ignore"):
        word = PrefixHash(low).of(starts, ends)
        owner = np.searchsorted(begins, starts, side="right") - 1
        count = np.bincount(owner, minlength=texts)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        place = np.arange(len(word)) - first[owner]
        # A shingle begins at every word that has enough words after it, or at the
        # first word of a short text; a length goes into the hash of a short one.
        size = np.minimum(count, words)[owner]
        begin = np.flatnonzero((place + words <= count[owner]) | (place == 0))
        value = np.zeros(len(begin), np.uint64)
        for k in range(words):
            inside = k < size[begin]
            step = word[np.minimum(begin + k, len(word) - 1)] if len(word) else value
            value = np.where(inside, mix(value * _C1 + step + _C2), value)
    owner = owner[begin]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.bincount(owner[keep], minlength=texts)


def super_minhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (texts x slots, 64-bit: round in the top byte, then the fraction) of
    sets given in a row. Empty sets have the highest value in all slots."""
    texts = len(counts)
    top = np.uint64(2**64 - 1)
    table = np.full(texts * slots, top, np.uint64)
    owner = np.repeat(np.arange(texts), counts)
    shuffled = None
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(elements):
                break
            drawn = mix(elements * _C3 + np.uint64(j + 1) * _C1)
            swap = j + (mix(drawn + _C2) % np.uint64(slots - j)).astype(np.int64)
            if shuffled is None:
                place = swap
            else:
                row = np.arange(len(elements))
                place = shuffled[row, swap].astype(np.int64)
                shuffled[row, swap] = shuffled[:, j]
            np.minimum.at(table, owner * slots + place,
                          np.uint64(j) << np.uint64(56) | drawn >> np.uint64(8))
            highest = table.reshape(texts, slots).max(1)
            going = (highest >= np.uint64(j + 1) << np.uint64(56))[owner]
            if shuffled is None:
                shuffled = np.tile(np.arange(slots, dtype=np.uint8), (int(going.sum()), 1))
                row = np.arange(len(shuffled))
                shuffled[row, swap[going]] = shuffled[:, 0]
            else:
                shuffled = shuffled[going]
            elements, owner = elements[going], owner[going]
    return table.reshape(texts, slots)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that identify the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            elements, counts = shingle_sets(*flat_bytes(batch["text"]), near.words)
            signature = super_minhash(elements, counts, near.slots)
            with np.errstate(over="ignore"):
                bands = np.zeros((len(counts), near.bands), np.uint64)
                for k in range(near.rows):
                    bands = mix(bands * _C1 + signature[:, k::near.rows])
                bands = mix(bands + np.arange(near.bands, dtype=np.uint64) * _C2)
                sums = [np.zeros(len(counts), np.uint64) for _ in range(2)]
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                for total, salt in zip(sums, (_C1, _C2), strict=True):
                    if len(full):
                        total[full] = np.add.reduceat(mix(elements + salt), starts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(counts.astype(np.int64)),
                 *(pa.array(t.view(np.int64)) for t in sums),
                 pa.FixedSizeListArray.from_arrays(
                     pa.array(bands.reshape(-1).view(np.int64)), near.bands).cast(pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _bit(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(doc_id), F.lit(_BITS))


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id. Its size is fixed (2 MB), so it may go to all
    tasks; with very many ids it lets more rows pass, never fewer."""
    words = ids.select(_bit().alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("bits")).collect()
    out = np.zeros(_BITS // 64, np.uint64)
    for row in words:
        out[row["word"]] = row["bits"] % (1 << 64)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, elements (sorted 64-bit hashes as bytes) of the rows whose id is in
    ``wanted``, and of a few others; no shuffle of texts."""
    marks = _marks(wanted)
    rows = id_and_text(docs).where("doc_id IS NOT NULL").withColumn("b", _bit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch["b"].to_numpy().astype(np.uint64)
            hit = (marks[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)
            yield from sets(batch.filter(pa.array(hit.astype(bool))))

    def sets(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for batch in small_batches([some], BATCH_BYTES):
            elements, counts = shingle_sets(*flat_bytes(batch["text"]), words)
            ends = np.cumsum(counts)
            rows = [elements[e - c:e].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(rows, pa.binary())],
                names=["rep", "elements"])

    return rows.mapInArrow(run, "rep long, elements binary")


# --- links -----------------------------------------------------------------------------------

def confirm(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """pivot, member, linked: ``pairs`` compared on their full sets. A pivot with very
    many members is split by the join."""
    one = sets.select(F.col("rep").alias("member"), F.col("elements").alias("own"))
    other = sets.select(F.col("rep").alias("pivot"), F.col("elements").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for own, base in zip(batch["own"], batch["base"], strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, base))
                common = np.isin(a, b, assume_unique=True).sum() if len(a) < 64 else \
                    len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                flags.append(bool(near.linked(common, len(a), len(b))))
            yield pa.RecordBatch.from_arrays(
                [batch["pivot"], batch["member"], pa.array(flags, pa.bool_())],
                names=["pivot", "member", "linked"])

    rows = pairs.join(one.hint("merge"), "member").join(other.hint("merge"), "pivot")
    return rows.select("pivot", "member", "own", "base").mapInArrow(
        run, "pivot long, member long, linked boolean")


def block_groups(block: pa.Table, near: Near) -> pa.Table:
    """Connected groups among the documents of one block pair: member, root. Columns:
    rep, side (0, 1, or 2 where both sides are one block), elements."""
    reps = block["rep"].to_numpy()
    side = block["side"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["elements"]]
    rows = [np.flatnonzero(side == 2)] * 2 if (side == 2).any() else [
        np.flatnonzero(side == k) for k in (0, 1)]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1  # others are in no intersection
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    where = [np.full(len(sets), -1) for _ in range(2)]
    for k in range(2):
        where[k][rows[k]] = np.arange(len(rows[k]))
    for low in range(0, width, 4096):
        begin, end = np.searchsorted(column, [low, low + 4096])
        parts = []
        for k in range(2):
            own = where[k][owner[begin:end]]
            part = np.zeros((len(rows[k]), 4096), np.float32)
            part[own[own >= 0], column[begin:end][own >= 0] - low] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    left, right = sizes[rows[0]][:, None], sizes[rows[1]][None, :]
    a, b = np.nonzero(near.linked(common.astype(np.int64), left, right))
    a, b = rows[0][a], rows[1][b]
    rank = np.argsort(np.argsort(reps, kind="stable"), kind="stable")
    label = rank.copy()
    while True:  # lowest label along links, with shortcuts
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        by_rank = np.empty_like(new)
        by_rank[rank] = new
        new = np.minimum(new, by_rank[new])
        if (new == label).all():
            break
        label = new
    root = np.sort(reps)[label]
    some = root != reps
    return pa.table({"member": reps[some], "root": root[some]})


def block_links(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """pivot, member links within buckets (``key``, ``rep``, ``n_shingles``), exactly, in
    blocks of bounded documents and shingles."""
    totals = members.groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
        .cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.join(totals, "key").withColumn("own", own).select(
        "key", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0) \
        .otherwise(1).cast("int")
    pairs = placed.select("rep", "key", F.least("own", "with").alias("low"),
                          F.greatest("own", "with").alias("high"), side.alias("side"))
    # A document stands for itself once in the pair of its own block.
    return pairs.join(sets.hint("merge"), "rep").groupBy("key", "low", "high").applyInArrow(
        lambda block: block_groups(block, near), "member long, root long").select(F.col("root").alias("pivot"), "member")


def links(docs: DataFrame, reps: DataFrame, near: Near) -> DataFrame:
    """Edges pivot, member that connect what is linked among ``reps`` (rep, n_shingles,
    bands)."""
    rows = materialize(reps.select("rep", "n_shingles", F.explode("bands").alias("key")), "near-bands")
    buckets = rows.groupBy("key").agg(
        F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("rep") % (1 << 40)).alias("members")).where("size > 1")
    buckets = materialize(buckets, "near-buckets")
    held = materialize(rows.join(buckets.hint("merge"), "key"), "near-held")
    pairs = materialize(held.where("rep <> pivot").select(
        "pivot", F.col("rep").alias("member")).distinct(), "near-pairs")
    wanted = pairs.select(F.col("pivot").alias("doc_id")).union(
        pairs.select(F.col("member").alias("doc_id"))).distinct()
    sets = materialize(full_sets(docs, wanted, near.words), "near-sets")
    checked = materialize(confirm(pairs, sets, near), "near-checked")
    # Buckets of three or more that are not resolved; of those with the same members one.
    failed = held.where("size > 2").join(
        checked.where(~F.col("linked")).select("pivot", F.col("member").alias("rep")),
        ["pivot", "rep"], "left_semi")
    open_keys = failed.groupBy("pivot", "size", "members").agg(F.min("key").alias("key"))
    members = held.join(open_keys.select("key"), "key", "left_semi") \
        .select("key", "rep", "n_shingles")
    inner = materialize(block_links(members, sets, near), "near-blocks")
    return checked.where("linked").select("pivot", "member").union(inner).distinct()


# --- components --------------------------------------------------------------------------------

def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """member, root: each end of an edge with the smallest id reachable. Alternating
    large-star and small-star steps (minima with map-side combination and one join)
    until the edges no longer change; written out each round."""
    edges = edges.select(F.greatest("pivot", "member").alias("u"),
                         F.least("pivot", "member").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "star-0")
    mark = None
    for k in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest.hint("merge"), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, f"star-{k + 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == mark:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


# --- the operator --------------------------------------------------------------------------------

def group(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row.

    component_id is the smallest doc_id reachable over links (see ``Near``); texts with equal sets are linked. Null, empty and blank
    texts have an empty set and are linked with nothing. Rows that repeat an id are one
    document; rows without an id are linked with nothing (component_id null, kept).
    """
    near = near or Near()
    drawn = materialize(sketches(docs, near), "near-sketches")
    full = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    known = materialize(full.select("doc_id", "set_a", "set_b", "n_shingles").join(
        classes.hint("merge"), ["set_a", "set_b"]).select("doc_id", "rep"), "near-classes")
    reps = full.join(known.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi") \
        .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    roots = components(links(docs, reps, near))
    found = known.distinct().join(
        roots, F.col("rep") == F.col("member"), "left").select(
        F.col("doc_id").alias("known_id"), F.coalesce("root", "rep").alias("component_id"))
    out = drawn.join(found, F.col("doc_id") == F.col("known_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """``docs`` with the first document of each group only; all columns stay."""
    return without(docs, group(docs, near).where(~F.col("kept")))
