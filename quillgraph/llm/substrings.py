"""Removal of every later copy of a 100-byte string, over all documents.

A byte goes if a 100-byte string that covers it also begins earlier. Suffix order gives
this exactly: the longest previous factor (LPF) of a start is the longer of its common
prefixes with the previous and the next suffix in suffix order that begin earlier, and a
start is a copy where its LPF is 100 or more. One suffix array of all text can't be built,
so starts are first brought together with those they could be equal to:

1. Anchors. In each 100-byte string the 40-byte substring with the lowest hash is its
   anchor, so equal strings have equal anchors at equal places. Starts with one anchor
   are one run. A run is (hash of the anchor, hash of the text of the run): about one in
   31 bytes, packed in binary columns by bucket of the anchor's hash. Within a chunk of
   text only the first of equal runs is sent on; the others are copies already.
2. In a bucket, runs with a unique anchor are done; equal runs after the first are
   copies; runs that share an anchor but differ around it are open.
3. The texts of open runs (160 bytes at most) are fetched and meet by anchor. There the
   starts are put in suffix order and their LPF is computed by a scan with a stack.
   Of a hot anchor (more than BUCKET_TEXTS open runs) the single 100-byte strings meet,
   by the hash of the string: those that differ go to different buckets, and of equal
   ones each slice of runs sends the first only, the others are copies already.
4. Copied intervals are merged by document and cut out.

Very frequent passages are cut down to one run a chunk before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import PrefixHash, buckets_for, flat_bytes, id_and_text, small_batches
from quillgraph.session import materialize

LENGTH, ANCHOR = 100, 40
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
BUCKET_TEXTS = 8_000
_SLICE = 200_000  # starts put in suffix order at a time, about
_STEP = 1 << 20  # starts handled at a time
_PLACE = np.uint64((1 << 24) - 1)
NO_ID = 2**63 - 1  # documents without an id, as the last
_SPAN = np.dtype([("doc", "<i8"), ("low", "<i8"), ("high", "<i8")])
_RUN = np.dtype([("key", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("low", "<i8"), ("width", "<i4")])


# --- 1. anchors ------------------------------------------------------------------------------

def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from minima of block ends and heads."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tails[:n - width + 1], heads[width - 1:n])


def runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: anchor hash, text hash, first start, last start."""
    whole = np.ones(len(data) + 1, bool)
    for low, high in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        whole[max(low, high - LENGTH + 1):high] = False
    whole[len(data):] = False
    parts = []
    for base in range(0, len(data) - LENGTH + 1, _STEP):
        piece = data[base:base + _STEP + LENGTH - 1]
        with np.errstate(over="ignore"):
            prefix = PrefixHash(piece)
            hashes = prefix.windows(ANCHOR)
            ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
            place = (sliding_minimum(ranked, LENGTH - ANCHOR + 1) & _PLACE).astype(np.int64)
            good = whole[base:base + len(place)]
            fresh = np.ones(len(place), bool)
            fresh[1:] = (place[1:] != place[:-1]) | ~good[:-1]
            first = np.flatnonzero(good & fresh)
            stop = np.ones(len(place), bool)
            stop[:-1] = (place[1:] != place[:-1]) | ~good[1:]
            last = np.flatnonzero(good & stop)
            parts.append((hashes[place[first]], prefix.of(first, last + LENGTH),
                          first + base, last + base))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals joined where they touch, by document."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    change = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    reach = high.copy()
    for a, b in zip(change.tolist(), [*change[1:].tolist(), len(doc)], strict=True):
        np.maximum.accumulate(high[a:b], out=reach[a:b])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], low[at], reach[np.append(at[1:], len(doc)) - 1]


def _later(key: np.ndarray, text: np.ndarray, doc: np.ndarray, low: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """For each run: is it the first of its (key, text), and does it repeat an earlier
    place. A run at the very place of the first (a repeated row) is neither."""
    order = np.lexsort((low, doc, text, key))
    k, t, d, s = (x[order] for x in (key, text, doc, low))
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    first, repeat = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = head
    repeat[order] = ~head & ((d != d[lead]) | (s != s[lead]))
    return first, repeat


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, payload: packed runs by bucket of the anchor's hash; buckets below 0:
    packed intervals that are known to be copies, spread by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, CHUNK_BYTES):
            ids = batch["doc_id"].cast(pa.int64()).fill_null(NO_ID).to_numpy()
            data, begins = flat_bytes(batch["text"])
            key, text, first, last = runs(data, begins)
            owner = np.searchsorted(begins, first, side="right") - 1
            doc, low, width = ids[owner], first - begins[owner], last - first
            head, repeat = _later(key, text, doc, low)
            spans = np.zeros(0, _SPAN)
            if repeat.any():
                found = merged(doc[repeat], low[repeat], low[repeat] + width[repeat] + LENGTH)
                spans = np.zeros(len(found[0]), _SPAN)
                for name, values in zip(_SPAN.names, found, strict=True):
                    spans[name] = values
            kept = np.flatnonzero(head)
            bucket = (key[kept] % np.uint64(buckets)).astype(np.int64)
            kept = kept[np.argsort(bucket, kind="stable")]
            packed = np.zeros(len(kept), _RUN)
            for name, values in zip(_RUN.names, (key, text, doc, low, width), strict=True):
                packed[name] = values[kept]
            counts = np.bincount(bucket, minlength=buckets)
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - int(ids[0] % buckets), *some.tolist()], pa.int64()),
                 pa.array([_pack(spans), *(_pack(packed[ends[b] - counts[b]:ends[b]])
                                           for b in some)], pa.binary())],
                names=["bucket", "payload"])

    return id_and_text(docs).mapInArrow(run, "bucket long, payload binary")


def _pack(rows: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpack(payloads: list[bytes], kind: np.dtype) -> dict[str, np.ndarray]:
    columns: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind[name])] for name in kind.names}
    for data in payloads:
        rows, at = len(data) // kind.itemsize, 0
        for name in kind.names:
            columns[name].append(np.frombuffer(data, kind[name], rows, at))
            at += rows * kind[name].itemsize
    return {name: np.concatenate(parts) for name, parts in columns.items()}


# --- 2. equal runs -----------------------------------------------------------------------------

_FOUND = "doc long, low long, high long, key long"


def _found(doc, low, high, key=None) -> pa.Table:
    """Rows of _FOUND; no key: a copied interval, else an open run of that anchor."""
    keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key.view(np.int64))
    return pa.table({"doc": doc, "low": low, "high": high, "key": keys})


def resolve(rows: pa.Table) -> pa.Table:
    """Copies and open runs of one bucket."""
    payloads = rows["payload"].to_pylist()
    if rows["bucket"][0].as_py() < 0:
        spans = _unpack(payloads, _SPAN)
        return _found(spans["doc"], spans["low"], spans["high"])
    run = _unpack(payloads, _RUN)
    _, inverse, counts = np.unique(run["key"], return_inverse=True, return_counts=True)
    many = counts[inverse] > 1
    run = {name: values[many] for name, values in run.items()}
    first, repeat = _later(run["key"], run["text"], run["doc"], run["low"])
    high = run["low"] + run["width"] + LENGTH
    copies = _found(*merged(run["doc"][repeat], run["low"][repeat], high[repeat]))
    _, inverse, texts = np.unique(run["key"][first], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(first)[texts[inverse] > 1]
    return pa.concat_tables([copies, _found(
        run["doc"][open_], run["low"][open_], high[open_], run["key"][open_])])


# --- 3. longest previous factors ------------------------------------------------------------------

def longest_previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF by text rank. ``order``: text ranks in suffix order; ``common[i]``: common
    prefix of suffixes i - 1 and i. The stack holds suffixes whose next smaller one is
    still to come; what lies below is the previous smaller one."""
    n = len(order)
    out = [0] * n
    ranks, shared = [*order.tolist(), -1], [*common.tolist(), 0]
    if n:
        shared[0] = 0
    stack: list[tuple[int, int]] = []
    for rank, prefix in zip(ranks, shared, strict=True):
        while stack and (rank < stack[-1][0] or prefix <= stack[-1][1]):
            top, below = stack.pop()
            if rank < top:
                out[top] = max(below, prefix)
                prefix = min(below, prefix)
            else:
                out[top] = below
        stack.append((rank, prefix))
    return np.array(out, np.int64)


def copies_of(contexts: list[bytes], doc: np.ndarray, low: np.ndarray, group: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Starts in ``contexts`` (texts from ``low`` of ``doc``) whose LPF within their
    ``group`` reaches LENGTH, as doc and start."""
    sizes = np.array([len(c) - LENGTH + 1 for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    if not len(sizes) or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum([0, *(len(c) for c in contexts)])[:-1]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.repeat(begins, sizes) + inside
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Only starts whose string can occur twice in their group are put in suffix order.
    with np.errstate(over="ignore"):
        hashed = PrefixHash(data).windows(LENGTH)[start] ^ (
            group[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(hashed, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    twice = twice[np.argsort(hashed[twice], kind="stable")]
    # Equal strings have equal hashes and stay together; slices bound the memory.
    change = np.flatnonzero(np.diff(hashed[twice])) + 1
    cuts, edge = [0], 0
    for at in change.tolist():
        if at - edge >= _SLICE:
            cuts.append(at)
            edge = at
    parts = []
    for a, b in zip(cuts, [*cuts[1:], len(twice)], strict=True):
        part = twice[a:b]
        own = owner[part]
        parts.append(_copies(data, start[part], group[own], doc[own], low[own] + inside[part]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _copies(data: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray,
            low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the given starts whose LPF reaches LENGTH."""
    # Repeated rows give one place twice; it is one start.
    place = np.lexsort((low, doc, group))
    keep = np.ones(len(place), bool)
    keep[1:] = ((low[place][1:] != low[place][:-1]) | (doc[place][1:] != doc[place][:-1])
                | (group[place][1:] != group[place][:-1]))
    place = place[keep]
    start, group, doc, low = start[place], group[place], doc[place], low[place]
    if not len(start):
        return doc, low
    strings = sliding_window_view(data, LENGTH)[start]
    words = np.zeros((len(start), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = strings
    order = np.lexsort((*words.view(">u8").astype(np.uint64).T[::-1], group))
    common = np.zeros(len(order), np.int64)
    differ = strings[order[1:]] != strings[order[:-1]]
    common[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    common[1:][group[order[1:]] != group[order[:-1]]] = 0
    text_rank = np.empty(len(order), np.int64)
    text_rank[np.lexsort((low, doc))] = np.arange(len(order))
    copied = longest_previous_factors(text_rank[order], common)[text_rank] >= LENGTH
    return doc[copied], low[copied]


def _strings(hot_runs: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """The strings of (key, doc, low, context), first of their kind; copies without key."""
    group, doc, low = (np.array([run[k] for run in hot_runs], np.int64) for k in range(3))
    contexts = [run[3] for run in hot_runs]
    copied = np.rec.fromarrays(copies_of(contexts, doc, low, group), names="doc,start")
    sizes = np.array([len(c) - LENGTH + 1 for c in contexts], np.int64)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.rec.fromarrays([np.repeat(doc, sizes), np.repeat(low, sizes) + inside],
                              names="doc,start")
    first = np.flatnonzero(~np.isin(place, copied))
    begins = np.repeat(np.cumsum([0, *(len(c) for c in contexts)])[:-1], sizes) + inside
    data = np.frombuffer(b"".join(contexts), np.uint8)
    with np.errstate(over="ignore"):
        hashed = PrefixHash(data).windows(LENGTH)[begins[first]].view(np.int64)
    strings = np.ascontiguousarray(sliding_window_view(data, LENGTH)[begins[first]])
    offsets = np.arange(len(first) + 1, dtype=np.int32) * np.int32(LENGTH)
    known = pa.Array.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer(offsets), pa.py_buffer(strings)])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(hashed), pa.nulls(len(copied), pa.int64())]),
         pa.array(np.concatenate([place.doc[first], copied.doc])),
         pa.array(np.concatenate([place.start[first], copied.start])),
         pa.concat_arrays([known, pa.nulls(len(copied), pa.binary())])],
        names=["key", "doc", "low", "context"])


def _open_texts(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """key, doc, low, context of the open runs. Runs of hot anchors are given as their
    100-byte strings, by hash; without key and context those that are known as copies."""
    most = BUCKET_TEXTS
    hot = open_runs.groupBy("key").count().where(F.col("count") > most) \
        .select(F.col("key").alias("hot_key"))
    wanted = open_runs.join(hot, F.col("key") == F.col("hot_key"), "left").groupBy("doc").agg(
        F.collect_list(F.struct("key", "low", "high", F.col("hot_key").isNotNull().alias("hot")))
        .alias("runs"))
    joined = _keyed(docs).join(wanted, "doc").select("doc", "text", "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, CHUNK_BYTES):
            data, begins = flat_bytes(batch["text"])
            keys, docs_, lows, contexts = [], [], [], []
            hot_runs: list[tuple[int, int, int, bytes]] = []
            for doc, begin, found in zip(batch["doc"].to_pylist(), begins.tolist(),
                                         batch["runs"].to_pylist(), strict=False):
                for run in found:
                    if run["hot"]:
                        hot_runs.append((run["key"], doc, run["low"], data[
                            begin + run["low"]:begin + run["high"]].tobytes()))
                        continue
                    keys.append(run["key"])
                    docs_.append(doc)
                    lows.append(run["low"])
                    contexts.append(data[begin + run["low"]:begin + run["high"]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(docs_, pa.int64()),
                 pa.array(lows, pa.int64()), pa.array(contexts, pa.binary())],
                names=["key", "doc", "low", "context"])
            for at in range(0, len(hot_runs), most):
                yield _strings(hot_runs[at:at + most])

    return joined.mapInArrow(fetch, "key long, doc long, low long, context binary")


def _copies_in_bucket(rows: pa.Table) -> pa.Table:
    doc, start = copies_of(rows["context"].to_pylist(), rows["doc"].to_numpy(),
                           rows["low"].to_numpy(), rows["key"].to_numpy())
    doc, low, high = merged(doc, start, start + LENGTH)
    return pa.table({"doc": doc, "low": low, "high": high})


# --- the operator ------------------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "doc_id", "text")


def copied_spans(docs: DataFrame) -> DataFrame:
    """doc, low, high: byte intervals that are copies (they may overlap)."""
    total = id_and_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(total, BUCKET_BYTES)
    found = materialize(anchors(docs, buckets).groupBy("bucket").applyInArrow(resolve, _FOUND),
                        "copies-equal")
    open_runs = materialize(_open_texts(docs, found.where("key IS NOT NULL")), "copies-open")
    parts = buckets_for(open_runs.count(), BUCKET_TEXTS)
    inner = open_runs.where("key IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(parts))) \
        .groupBy("bucket").applyInArrow(_copies_in_bucket, "doc long, low long, high long")
    known = open_runs.where("key IS NULL").select("doc", "low", (F.col("low") + LENGTH).alias("high"))
    return found.where("key IS NULL").select("doc", "low", "high").union(known).union(inner)


def dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte intervals removed), kept_sha256
    per row; on demand ``kept`` (the remaining bytes).

    Texts count as UTF-8. Null and empty texts, and texts under 100 bytes, lose nothing.
    Rows that repeat an id are one document. Rows without an id are one document after
    all others, and may lose what only they share; an empty table gives no rows.
    """
    spans = copied_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    joined = _keyed(docs).join(spans, "doc", "left").select("doc_id", "text", "cuts")
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
              " spans array<struct<low: bigint, high: bigint>>") + ", kept binary" * with_kept
    span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, CHUNK_BYTES):
            data, begins = flat_bytes(batch["text"])
            rows: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans",
                                                     "kept_sha256", "spans", "kept")}
            for k, cuts in enumerate(batch["cuts"]):
                own = data[begins[k]:begins[k + 1]]
                found = []
                if cuts.is_valid:
                    low, high = (cuts.values.field(c).to_numpy() for c in (0, 1))
                    _, low, high = merged(np.zeros(len(low), np.int64), low, high)
                    found = list(zip(low.tolist(), high.tolist(), strict=True))
                edges = [0, *(x for s in found for x in s), len(own)]
                kept = b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows["n_bytes"].append(len(own))
                rows["n_removed"].append(len(own) - len(kept))
                rows["n_spans"].append(len(found))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["spans"].append([{"low": a, "high": b} for a, b in found])
                rows["kept"].append(kept)
            kinds = {"kept_sha256": pa.string(), "spans": span, "kept": pa.binary()}
            names = [c for c in rows if c != "kept" or with_kept]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()),
                 *(pa.array(rows[c], kinds.get(c, pa.int64())) for c in names)],
                names=["doc_id", *names])

    return joined.mapInArrow(cut, schema)
