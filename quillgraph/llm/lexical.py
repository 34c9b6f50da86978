"""Ranked lexical search with pair-bound MaxScore.

1. One pass over the texts counts, per document, its terms and the terms that the queries
   of a block ask for. Totals and document frequencies are sums over all documents.
2. Documents are cut into shards. A shard's index has a posting list per term (documents
   and their exact impacts, with the highest), and for pairs of terms that a query holds
   together the list of documents with both, with the highest joint impact.
3. A query's terms are taken in pairs of alike frequency. What a document can get from a
   pair is at most the highest of both single maxima and the joint one, often far below
   the sum of the maxima. Pairs are taken by falling bound: a document whose best pair is
   this one gets at most what this pair and all weaker ones allow, so the scan stops when
   that is below the 20th score so far, and where only the joint bound reaches it, only
   the intersection list is read. Candidates drop out as soon as their partial score and
   the bounds of what is left can't reach it.
4. Before that, the 20th highest impact of a term or pair over all shards is a score that
   20 documents reach, so every shard begins with a threshold. Shards give their 20 best
   of each query; ranks come from these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import id_and_text, small_batches
from quillgraph.session import materialize

TOP = 20
QUERY_BLOCK = 2_000  # queries whose terms and pairs travel with the tasks, about
SHARD_DOCS, SHARD_POSTINGS = 8_000, 1_000_000
BATCH_BYTES = 4 << 20
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
_INDEX = "shard long, kind int, a int, b int, docs binary, impacts binary, best array<long>"
_DOCS, _TERM, _PAIR = 0, 1, 2
# Letters and digits of ASCII (lowered) and all bytes beyond it make terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127
                    else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# --- queries ------------------------------------------------------------------------------

@dataclass
class Block:
    """Some queries: ids by place, and their terms. A unit is a term with the number of
    times a query holds it."""
    items: list = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    counted: list[dict[int, int]] = field(default_factory=list)  # term -> times, by query
    weights: list[int] = field(default_factory=list)             # by term, once known
    groups: list[list[tuple]] = field(default_factory=list)      # ((term, times), other or None)
    pairs: dict[tuple, int] = field(default_factory=dict)
    floors: list[int] = field(default_factory=list)

    def add(self, item: int | None, text: str | None) -> None:
        self.items.append(item)
        found = Counter(terms((text or "").encode()))
        self.counted.append({self.vocabulary.setdefault(t, len(self.vocabulary)): k
                             for t, k in found.items()})

    def weigh(self, n_docs: int, frequency: dict[int, int]) -> None:
        """Weights of terms, and each query's terms in pairs of neighbours by frequency."""
        df = [frequency.get(t, 0) for t in range(len(self.vocabulary))]
        self.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0
                        for d in df]
        for counted in self.counted:
            units = sorted(((t, k) for t, k in counted.items() if self.weights[t] > 0),
                           key=lambda u: (df[u[0]], u))
            self.groups.append([(a, b) for a, b in zip(
                units[::2], [*units[1::2], None] if len(units) % 2 else units[1::2], strict=True)])
            for pair in self.groups[-1]:
                if pair[1]:
                    self.pairs.setdefault(pair, len(self.pairs))

    def set_floors(self, best: dict[tuple[int, int], int]) -> None:
        """``best``: the 20th highest impact by kind and number. Scores that 20 documents
        reach, by query."""
        for groups in self.groups:
            reached = [0]
            for pair in groups:
                reached += [best.get((_TERM, u[0]), 0) * u[1] for u in pair if u]
                reached.append(best.get((_PAIR, self.pairs.get(pair, -1)), 0))
            self.floors.append(max(reached))


# --- index ----------------------------------------------------------------------------------

def counts(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms, at least one), the block's terms in the text and how often."""
    vocabulary = block.vocabulary
    asked = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = terms(text.as_buffer().to_pybytes())
                if found:
                    tf = Counter(found)
                    held = [(vocabulary[t], tf[t]) for t in tf.keys() & asked]
                    rows.append((doc_id, len(found), [t for t, _ in held], [k for _, k in held]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (
                    pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)],
                names=["doc_id", "n", "terms", "tfs"])

    return id_and_text(docs).mapInArrow(run, _COUNTS)


def _best(values: np.ndarray) -> list[int]:
    return np.sort(values)[::-1][:TOP].tolist()


def shard_rows(number: int, table: pa.Table, block: Block, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index of one shard: its documents in the order of ids (nulls last), posting
    lists, and intersection lists."""
    table = table.sort_by([("doc_id", "ascending")])
    ids = table["doc_id"]
    n = table["n"].to_numpy()
    held = table["terms"].combine_chunks()
    sizes = np.diff(held.offsets.to_numpy())
    term = held.flatten().to_numpy()
    tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(n)), sizes)
    m = 75 + 25 * n * n_docs // n_terms
    impact = np.array(block.weights, np.int64)[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    order = np.lexsort((doc, term))
    order = order[impact[order] > 0]
    term, doc, impact = term[order], doc[order].astype(np.int32), impact[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term))
    lists = {int(term[a]): (doc[a:b], impact[a:b]) for a, b in zip(starts, ends, strict=True)}
    rows = [(_DOCS, -1, -1, ids.fill_null(0).to_numpy().tobytes(),
             ids.is_null().to_numpy().astype(np.int64).tobytes(), [])]
    rows += [(_TERM, t, -1, d.tobytes(), x.tobytes(), _best(x)) for t, (d, x) in lists.items()]
    beside = np.zeros(len(n), np.int64)
    for ((a, times_a), (b, times_b)), k in block.pairs.items():
        if a in lists and b in lists:
            (docs_a, own), (docs_b, other) = lists[a], lists[b]
            beside[docs_a] = own
            joint = beside[docs_b]
            both = joint > 0
            beside[docs_a] = 0
            if both.any():
                rows.append((_PAIR, k, -1, docs_b[both].tobytes(), b"",
                             _best(joint[both] * times_a + other[both] * times_b)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(rows), pa.int64()),
         *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
        names=["shard", "kind", "a", "b", "docs", "impacts", "best"])


def build_index(counted: DataFrame, block: Block, n_docs: int, n_terms: int,
                shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Posting and intersection lists of all shards; a shard is a run of an input
    partition. Ready to be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            return shard_rows(number, pa.Table.from_batches(waiting), block, n_docs, n_terms)

        docs = postings = 0
        for batch in batches:
            for low in range(0, len(batch), 1_000):
                part = batch.slice(low, 1_000)
                waiting.append(part)
                docs += len(part)
                postings += len(part["terms"].flatten())
                if docs >= shard_docs or postings >= SHARD_POSTINGS:
                    yield shard()
                    waiting.clear()
                    docs, postings, number = 0, 0, number + 1
        if waiting:
            yield shard()

    return counted.mapInArrow(run, _INDEX)


def twentieth(index: DataFrame) -> dict[tuple[int, int], int]:
    """The 20th highest impact of each list over all shards, where there are so many: one
    row for each term and pair of the block."""
    values = index.where(F.col("kind") != _DOCS).select("kind", "a", F.explode("best").alias("v"))
    place = F.row_number().over(Window.partitionBy("kind", "a").orderBy(F.desc("v")))
    ranked = values.withColumn("place", place).where(F.col("place") <= TOP) \
        .where(F.col("place") == TOP)
    return {(r["kind"], r["a"]): r["v"] for r in ranked.collect()}


# --- search ------------------------------------------------------------------------------------

class Shard:
    def __init__(self, rows: pa.Table) -> None:
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.joint: dict[int, tuple[np.ndarray, int]] = {}
        for kind, a, docs, impacts, best in zip(*(rows[c].to_pylist() for c in (
                "kind", "a", "docs", "impacts", "best")), strict=True):
            if kind == _DOCS:
                ids, no_id = np.frombuffer(docs, np.int64), np.frombuffer(impacts, np.int64)
                self.ids = [None if x else int(i) for i, x in zip(ids, no_id, strict=True)]
            elif kind == _TERM:
                self.lists[a] = np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int64)
            else:
                self.joint[a] = np.frombuffer(docs, np.int32), best[0]

    def gains(self, unit: tuple[int, int], docs: np.ndarray) -> np.ndarray:
        """What ``docs`` (sorted) get from a term."""
        held, impacts = self.lists[unit[0]]
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, impacts[at], 0) * unit[1]

    def search(self, groups: list[tuple], pairs: dict[tuple, int], floor: int,
               read: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best documents: all that are among the first 20 of
        the shard and reach ``floor``. ``read`` counts postings taken as candidates."""
        bounded = []
        for pair in groups:
            units = [u for u in pair if u and u[0] in self.lists]
            if not units:
                continue
            parts = [(int(self.lists[u[0]][1].max()) * u[1], self.lists[u[0]][0]) for u in units]
            if len(units) == 2 and pairs[pair] in self.joint:
                docs, most = self.joint[pairs[pair]]
                parts.append((most, docs))
            bounded.append((max(x for x, _ in parts), units, parts))
        bounded.sort(key=lambda g: (g[0], g[1]))
        below = np.cumsum([0, *(g[0] for g in bounded)])  # bound of all weaker groups
        known = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(len(bounded) - 1, -1, -1):
            if below[k + 1] < floor:
                break
            lists = [found for most, found in bounded[k][2] if below[k] + most >= floor]
            if not lists:
                continue
            new = np.zeros(len(self.ids), bool)
            for found in lists:
                new[found] = True
            new &= ~known
            known |= new
            some = np.flatnonzero(new)
            if read is not None:
                read["candidates"] += len(some)
            total = np.zeros(len(some), np.int64)
            for j in range(k, -1, -1):  # stronger groups hold none of these documents
                for unit in bounded[j][1]:
                    total += self.gains(unit, some)
                stays = total + below[j] >= floor
                if not stays.all():
                    some, total = some[stays], total[stays]
            docs, scores = np.concatenate([docs, some]), np.concatenate([scores, total])
            order = np.lexsort((docs, -scores))[:TOP]
            docs, scores = docs[order], scores[order]
            if len(docs) == TOP:
                floor = max(floor, int(scores[-1]))
        return docs, scores


def search_index(index: DataFrame, block: Block) -> DataFrame:
    """query (place in the block), item_id, doc_id, score: the best of each shard."""

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        out: list[list] = [[], [], [], []]
        for query, groups in enumerate(block.groups):
            docs, scores = shard.search(groups, block.pairs, max(1, block.floors[query]))
            for column, more in zip(out, ([query] * len(docs), [block.items[query]] * len(docs),
                                          [shard.ids[d] for d in docs], scores.tolist()), strict=True):
                column += more
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                        names=["query", "item_id", "doc_id", "score"])

    return index.groupBy("shard").applyInArrow(
        run, "query int, item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, query_block: int = QUERY_BLOCK,
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``TOP`` best documents of each row of
    ``queries`` (item_id, text) with a score above 0; equal scores by id, nulls last.

    Null and empty texts have no terms: such queries get no rows, such documents are not
    counted. Rows that repeat an id are documents, or queries, of their own. Empty tables
    give no rows. Queries are taken in blocks of about ``query_block``, all documents for
    each block.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), "text") \
        .where("text IS NOT NULL")
    blocks = max(1, -(-asked.count() // query_block))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        block = Block()
        for row in asked.where(number == k).collect():
            block.add(row["item_id"], row["text"])
        counted = materialize(counts(docs, block), "lexical-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not block.vocabulary:
            continue
        frequency = counted.select(F.explode("terms").alias("t")).groupBy("t").count()
        block.weigh(n_docs, {r["t"]: r["count"] for r in frequency.collect()})
        held = counted.where(F.size("terms") > 0)
        index = materialize(build_index(held, block, n_docs, n_terms, shard_docs), "lexical-index")
        block.set_floors(twentieth(index))
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.union(search_index(index, block)
                            .withColumn("rank", F.row_number().over(best))
                            .where(F.col("rank") <= TOP)
                            .select("item_id", "rank", "doc_id", "score"))
    return found
