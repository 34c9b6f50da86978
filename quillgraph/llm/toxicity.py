"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first four and five letters (inflected and compounded insults
share them), hashed into a fixed number of buckets. The machine has a short vector for
each term that is not rare, and a weight for each of those that tells by itself; products
of vectors give the weight of pairs, so that an insult next to the mention of a group
counts for more than both alone, also where neither tells anything alone. It is fitted
on a bounded random sample of labelled documents; scoring is one narrow pass over all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bpe import Cache
from quillgraph.llm.common import id_and_text, small_batches

BUCKETS = 1 << 20
FACTORS = 4
SAMPLE_ROWS = 12_000  # labelled documents that the fit may use, about
LEAST_DOCS = 4        # sampled documents a term must occur in to get a vector
LEAST_CHI = 8.0       # and how far from chance, to get a weight too
RATE, L1, L2 = 1.0, 1.0, 0.01
EPOCHS, BATCH = 8, 128
# Vectors are fitted after the weights, on what these leave open.
VECTOR_EPOCHS, VECTOR_BATCH, VECTOR_START, VECTOR_RATE, VECTOR_L2 = 6, 32, 0.1, 0.1, 1e-4
THRESHOLD = 0.7
BATCH_BYTES = 4 << 20
_WORD = re.compile(r"\w+")


def term_ids(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word and of its prefixes."""
    terms = {word} | {f"{word[:n]}*" for n in (4, 5) if len(word) >= n}
    return tuple(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms}))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct term buckets of the whole text (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(term_ids)
        for batch in small_batches(batches, BATCH_BYTES):
            found = [np.array(sorted(set().union(*map(known.__getitem__, set(
                _WORD.findall(text.lower()))))), np.int32) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "terms"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, terms array<int>")


@dataclass
class Machine:
    """``slot_of`` maps a bucket to its row of ``weights`` and ``vectors``; weights of
    terms that don't tell by themselves are 0."""
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slot_of: dict[int, int]

    def margins(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents given as runs of ``slots``; run i begins at starts[i]. Pairs
        count by 1 / root of the number of the document's terms: chance products of a long
        document don't add up, and a telling pair still shows among hundreds of terms."""
        return self.bias + _parts(self.weights, self.vectors, slots, starts)[0]


def _parts(weights, vectors, slots, starts):
    ends = np.append(starts[1:], len(slots))
    counts = ends - starts
    sums = np.zeros((len(starts), vectors.shape[1]))
    linear, squares = np.zeros(len(starts)), np.zeros(len(starts))
    full = np.flatnonzero(counts)
    if len(full):
        own = vectors[slots]
        sums[full] = np.add.reduceat(own, starts[full], axis=0)
        linear[full] = np.add.reduceat(weights[slots], starts[full])
        squares[full] = np.add.reduceat((own * own).sum(1), starts[full])
    scale = 1.0 / np.sqrt(np.maximum(counts, 1))
    return linear + 0.5 * scale * ((sums * sums).sum(1) - squares), sums, scale, counts


def _telling(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in LEAST_DOCS documents or more, which get a vector, and which of them get
    a weight: those whose own frequency depends on the label (chi-squared of the two by
    two table, one degree of freedom). Terms that tell only in pairs pass by the first."""
    n, toxic = len(labels), labels.sum()
    seen = np.bincount(flat, minlength=BUCKETS).astype(float)
    hits = np.bincount(flat, labels[owner], minlength=BUCKETS)
    expected = seen * toxic / max(n, 1)
    spread = expected * (1 - toxic / max(n, 1)) * (1 - seen / max(n, 1))
    chi = np.divide((hits - expected) ** 2, spread, out=np.zeros(BUCKETS), where=spread > 0)
    buckets = np.flatnonzero(seen >= LEAST_DOCS)
    return buckets, chi[buckets] >= LEAST_CHI


def train(terms: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS,
          factors: int = FACTORS, seed: int = 7, vector_epochs: int = VECTOR_EPOCHS) -> Machine:
    """Logistic loss over small batches, in two stages. First the weights and the bias:
    proximal steps with an L1 penalty (terms that tell nothing end at 0). Then, with these
    fixed, the vectors by AdaGrad: they take up what pairs of terms tell beyond the sum of
    the weights."""
    lengths = np.array([len(t) for t in terms], np.int64)
    flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(terms)), lengths)
    buckets, telling = _telling(flat, owner, labels)
    slot = np.full(BUCKETS, -1, np.int64)
    slot[buckets] = np.arange(len(buckets))
    inside = slot[flat] >= 0
    owner, flat = owner[inside], slot[flat[inside]]
    begins = np.searchsorted(owner, np.arange(len(terms) + 1))
    rng = np.random.default_rng(seed)
    n = len(buckets)

    def batches(times: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows, their slots in a row, where each row begins, and its number of slots."""
        for _ in range(times if len(terms) else 0):
            order = rng.permutation(len(terms))
            for low in range(0, len(order), size):
                rows = order[low:low + size]
                parts = [flat[begins[r]:begins[r + 1]] for r in rows]
                counts = np.array([len(p) for p in parts])
                yield rows, np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)[:-1]]), counts

    weights, vectors = np.zeros(n), rng.normal(0, VECTOR_START, (n, factors))
    bias = _fit_weights(weights, telling, labels, batches(epochs, BATCH))
    _fit_vectors(vectors, weights, bias, labels, batches(vector_epochs, VECTOR_BATCH))
    return Machine(bias, weights, vectors, {int(b): i for i, b in enumerate(buckets)})


def _errors(margin: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels


def _fit_weights(weights: np.ndarray, telling: np.ndarray, labels: np.ndarray,
                 batches: Iterator[tuple[np.ndarray, ...]]) -> float:
    """Fits ``weights`` in place; returns the bias."""
    pulls, sizes = np.zeros(len(weights)), np.zeros(len(weights))
    bias, step = -2.0, 1.0
    nothing = np.zeros((len(weights), 0))
    for rows, slots, starts, counts in batches:
        error = _errors(bias + _parts(weights, nothing, slots, starts)[0], labels[rows])
        if len(slots):  # a batch may have rare terms only
            used, at = np.unique(slots, return_inverse=True)
            grad = np.bincount(at, np.repeat(error, counts), len(used))
            grown = sizes[used] + grad * grad
            pulls[used] += grad - (np.sqrt(grown) - np.sqrt(sizes[used])) / RATE * weights[used]
            sizes[used] = grown
            z = pulls[used]
            weights[used] = np.where((np.abs(z) <= L1) | ~telling[used], 0.0, -(z - np.sign(z) * L1) / (
                (1.0 + np.sqrt(grown)) / RATE + L2))
        step += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(step)
    return bias


def _fit_vectors(vectors: np.ndarray, weights: np.ndarray, bias: float, labels: np.ndarray,
                 batches: Iterator[tuple[np.ndarray, ...]]) -> None:
    """Fits ``vectors`` in place."""
    steps = np.full(vectors.shape, 1e-2)
    for rows, slots, starts, counts in batches:
        if not len(slots):
            continue
        margin, sums, scale, _ = _parts(weights, vectors, slots, starts)
        error = _errors(bias + margin, labels[rows])
        used, at = np.unique(slots, return_inverse=True)
        pull = np.repeat(error * scale, counts)[:, None] * (
            np.repeat(sums, counts, axis=0) - vectors[slots])
        grad = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(vectors.shape[1])], 1)
        grad += VECTOR_L2 * vectors[used]
        steps[used] += grad * grad
        vectors[used] -= VECTOR_RATE * grad / np.sqrt(steps[used])


def held_out(doc_id: Column) -> Column:
    """Rows that the fit must not see: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from a random sample, by hash of the id, of the labelled documents that
    are not held out. Rows without id, text row or label are not learned from; ids with
    several labels count as toxic if one says so."""
    truth = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, truth.count()))
    chance = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = truth.where(chance < share)
    rows = features(docs.join(chosen, F.col("doc_id") == F.col("label_id"), "left_semi")) \
        .join(chosen, F.col("doc_id") == F.col("label_id")) \
        .select("terms", "toxic", "doc_id").toArrow().sort_by("doc_id")
    terms = [np.asarray(t.values, np.int64) for t in rows["terms"]]
    return train(terms, rows["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score per row; only the text is looked at. Null and empty texts and
    texts without known terms get the score of the bias; an empty table gives no rows."""
    slot_of = machine.slot_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(lambda word: tuple(slot_of[t] for t in term_ids(word) if t in slot_of))
        for batch in small_batches(batches, BATCH_BYTES):
            found = [np.array(sorted(set().union(*map(known.__getitem__, set(
                _WORD.findall(text.lower()))))), np.int64) for text in batch["text"].to_pylist()]
            counts = np.array([len(f) for f in found], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
            margins = machine.margins(np.concatenate(found), starts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()),
                 pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))],
                names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
