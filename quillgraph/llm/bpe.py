"""Byte-level BPE, encoding and decoding, with a segment tree over pair ranks.

A pre-token is merged by a segment tree whose leaves are the ranks of its adjacent
symbol pairs. The root holds the lowest rank; going down to the left child wherever it
equals the root's rank finds its leftmost pair. A merge changes three leaves, each a
logarithmic update, until no pair can be merged. Long pre-tokens cost n log n. Short
ones are merged many at a time: one numpy matrix holds a tree per row.

Tokenisation is local to a document, so the operator is one narrow pass: texts go to
Python in Arrow batches, words already seen come from bounded caches per worker, and
the words of a batch that are new are encoded together.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import id_and_text, small_batches

BATCH_BYTES = 2 << 20
CACHED_WORDS = 300_000
_NONE = 1 << 60
_LAST = np.int32(2**31 - 1)
# Pre-tokens of up to so many bytes are merged in matrices of so many rows.
_WIDEST, _ROWS = 64, 1 << 14
# The pre-tokenisation pattern and the printable stand-ins of bytes that
# the published byte-level vocabulary is defined with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

# Where a text can't be cut at its spaces alone: white space beside a space or an end.
_UNEVEN = re.compile(r" \s|\s |^\s|\s\Z")


class Cache(dict):
    """Values by word from ``make``; emptied when it has grown to ``most`` entries."""

    def __init__(self, make: Callable[[str], object], most: int = CACHED_WORDS) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> object:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


class BatchCache(dict):
    """Ids by word. ``need`` makes those of all new words of a batch at once."""

    def __init__(self, make_all: Callable[[list[str]], list[bytes]],
                 most: int = CACHED_WORDS) -> None:
        super().__init__()
        self.make_all, self.most = make_all, most

    def need(self, words: Collection[str]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, self.make_all(new), strict=True))


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary."""
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``symbols`` by ``pairs`` ((a, b) -> (rank, merged)), lowest rank first,
    then leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    merged: dict[int, int] = {}
    for i in range(n - 1):
        found = pairs.get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0]
            merged[found[0]] = found[1]
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, rank: int) -> None:
        i = size + leaf
        tree[i] = rank
        i >>= 1
        while i:
            low = tree[2 * i] if tree[2 * i] < tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def renew(left: int, right: int) -> None:
        found = pairs.get((symbols[left], symbols[right]))
        if found:
            merged[found[0]] = found[1]
        put(left, found[0] if found else _NONE)

    while (rank := tree[1]) < _NONE:
        i = 1
        while i < size:
            i = 2 * i if tree[2 * i] == rank else 2 * i + 1
        left = i - size
        gone = after[left]
        symbols[left] = merged[rank]
        symbols[gone] = -1
        right = after[left] = after[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if right < n:
            before[right] = left
            renew(left, right)
        else:
            put(left, _NONE)
        if before[left] >= 0:
            renew(before[left], left)
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks of symbol pairs, for single pairs and for arrays of them."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        self.one = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        table = np.array([(a << 20 | b, rank, c) for rank, (a, b, c) in enumerate(merges)],
                         np.int64).reshape(-1, 3)
        self.merged = table[:, 2].astype(np.int32)
        order = np.argsort(table[:, 0])
        self.keys, self.ranks = table[order, 0], table[order, 1].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _LAST where a pair can't be merged (symbols below 0: none)."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0),
                        self.ranks[at], _LAST)


def merge_rows(symbols: np.ndarray, pairs: Pairs) -> np.ndarray:
    """``merge`` for each row of a matrix of symbols, padded with -1; the width is a
    power of two. Merged-away places become -1."""
    rows, size = symbols.shape
    symbols = np.concatenate([symbols, np.full((rows, 2), -1, np.int32)], axis=1)
    tree = np.full((rows, 2 * size), _LAST, np.int32)
    tree[:, size:] = pairs.rank(symbols[:, :size], symbols[:, 1:size + 1])
    for low in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    after = np.tile(np.minimum(np.arange(1, size + 3), size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size + 1), (rows, 1))

    def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray | int) -> None:
        node = leaf + size
        tree[row, node] = rank
        for _ in range(size.bit_length() - 1):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    row = np.flatnonzero(tree[:, 1] < _LAST)
    while len(row):
        lowest = tree[row, 1]
        node = np.ones(len(row), np.int64)
        for _ in range(size.bit_length() - 1):
            node = 2 * node + (tree[row, 2 * node] != lowest)
        left = node - size
        gone = after[row, left]
        right = after[row, gone]
        symbols[row, left] = pairs.merged[lowest]
        symbols[row, gone] = -1
        after[row, left], before[row, right] = right, left
        put(row, np.minimum(gone, size - 1), np.where(
            gone < size, _LAST, tree[row, 2 * size - 1]))
        put(row, left, pairs.rank(symbols[row, left], symbols[row, right]))
        first = before[row, left]
        some = first >= 0
        put(row[some], first[some], pairs.rank(
            symbols[row[some], first[some]], symbols[row[some], left[some]]))
        row = row[tree[row, 1] < _LAST]
    return symbols[:, :size]


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        of_byte = byte_symbols()
        to_byte = {c: b for b, c in of_byte.items()}
        self.start = np.array([vocab[of_byte[b]] for b in range(256)], np.int32)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()
                         if all(c in to_byte for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.split = regex.compile(PATTERN)
        self.tokens = BatchCache(self._tokens)
        self.spaced = BatchCache(self._spaced)

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, those of about one length together."""
        raw = [t.encode() for t in tokens]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for i, data in enumerate(raw):
            classes.setdefault(1 << max(1, (len(data) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            if size > _WIDEST:
                for i in members:
                    ids = merge(self.start[np.frombuffer(raw[i], np.uint8)].tolist(), self.pairs.one)
                    out[i] = np.array(ids, "<u4").tobytes()
                continue
            for low in range(0, len(members), _ROWS):
                part = members[low:low + _ROWS]
                bare = np.frombuffer(b"".join(raw[i].ljust(size, b"\0") for i in part), np.uint8)
                lengths = np.array([len(raw[i]) for i in part])
                symbols = np.where(np.arange(size) < lengths[:, None],
                                   self.start[bare.reshape(-1, size)], np.int32(-1))
                merged = merge_rows(symbols, self.pairs)
                ends = np.cumsum((merged >= 0).sum(1)) * 4
                flat = merged[merged >= 0].astype("<u4").tobytes()
                for i, begin, end in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = flat[begin:end]
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them."""
        found = [self.split.findall(" " + word) for word in words]
        self.tokens.need({t for tokens in found for t in tokens})
        return [b"".join(map(self.tokens.__getitem__, tokens)) for tokens in found]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plans = []  # by text: runs of pre-tokens, of spaced words, or ready ids
        spaced: set[str] = set()
        tokens: set[str] = set()
        for text in texts:
            plan: list[tuple[BatchCache | None, list]] = []
            at = 0
            for mark in [*self.cut.finditer(text), None]:
                part = text[at:mark.start()] if mark else text[at:]
                head, rest = part, []
                if part and not _UNEVEN.search(part):
                    head, *rest = part.split(" ")
                first = self.split.findall(head)
                tokens.update(first)
                spaced.update(rest)
                plan += [(self.tokens, first), (self.spaced, rest)]
                if mark:
                    plan.append((None, [np.array([self.special[mark[0]]], "<u4").tobytes()]))
                    at = mark.end()
            plans.append(plan)
        self.spaced.need(spaced)
        self.tokens.need(tokens)
        return [b"".join(x for cache, items in plan
                         for x in (map(cache.__getitem__, items) if cache is not None else items))
                for plan in plans]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self.spaced.clear()
        self.tokens.clear()

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False,
               with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; on demand ``ids``
    (array<int>) and ``decoded``.

    ``path`` is a byte-level BPE file that all executors can read. Strings of special
    tokens in a text become their ids. Null and empty texts have no tokens; equal rows
    give equal results; an empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            yield from coded(batches, own)
        finally:  # workers live on; what they remember must not add up in an executor
            own.forget()

    def coded(batches: Iterator[pa.RecordBatch], own: Codec) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            rows: dict[str, list] = {c.split(" ")[0]: [] for c in schema.split(", ")[1:]}
            for ids in own.encode_all(batch["text"].to_pylist()):
                decoded = own.decode(ids)
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    rows["ids"].append(np.frombuffer(ids, "<i4"))
                if with_text:
                    rows["decoded"].append(decoded)
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()),
                 *(pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items())],
                names=["doc_id", *rows])

    return id_and_text(docs).mapInArrow(run, schema)
