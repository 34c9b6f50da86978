"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most ``capacity`` different ones. The
instance is therefore a histogram of lengths, counted in Spark and bounded by the
capacity whatever the data. On it the plan is made in bulk: sets of pieces that provably
belong together are fixed for all their copies at once, and what remains is packed by
best fit decreasing. The plan says for each length which ranks go to which sequences and
where; the pieces find their places by their rank among all pieces of their length. Ranks
are local ranks within a chunk of input plus the chunk's offset, so no length, however
frequent, is gathered in one task.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm.bpe import BatchCache
from quillgraph.llm.common import id_and_text, small_batches
from quillgraph.session import materialize

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 600_000  # of about 200 bytes each, while a task runs
_MARKS = frozenset(".,;:!?")
_TOGETHER = 2_000  # pieces in one call of the library
BATCH_BYTES = 2 << 20  # with 8 MB a worker holds a third more and takes no less time


# --- ids of the tokenizers library, with caches by word --------------------------------

class WordEncoder:
    """Ids of a word-based tokenizer whose tokens never cross a space or a line end.

    A text is cut there and each different word is encoded by the library once (per
    cache). Words of plain Latin letters are first cut as the tokenizer's own pattern
    cuts them, so that a word with and without a comma is encoded once; in a text of
    plain letters alone, before its words are told apart.
    """

    # Fixed value: the split pattern stated in the tokenizer's file.
    _PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    # Characters below U+0250 but one are lowered one by one and composed already; words
    # with the bracket may hold special tokens.
    _PLAIN = re.compile("[^<İɐ-\U0010ffff]*\\Z")
    # A mark before a space that may be part of a longer piece: it is behind another sign.
    _RUN_OF_SIGNS = re.compile("[^ 0-9a-zß-öø-ÿ][.,;:!?] ")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        if not all(t["content"].startswith("<") for t in _added_tokens(path)):
            raise ValueError("special tokens must begin with an angle bracket")
        self.pieces = BatchCache(self._together, CACHED_WORDS)
        self.words = BatchCache(self._words, CACHED_WORDS)

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: one call of the library for many, with a space between."""
        out: list[bytes] = []
        for low in range(0, len(pieces), _TOGETHER):
            part = pieces[low:low + _TOGETHER]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids), np.arange(len(part)), "right") * 4
            out += [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _cut(self, word: str) -> tuple[str, ...] | list[str]:
        """Pieces of a plain word; most are letters, perhaps with one mark behind."""
        word = word.lower()
        if word.isalpha():
            return (word,)
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return word[:-1], word[-1]
        return self._PIECES.findall(word)

    def _words(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if self._PLAIN.match(w)]
        cut = dict(zip(plain, map(self._cut, plain), strict=True))
        self.pieces.need({x for pieces in cut.values() for x in pieces})
        pieces, join = self.pieces, b"".join
        out = []
        for word in words:
            parts = cut.get(word)
            if parts is None:
                out.append(self._library(word))
            elif len(parts) == 1:
                out.append(pieces[parts[0]])
            else:
                out.append(join([pieces[x] for x in parts]))
        return out

    def _library(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _spaced(self, text: str) -> str:
        """The text with spaces for line ends; of a plain one in lower case, and with a
        space before the marks that end words, as these are pieces of their own."""
        text = text.replace("\n", " ")
        if self._PLAIN.match(text):
            text = text.lower()
            if not self._RUN_OF_SIGNS.search(text):
                for mark in _MARKS:
                    text = text.replace(mark + " ", f" {mark} ")
        return text

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(map(self._spaced, texts), pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.words.need(words)
        found = [self.words[w] for w in words]
        # The ids of all words in a row, by the number of each word.
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        at = np.repeat(first[which] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        bounds = 4 * ends[cut.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self.words.clear()
        self.pieces.clear()


def _added_tokens(path: str) -> list[dict]:
    import json
    with open(path, encoding="utf-8") as file:
        return json.load(file)["added_tokens"]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length,
    ids_crc32 (and ``ids``), with ``chunk`` and ``local`` rank of the piece among the
    chunk's pieces of its length. A chunk is an input partition."""
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long,"
              " chunk long, local long" + ", ids array<int>" * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, chunk = encoder(path), TaskContext.get().partitionId()
        try:
            yield from cut(batches, own, chunk)
        finally:  # workers live on; what they remember must not add up in an executor
            own.forget()

    def cut(batches: Iterator[pa.RecordBatch], own: WordEncoder, chunk: int
            ) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches, BATCH_BYTES):
            rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for doc_id, ids in zip(batch["doc_id"].to_pylist(),
                                   own.encode_all(batch["text"].to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    for c, v in (("doc_id", doc_id), ("piece", k), ("start", at // 4),
                                 ("length", length), ("ids_crc32", zlib.crc32(part)),
                                 ("chunk", chunk), ("local", int(seen[length]))):
                        rows[c].append(v)
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, "<i4"))
                    seen[length] += 1
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()],
                names=list(rows))

    return id_and_text(docs).mapInArrow(run, schema)


# --- the plan, on the histogram of lengths ---------------------------------------------

class Plan:
    """Places by length: ranks [rank, next rank) of a length go to sequences from
    ``sequence`` on, ``each`` to a sequence, from ``offset`` on.

    Entries are bounded: a group of alike sequences is split at most once a length and
    halves its free room whenever a length fills it, so their number is at most about
    11 x 3 x capacity.
    """

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.sequences, self.reduced = capacity, 0, 0
        self.used = [0] * (capacity + 1)
        self.entries: list[tuple[int, int, int, int, int]] = []  # length, rank, sequence, each, offset

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append((length, self.used[length], sequence, each, offset))
        self.used[length] += count

    def fix(self, group: list[int], times: int) -> None:
        """``times`` sequences that hold the lengths of ``group``."""
        offset = 0
        for length in group:
            self._take(length, times, self.sequences, 1, offset)
            offset += length
        self.sequences += times

    def reduce(self, left: list[int]) -> None:
        """Fix dominating sets. For the largest length j and the room r = C - j: if
        nothing fits, {j}; with k the largest that fits, {j, k} if k fills the room, if
        no two pieces fit together, or if no three fit and no pair is longer than k:
        then every other set with j can be exchanged for it without loss. An exact fill
        holds for every j. Stops at the first length without a dominating set."""
        top = self.capacity
        for j in range(top, 0, -1):
            k = top - j
            if k and k <= j and left[j] and left[k]:
                times = min(left[j], left[k]) if j != k else left[j] // 2
                if times:
                    self._fixed(left, [j, k], times)
        while lengths := [n for n in range(1, top + 1) if left[n]]:
            j = lengths[-1]
            left[j] -= 1
            group = self._dominating(left, j)
            left[j] += 1
            if group is None:
                return
            need = {n: group.count(n) for n in group}
            times = min(left[n] // c for n, c in need.items())
            self._fixed(left, group, times)

    def _fixed(self, left: list[int], group: list[int], times: int) -> None:
        self.fix(group, times)
        self.reduced += times
        for n in group:
            left[n] -= times

    def _dominating(self, left: list[int], j: int) -> list[int] | None:
        room = self.capacity - j
        fit = [n for n in range(1, room + 1) if left[n]]
        if not fit:
            return [j]
        small = [n for n in fit[:3] for _ in range(min(left[n], 3))][:3]
        k = fit[-1]
        if k == room or len(small) < 2 or small[0] + small[1] > room:
            return [j, k]
        if len(small) < 3 or sum(small) > room:
            pair = 0
            for a in fit:
                at = bisect.bisect_right(fit, room - a) - 1
                if at >= 0 and fit[at] == a and left[a] < 2:
                    at -= 1
                pair = max(pair, a + fit[at] if at >= 0 else 0)
            if pair <= k:
                return [j, k]
        return None

    def best_fit(self, left: list[int]) -> None:
        """Best fit decreasing for all pieces of a length at once. Open sequences are
        grouped by free room; the tightest group that fits takes as many as fit."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first, count)

        def open_up(room: int, first: int, count: int) -> None:
            if room and count:
                if room not in groups:
                    bisect.insort(rooms, room)
                groups.setdefault(room, []).append((first, count))

        for length in range(self.capacity, 0, -1):
            while left[length]:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, count = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    each = self.capacity // length
                    count = max(1, left[length] // each)
                    room, first = self.capacity, self.sequences
                    self.sequences += count
                each = room // length
                full = min(count, left[length] // each)
                if full:
                    self._take(length, full * each, first, each, self.capacity - room)
                    left[length] -= full * each
                    open_up(room - each * length, first, full)
                if full < count and 0 < left[length] < each:
                    rest = left[length]
                    self._take(length, rest, first + full, rest, self.capacity - room)
                    left[length] = 0
                    open_up(room - rest * length, first + full, 1)
                    full += 1
                open_up(room, first + full, count - full)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """length, rank, sequence, each, offset, sorted by length and rank."""
        rows = np.array(sorted(self.entries), np.int64).reshape(-1, 5)
        return tuple(rows.T)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = [histogram.get(n, 0) for n in range(capacity + 1)]
    out = Plan(capacity)
    out.reduce(left)
    out.best_fit(left)
    return out


# --- the operator ------------------------------------------------------------------------

def pack(docs: DataFrame, path: str, capacity: int = CAPACITY,
         with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``) per piece.

    A document is its ids and a closing id 0; longer ones are cut into pieces. Sequences
    are gapless from offset 0. Null and empty texts are the closing id alone; rows that
    repeat an id are packed each; an empty table gives no rows. ``path``: a tokenizer
    file that all executors can read.
    """
    items = materialize(pieces(docs, path, capacity, with_ids), "pack-pieces")
    counts = materialize(items.groupBy("chunk", "length").agg(
        F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, ranks, sequences, each, offsets = plan(histogram, capacity).arrays()
    # One row per chunk and length: pieces of the length in the chunks before it.
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0))
                         .cast("long").alias("base"))
    shift = 40  # ranks of one length below 2**40
    keys = (lengths << shift) | ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["base"].to_numpy() + batch["local"].to_numpy()
            at = np.searchsorted(keys, (length << shift) | rank, side="right") - 1
            inside = rank - ranks[at]
            kept = batch.drop_columns(["chunk", "local", "base"])
            yield kept.append_column("sequence_id", pa.array(sequences[at] + inside // each[at])) \
                .append_column("offset", pa.array(offsets[at] + length * (inside % each[at])))

    located = items.join(base, ["chunk", "length"]).select(*items.columns, "base")
    fields = [f for f in items.schema if f.name not in ("chunk", "local")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return located.mapInArrow(place, schema)
