"""Repair of conversation structure by a grammar-compressed shortest edit.

1. Every row becomes a symbol, its role's initial and its fault. Rows are range-partitioned
   in the order of conversations and turns, so that a long conversation is spread over
   tasks, and kept as chunks: byte strings of symbols with what their borders need.
2. Re-Pair: the most frequent neighbours of all chunks, counted in Spark, become rules, in
   a few rounds. The grammar is shared by all conversations and bounded by one byte.
3. An edit of a run of rows leads from one state of the legal pattern to another. Every
   symbol has a matrix of cheapest edits from state to state (min-plus), every rule the
   product of its two, bottom-up; an entry holds its cost and its audit as a rope, whose
   text is made only where costs are equal. A conversation is a product of few matrices.
4. The audits go to the rows: both are streamed side by side, one conversation after the
   other, and the repaired rows are hashed as they pass. Nothing but the audit is held.

A conversation's SHA-256 is sequential, so the rows of a very long one stream through one
task; no task gathers them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.bpe import Cache
from quillgraph.llm.common import BLANK, NOT_BLANK
from quillgraph.session import materialize

CHUNK = 4_096              # symbols
ROUNDS, RULES_A_ROUND = 6, 32
KNOWN = 20_000             # sequences of whole chunks whose outcome a worker remembers
_ROLES = {"s": 0, "u": 1, "a": 2}  # else 3
_OK, _TRUNCATED, _GONE = 0, 1, 2
_LEGAL = {"su", "ua", "au"}
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FINAL = (_START, _ASSISTANT)


# --- damage and faults -----------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (1 for a repeat) of ``rows`` after the damage that
    the checksum of ``conv_id:turn`` chooses. Nulls in role and text, and in the checksum's
    text, are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")) \
        .otherwise(part("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("copy"))


def in_order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first; several of one turn by a digest of
    role and text, so that equal ones are neighbours."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
            F.col("digest").asc(), F.col("copy").asc()]


def with_digest(rows: DataFrame) -> DataFrame:
    whole = F.sha2(F.concat("role", F.lit("\x00"), "text"), 256)
    return rows.withColumn("digest", F.substring(F.unhex(whole), 1, 16))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, copy, initial, fault (blank, duplicate, truncated or null)
    of rows with a digest; a duplicate has an earlier row of the same role and text."""
    light = rows.select(
        "conv_id", "turn", "digest", "copy", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(NOT_BLANK)).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{BLANK}*\z")).alias("truncated"))
    same = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    again = light.withColumn("again", F.row_number().over(same) > 1)
    return again.select("conv_id", "turn", "digest", "copy", "initial", F.when(
        F.col("blank"), "blank").when(F.col("again"), "duplicate").when(
        F.col("truncated"), "truncated").alias("fault"))


_CHUNK_SCHEMA = ("conv_id long, part int, no int, symbols binary, first string, last string,"
                 " blank long, duplicate long, truncated long, illegal long,"
                 " low long, high long, turns long")


def _symbol(initial: str, fault: str | None) -> int:
    return 3 * _ROLES.get(initial, 3) + (
        _OK if fault is None else _TRUNCATED if fault == "truncated" else _GONE)


def chunks(found: DataFrame) -> DataFrame:
    """Runs of symbols of one conversation, in order of (part, no), with counts of faults
    and of illegal neighbours, first and last initial, lowest and highest turn and the
    number of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]
        now: dict | None = None
        no = 0
        for batch in batches:
            done = []
            for conv_id, turn, initial, fault in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "turn", "initial", "fault")), strict=True):
                if now is None or now["conv_id"] != conv_id or len(now["symbols"]) == CHUNK:
                    if now is not None:
                        done.append(now)
                        no += 1
                    now = dict.fromkeys(names, 0) | {
                        "conv_id": conv_id, "part": part, "no": no, "symbols": bytearray(),
                        "first": initial, "last": None, "low": None, "high": None}
                now["symbols"].append(_symbol(initial, fault))
                if fault:
                    now[fault] += 1
                if now["last"] is not None and now["last"] + initial not in _LEGAL:
                    now["illegal"] += 1
                now["last"] = initial
                if turn is not None and turn != now["high"]:
                    now["turns"] += 1
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
            yield _batch(done)
        yield _batch([now] if now else [])

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        fields = [c.split() for c in _CHUNK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array([bytes(r[n]) if n == "symbols" else r[n] for r in rows], kinds[k])
             for n, k in fields], names=[n for n, _ in fields])

    placed = found.repartitionByRange(*in_order()).sortWithinPartitions(*in_order())
    return placed.mapInArrow(run, _CHUNK_SCHEMA)


# --- matrices of cheapest edits -----------------------------------------------------------------

class Rope:
    """A text as a tree of parts, made only when it is asked for."""
    __slots__ = ("left", "right", "made")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, made: str | None = None):
        self.left, self.right, self.made = left, right, made

    def __str__(self) -> str:
        if self.made is None:
            parts, waiting = [], [self]
            while waiting:
                rope = waiting.pop()
                if rope.made is not None:
                    parts.append(rope.made)
                else:
                    waiting += [rope.right, rope.left]
            self.made = "".join(parts)
            self.left = self.right = None
        return self.made


_EMPTY = Rope(made="")
Entry = tuple[int, Rope] | None


def _lower(a: Entry, b: Entry) -> Entry:
    """The cheaper of two edits of the same rows; of equal ones the ASCII-least audit.
    (Neither can be a proper beginning of the other: it would lack an insertion.)"""
    if a is None or b is None or a[0] != b[0]:
        return b if a is None or (b is not None and b[0] < a[0]) else a
    return a if str(a[1]) <= str(b[1]) else b


def times(row: list[Entry], matrix: list[list[Entry]]) -> list[Entry]:
    out: list[Entry] = [None] * 4
    for q, head in enumerate(row):
        if head is not None:
            for r, tail in enumerate(matrix[q]):
                if tail is not None:
                    cost = head[0] + tail[0]
                    if out[r] is None or cost <= out[r][0]:
                        joined = tail[1] if head[1] is _EMPTY else Rope(head[1], tail[1])
                        out[r] = _lower(out[r], (cost, joined))
    return out


def product(a: list[list[Entry]], b: list[list[Entry]]) -> list[list[Entry]]:
    return [times(row, b) for row in a]


def _insertions() -> list[list[Entry]]:
    """Cheapest insertions between states; more than two in a row never help."""
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for q in range(4):
        after = _ASSISTANT if q == _USER else _USER
        out[q][q] = (0, _EMPTY)
        out[q][after] = (3, Rope(made="I"))
        if q != _USER and q != _ASSISTANT:
            out[q][_ASSISTANT] = (6, Rope(made="II"))
    return out


INSERTIONS = _insertions()


def _edits(symbol: int) -> list[list[Entry]]:
    """Insertions before a row and then its own edit."""
    role, fault = divmod(symbol, 3)
    own: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    more = 3 * (fault == _TRUNCATED)
    for q in range(4):
        own[q][q] = (4, Rope(made="D"))
        if fault != _GONE:
            after = _ASSISTANT if q == _USER else _USER
            own[q][after] = (3 + more, Rope(made="R"))
            kept = {0: _SYSTEM if q == _START else None,
                    1: _USER if q != _USER else None,
                    2: _ASSISTANT if q == _USER else None}.get(role)
            if kept is not None:
                own[q][kept] = _lower(own[q][kept], (more, Rope(made="K")))
    return product(INSERTIONS, own)


# --- grammar --------------------------------------------------------------------------------------

Rules = list[tuple[int, int]]
SYMBOLS = 12


def compress(sequence: bytes, rules: Rules, first: int = 0) -> bytes:
    """``sequence`` with the rules from number ``first`` on applied, in their order."""
    for k in range(first, len(rules)):
        if len(sequence) < 2:
            break
        sequence = sequence.replace(bytes(rules[k]), bytes([SYMBOLS + k]))
    return sequence


def grammar(rows: DataFrame, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND) -> Rules:
    """Re-Pair rules (pairs of earlier symbols) from all sequences. A round takes the most
    frequent pairs; what comes to the driver is at most the square of the alphabet."""
    rules: Rules = []
    distinct = materialize(rows.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "turn-sequences")
    for _ in range(rounds):
        known = list(rules)

        def run(batches: Iterator[pa.RecordBatch], known: Rules = known) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << 16, np.int64)
            for batch in batches:
                for sequence, n in zip(batch["symbols"], batch["n"].to_pylist(), strict=True):
                    short = np.frombuffer(compress(sequence.as_buffer().to_pybytes(), known), np.uint8)
                    if len(short) > 1:
                        np.add.at(seen, short[:-1].astype(np.int64) << 8 | short[1:], n)
            pairs = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(seen[pairs])],
                                             names=["pair", "n"])

        best = distinct.mapInArrow(run, "pair long, n long").groupBy("pair") \
            .agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair") \
            .limit(rules_a_round).collect()
        if not best:
            break
        rules += [divmod(r["pair"], 256) for r in best]
    return rules


def matrices(rules: Rules) -> list[list[list[Entry]]]:
    """One matrix for each symbol and rule, bottom-up."""
    out = [_edits(s) for s in range(SYMBOLS)]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


# --- the operator -------------------------------------------------------------------------------

def begin() -> list[Entry]:
    return [(0, _EMPTY), None, None, None]


def advance(row: list[Entry], sequence: bytes, rules: Rules, tables: list) -> list[Entry]:
    for symbol in compress(sequence, rules):
        row = times(row, tables[symbol])
    return row


def finish(row: list[Entry]) -> tuple[int, str]:
    """Cost and audit of the cheapest legal end."""
    ended = times(row, INSERTIONS)
    best = None
    for q in _FINAL:
        best = _lower(best, ended[q])
    return best[0], str(best[1])


_SOLVED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,"
           " cost long, audit string")


def solve(parts: DataFrame, rules: Rules) -> DataFrame:
    """Counts, cost and audit of each conversation from its chunks."""
    counted = ("blank", "duplicate", "truncated", "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = matrices(rules)
        whole = Cache(lambda s: finish(advance(begin(), s, rules, tables)), KNOWN)
        rows: list[tuple] = []
        now: list[dict] = []  # the last chunk, and sums so far
        row = alone = None

        def close() -> None:
            total = now[0]
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            cost, audit = whole[alone] if row is None else finish(row)
            rows.append((total["conv_id"], gaps, *(total[c] for c in counted), cost, audit))

        for batch in batches:
            for part in batch.to_pylist():
                if now and now[0]["conv_id"] == part["conv_id"]:
                    total = now[0]
                    if row is None:
                        row = advance(begin(), alone, rules, tables)
                    row = advance(row, part["symbols"], rules, tables)
                    for c in counted:
                        total[c] += part[c]
                    total["illegal"] += total["last"] + part["first"] not in _LEGAL
                    total["last"] = part["last"]
                    if part["low"] is not None:
                        total["turns"] += part["turns"] - (part["low"] == total["high"])
                        total["high"] = part["high"]
                        if total["low"] is None:
                            total["low"] = part["low"]
                else:
                    if now:
                        close()
                    now, row, alone = [part], None, part["symbols"]
            yield _rows(rows)
            rows.clear()
        if now:
            close()
        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _SOLVED.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n == "audit" else pa.int64())
             for n, c in zip(names, columns, strict=True)], names=names)

    together = parts.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "part", "no")
    return together.mapInArrow(run, _SOLVED)


class Writer:
    """Applies an audit to rows as they come and hashes the repaired ones."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines = audit, 0, _START, 0
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _next(self) -> str:
        """The role that must come now."""
        self.state = _ASSISTANT if self.state == _USER else _USER
        return "user" if self.state == _USER else "assistant"

    def insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._put(self._next(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._put(self._next(), text)
        elif edit == "K":
            self.state = 1 + _ROLES[role[0]]
            self._put(role, text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    of the conversations in ``rows`` (conv_id, turn, role, text, after any damage; not
    null but for ids and turns; ``copy`` orders equal rows).

    A role without a letter is no legal one. Rows without conv_id are one conversation.
    Rows that repeat one another are duplicates. An empty table gives no rows.
    """
    rows = with_digest(rows)
    parts = materialize(chunks(faults(rows)), "turn-chunks")
    solved = solve(parts, grammar(parts.select("symbols")))
    fields = [c.split() for c in _SOLVED.split(", ")][1:]
    row_fields = [("turn", "long"), ("digest", "binary"), ("copy", "int"), ("role", "string"),
                  ("text", "string")]
    heads = solved.select("conv_id", F.lit(0).alias("kind"), *(
        F.lit(None).cast(k).alias(n) for n, k in row_fields), *(n for n, _ in fields))
    own = rows.select("conv_id", F.lit(1).alias("kind"), *(
        F.col(n).cast(k).alias(n) for n, k in row_fields), *(
        F.lit(None).cast(k).alias(n) for n, k in fields))
    conv, turn, digest, copy = in_order()
    stream = heads.union(own).repartition("conv_id").sortWithinPartitions(
        conv, "kind", turn, digest, copy)
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer = None, None
        for batch in batches:
            done: list[dict] = []
            heads = iter(batch.select(["conv_id", *names]).filter(
                pc.equal(batch["kind"], 0)).to_pylist())
            for kind, role, text in zip(*(batch[c].to_pylist() for c in ("kind", "role", "text")),
                                        strict=True):
                if kind == 0:
                    if head:
                        done.append(head | {"repaired_sha256": writer.digest()})
                    head = next(heads)
                    writer = Writer(head["audit"])
                else:
                    writer.take(role, text)
            yield _out(done)
        yield _out([head | {"repaired_sha256": writer.digest()}] if head else [])

    def _out(done: list[dict]) -> pa.RecordBatch:
        columns = ["conv_id", *names, "repaired_sha256"]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in done], pa.string() if c in ("audit", "repaired_sha256")
                      else pa.int64()) for c in columns], names=columns)

    return stream.mapInArrow(run, _SOLVED + ", repaired_sha256 string")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """``repair`` of ``damage``, with a row for each original conversation: those that have
    no rows left have zeros, an empty audit and the hash of nothing."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                       F.col("turn").cast("long").alias("turn"), "role", "text")
    done = repair(damage(rows))
    every = rows.select("conv_id").distinct().select(F.col("conv_id").alias("id"))
    zero = {c: F.lit(0).cast("long") for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = every.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *(
        F.coalesce(F.col(c), value).alias(c) for c, value in zero.items()))
