"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition on the text that rejects a document. On a sample the rules'
costs (seconds a row) and selectivities (share rejected) are measured; rules are then
ordered by rejections per cost and evaluated as one CASE, so that most bad documents
meet a cheap rule first and the costly ones run on what is left. The order changes the
cost and the name of the rule that rejects, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BLANK, NOT_BLANK, text_column
from quillgraph.session import materialize

SAMPLE_ROWS = 2_000
_WINDOW = 5


# --- measures ------------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))


def _count(text: Column, others: str) -> Column:
    """Characters left when the runs of ``others`` are deleted."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeats(words: Column) -> Column:
    """Words equal to the word before them."""
    same = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                      lambda a, b: a.eqNullSafe(b))
    return F.size(F.filter(same, lambda x: x)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts with a repeated hash sort
    them; equal neighbours give the positions, whose gaps give the words covered.
    """
    n = F.size(words)
    keys = F.when(n >= _WINDOW, F.transform(
        F.sequence(F.lit(0), n - _WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(_WINDOW))))) \
        .otherwise(F.array().cast("array<bigint>"))

    def at_repeats(ordered: Column) -> Column:
        flags = F.transform(ordered, lambda x, i: F.when(
            (F.get(ordered, i - 1)["k"] == x["k"]) | (F.get(ordered, i + 1)["k"] == x["k"]),
            x["i"]))
        return F.sort_array(F.filter(flags, lambda x: x.isNotNull()))

    def total(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                          lambda a, b: F.coalesce(F.least(b - a, F.lit(_WINDOW)), F.lit(_WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def counted(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(
            keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")) \
            .otherwise(_let(_let(ordered, at_repeats), total))

    return _let(keys, counted)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text, its words and lines, and the counts of every text that are reported
    (null: empty, all counts 0): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words. One narrow pass; no shuffle."""
    text = F.col("text")
    split = docs.select("doc_id", text_column().alias("text")) \
        .withColumns({"words": _words(text), "lines": _lines(text)})
    words, lines = F.col("words"), F.col("lines")
    return split.select(
        "doc_id", "text", "words", "lines",
        F.size(words).cast("long").alias("n_words"),
        _count(text, BLANK + "+").alias("word_chars"),
        _count(text, "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(words).alias("n_repeat_words"))


# --- rules ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the text column and says whether the document goes."""
    name: str
    rejects: Callable[[Column], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


def _size(text: Column) -> Column:
    return F.size(_words(text))


# Shares in percent. Each bound lies far from what prose reaches: clean text has no
# symbols among its words, under 40 % capitals even where a text is one short line.
RULES = (
    Rule("few_words", lambda t: _size(t) < 10),
    Rule("repeated_windows", lambda t: _let(_words(t), lambda w: _share(
        _covered(w), F.size(w), 20))),
    Rule("symbols", lambda t: _share(_count(t, "[^#*$%&|<>]+"), _size(t), 25)),
    Rule("capitals", lambda t: _share(_count(t, r"\P{Lu}+"), _count(t, r"\P{L}+"), 50)),
    Rule("shouting", lambda t: _share(_count(t, "[^!]+"), _size(t), 50)),
    Rule("stutter", lambda t: _let(_words(t), lambda w: _share(_repeats(w), F.size(w), 30))),
    Rule("repeated_lines", lambda t: _let(_lines(t), lambda x: _share(
        F.size(x) - F.size(F.array_distinct(x)), F.size(x), 50))),
)


# Rules that need nothing beyond what is reported anyway.
REPORTED = ("few_words", "repeated_windows", "symbols")


def of_measures(name: str) -> Column:
    """The rule ``name`` on the columns of ``measures``; what is not reported is computed
    here, inside the rule."""
    col = F.col
    text, words, lines = col("text"), col("words"), col("lines")
    return {
        "few_words": lambda: col("n_words") < 10,
        "repeated_windows": lambda: _share(col("n_repeat_words"), col("n_words"), 20),
        "symbols": lambda: _share(col("n_symbols"), col("n_words"), 25),
        "capitals": lambda: _share(_count(text, r"\P{Lu}+"), _count(text, r"\P{L}+"), 50),
        "shouting": lambda: _share(_count(text, "[^!]+"), col("n_words"), 50),
        "stutter": lambda: _share(_repeats(words), col("n_words"), 30),
        "repeated_lines": lambda: _share(col("n_dup_lines"), F.size(lines), 50),
    }[name]()


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
         runs: int = 2) -> list[dict[str, object]]:
    """Rules by rejections per cost, with rule, cost (s) and rejected (share), as
    measured on about ``sample_rows`` random documents. A cost is the shortest of several
    runs after a first one, which pays for compilation, without what a run takes that
    reads the texts and does nothing. Ties and an empty table keep the given order."""
    rows = docs.count()
    if not rows:
        return [{"rule": rule, "cost": 0.0, "rejected": 0.0} for rule in rules]
    sample = materialize(docs.select(text_column().alias("text"))
                         .sample(min(1.0, sample_rows / rows), seed=7).coalesce(1), "rule-sample")

    def measured(rejects: Column) -> tuple[float, float]:
        job = sample.agg(F.count(F.lit(1)), F.count_if(rejects))
        times = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            seen, gone = job.first()
            times.append(time.perf_counter() - begun)
        return min(times[1:]), gone / max(seen, 1)

    idle, _ = measured(F.length("text") < 0)
    found = []
    for rule in rules:
        cost, rejected = measured(rule.rejects(F.col("text")))
        found.append({"rule": rule, "cost": max(cost - idle, 1e-3), "rejected": rejected})
    return sorted(found, key=lambda x: -x["rejected"] / x["cost"])


def cascade(order: list[dict[str, object]], condition: Callable[[Rule], Column]) -> Column:
    """The name of the first rule that rejects; null for documents that stay."""
    out = None
    for step in order:
        rule = step["rule"]
        out = (F if out is None else out).when(condition(rule), F.lit(rule.name))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """The reported counts of ``measures`` with doc_id, rejected_by (null: kept), base_failed
    and kept, per row.

    Rules on reported counts cost nothing more and come first; the others follow in the
    order of the plan, and are not evaluated for documents that are rejected by then.
    """
    order = plan(docs)
    free = [s for s in order if s["rule"].name in REPORTED]
    order = free + [s for s in order if s["rule"].name not in REPORTED]
    rejected = cascade(order, lambda rule: of_measures(rule.name))
    base = of_measures("few_words") | of_measures("repeated_windows")
    return measures(docs).withColumns({"rejected_by": rejected, "base_failed": base}) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()) \
        .drop("text", "words", "lines")


def passing(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a rule rejects; all columns stay. Rules
    after the one that rejects are not evaluated. Null and empty texts go (no words)."""
    verdict = cascade(plan(docs), lambda rule: rule.rejects(text_column()))
    return docs.where(verdict.isNull())
