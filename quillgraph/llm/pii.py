"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of the base patterns and of looser ones (numbers without a
country prefix, spelt-out addresses, long IP addresses, cards with other separators).
Labelers vote on each candidate: the form of its surroundings, a checksum or range,
gazetteers, and words before it. Votes are counted by pattern in Spark (a bounded number
of rows); expectation-maximisation on these counts estimates how reliable each labeler
is and how likely each pattern is personal data; these likelihoods train the final
classifier, which is applied as a column expression. Base matches that are valid always
stay; the classifier decides on the others.

Positions come from the pieces between matches: a match begins where the lengths of all
pieces and matches before it end. Texts never leave the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import text_column
from quillgraph.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "valid", "listed", "context")
ACCEPT = 0.9
_SPAN = "struct<start:int,end:int,text:string>"

# Possessive forms of the base patterns: what follows a repeated class can't begin with
# a character of the class, so giving back never helps, and long runs need no stack. The
# look-behinds start a match at the head of a run or right after the match before.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?"
             r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){2}\.[0-9]{1,7}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}"
             r"(?![0-9A-Za-z-])",
}
# A cheap test of what a text must hold for any match of the kind.
_NEEDS = {"email": r"@|\bat\x20?[\])]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]",
          "card": r"[0-9][\x20.-]?[0-9]", "phone": r"\+[0-9]|[0-9][.-][0-9]{4}"}

# Shorter matches can't be valid; a table of numbers has thousands of them.
_LEAST = {"email": 5, "ip": 7, "card": 13, "phone": 10}

# Gazetteers: common top-level domains, calling codes, prefixes of card issuers and
# address blocks that belong to no one.
_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|ch|at|be|pl|ru|jp|cn|in|br|au|ca|us)$"
_CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^[(0-9]"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_NOBODY = r"^(?:0|10|127|169\.254|192\.168|2[2-5][0-9])\."
_CUES = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
         "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
         "card": r"(?i)\b(?:card|visa|credit|debit|payment|account)\b",
         "phone": r"(?i)\b(?:call|phone|tel|mobile|cell|fax|contact)\b"}
_AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|serial|section|figure|no|id)[.:]?\x20?$"


# --- spans -------------------------------------------------------------------------------

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def matches(text: Column, pattern: str, least: int = 1) -> Column:
    """Leftmost non-overlapping matches of ``least`` characters or more as array of
    start, end (code points), text. Shorter ones only move the position on."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(
            F.length(gap).alias("gap"), hit.alias("hit")))

        def add(done: Column, step: Column) -> Column:
            start = done["at"] + step["gap"]
            end = start + F.length(step["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), step["hit"].alias("text"))
            longer = F.when(F.length(step["hit"]) >= least, F.concat(done["out"], F.array(span)))
            return F.when(step["hit"].isNull(), done).otherwise(F.struct(
                end.alias("at"), F.coalesce(longer, done["out"]).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), _none().alias("out"))
        return F.when(F.size(found) == 0, _none()).otherwise(
            F.aggregate(steps, begin, add, lambda done: done["out"]))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn check."""
    figures = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")

    def worth(figure: Column, place: Column) -> Column:
        plain = figure.cast("int")
        twice = 2 * plain
        return F.when(place % 2 == 0, plain).otherwise(
            F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(figures, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    number = _digits(found)
    if kind == "card":
        return F.when(F.length(number).between(13, 19), _luhn(number)).otherwise(F.lit(False))
    return F.length(number).between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, span: Column) -> list[Column]:
    """One vote by each labeler: 1 for, -1 against, 0 none."""
    before = F.substring(text, F.greatest(span["start"] - 39, F.lit(1)),
                         F.least(span["start"], F.lit(40)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    found = span["text"]
    form = _vote(before.rlike(r"(?:^|[\s(<\[\"':,;])$") & after.rlike(r"^(?:$|[\s)>\]\"':,;.!?])"),
                 before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"))
    number = _digits(found)
    valid, listed = {
        "email": (_vote(found.rlike("[A-Za-z]"), ~found.rlike("[A-Za-z]")),
                  _vote(F.lower(found).rlike(_DOMAINS), F.lit(False))),
        "ip": (_vote(_valid("ip", found) | found.contains(":"), F.lit(True)),
               _vote(F.lit(False), found.rlike(_NOBODY))),
        "card": (_vote(_valid("card", number), F.lit(True)),
                 _vote(number.rlike(_ISSUER), ~number.rlike(_ISSUER))),
        "phone": (_vote(_valid("phone", found), F.lit(True)),
                  _vote(found.rlike(_CALLING), found.rlike(r"^\+"))),
    }[kind]
    context = _vote(before.rlike(_CUES[kind]), before.rlike(_AGAINST))
    return [form, valid, listed, context]


def _candidates(kind: str, text: Column) -> Column:
    """Base matches (``base``: valid ones, which stay) and loose ones apart from them."""

    def described(spans: Column, base: Column | None) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (_valid(kind, s["text"]) if base is None else base).alias("base"),
            F.lit(base is not None).alias("loose"),
            *(v.alias(n) for n, v in zip(LABELERS, _votes(kind, text, s), strict=True)),
            F.least(F.length(s["text"]) / 6, F.lit(5)).cast("int").alias("size")))

    def both(base: Column) -> Column:
        apart = F.filter(matches(text, _LOOSE[kind]), lambda s: ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.concat(described(base, None), described(apart, F.lit(False)))

    spans = matches(text, _BASE[kind], _LEAST[kind])
    return F.when(text.rlike(_NEEDS[kind]), _let(spans, both)).otherwise(described(_none(), None))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__spans``: the candidates of all kinds with their votes, by kind
    and start. One narrow pass."""
    text = text_column()
    # Within a kind the structs compare by start.
    return docs.withColumn("__spans", F.concat(
        *(F.sort_array(_candidates(kind, text)) for kind in KINDS)))


# --- the model -----------------------------------------------------------------------------

@dataclass
class Model:
    """Weights of the final classifier by (feature, value), and the labelers'
    reliabilities: share of right votes by labeler."""
    weights: dict[tuple[str, object], float] = field(default_factory=dict)
    bias: float = 0.0
    reliability: dict[str, float] = field(default_factory=dict)

    def probability(self, span: Column) -> Column:
        total = F.lit(self.bias)
        for (name, value), weight in sorted(self.weights.items(), key=str):
            total = total + F.when(span[name] == F.lit(value), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def accepts(self, span: Column) -> Column:
        """Base spans, and the loose ones that are probably personal data."""
        return span["base"] | (span["loose"] & (self.probability(span) >= ACCEPT))


def expectation_maximisation(rows: Iterable[dict], rounds: int = 50
                             ) -> tuple[list[float], dict[str, float]]:
    """Likelihood of each vote pattern (with its count ``n``) to be personal data, and
    each labeler's reliability; labelers err independently and may abstain. It starts
    from reliabilities of 0.8; two pseudo-votes keep rare labelers near it."""
    rows = list(rows)
    reliability, prior = dict.fromkeys(LABELERS, 0.8), 0.5
    likely = [0.5] * len(rows)
    for _ in range(rounds):
        for i, row in enumerate(rows):
            odds = math.log(prior / (1 - prior))
            for name in LABELERS:
                odds += row[name] * math.log(reliability[name] / (1 - reliability[name]))
            likely[i] = 1 / (1 + math.exp(-odds))
        total = sum(r["n"] for r in rows)
        prior = (1 + sum(p * r["n"] for p, r in zip(likely, rows, strict=True))) / (2 + total)
        for name in LABELERS:
            right = cast = 0.0
            for p, row in zip(likely, rows, strict=True):
                if row[name]:
                    cast += row["n"]
                    right += row["n"] * (p if row[name] > 0 else 1 - p)
            reliability[name] = min(0.99, max(0.51, (1.6 + right) / (2 + cast)))
    return likely, reliability


def classifier(rows: list[dict], likely: list[float], rounds: int = 400) -> Model:
    """Logistic regression on the likelihoods, by gradient descent over patterns."""
    names = ("kind", "size", *LABELERS)
    model = Model()
    keys = sorted({(n, r[n]) for r in rows for n in names}, key=str)
    model.weights = dict.fromkeys(keys, 0.0)
    total = sum(math.sqrt(r["n"]) for r in rows)
    for _ in range(rounds if rows else 0):
        step_bias, steps = 0.0, dict.fromkeys(keys, 0.0)
        for row, p in zip(rows, likely, strict=True):
            margin = model.bias + sum(model.weights[n, row[n]] for n in names)
            error = math.sqrt(row["n"]) * (p - 1 / (1 + math.exp(-margin))) / total
            step_bias += error
            for n in names:
                steps[n, row[n]] += error
        model.bias += 2.0 * step_bias
        for key in keys:
            model.weights[key] += 2.0 * (steps[key] - 0.0005 * model.weights[key])
    return model


def fit(found: DataFrame) -> Model:
    """The model from all candidates of ``candidates``. The rows that come to the driver
    are patterns: at most 4 kinds x 6 sizes x 3 votes of 4 labelers, whatever the data."""
    rows = [r.asDict() for r in found.select(F.explode("__spans").alias("s"))
            .groupBy("s.kind", "s.size", *(f"s.{n}" for n in LABELERS))
            .agg(F.count(F.lit(1)).alias("n")).collect()]
    rows.sort(key=str)
    likely, reliability = expectation_maximisation(rows)
    model = classifier(rows, likely)
    model.reliability = reliability
    return model


# --- the operator ---------------------------------------------------------------------------

def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans, spans per row: arrays of kind, start, end in code points (end
    exclusive), by kind (email, ip, card, phone), then start. ``spans`` holds the base
    ones and what the classifier adds.

    Null and empty texts have none; ids may be null or repeat; an empty table gives no
    rows. The text is read once; what is kept between the two steps has no text.
    """
    found = materialize(candidates(docs.select("doc_id", "text")).select("doc_id", "__spans"),
                        "pii-candidates")
    model = fit(found)

    def shown(keep: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("__spans", keep), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return found.select("doc_id", shown(lambda s: s["base"]).alias("base_spans"),
                        shown(model.accepts).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets, and ``n_chars``,
    if there, the new length; of overlapping spans the first, longest counts. Null texts
    stay null. Two passes over the texts: one fits the model."""
    model = fit(materialize(candidates(docs.select("doc_id", "text")).select("__spans"),
                            "pii-fit"))
    text = F.col("text")

    def add(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        return F.when(span["start"] < done["at"], done).otherwise(F.struct(
            span["end"].alias("at"),
            F.concat(done["out"], gap, F.lit("<"), F.upper(span["kind"]), F.lit(">")).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by_start = F.sort_array(F.transform(F.filter("__spans", model.accepts), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("longest"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    whole = F.aggregate(by_start, begin, add, lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    clean = candidates(docs).withColumn(
        "text", F.when(F.size("__spans") == 0, text).otherwise(whole))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(
            F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)
