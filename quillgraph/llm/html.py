"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores the share of words in its context
that lie in the content of labelled pages (positive), a tag loses by how seldom it lies
there (negative). Kadane's scan finds the contiguous run with the highest sum in one
pass. Labelled pages are those whose own markup names the content (one ``article`` or
``main``); that markup is the label only, never a feature. Counts cover all labelled
pages; there are as many as contexts and tags, which are fixed lists.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import small_batches

BATCH_BYTES = 4 << 20

# Elements by role, as HTML defines them.
_RAW = "script|style|noscript|template|textarea|select|svg|iframe|object|title"
_HEAD = frozenset("base basefont bgsound link meta noframes".split())  # and raw ones
_MATH = frozenset(
    "math annotation annotation-xml maction menclose merror mfenced mfrac mglyph mi mlabeledtr"
    " mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_BOILERPLATE = frozenset("nav header footer aside form button menu dialog".split())
_CONTENT = frozenset(["article", "main"])
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption div section"
                    " ul ol dl table tr figure body".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
# Class, id and role names that tell what is not the article. They count as whole names
# only ("has-sidebar" is a layout), and never for elements that hold the article.
_NO_HINT = frozenset(["html", "body", *_CONTENT])
_HINT = re.compile(
    r"(?:^|\s)(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header"
    r"|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|share|sharing|sidebar"
    r"|signup|social|sponsor\w*|subscribe|widget)(?=$|\s)", re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?![\w:-])(?:[^>]*/>|.*?(?:</\1\s*>|\Z))"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_PRIOR = 20  # pages' words a prior counts for


def _prior(feature: str) -> float:
    name = feature.split(":")[-1]
    if name in _BOILERPLATE or name == "hint":
        return 0.01
    if name in _CONTENT or name in ("body", "html", "none"):
        return 0.1
    return 0.9 if name in _PARAGRAPHS or name in _INLINE - {"a"} else 0.5


class Piece:
    """A run of text or a tag, with what the scores need."""
    __slots__ = ("feature", "words", "text", "blocked", "boundary", "content")

    def __init__(self, feature: str, text: str, blocked: bool, boundary: bool, content: bool):
        self.feature, self.text, self.blocked = feature, text, blocked
        self.words = len(text.split()) if text else 0
        self.boundary, self.content = boundary, content


class Open:
    """The open elements but inline ones, and counts of them, so that no token looks
    through all of them however deep they are nested."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []  # name; boilerplate or not
        self.names, self.blocks = Counter(), []
        self.blocked = self.content = 0

    def push(self, name: str, blocked: bool) -> None:
        self.stack.append((name, blocked))
        self._count(name, blocked, 1)
        if name in _BLOCKS:
            self.blocks.append(name)

    def pop(self) -> tuple[str, bool]:
        name, blocked = self.stack.pop()
        self._count(name, blocked, -1)
        if name in _BLOCKS:
            self.blocks.pop()
        return name, blocked

    def _count(self, name: str, blocked: bool, step: int) -> None:
        self.names[name] += step
        self.blocked += step * blocked
        self.content += step * (name in _CONTENT)

    def close(self, name: str) -> bool | None:
        """Ends the innermost element of the name and all in it; whether it is boilerplate,
        None if none is open."""
        if not self.names[name]:
            return None
        while True:
            ended, blocked = self.pop()
            if ended == name:
                return blocked


def parse(page: str) -> list[Piece]:
    """Text runs and tags in page order. Comments, raw elements, the head and an unfinished
    last tag give nothing; an element that is never closed ends with the one around it.

    The head ends at its end tag or, where that is left out, at the first text or tag that
    can't stand in it. Formulas are text of the line they stand in, without their tags and
    the source in their annotations.
    """
    out: list[Piece] = []
    nest = Open()
    in_head = in_note = False

    def add_text(raw: str) -> None:
        text = html.unescape(raw)
        if not text:
            return
        blocked = nest.blocked > 0
        context = "hint" if blocked else nest.blocks[-1] if nest.blocks else "none"
        out.append(Piece("w:" + context, text, blocked, False, nest.content > 0))

    at = 0
    for token in _TOKEN.finditer(page):
        between = page[at:token.start()]
        in_head = in_head and not between.strip()
        if not in_head and not in_note:
            add_text(between)
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        closing, names = token[2] == "/", token[4]
        if name in _MATH:
            in_head = False
            if name.startswith("annotation"):
                in_note = not closing and not names.rstrip().endswith("/")
            elif closing and name in ("math", "semantics"):
                in_note = False
            continue
        if name in _BLOCKS or name in _BOILERPLATE or name in _CONTENT:
            in_note = False  # an annotation that is never closed
        if name == "head":
            in_head = not closing
            continue
        if in_head and name in _HEAD:
            continue
        in_head = False
        hint = bool(names) and not closing and name not in _NO_HINT and any(
            _HINT.search(a or b or c) for a, b, c in _NAMES.findall(names))
        known = name in _BLOCKS or name in _INLINE or name in _BOILERPLATE or name in _CONTENT
        tag = "t:" + ("hint" if hint else name if known else "other")
        inside = nest.content > 0
        if name not in _INLINE and name not in _VOID:
            if closing:
                if nest.close(name) and name not in _BOILERPLATE:
                    tag = "t:hint"
            else:
                if name in _PARAGRAPHS and nest.stack and nest.stack[-1][0] in _PARAGRAPHS:
                    nest.pop()
                nest.push(name, hint or (name in _BOILERPLATE))
        elif hint and name not in _VOID and not closing:
            tag = "t:" + name  # inline hints don't open a region
        out.append(Piece(tag, "\n" if name == "br" else "", False,
                         name not in _INLINE, inside and name not in _CONTENT))
    if not in_note and not (in_head and not page[at:].strip()):
        add_text(page[at:])
    return out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, inside, outside: occurrences in and out of the content of labelled pages."""
    for batch in small_batches(batches, BATCH_BYTES, "html"):
        inside, outside = Counter(), Counter()
        for page in batch["html"].to_pylist():
            pieces = parse(page)
            if sum(p.feature in ("t:article", "t:main") for p in pieces) not in (1, 2):
                continue
            for p in pieces:
                (inside if p.content else outside)[p.feature] += max(p.words, p.feature[0] == "t")
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()),
             pa.array([outside[n] for n in names], pa.int64())],
            names=["feature", "inside", "outside"])


class Weights:
    """Scores by feature, from the counts of labelled pages and priors by role."""

    def __init__(self, counts: dict[str, tuple[int, int]]) -> None:
        self.counts, self.known = counts, {}

    def share(self, feature: str) -> float:
        if feature not in self.known:
            inside, outside = self.counts.get(feature, (0, 0))
            self.known[feature] = (inside + _PRIOR * _prior(feature)) / (inside + outside + _PRIOR)
        return self.known[feature]

    def score(self, piece: Piece) -> float:
        if piece.feature[0] == "w":
            return piece.words * max(0.01, self.share(piece.feature))
        return -0.05 - 1.5 * (1.0 - self.share(piece.feature))


def region(pieces: list[Piece], weights: Weights) -> tuple[int, int]:
    """The run with the highest sum; of equal runs the first, shortest. Empty if no
    word scores."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, piece in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += weights.score(piece)
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weights: Weights) -> str:
    pieces = parse(page)
    low, high = region(pieces, weights)
    blocks, now = [], []
    for piece in pieces[low:high]:
        if piece.boundary or piece.blocked:
            blocks.append("".join(now))
            now = []
        if not piece.blocked:
            now.append(piece.text)
    blocks.append("".join(now))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def fit(pages: DataFrame) -> Weights:
    """Weights from all labelled pages: one row per feature comes to the driver, and
    features are the fixed lists above."""
    counts = _pages(pages).mapInArrow(count, "feature string, inside long, outside long") \
        .groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights({r["feature"]: (r["inside"], r["outside"]) for r in counts.collect()})


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row; text is empty where a page has no content.

    Null and empty pages have none; pages cut off anywhere give what they hold; ids may
    be null or repeat; an empty table gives no rows. One narrow pass (two with ``fit``).
    """
    weights = weights or fit(pages)

    source = _pages(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES, "html"):
            texts = [main_text(page, weights) for page in batch["html"].to_pylist()]
            yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))

    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).withColumn(
        "n_chars", F.length("text").cast("long"))
