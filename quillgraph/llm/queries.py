"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import (
    bpe, exact, frequent, html, lexical, lines, minhash, packing, pii, rules, substrings,
    toxicity, turns)
from quillgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return register


_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"


@_query("op1_exact_dedup", rf"""
WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_BARE}) AS text_sha256
           FROM documents),
     r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)
                  AS group_size
           FROM p WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


@_query("op9_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     s AS (SELECT doc_id, t,
                  list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(t, chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM d),
     k AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM s WHERE len(w) >= 5),
     g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM k),
     r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
     c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
           FROM r, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
     m AS (SELECT s.doc_id, len(w) AS n_words,
                  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                  len(l) - len(list_distinct(l)) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
                  len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2])) AS n_repeats,
                  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_shouts,
                  length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
                  length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters
           FROM s LEFT JOIN c USING (doc_id)),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_upper > 50 * n_letters
            OR 100 * n_shouts > 50 * n_words OR 100 * n_repeats > 30 * n_words
            OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b""")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; every executor has it there."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@_query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@_query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@_query("op10_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     u AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS k FROM d),
     o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k)
                     - length(line) - 1 AS pos,
                  lower(array_to_string(list_filter(regexp_split_to_array(
                      line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ')) AS norm
           FROM u),
     p AS (SELECT *, sum(CAST(norm = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS par FROM o),
     b AS (SELECT doc_id, par, min(k) AS k, string_agg(norm, ' ' ORDER BY k) AS whole
           FROM p WHERE norm <> '' GROUP BY doc_id, par),
     c AS (SELECT doc_id, par, row_number() OVER (PARTITION BY whole ORDER BY doc_id, k) > 1 AS again
           FROM b),
     r AS (SELECT p.*, norm <> '' AND (again OR row_number() OVER (
                           PARTITION BY norm ORDER BY p.doc_id, k) > 1) AS gone,
                  CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1
                  END AS n_words
           FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.par = c.par),
     i AS (SELECT *, sum(CAST(norm <> '' AND NOT gone AS INT)) OVER (
                         PARTITION BY doc_id ORDER BY k) AS island FROM r),
     s AS (SELECT doc_id, island, sum(n_words) FILTER (gone) AS n FROM i GROUP BY doc_id, island),
     t AS (SELECT doc_id, count(*) FILTER (n >= 20) AS n_passages FROM s GROUP BY doc_id)
SELECT i.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       CAST(coalesce(sum(n_words) FILTER (gone), 0) AS BIGINT) AS n_removed_words,
       any_value(n_passages) AS n_passages,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256,
       coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(line) AS BIGINT), ','
                           ORDER BY k) FILTER (gone), '') AS spans
FROM i JOIN t ON i.doc_id = t.doc_id GROUP BY i.doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return lines.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_removed_words", "n_passages",
        F.sha2("text", 256).alias("kept_sha256"),
        F.concat_ws(",", F.transform("spans", span)).alias("spans"))


@_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind))
    return pii.detect(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("spans").alias("spans"))


@_query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(table(spark, sf_dir, "documents"),
                         minhash.Near(words=3, percent=85, bands=24, rows=5))


@_query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op11_structure_repair")
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@_query("op12_lexical_search", rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(
                      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM documents),
     d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
     c AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM d),
     f AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
     q AS (SELECT item_id, unnest(regexp_extract_all(
                      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM benchmark),
     t AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
     x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
     y AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM x, c),
     s AS (SELECT item_id, f.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (
                      75 + CAST((25 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
           FROM t JOIN f USING (term) JOIN y USING (term) JOIN d ON d.doc_id = f.doc_id, c
           GROUP BY item_id, f.doc_id),
     r AS (SELECT item_id, CAST(row_number() OVER (
                      PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op13_frequent_lines", rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     u AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS k FROM d),
     n AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                               '{_UPPER}', '{_LOWER}') AS key
           FROM u),
     f AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     g AS (SELECT n.doc_id, line, k, coalesce(doc_id <> last, false) AS gone
           FROM n LEFT JOIN f ON n.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""")
def op13_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
