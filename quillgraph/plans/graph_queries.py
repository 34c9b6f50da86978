"""Queries over graphs, samples, features, link prediction and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators import features, graph, linkpred, metrics, partners, sampling
from quillgraph.operators.skew import parts_of
from quillgraph.plans.catalog import AUTHOR_IX, EDGES, MENTIONS, PAIRS, hash32, hash60, query
from quillgraph.session import materialize, scratch
from quillgraph.sources import tables
from quillgraph.sources import testtables as tt
from quillgraph.sources.testtables import Tables

WIDTH = 64  # elements of an embedding in the test tables
OUT = 16    # elements after projection


def _edges(t: Tables) -> DataFrame:
    return graph.bipartite_edges(tt.authorships(t, *graph.TEAM_SIZE))


def _pair_parts(t: Tables) -> int:
    """Partitions for pairs of co-authors, some four for each line item."""
    return parts_of(4 * t.lineitem.count(), t.lineitem)


def _undirected(t: Tables) -> DataFrame:
    return graph.undirected_edges(graph.coauthor_pairs(tt.small_teams(t)), parts=_pair_parts(t))


def _symmetric(t: Tables) -> DataFrame:
    return graph.symmetric_edges(graph.coauthor_pairs(tt.small_teams(t)), parts=_pair_parts(t))


def _nodes(t: Tables) -> DataFrame:
    """Every author with a vector: embedding number ``author % embeddings``.

    Kept as a table, as features are between jobs, so that the planner knows its
    size when it chooses between a broadcast and a shuffle.
    """
    count = t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
    authors = t.part.select(F.col("p_partkey").alias("node"),
                            F.pmod(F.col("p_partkey"), count).alias("vec_id"))
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("features"))
    return materialize(authors.join(vectors, "vec_id").select("node", "features"), "nodes")


def _author_count(t: Tables) -> Column:
    return t.part.agg(F.count(F.lit(1)).alias("n")).scalar()


NODES = """n AS MATERIALIZED (SELECT p_partkey AS node, embedding AS e FROM part
  JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


def _long(df: DataFrame, key: str, vector: str = "features") -> DataFrame:
    """``(key, pos, value)``: one row per vector element, rounded."""
    return (df.select(key, F.posexplode(vector).alias("pos", "value"))
            .select(key, "pos", (F.round("value", 5) + F.lit(0.0)).alias("value")))


@query(f"WITH {EDGES} SELECT author, work FROM edges")
def bipartite_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS work, l_partkey AS author FROM lineitem
  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10))
SELECT author, work FROM m WHERE author IN (
  SELECT author FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)""")
def distinct_bipartite_edges(t: Tables) -> DataFrame:
    return graph.bipartite_edges(tt.authorships(t, *graph.TEAM_SIZE), dedup=True)


@query(f"""WITH {MENTIONS}, c AS (SELECT author, count(*) AS n_works FROM m GROUP BY 1)
SELECT author, work, n_works FROM m JOIN c USING (author) WHERE n_works > 2""")
def works_per_author_list(t: Tables) -> DataFrame:
    return graph.works_per_author(tt.mentions(t), 3)


@query(f"""WITH {EDGES}, best AS (SELECT author FROM edges GROUP BY 1 HAVING count(*) > 2
  ORDER BY count(*) DESC, author LIMIT 20)
SELECT author, work FROM edges WHERE author IN (SELECT author FROM best)""")
def top_authors(t: Tables) -> DataFrame:
    return graph.top_authors(_edges(t), 20)


@query(f"""WITH {EDGES} SELECT DISTINCT work::VARCHAR AS id, '{graph.WORK_COLOR}' AS color FROM edges
UNION ALL SELECT DISTINCT author::VARCHAR, '{graph.AUTHOR_COLOR}' FROM edges""")
def graph_nodes(t: Tables) -> DataFrame:
    return graph.graph_nodes(_edges(t))


@query(f"WITH {PAIRS} SELECT work, src, dst FROM pairs")
def coauthor_pairs(t: Tables) -> DataFrame:
    return graph.coauthor_pairs(tt.small_teams(t))


@query(f"WITH {PAIRS} SELECT src, dst, weight FROM und")
def undirected_edges(t: Tables) -> DataFrame:
    return _undirected(t)


@query(f"WITH {PAIRS} SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und")
def symmetric_edges(t: Tables) -> DataFrame:
    return _symmetric(t)


@query(f"""WITH {EDGES} SELECT author, work FROM edges
ORDER BY md5('rows:' || author || ':' || work), author, work LIMIT 1000""")
def sample_rows(t: Tables) -> DataFrame:
    return sampling.sample_rows(_edges(t), 1000, ["author", "work"])


@query(f"""WITH {EDGES}, g AS (SELECT work FROM (SELECT DISTINCT work FROM edges)
  ORDER BY md5('groups:' || work), work LIMIT 500)
SELECT author, work FROM edges WHERE work IN (SELECT work FROM g)""")
def sample_groups(t: Tables) -> DataFrame:
    return sampling.sample_groups(_edges(t), 500, "work")


@query(f"""WITH {PAIRS}, h AS (SELECT *, {hash32("'edge:' || src || ':' || dst")} AS h FROM und)
SELECT src, dst, weight, CASE WHEN h < {int(round(0.8 * 2**32))} THEN 'train'
  WHEN h < {int(round(0.9 * 2**32))} THEN 'val' ELSE 'test' END AS split FROM h""")
def edge_split(t: Tables) -> DataFrame:
    return sampling.split_edges(_undirected(t))


@query(f"""WITH h AS (SELECT o_orderkey, {hash32("'split:' || o_orderkey")} AS h FROM orders)
SELECT o_orderkey, CASE WHEN h < {int(round(0.8 * 2**32))} THEN 'train' ELSE 'test' END AS split
FROM h""")
def row_split(t: Tables) -> DataFrame:
    return sampling.split(t.orders.select("o_orderkey"), {"train": 0.8, "test": 0.2},
                          ["o_orderkey"])


def _drawn(salt: str, k: int) -> str:
    """SQL for ``k`` random pairs per undirected edge, as CTE ``drawn``."""
    text = f"'{salt}:' || src || ':' || dst || ':' || draw"
    nodes = "(SELECT count(*) FROM part)"
    return f"""drawn AS MATERIALIZED (SELECT src AS pos_src, dst AS pos_dst, draw,
  {hash60(text, 0)} % {nodes} AS nsrc, {hash60(text, 1)} % {nodes} AS ndst
  FROM (SELECT src, dst, unnest(range(1, {k + 1}))::INT AS draw FROM und))"""


@query(f"""WITH {PAIRS}, {_drawn("neg", 1)}
SELECT pos_src, pos_dst, draw, nsrc AS src, ndst AS dst FROM drawn""")
def negatives(t: Tables) -> DataFrame:
    return sampling.random_negatives(_undirected(t), _author_count(t))


@query(f"""WITH {PAIRS}, {_drawn("rank", 5)}
SELECT pos_src AS src, pos_dst, draw, ndst AS dst FROM drawn""")
def ranking_negatives(t: Tables) -> DataFrame:
    return sampling.corrupt_targets(_undirected(t), _author_count(t), 5)


# Free pairs by the round (of three draws) that finds them first, and as many rounds as
# give one pair per positive.
HARD = f"""{_drawn("hard", 24)}, p AS (
  SELECT least(nsrc, ndst) AS src, greatest(nsrc, ndst) AS dst, min((draw + 2) // 3) AS found
  FROM drawn WHERE nsrc <> ndst GROUP BY 1, 2),
free AS MATERIALIZED (SELECT p.* FROM p ANTI JOIN und ON und.src = p.src AND und.dst = p.dst),
c AS (SELECT found, sum(count(*)) OVER (ORDER BY found) AS n FROM free GROUP BY 1),
neg AS (SELECT src, dst, row_number() OVER (
    ORDER BY md5('hard-order:' || src || ':' || dst), src, dst) - 1 AS ix
  FROM free WHERE found <= (SELECT min(found) FROM c WHERE n >= (SELECT count(*) FROM und)))"""


@query(f"""WITH {PAIRS}, {HARD}
SELECT src, dst FROM neg WHERE ix < (SELECT count(*) FROM und)""")
def hard_negatives(t: Tables) -> DataFrame:
    """As many pairs that are no edges as there are edges."""
    edges = materialize(_undirected(t), "edges")
    return sampling.hard_negatives(edges, edges, _author_count(t)).select("src", "dst")


@query(f"""WITH {PAIRS}, {HARD},
h AS (SELECT {hash32("'edge:' || src || ':' || dst")} AS h FROM und),
s AS (SELECT count(*) FILTER (h >= {int(round(0.9 * 2**32))}) AS test,
  count(*) FILTER (h < {int(round(0.8 * 2**32))}) AS train, count(*) AS n FROM h)
SELECT src, dst, CASE WHEN ix < test THEN 'test' WHEN ix < test + train THEN 'train'
  ELSE 'val' END AS split FROM neg, s WHERE ix < n""")
def split_negatives(t: Tables) -> DataFrame:
    """As many negatives as positives in each part of the split."""
    edges = materialize(_undirected(t), "edges")
    return sampling.split_negatives(sampling.split_edges(edges), edges, _author_count(t))


@query(f"""WITH {PAIRS}, sym AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und),
seeds AS (SELECT p_partkey AS node FROM part),
r AS MATERIALIZED (SELECT src, dst,
  row_number() OVER (PARTITION BY src ORDER BY md5('hop1:' || src || ':' || dst), dst) AS r1,
  row_number() OVER (PARTITION BY src ORDER BY md5('hop2:' || src || ':' || dst), dst) AS r2
  FROM sym),
h1 AS MATERIALIZED (SELECT src, dst FROM r SEMI JOIN seeds ON src = node WHERE r1 <= 10),
h2 AS (SELECT r.src, r.dst FROM r SEMI JOIN h1 ON r.src = h1.dst WHERE r2 <= 10)
SELECT 1 AS hop, src, dst FROM h1 UNION ALL SELECT 2, src, dst FROM h2""")
def neighbor_sample(t: Tables) -> DataFrame:
    """Sampled surroundings of every author, two hops."""
    seeds = t.part.select(F.col("p_partkey").alias("node"))
    # Read once per hop, hence kept as a table.
    return sampling.neighbor_sample(materialize(_symmetric(t), "edges"), seeds,
                                    parts=_pair_parts(t))


@query(f"WITH {AUTHOR_IX} SELECT author, author_ix FROM ix")
def author_index(t: Tables) -> DataFrame:
    return features.author_index(tt.positioned(t))


NAMED_IX = AUTHOR_IX.replace("ORDER BY work, pos, author)", "ORDER BY work, pos, 'A' || author)")


@query(f"""WITH {PAIRS}, {NAMED_IX} SELECT a.author_ix AS src, b.author_ix AS dst, weight
FROM und JOIN ix a ON a.author = src JOIN ix b ON b.author = dst""")
def indexed_edges(t: Tables) -> DataFrame:
    """The co-author graph of text ids, in author numbers."""
    named = lambda c: F.concat(F.lit("A"), F.col(c).cast("string"))
    edges = _undirected(t).withColumns({"src": named("src"), "dst": named("dst")})
    index = features.author_index(tt.positioned(t).withColumn("author", named("author")))
    return graph.index_edges(edges, materialize(index, "author-index"))


@query(f"""WITH {PAIRS}, sym AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und),
seeds AS (SELECT DISTINCT o_custkey % (SELECT count(*) FROM part) AS node FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
h1 AS MATERIALIZED (SELECT src, dst FROM sym SEMI JOIN seeds ON src = node
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5('hop1:' || src || ':' || dst), dst) <= 3),
h2 AS (SELECT sym.src, sym.dst FROM sym SEMI JOIN h1 ON sym.src = h1.dst QUALIFY row_number() OVER (
  PARTITION BY sym.src ORDER BY md5('hop2:' || sym.src || ':' || sym.dst), sym.dst) <= 2)
SELECT 1 AS hop, src, dst FROM h1 UNION ALL SELECT 2, src, dst FROM h2""")
def neighbor_sample_seeds(t: Tables) -> DataFrame:
    """Sampled surroundings of some authors: only their edges are ranked."""
    count = _author_count(t)
    seeds = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(
        F.pmod(F.col("o_custkey"), count).alias("node"))
    return sampling.neighbor_sample(materialize(_symmetric(t), "edges"), seeds, (3, 2),
                                    parts=_pair_parts(t))


def _terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    """``(work, position, item, author, field)`` and the same with ``country``.

    The author's own brand is the field, the supplier's nation the country.
    """
    def seen(column: str, name: str) -> DataFrame:
        return tt.lines(t, ["l_linenumber", "l_partkey", column]).select(
            F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("position"),
            F.col("l_partkey").alias("author"), F.col("l_partkey").alias("item"),
            F.col(column).alias(name))

    return seen("p_brand", "field"), seen("n_name", "country")


def _vocab(term: str, source: str) -> str:
    return f"""{term}s AS (SELECT term, row_number() OVER (
  ORDER BY work, pos, item, term) - 1 AS ix FROM (
  SELECT {source} AS term, l_orderkey AS work, l_linenumber AS pos, l_partkey AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (
    PARTITION BY {source} ORDER BY l_orderkey, l_linenumber, l_partkey) = 1))"""


VOCABS = _vocab("field", "p_brand") + ", " + _vocab("country", "n_name")


@query(f"""WITH {VOCABS} SELECT 'field' AS kind, term, ix FROM fields
UNION ALL SELECT 'country', term, ix FROM countrys""")
def vocabularies(t: Tables) -> DataFrame:
    fields, countries = _terms(t)
    return (features.vocabulary(fields, "field", features.SEEN)
            .select(F.lit("field").alias("kind"), "term", "ix")
            .unionByName(features.vocabulary(countries, "country", features.SEEN)
                         .select(F.lit("country").alias("kind"), "term", "ix")))


@query(f"""WITH {VOCABS} SELECT p_partkey AS author, ix, term FROM part
JOIN fields ON p_brand = term WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def load_vocabulary(t: Tables) -> DataFrame:
    """Terms to indexes, and back by the inverse lookup."""
    fields, _ = _terms(t)
    vocab = materialize(features.vocabulary(fields, "field", features.SEEN), "vocabulary")
    coded = features.encode(fields.select("author", "field").distinct(), vocab, "field")
    return tables.lookup_terms(coded, vocab, "ix").select("author", "ix", "term")


@query(f"""WITH {AUTHOR_IX}, {VOCABS},
v AS (SELECT l_partkey AS author, embedding AS e FROM lineitem JOIN embeddings
  ON vec_id = l_orderkey % (SELECT count(*) FROM embeddings)
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 500 = 7)),
u AS (SELECT author, unnest(range({WIDTH})) AS pos, unnest(e) AS x FROM v),
mean AS (SELECT author, pos, avg(x::DOUBLE) AS value FROM u GROUP BY 1, 2
  UNION ALL SELECT author, unnest(range({WIDTH})), 0.0 FROM ix ANTI JOIN v USING (author)),
fs AS (SELECT DISTINCT l_partkey AS author, ix FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN fields ON p_brand = term),
cs AS (SELECT DISTINCT l_partkey AS author, ix FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN countrys ON n_name = term),
nf AS (SELECT count(*) AS n FROM fields), nc AS (SELECT count(*) AS n FROM countrys),
hot AS (
  SELECT author, {WIDTH} + i AS pos, (EXISTS (SELECT 1 FROM fs WHERE fs.author = ix.author
    AND fs.ix = i))::INT::DOUBLE AS value
  FROM ix, (SELECT unnest(range(n)) AS i FROM nf)
  UNION ALL SELECT author, {WIDTH} + (SELECT n FROM nf) + i, (EXISTS (SELECT 1 FROM cs
    WHERE cs.author = ix.author AND cs.ix = i))::INT::DOUBLE
  FROM ix, (SELECT unnest(range(n)) AS i FROM nc))
SELECT author_ix, pos::INT AS pos, round(value, 5) + 0.0::DOUBLE AS value
FROM (SELECT * FROM mean UNION ALL SELECT * FROM hot) JOIN ix USING (author)""")
def author_features(t: Tables) -> DataFrame:
    count = t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
    # The works of a few authors have no vector, so that these have a mean of nothing.
    without = t.lineitem.filter("l_partkey % 500 = 7").select(F.col("l_orderkey").alias("work"))
    vectors = (t.orders.select(F.col("o_orderkey").alias("work"),
                               F.pmod(F.col("o_orderkey"), count).alias("vec_id"))
               .join(without, "work", "left_anti")
               .join(t.embeddings, "vec_id").select("work", F.col("embedding").alias("vector")))
    fields, countries = _terms(t)
    made = features.author_features(features.author_index(tt.positioned(t)), tt.mentions(t),
                                    vectors, fields, countries, WIDTH)
    return _long(made, "author_ix")


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS w
  FROM documents),
c AS (SELECT doc_id, ({hash32("w")} % {WIDTH})::INT AS pos, count(*) AS n FROM w WHERE w <> ''
  GROUP BY 1, 2)
SELECT doc_id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 5) AS value FROM c""")
def text_embedding(t: Tables) -> DataFrame:
    return features.hashed_words(t.documents, "doc_id", "text", WIDTH).withColumn(
        "value", F.round("value", 5))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \t\r\n]+')) AS w
  FROM documents),
c AS (SELECT doc_id, ({hash32("w")} % {WIDTH})::INT AS pos, count(*) AS n FROM w WHERE w <> ''
  GROUP BY 1, 2)
SELECT doc_id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 5) AS value FROM c""")
def encoded_text(t: Tables) -> DataFrame:
    """Text vectors by an encoder in Python, called with batches of texts."""
    texts = features.embed_text(t.documents.select("doc_id", "text"), "text",
                                features.HashingEncoder(WIDTH))
    return _long(texts, "doc_id", "vector").filter(F.col("value") != 0)


def _projection() -> np.ndarray:
    """A fixed ``OUT × WIDTH`` matrix given by a rule, also used in the SQL."""
    out, inp = np.meshgrid(np.arange(OUT), np.arange(WIDTH), indexing="ij")
    return ((7 * inp + 3 * out) % 11 - 5) / 10


PROJECTED = f"""pr AS MATERIALIZED (SELECT node, list_transform(range({OUT}), lambda o: list_sum(list_transform(
  range({WIDTH}), lambda i: e[i + 1]::DOUBLE * (((7 * i + 3 * o) % 11 - 5) / 10)))) AS x FROM n)"""


@query(f"""WITH {NODES}, {PROJECTED}, u AS (SELECT node, unnest(range({OUT})) AS pos,
  unnest(x) AS x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS norm FROM pr)
SELECT node, pos::INT AS pos, round(x / norm, 5) + 0.0::DOUBLE AS value FROM u""")
def project_normalise(t: Tables) -> DataFrame:
    return _long(linkpred.project_unit(_nodes(t), _projection()), "node")


@query(f"""WITH {NODES}, {PROJECTED}, s AS (SELECT sqrt(sum(list_sum(list_transform(x,
  lambda v: v * v)))) AS norm FROM pr),
u AS (SELECT node, unnest(range({OUT})) AS pos, unnest(x) AS x FROM pr)
SELECT node, pos::INT AS pos, round(x / norm, 5) + 0.0::DOUBLE AS value FROM u, s""")
def project_batch_norm(t: Tables) -> DataFrame:
    return _long(linkpred.project_unit(_nodes(t), _projection(), norm="global"), "node")


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"""WITH {PAIRS}, {NODES}, unit AS MATERIALIZED (SELECT node, list_transform(e, lambda x: x::DOUBLE / len) AS e
  FROM (SELECT node, e, sqrt({DOT.format("e", "e")}) AS len FROM n)),
s AS (SELECT src, dst, a.e AS a, b.e AS b FROM und
  JOIN unit a ON a.node = src JOIN unit b ON b.node = dst),
c AS (SELECT src, dst, ({DOT.format("a", "b")} + 1) / 2 AS score FROM s)
SELECT src, dst, round(score, 5) AS score, (score > 0.5)::INT AS predicted FROM c""")
def pair_cosine(t: Tables) -> DataFrame:
    scored = linkpred.cosine_scores(_undirected(t).select("src", "dst"), _nodes(t))
    return scored.withColumn("score", F.round("score", 5))


TARGET = 0
SCORED = f"""near AS (SELECT dst AS node FROM und WHERE src = {TARGET}
  UNION SELECT src FROM und WHERE dst = {TARGET}),
sc AS (SELECT node, 1 / (1 + exp(-{DOT.format(
    "e", f"(SELECT e FROM n WHERE node = {TARGET})")})) AS score FROM n
  WHERE node <> {TARGET} AND node NOT IN (SELECT node FROM near))"""


@query(f"""WITH {PAIRS}, {NODES}, {SCORED}, k AS (
  SELECT node, score FROM sc ORDER BY round(score, 9) DESC, node LIMIT 10)
SELECT node, p_name AS name, round(score, 5) AS score FROM k JOIN part ON node = p_partkey""")
def topk_partners(t: Tables) -> DataFrame:
    """The ten likeliest new partners of one author, with names."""
    scored = linkpred.score_candidates(_nodes(t), _undirected(t), TARGET)
    best = scored.orderBy(F.desc(F.round("score", 9)), "node").limit(10)
    names = t.part.select(F.col("p_partkey").alias("ix"), F.col("p_name").alias("term"))
    named = tables.lookup_terms(best.withColumnRenamed("node", "ix"), names, "ix", name="name")
    return named.select(F.col("ix").alias("node"), "name", F.round("score", 5).alias("score"))


@query(f"""WITH {PAIRS}, {NODES}, {SCORED} SELECT node, round(score, 5) AS score FROM sc
ORDER BY node LIMIT 1""")
def smallest_candidate(t: Tables) -> DataFrame:
    scored = linkpred.score_candidates(_nodes(t), _undirected(t), TARGET)
    return linkpred.smallest_candidate(scored).withColumn("score", F.round("score", 5))


def _layer_sql(combine: str) -> str:
    return f"""WITH {PAIRS}, {NODES},
sym AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und),
x AS (SELECT node, unnest(range({WIDTH})) AS pos, unnest(e)::DOUBLE AS x FROM n),
hood AS (SELECT dst AS node, pos, {combine}(x) AS h FROM sym JOIN x ON x.node = sym.src
  GROUP BY 1, 2)
SELECT x.node, x.pos::INT AS pos, round(greatest(x + coalesce(h, 0), 0), 5) + 0.0::DOUBLE AS value
FROM x LEFT JOIN hood ON x.node = hood.node AND x.pos = hood.pos"""


@query(_layer_sql("avg"))
def sage_layer(t: Tables) -> DataFrame:
    return _long(linkpred.sage_layer(_symmetric(t), _nodes(t), WIDTH), "node")


@query(_layer_sql("sum"))
def gin_layer(t: Tables) -> DataFrame:
    return _long(linkpred.gin_layer(_symmetric(t), _nodes(t), WIDTH), "node")


def _weights(rows: int, columns: int, a: int, b: int, modulus: int) -> np.ndarray:
    """A fixed matrix given by a rule, also used in the SQL."""
    row, column = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return ((a * column + b * row) % modulus - modulus // 2) / 10


def _times_sql(vector: str, rows: int, columns: int, a: int, b: int, modulus: int) -> str:
    """The elements of ``_weights(...) @ vector`` as a list in SQL."""
    return f"""list_transform(range({rows}), lambda o: list_sum(list_transform(range({columns}),
  lambda i: {vector}[i + 1] * ((({a} * i + {b} * o) % {modulus} - {modulus // 2}) / 10))))"""


def _bias(rows: int) -> np.ndarray:
    return (np.arange(rows) % 3 - 1) / 10


SYM = "sym AS (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und)"
HOOD = f"""{SYM}, hx AS (SELECT node, unnest(range({WIDTH})) AS pos, unnest(e)::DOUBLE AS x FROM n),
hp AS (SELECT dst AS node, pos, {{0}}(x) AS h FROM sym JOIN hx ON hx.node = sym.src GROUP BY 1, 2),
hood AS (SELECT node, list(h ORDER BY pos) AS h FROM hp GROUP BY 1),
base AS MATERIALIZED (SELECT n.node, list_transform(e, lambda v: v::DOUBLE) AS e,
  coalesce(h, list_transform(range({WIDTH}), lambda i: 0.0::DOUBLE)) AS h
  FROM n LEFT JOIN hood ON hood.node = n.node)"""
SAGE = f"""{HOOD.format("avg")},
own AS (SELECT node, {_times_sql("e", OUT, WIDTH, 7, 3, 11)} AS a,
  {_times_sql("h", OUT, WIDTH, 5, 2, 7)} AS b FROM base),
emb AS MATERIALIZED (SELECT node, list_transform(range({OUT}), lambda o: greatest(
  a[o + 1] + b[o + 1] + (o % 3 - 1) / 10, 0)) AS e FROM own)"""


def _sage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return linkpred.sage_layer(edges, nodes, WIDTH, own_weight=_weights(OUT, WIDTH, 7, 3, 11),
                               hood_weight=_weights(OUT, WIDTH, 5, 2, 7), bias=_bias(OUT))


@query(f"""WITH {PAIRS}, {NODES}, {SAGE}
SELECT node, pos::INT AS pos, round(x, 5) + 0.0::DOUBLE AS value
FROM (SELECT node, unnest(range({OUT})) AS pos, unnest(e) AS x FROM emb)""")
def sage_weights(t: Tables) -> DataFrame:
    """A SAGE layer with weights for node and neighbours, and a bias."""
    return _long(_sage(_symmetric(t), _nodes(t)), "node")


def _norm_sql(vector: str, rows: int) -> str:
    """Bias, batch norm with stored values, ReLU, element by element, in SQL."""
    return f"""list_transform(range({rows}), lambda o: greatest(
  ({vector}[o + 1] + (o % 3 - 1) / 10 - (o % 5) / 10) / sqrt(1 + o % 2 + 0.00001)
  * (1 + (o % 4) / 10) + (o % 2 - 0.5) / 10, 0))"""


def _mlp(rows: int, columns: int, a: int, b: int, modulus: int) -> dict:
    o = np.arange(rows)
    return {"weight": _weights(rows, columns, a, b, modulus), "bias": _bias(rows),
            "mean": (o % 5) / 10, "var": 1 + o % 2, "gamma": 1 + (o % 4) / 10,
            "beta": (o % 2 - 0.5) / 10}


@query(f"""WITH {PAIRS}, {NODES}, {HOOD.format("sum")},
s AS (SELECT node, list_transform(range({WIDTH}), lambda i: e[i + 1] * 1.1 + h[i + 1]) AS e FROM base),
l1 AS (SELECT node, {_times_sql("e", OUT, WIDTH, 7, 3, 11)} AS e FROM s),
l2 AS (SELECT node, {_norm_sql("e", OUT)} AS e FROM l1),
l3 AS (SELECT node, {_times_sql("e", OUT, OUT, 5, 2, 7)} AS e FROM l2),
l4 AS (SELECT node, {_norm_sql("e", OUT)} AS e FROM l3)
SELECT node, pos::INT AS pos, round(x, 5) + 0.0::DOUBLE AS value
FROM (SELECT node, unnest(range({OUT})) AS pos, unnest(e) AS x FROM l4)""")
def gin_mlp(t: Tables) -> DataFrame:
    """A GIN layer with two linear steps, each with batch norm and ReLU."""
    layer = linkpred.gin_layer(_symmetric(t), _nodes(t), WIDTH, eps=0.1, mlp=[
        _mlp(OUT, WIDTH, 7, 3, 11), _mlp(OUT, OUT, 5, 2, 7)])
    return _long(layer, "node")


@query(f"""WITH {PAIRS}, {NODES}, {SAGE}, near AS (SELECT src, dst FROM sym),
sc AS (SELECT a.node AS target, b.node, round({DOT.format("a.e", "b.e")}, 9) AS dot
  FROM emb a, emb b WHERE a.node % 20 = 0 AND a.node <> b.node),
free AS (SELECT sc.* FROM sc ANTI JOIN near ON near.src = sc.target AND near.dst = sc.node),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dot DESC, node)::INT AS rank FROM free)
SELECT target, rank, node, p_name AS name, round(1 / (1 + exp(-dot)), 5) AS score
FROM k JOIN part ON node = p_partkey WHERE rank <= 10""")
def predict_partners(t: Tables) -> DataFrame:
    """The ten likeliest new partners, with names, of every author whose number is
    divisible by 20, from embeddings of a SAGE layer over the whole graph."""
    edges = materialize(_symmetric(t), "edges")
    targets = t.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))
    names = t.part.select(F.col("p_partkey").alias("ix"), F.col("p_name").alias("term"))
    made = partners.predict_partners(_nodes(t), edges, targets,
                                     [lambda nodes: _sage(edges, nodes)], names)
    return made.withColumn("score", F.round("score", 5))


def _training_pairs(t: Tables) -> DataFrame:
    """Labelled pairs of the whole graph with their split, written once."""
    edges = materialize(_undirected(t).select("src", "dst"), "edges")
    drawn = sampling.hard_negatives(edges, edges, _author_count(t))
    return materialize(sampling.split_edges(sampling.labelled(edges, drawn)), "pairs")


@query()
def link_model_scores(t: Tables) -> DataFrame:
    """Test pairs scored by a model trained on features of two neighbour hops."""
    pairs = _training_pairs(t)
    train = pairs.filter(F.col("split") == "train").filter(F.col("label") == 1)
    known = train.select("src", "dst").unionByName(
        train.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = linkpred.graph_features(known, _nodes(t), WIDTH, 2, materialize)
    with scratch(t.part.sparkSession):  # the training rows are not needed for scores
        training = linkpred.training_cells(pairs.filter(F.col("split") == "train"), nodes)
        model = linkpred.train_link_model(training, max_iter=5)
    scored = linkpred.apply_link_model(
        model, linkpred.gather(pairs.filter(F.col("split") == "test"), nodes))
    return scored.select("src", "dst", "label", "score")


@query(f"""WITH {PAIRS}, {HARD} SELECT src, dst, 1 AS label FROM und
UNION ALL SELECT src, dst, 0 FROM neg WHERE ix < (SELECT count(*) FROM und)""")
def labelled_pairs(t: Tables) -> DataFrame:
    """Edges, and as many pairs that are none, in one labelled table."""
    edges = materialize(_undirected(t).select("src", "dst"), "edges")
    return sampling.labelled(edges, sampling.hard_negatives(edges, edges, _author_count(t)))


@query(f"""WITH {PAIRS}, {NODES}
SELECT src, dst, round(1 / (1 + exp(-{DOT.format("a.e", "b.e")})), 5) AS score FROM und
JOIN n a ON a.node = src JOIN n b ON b.node = dst""")
def pair_dot(t: Tables) -> DataFrame:
    """Every edge scored by the sigmoid of its inner product."""
    pairs = linkpred.gather(_undirected(t).select("src", "dst"), _nodes(t))
    return linkpred.dot_scores(pairs).withColumn("score", F.round("score", 5))


@query(f"""WITH {PAIRS}, {HARD}, drawn_pairs AS (
  SELECT src, dst, 1 AS label FROM und UNION ALL
  SELECT src, dst, 0 FROM neg WHERE ix < (SELECT count(*) FROM und)),
h AS (SELECT *, {hash32("'edge:' || src || ':' || dst")} AS h FROM drawn_pairs)
SELECT src, dst, label, true AS better_than_chance FROM h WHERE h >= {int(round(0.9 * 2**32))}""")
def link_model_test(t: Tables) -> DataFrame:
    """Test pairs and labels of a model of two neighbour hops and the number of partners,
    trained by Newton steps and chosen by its validation AUC; and whether its AUC on these
    pairs is above 0.5."""
    pairs = _training_pairs(t)
    train = pairs.filter((F.col("split") == "train") & (F.col("label") == 1))
    known = train.select("src", "dst").unionByName(
        train.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hops = linkpred.graph_features(known, _nodes(t), WIDTH, 2, materialize)
    degree = F.log1p(F.coalesce("degree", F.lit(0)).cast("double"))
    nodes = materialize(
        hops.join(graph.degrees(known).withColumnRenamed("src", "node"), "node", "left")
        .select("node", F.concat("features", F.array(degree)).alias("features")), "nodes")

    with scratch(t.part.sparkSession):  # the training rows are not needed for scores
        training = linkpred.training_cells(pairs.filter(F.col("split") != "test"), nodes,
                                           held=F.col("split") == "val")
        weights, _ = linkpred.best_newton(training, None, ["src", "dst"], WIDTH + 1)
    test = linkpred.gather(pairs.filter(F.col("split") == "test"), nodes)
    scored = materialize(linkpred.newton_scores(test, weights), "scored")
    area = metrics.roc_auc(scored.select("label", "score")).select(F.col("roc_auc") > 0.5).scalar()
    return scored.select("src", "dst", "label", area.alias("better_than_chance"))


@query("""WITH x AS (SELECT quality = 1 AS y, toxic = 0 AS p FROM labels),
c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
  count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM x)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_metrics(t: Tables) -> DataFrame:
    rows = t.labels.select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"))
    made = metrics.classification_metrics(rows)
    return made.select("tp", "fp", "fn", "tn", *[
        F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _judged(t: Tables) -> DataFrame:
    """Label and score per document: its quality, scored by its length."""
    return t.labels.join(t.documents, "doc_id").select(
        F.col("quality").alias("label"), F.col("n_chars").alias("score"))


JUDGED = "x AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {JUDGED}, r AS (SELECT y, (rank() OVER (ORDER BY s)
  + (count(*) OVER (PARTITION BY s) - 1) / 2) AS r FROM x),
c AS (SELECT sum(y)::DOUBLE AS p, count(*) - sum(y) AS n, sum(CASE WHEN y = 1 THEN r END) AS rs
  FROM r)
SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM c""")
def roc_auc(t: Tables) -> DataFrame:
    return metrics.roc_auc(_judged(t)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {JUDGED}, g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen
  FROM g)
SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c""")
def average_precision(t: Tables) -> DataFrame:
    made = metrics.average_precision(_judged(t))
    return made.select(F.round("average_precision", 6).alias("average_precision"))


def _ranked(t: Tables) -> DataFrame:
    """A ranking per supplier with many tied scores: returned lines by quantity."""
    return t.lineitem.select("l_suppkey", F.col("l_quantity").alias("score"),
                             (F.col("l_returnflag") == "R").cast("int").alias("label"))


RANKED = """x AS (SELECT l_suppkey, l_quantity AS s, (l_returnflag = 'R')::INT AS y
  FROM lineitem)"""
GROUPED_AP = """g AS (SELECT l_suppkey, s, sum(y) AS pos, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT l_suppkey, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY s DESC)),
ap AS (SELECT l_suppkey, coalesce(sum(pos * tp / seen) / nullif(sum(pos), 0), 0) AS ap FROM c
  GROUP BY 1)"""


def _ndcg_sql(k: int) -> str:
    def part(name: str, by: str) -> str:
        return f"""{name}_r AS (SELECT l_suppkey, {by} AS b, y, row_number() OVER (
  PARTITION BY l_suppkey ORDER BY {by} DESC) AS rn FROM x),
{name}_t AS (SELECT l_suppkey, b, sum(y) AS gain,
  avg(CASE WHEN rn <= {k} THEN 1 / log2(rn + 1) ELSE 0 END) AS d FROM {name}_r GROUP BY 1, 2),
{name} AS (SELECT l_suppkey, sum(gain * d) AS v FROM {name}_t GROUP BY 1)"""

    return f"""{part("dcg", "s")}, {part("ideal", "y")},
nd AS (SELECT l_suppkey, coalesce(dcg.v / nullif(ideal.v, 0), 0) AS ndcg
  FROM dcg JOIN ideal USING (l_suppkey))"""


@query(f"WITH {RANKED}, {_ndcg_sql(10)} SELECT l_suppkey, round(ndcg, 6) AS ndcg FROM nd")
def ndcg_at_k(t: Tables) -> DataFrame:
    made = metrics.ndcg_at_k(_ranked(t), ["l_suppkey"], 10)
    return made.withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {RANKED}, {GROUPED_AP} SELECT l_suppkey, round(ap, 6) AS average_precision FROM ap")
def grouped_average_precision(t: Tables) -> DataFrame:
    made = metrics.average_precision(_ranked(t), ["l_suppkey"])
    return made.withColumn("average_precision", F.round("average_precision", 6))


@query(f"""WITH {RANKED}, {_ndcg_sql(10)}, {GROUPED_AP}, ok AS (SELECT l_suppkey FROM x GROUP BY 1
  HAVING count(*) >= 10 AND sum(y) > 0 AND sum(y) < count(*))
SELECT round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map_at_k
FROM nd JOIN ap USING (l_suppkey) WHERE l_suppkey IN (SELECT l_suppkey FROM ok)""")
def ranking_metrics(t: Tables) -> DataFrame:
    made = metrics.ranking_metrics(_ranked(t), ["l_suppkey"], 10)
    return made.select(F.round("ndcg", 6).alias("ndcg"), F.round("map_at_k", 6).alias("map_at_k"))
