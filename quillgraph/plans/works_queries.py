"""Queries over works: statistics, columns, extraction and enrichment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions.spec import Leaf, extract
from quillgraph.operators import graph, sampling, stats
from quillgraph.operators.ordering import dense_index
from quillgraph.plans.catalog import MENTIONS, SELECTED, hash32, query
from quillgraph.session import materialize, new_path
from quillgraph.sinks import writers
from quillgraph.sources import snapshot, tables
from quillgraph.sources import testtables as tt
from quillgraph.sources.testtables import Tables

COUNTRY = """c AS (SELECT n_name AS country, count(*) AS works FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""
CONCEPT = """c AS (SELECT p_type AS concept, count(DISTINCT l_orderkey) AS works FROM lineitem
  JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
CITATIONS = """y AS (SELECT l_orderkey AS work, year(l_shipdate) AS y, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
cit AS (SELECT o_orderkey AS work, coalesce(arg_max(n, y), 0)::BIGINT AS citation_count,
               coalesce(sum(n), 0)::BIGINT AS total_citations
        FROM orders LEFT JOIN y ON o_orderkey = work GROUP BY 1)"""

SMALL_COUNTRY = 2_400
COMMON_CONCEPT = 7_400
TITLE_WORDS = "der und"


def _countries(t: Tables) -> DataFrame:
    return stats.works_by_country(tt.mention_works(t))


def _concepts(t: Tables) -> DataFrame:
    return stats.works_by_concept(tt.counted_works(t, "concepts"))


def _citations(t: Tables) -> DataFrame:
    return stats.citation_distribution(tt.counted_works(t, "citations"), keep_id=True)


@query("SELECT count(*) AS size FROM orders")
def dataset_size(t: Tables) -> DataFrame:
    return stats.dataset_size(t.orders)


@query("SELECT count(DISTINCT l_partkey) AS authors FROM lineitem")
def unique_authors(t: Tables) -> DataFrame:
    return stats.unique_authors(tt.mention_works(t, institutions=False))


@query("SELECT count(DISTINCT o_orderkey) AS works FROM orders")
def unique_works(t: Tables) -> DataFrame:
    return stats.unique_works(t.orders.select(F.col("o_orderkey").alias("id")))


@query("SELECT count(DISTINCT team) AS teams FROM ("
       "SELECT list_sort(list(l_partkey)) AS team FROM lineitem GROUP BY l_orderkey)")
def unique_teams(t: Tables) -> DataFrame:
    return stats.unique_teams_of(tt.mentions(t))


@query(f"WITH {COUNTRY} SELECT country, works FROM c")
def works_by_country(t: Tables) -> DataFrame:
    return stats.in_order(_countries(t), "country")


@query("""SELECT n_name AS country, count(DISTINCT l_orderkey) AS works FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def distinct_works_by_country(t: Tables) -> DataFrame:
    return stats.works_by_country(tt.mention_works(t), distinct_works=True)


@query(f"WITH {CONCEPT} SELECT concept, works FROM c")
def works_by_concept(t: Tables) -> DataFrame:
    return stats.in_order(_concepts(t), "concept")


@query("""WITH f AS (SELECT o_orderkey, min(l_partkey) AS k FROM orders
  LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT p_brand AS topic, count(*) AS works FROM f LEFT JOIN part ON k = p_partkey GROUP BY 1""")
def works_by_topic(t: Tables) -> DataFrame:
    return stats.in_order(stats.works_by_topic(tt.counted_works(t, "primary_topic")), "topic")


@query(f"""WITH {COUNTRY} SELECT CASE WHEN works < {SMALL_COUNTRY} THEN 'other' ELSE country END
  AS country, sum(works)::BIGINT AS works FROM c GROUP BY 1""")
def country_other_bucket(t: Tables) -> DataFrame:
    return stats.merge_small(_countries(t), "country", SMALL_COUNTRY)


@query(f"WITH {COUNTRY} SELECT country, works, "
       "round(works / (SELECT sum(works) FROM c), 6) AS share FROM c")
def country_shares(t: Tables) -> DataFrame:
    return stats.shares(_countries(t)).withColumn("share", F.round("share", 6))


@query(f"WITH {COUNTRY} SELECT country, works FROM c ORDER BY works DESC, country LIMIT 20")
def top_countries(t: Tables) -> DataFrame:
    return stats.top(_countries(t), "country", 20)


@query(f"WITH {CONCEPT} SELECT concept, works FROM c WHERE works > {COMMON_CONCEPT}")
def concepts_over_threshold(t: Tables) -> DataFrame:
    return stats.over(_concepts(t), COMMON_CONCEPT)


@query(f"WITH {CITATIONS} SELECT work, citation_count, total_citations FROM cit")
def citation_distribution(t: Tables) -> DataFrame:
    return _citations(t).withColumn("work", F.substring("work", 2, 20).cast("bigint"))


@query(f"WITH {CITATIONS} SELECT citation_count AS bucket, count(*) AS works FROM cit GROUP BY 1")
def citation_histogram(t: Tables) -> DataFrame:
    hist = stats.histogram(_citations(t), "citation_count")
    return hist.withColumn("bucket", F.col("bucket").cast("bigint"))


@query(f"""WITH {CITATIONS} SELECT min(total_citations) AS minimum,
  quantile_cont(total_citations, 0.25) AS q1, quantile_cont(total_citations, 0.5) AS median,
  quantile_cont(total_citations, 0.75) AS q3, max(total_citations) AS maximum FROM cit""")
def citation_box(t: Tables) -> DataFrame:
    return stats.box_summary(_citations(t), "total_citations")


@query("""WITH w AS (SELECT c_nationkey AS k, count(*) AS works FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT c_nationkey AS k, count(*) AS persons FROM customer GROUP BY 1)
SELECT n_name AS country, works, persons, round(works / persons * 1000, 6) AS papers_per_capita
FROM w JOIN p ON w.k = p.k JOIN nation ON w.k = n_nationkey""")
def papers_per_capita(t: Tables) -> DataFrame:
    home = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    papers = (t.orders.join(home, F.col("o_custkey") == F.col("c_custkey"))
              .groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("works")))
    persons = home.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("persons"))
    names = t.nation.select("n_nationkey", F.col("n_name").alias("country"))
    per = stats.per_capita(papers.join(names, "n_nationkey"), persons, "n_nationkey")
    return per.select("country", "works", "persons",
                      F.round("papers_per_capita", 6).alias("papers_per_capita"))


@query("""SELECT l_linenumber, round(avg(l_quantity), 6) AS l_quantity,
  round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1""")
def mean_by_group(t: Tables) -> DataFrame:
    means = stats.mean_by(t.lineitem, "l_linenumber", "l_quantity", "l_extendedprice")
    return means.select("l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                        F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END
  AS url FROM pages""")
def strip_prefix(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.strip_prefix(F.col("url"), "https://").alias("url"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END
  AS url FROM pages""")
def trim_prefix_legacy(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.trim_prefix_legacy(F.col("url"), "https://").alias("url"))


@query("""WITH u AS (SELECT page_id, unnest([url, 'https://' || url]) AS u FROM pages)
SELECT page_id, CASE WHEN starts_with(u, 'https://') THEN substr(u, 9) ELSE u END AS url FROM u""")
def prefix_in_arrays(t: Tables) -> DataFrame:
    pair = F.array("url", F.concat(F.lit("https://"), "url"))
    stripped = C.strip_each(pair, lambda c: C.strip_prefix(c, "https://"))
    return t.pages.select("page_id", F.explode(stripped).alias("url"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE '' END
  AS doi FROM pages""")
def doi_or_empty(t: Tables) -> DataFrame:
    secure = F.when(F.col("url").startswith("https://"), F.col("url"))
    doi = C.null_to_empty(C.strip_prefix(secure, "https://"))
    return t.pages.select("page_id", doi.alias("doi"))


@query("""SELECT 'W' || l_orderkey AS work, 'A' || l_partkey AS author, p_name AS name,
  'I' || l_suppkey AS institution, s_name AS institution_name, n_name AS country
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""")
def reshape_nested(t: Tables) -> DataFrame:
    compact = snapshot.compact_work(tt.raw_works(t, ["authorships"]), ["id", "authors"])
    authors = compact.select(F.col("id").alias("work"), F.explode("authors").alias("a"))
    placed = authors.select("work", "a", F.explode("a.institutions").alias("i"))
    return placed.select("work", F.col("a.id").alias("author"), F.col("a.name").alias("name"),
                         F.col("i.id").alias("institution"),
                         F.col("i.name").alias("institution_name"),
                         F.col("i.country").alias("country"))


@query("""SELECT o_orderkey AS arxiv_o_orderkey, o_orderstatus AS arxiv_order_status,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS arxiv_update_date FROM orders""")
def rename_parse(t: Tables) -> DataFrame:
    papers = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("Order-Status"),
                             F.date_format("o_orderdate", "yyyy-MM-dd").alias("update_date"))
    renamed = tables.read_metadata(papers)
    return renamed.withColumn("arxiv_update_date", F.date_format(
        "arxiv_update_date", "yyyy-MM-dd HH:mm:ss"))


def work_lines(t: Tables) -> DataFrame:
    """Every raw work as one JSON line ``value``."""
    return tt.raw_works(t).select(F.to_json(F.struct("*")).alias("value"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS authors, count(DISTINCT l_returnflag) AS keywords,
  count(DISTINCT year(l_shipdate)) AS years, count(DISTINCT p_type) AS concepts
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT 'W' || o_orderkey AS work_id, '10.1000/' || o_orderkey AS doi,
  strftime(o_orderdate, '%Y-%m-%d') AS date, authors, keywords, years, concepts
FROM orders JOIN l ON o_orderkey = l_orderkey""")
def json_extract_strict(t: Tables) -> DataFrame:
    good, _ = snapshot.extract_strict(work_lines(t))
    sizes = [F.size(c).cast("bigint").alias(name) for c, name in (
        ("authors", "authors"), ("keywords", "keywords"), ("citations", "years"),
        ("concepts", "concepts"))]
    return good.select("work_id", "doi", "date", *sizes)


@query("""SELECT 'malformed' AS reason, count(*) AS lines FROM documents
UNION ALL SELECT 'authors: no list', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))""")
def json_rejects(t: Tables) -> DataFrame:
    """Works without lists, records of another kind, and text that is no JSON."""
    lines = (work_lines(t).unionByName(t.events.select(F.col("props").alias("value")))
             .unionByName(t.documents.select(F.col("text").alias("value"))))
    _, rejects = snapshot.extract_strict(lines)
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT event_id::INT AS event, (props->>'$.k')::INT AS k FROM events")
def spec_extract(t: Tables) -> DataFrame:
    spec = {"event": Leaf("int", "event_id"), "k": Leaf("int", "props.k")}
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"),
                    F.lit(',"props":'), "props", F.lit("}"))
    good, _ = extract(t.events.select(line.alias("value")), spec)
    return good


@query(f"""SELECT doc_id, source FROM documents WHERE
  {" AND ".join(f"contains(lower(text), '{w}')" for w in TITLE_WORDS.split())}""")
def title_search(t: Tables) -> DataFrame:
    return tables.title_search(t.documents, TITLE_WORDS, "text").select("doc_id", "source")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(
    f"list_contains({WORDS}, '{w}')" for w in TITLE_WORDS.split()))
def word_search(t: Tables) -> DataFrame:
    """Documents with both whole words, from a stored index of words."""
    target = new_path(t.spark, "word-index")
    tables.write_word_index(t.documents, target, key="doc_id", column="text")
    return tables.word_search(t.spark, target, TITLE_WORDS, key="doc_id")


def _papers(t: Tables) -> DataFrame:
    """Papers with a DOI; those of filled orders have a blank one."""
    doi = F.concat(F.lit(tt.DOI_STEM), F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("paper"), F.when(
        F.col("o_orderstatus") == "F", "").otherwise(doi).alias("arxiv_doi"))


def _known_works(t: Tables) -> DataFrame:
    """Works with at least one author, as a lookup by DOI: a second work has the DOI of
    each order with over four lines, and a third has a blank one."""
    works = (t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_authors"))
             .select(F.concat(F.lit(tt.DOI_STEM), F.col("l_orderkey").cast("string")).alias("doi"),
                     "n_authors"))
    more = works.filter("n_authors > 4")
    return (works.unionByName(more.withColumn("n_authors", F.col("n_authors") + 100))
            .unionByName(more.withColumn("doi", F.lit(""))))


def _keyed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("key", C.doi_url(F.col(column)))


@query("""SELECT o_orderkey AS paper, '10.1000/' || l_orderkey AS doi, n AS n_authors FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey AND o_orderstatus <> 'F'""")
def enrich_left(t: Tables) -> DataFrame:
    papers = _keyed(tables.pending(_papers(t)), "arxiv_doi")
    known = _keyed(_known_works(t), "doi").withColumnRenamed("key", "work_key")
    attached = graph.enrich(papers, known, "key", "work_key")
    return attached.select("paper", "alex.doi", "alex.n_authors")


@query("""SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'F' THEN ''
  ELSE '10.1000/' || o_orderkey END AS arxiv_doi FROM orders WHERE o_orderstatus = 'F'
  OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def enrich_missing(t: Tables) -> DataFrame:
    papers = _keyed(tables.pending(_papers(t)), "arxiv_doi")
    known = _keyed(_known_works(t), "doi").withColumnRenamed("key", "work_key")
    return graph.not_found(papers, known, "key", "work_key").select("paper", "arxiv_doi")


@query("""SELECT o_orderkey AS paper, '10.1000/' || l_orderkey AS doi, n AS n_authors,
  CASE WHEN l_orderkey IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::INT AS delivery
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey AND o_orderstatus <> 'F'""")
def enrich_again(t: Tables) -> DataFrame:
    """Two deliveries of papers against works kept in buckets; the second holds the papers
    of the first, which are attached already, and new ones."""
    name = f"kept_{uuid.uuid4().hex}"
    known = _keyed(_known_works(t), "doi").withColumnRenamed("key", "work_key")
    kept = graph.keep_keyed(known, "work_key", name, new_path(t.spark, "kept-works"), 16)
    papers = _keyed(_papers(t), "arxiv_doi")
    first = graph.enrich_kept(papers.filter("paper % 2 = 0"), kept, "key")
    first = materialize(first.withColumn("delivery", F.when(F.col("alex").isNotNull(), 1)), "attached")
    second = papers.filter("paper % 2 = 1").withColumns({
        "alex": F.lit(None).cast(first.schema["alex"].dataType), "delivery": F.lit(None).cast("int")})
    done = graph.enrich_kept(first.unionByName(second), kept, "key").withColumn(
        "delivery", F.coalesce("delivery", F.when(F.col("alex").isNotNull(), 2)))
    return done.select("paper", "alex.doi", "alex.n_authors", "delivery")


def _order_works(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")


@query(f"""WITH {SELECTED} SELECT work, string_agg(author::VARCHAR, ',' ORDER BY author) AS authors
FROM sel GROUP BY 1""")
def author_selection(t: Tables) -> DataFrame:
    chosen = graph.author_selection(tt.authorships(t, 2))
    return chosen.select("work", F.array_join(
        F.col("authors").cast("array<string>"), ",").alias("authors"))


@query(f"""WITH {SELECTED} SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT work FROM sel)""")
def semi_selection(t: Tables) -> DataFrame:
    return graph.select_works(_order_works(t), graph.author_selection(tt.authorships(t, 2)))


@query("""WITH m AS (SELECT l_orderkey AS work, CASE WHEN l_partkey % 50 = 0 THEN '-'
  ELSE l_partkey::VARCHAR END AS author FROM lineitem),
big AS (SELECT work FROM m GROUP BY work HAVING count(*) > 1),
p AS (SELECT DISTINCT work, author FROM m WHERE work IN (SELECT work FROM big)),
rep AS (SELECT author FROM p GROUP BY author HAVING count(*) > 1),
sel AS (SELECT DISTINCT work FROM p WHERE author IN (SELECT author FROM rep))
SELECT o_orderkey AS id, work, o_totalprice FROM orders JOIN sel ON work = o_orderkey""")
def keyed_selection(t: Tables) -> DataFrame:
    """Selected works with the selector's key; authors without an id count as one author."""
    rows = tt.authorships(t, 2).withColumn("author", F.when(F.col("author") % 50 != 0, F.col("author")))
    selector = graph.author_selection(rows, legacy_null_group=True)
    return graph.select_works(_order_works(t), selector, keep_key=True).select(
        "id", "work", "o_totalprice")


@query("""WITH k AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag)
  AS keywords FROM lineitem GROUP BY 1)
SELECT 'W' || l_orderkey AS work, 'A' || l_partkey AS author, upper(p_name) AS name, keywords
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k USING (l_orderkey)""")
def nested_update(t: Tables) -> DataFrame:
    """One field of every author changed inside the array; one field of every keyword picked
    from the raw array."""
    raw = tt.raw_works(t, ["authorships", "keywords"])
    works = snapshot.compact_work(raw, ["id", "authors"]).withColumn(
        "authors", C.update_field(F.col("authors"), "name", F.upper))
    names = raw.select(C.strip_prefix(F.col("id"), C.ID_PREFIX).alias("key"),
                       F.array_join(C.pluck(F.col("keywords"), "display_name"), ",").alias("keywords"))
    return (works.join(names, F.col("id") == F.col("key"))
            .select(F.col("id").alias("work"), "keywords", F.explode("authors").alias("a"))
            .select("work", F.col("a.id").alias("author"), F.col("a.name").alias("name"), "keywords"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def without_technical(t: Tables) -> DataFrame:
    """A collection whose store added columns of its own, without these."""
    stored = t.orders.select(F.md5(F.col("o_orderkey").cast("string")).alias("_id"),
                             F.col("o_orderkey").alias("rowId"), "o_orderkey", "o_totalprice")
    return C.drop_technical(stored)


@query(f"""WITH {SELECTED} SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT work FROM sel)
  AND {hash32("'sample:' || o_orderkey")} < {int(0.05 * 2**32)}""")
def sampled_selection(t: Tables) -> DataFrame:
    sample = sampling.bernoulli(_order_works(t), 0.05, ["id"])
    return graph.select_works(sample, graph.author_selection(tt.authorships(t, 2)))


@query(f"WITH {MENTIONS} SELECT work, count(*) AS team_size FROM m GROUP BY 1 HAVING count(*) > 1")
def multi_author_works(t: Tables) -> DataFrame:
    return graph.within_team_size(tt.authorships(t), 2, None).select("work", "team_size").distinct()


SLICE = 1_000


@query(f"""SELECT o_orderkey // {SLICE} * {SLICE} AS slice_head,
  least(o_orderkey // {SLICE} * {SLICE} + {SLICE}, (SELECT max(o_orderkey) + 1 FROM orders))
  AS slice_tail, count(*) AS n FROM orders GROUP BY 1, 2""")
def slices(t: Tables) -> DataFrame:
    """The slice plan with the rows found in each slice."""
    rows = C.drop_technical(t.orders.withColumn("row_id", F.col("o_orderkey")), ("_id", "rowId"))
    found = tables.with_slice(rows, step=SLICE).groupBy("slice_head").agg(
        F.count(F.lit(1)).alias("n"))
    return tables.slices(rows, step=SLICE).join(found, "slice_head")


@query(f"""WITH s AS (SELECT o_orderkey // {SLICE} AS s, bool_and(EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS complete FROM orders GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (complete) AS done,
  count(*) FILTER (NOT complete) AS backlog FROM s""")
def slice_status(t: Tables) -> DataFrame:
    """A slice counts as done when each of its works has an author."""
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"))
    plan = tables.slices(rows, step=SLICE)
    bare = rows.join(t.lineitem.select("l_orderkey"), F.col("row_id") == F.col("l_orderkey"),
                     "left_anti")
    open_slices = tables.with_slice(bare, step=SLICE).select("slice_head").distinct()
    return tables.slice_status(plan, plan.join(open_slices, "slice_head", "left_anti"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS ix
FROM orders""")
def dense_numbering(t: Tables) -> DataFrame:
    """Total order without a single-task window."""
    return dense_index(t.orders.select("o_orderkey", "o_totalprice"),
                       [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "ix")


@query(f"""SELECT o_orderkey AS row_id, o_totalprice FROM orders
WHERE o_orderkey >= {SLICE // 2} AND o_orderkey < {SLICE + 7}""")
def slice_range(t: Tables) -> DataFrame:
    """A half-open range of rows, read from the folders of its slices only."""
    target = new_path(t.spark, "sliced")
    rows = tables.with_slice(t.orders.withColumn("row_id", F.col("o_orderkey")), step=SLICE)
    writers.write_slices(rows.select("row_id", "o_totalprice", "slice_head"), target, 3)
    return tables.read_slice_range(t.spark, target, SLICE // 2, SLICE + 7, step=SLICE).select(
        "row_id", "o_totalprice")
