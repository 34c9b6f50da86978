"""Queries that write below the shared work folder and read the result back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.hashing import below
from quillgraph.operators import features, graph, stats
from quillgraph.plans import overview
from quillgraph.plans.catalog import EDGES, MENTIONS, query
from quillgraph.plans.works_queries import CITATIONS, CONCEPT, COUNTRY, SLICE, work_lines
from quillgraph.schemas import RAW_WORK
from quillgraph.session import materialize, new_path
from quillgraph.sinks import writers
from quillgraph.sources import inferred, snapshot, tables
from quillgraph.sources import testtables as tt
from quillgraph.sources.testtables import Tables
from quillgraph.streaming import ingest
from quillgraph.streaming.ingest import ingest_new

ORDERS = "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
ORDERS_SQL = f"SELECT {', '.join(ORDERS)} FROM orders"


@query(ORDERS_SQL)
def sink_roundtrip(t: Tables) -> DataFrame:
    """Parquet at the collection's zstd level, with bounded file sizes."""
    target = new_path(t.spark, "roundtrip")
    writers.write_parquet(t.orders.select(*ORDERS), target, mode="errorifexists",
                          zstd_level=writers.ZSTD_LEVEL, rows_per_file=100_000)
    return tables.read_works(t.spark, target)


@query(ORDERS_SQL)
def sink_append(t: Tables) -> DataFrame:
    """A collection loaded in two appended batches, snappy and uncompressed."""
    target = new_path(t.spark, "append")
    first = below(0.5, "batch", F.col("o_orderkey"))
    writers.write_parquet(t.orders.select(*ORDERS).filter(first), target, codec="snappy")
    writers.append(t.orders.select(*ORDERS).filter(~first), target)
    return tables.read_works(t.spark, target)


@query(f"""SELECT o_orderkey // {SLICE} * {SLICE} AS slice_head, count(*) AS n,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def sink_slices(t: Tables) -> DataFrame:
    """One folder per slice; the second write replaces the slices of the first."""
    target = new_path(t.spark, "slices")
    rows = tables.with_slice(t.orders.withColumn("row_id", F.col("o_orderkey")), step=SLICE)
    for _ in range(2):
        writers.write_slices(rows.select("row_id", "o_totalprice", "slice_head"), target, 3)
    return (t.spark.read.parquet(target)
            .groupBy(F.col("slice_head").cast("bigint").alias("slice_head"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query(f"""WITH {EDGES} SELECT work::VARCHAR AS a, author::VARCHAR AS b FROM edges
UNION ALL SELECT DISTINCT work::VARCHAR, '{graph.WORK_COLOR}' FROM edges
UNION ALL SELECT DISTINCT author::VARCHAR, '{graph.AUTHOR_COLOR}' FROM edges""")
def sink_graph_csv(t: Tables) -> DataFrame:
    """Graph and node files as CSV, read back as one table."""
    folder = new_path(t.spark, "graph")
    writers.write_graph(graph.bipartite_edges(tt.authorships(t, *graph.TEAM_SIZE)), folder)

    def back(name: str, schema: str) -> DataFrame:
        return t.spark.read.option("header", "true").schema(schema).csv(f"{folder}/{name}")

    return back("graph", "a string, b string").unionByName(
        back("metadata", "a string, b string"))


@query("""SELECT term, row_number() OVER (ORDER BY k) - 1 AS ix FROM (
  SELECT p_brand AS term, min(p_partkey) AS k FROM part GROUP BY 1)""")
def sink_vocabulary(t: Tables) -> DataFrame:
    """A vocabulary as JSON lines, read back under its schema."""
    target = new_path(t.spark, "vocabulary-json")
    writers.write_vocabulary(features.vocabulary(
        t.part.select("p_partkey", "p_brand"), "p_brand", ["p_partkey"]), target, "json")
    return t.spark.read.schema("term string, ix bigint").json(target)


@query("SELECT unnest([1, 9, 17])::INT AS level, true AS measured, true AS smaller_than_plain")
def codec_levels(t: Tables) -> DataFrame:
    """Three levels of the profile: whether each was timed, and is smaller than the rows
    stored without a codec."""
    plain = new_path(t.spark, "plain")
    writers.write_parquet(t.orders, plain, codec="uncompressed")
    size = writers.stored_bytes(t.spark, plain)
    return writers.codec_profile(t.orders, (1, 9, 17)).select(
        "level", (F.col("time") > 0).alias("measured"), (F.col("size") < size).alias("smaller_than_plain"))


@query()
def codec_profile(t: Tables) -> DataFrame:
    """Size and time of a zstd write at every level."""
    return writers.codec_profile(t.orders)


STATS_SQL = f"""WITH {COUNTRY.replace("c AS", "by_country AS", 1)},
{CONCEPT.replace("c AS", "by_concept AS", 1)}, {CITATIONS}, {EDGES},
topics AS (SELECT p_brand, count(*) AS n FROM orders
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey
  LEFT JOIN part ON k = p_partkey GROUP BY 1)
SELECT unnest(['dataset_size', 'unique_authors', 'unique_works', 'unique_teams']) AS stat,
  'ok' AS status, 1::BIGINT AS n
UNION ALL SELECT 'works_by_country', 'ok', count(*) FROM by_country
UNION ALL SELECT 'works_by_concept', 'ok', count(*) FROM by_concept
UNION ALL SELECT 'citations_distribution', 'ok', count(*) FROM cit
UNION ALL SELECT 'works_by_topic', 'ok', count(*) FROM topics
UNION ALL SELECT 'graph/edges', 'ok', count(*) FROM edges"""


@query(STATS_SQL)
def stats_runner(t: Tables) -> DataFrame:
    """All overview statistics of one works table, each written on its own."""
    folder = new_path(t.spark, "overview")
    source = new_path(t.spark, "works")
    tt.works(t, ["authors", "concepts", "primary_topic", "citations"]).write.parquet(source)
    report = overview.run(tables.read_works(t.spark, source), folder)
    sizes = None
    for name in overview.OVERVIEW:
        size = (t.spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(name).alias("stat"), "n"))
        sizes = size if sizes is None else sizes.unionByName(size)
    return report.join(sizes, "stat", "left").select("stat", "status", "n")


@query(f"""WITH {CITATIONS}, {MENTIONS}, a AS (SELECT work, count(*) AS n FROM m GROUP BY 1)
SELECT 'W' || cit.work AS id, coalesce(n, 0) AS authors, total_citations FROM cit
LEFT JOIN a ON a.work = cit.work""")
def incremental_ingest(t: Tables) -> DataFrame:
    """Snapshot files arriving in two deliveries; each run takes the new ones only."""
    source, target, checkpoint = (new_path(t.spark, n) for n in ("arriving", "ingested", "state"))
    first = below(0.5, "delivery", F.col("id"))
    raw = tt.raw_works(t, ["authorships", "counts_by_year"])
    for delivery in (raw.filter(first), raw.filter(~first)):
        delivery.write.mode("append").option("compression", "gzip").json(source)
        ingest_new(t.spark, source, target, checkpoint, zstd_level=3)
    done = tables.read_works(t.spark, target)
    total = F.aggregate("citations.count", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return done.select("id", F.coalesce(F.size("authors"), F.lit(0)).cast("bigint").alias("authors"),
                       F.coalesce(total, F.lit(0)).alias("total_citations"))


@query("""SELECT 'W' || o_orderkey AS id, '10.1000/' || o_orderkey AS doi,
  'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
  coalesce(n, 0) AS authors, coalesce(c, 0) AS concepts FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT p_type) AS c FROM lineitem
  JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey""")
def snapshot_ingest(t: Tables) -> DataFrame:
    """gz JSON lines, scanned under the fixed schema and compacted."""
    source = new_path(t.spark, "snapshot")
    writer = tt.raw_works(t, ["authorships", "concepts"]).write.option("compression", "gzip")
    writer.json(source)
    # Lines of plain text in the same folder are dropped as malformed.
    t.documents.select("text").write.option("compression", "gzip").mode("append").text(source)
    done = snapshot.ingest(t.spark, source)
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c)
             for c in ("authors", "concepts")]
    return done.select("id", "doi", "title", "publication_date", *sizes)


# Fields of the made-up works that are null in all records, so that no line has them.
_NEVER = {"authorships[].author.orcid", "concepts[].wikidata", "primary_topic.score", "topics[].score"}


def _paths(kind: T.DataType, prefix: str = "") -> list[tuple[str, str]]:
    """Paths and types that the lines of all works show."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for path in [f"{prefix}.{f.name}" if prefix else f.name]
                if path not in _NEVER
                for x in [(path, f.dataType.typeName()), *_paths(f.dataType, path)]]
    if isinstance(kind, T.ArrayType):
        return [(prefix + "[]", kind.elementType.typeName()), *_paths(kind.elementType, prefix + "[]")]
    return []


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _paths(RAW_WORK))) + ") AS v(path, type)")
def schema_inference(t: Tables) -> DataFrame:
    """Inferred paths and types of the JSON lines of all works."""
    source = new_path(t.spark, "inference")
    work_lines(t).write.option("compression", "gzip").text(source)
    return snapshot.infer_schema(t.spark, source)


# Small enough that the bound cuts at every scale factor.
FILE_BYTES = 50_000


@query("""SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, 0::BIGINT AS too_large,
  true AS cut, true AS well_filled FROM lineitem""")
def sink_bounded_files(t: Tables) -> DataFrame:
    """Line items in files bounded by bytes: rows, files over the bound, whether the bound
    cuts, and whether there are at most twice as many files as the bytes need."""
    target = new_path(t.spark, "bounded")
    writers.write_bounded(t.lineitem, target, FILE_BYTES, zstd_level=3)
    sizes = writers.file_sizes(t.spark, target).agg(
        F.count_if(F.col("bytes") > FILE_BYTES).alias("too_large"),
        (F.count(F.lit(1)) > 1).alias("cut"),
        (F.count(F.lit(1)) <= 2 * F.ceil(F.sum("bytes") / FILE_BYTES)).alias("well_filled"))
    rows = t.spark.read.parquet(target).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    # Two tables of one row.
    return rows.withColumn("one", F.lit(1)).join(sizes.withColumn("one", F.lit(1)), "one").drop("one")


def _deliver(rows: DataFrame, source: str, broken: DataFrame | None = None) -> None:
    """Works as gz JSON lines, with lines that break off among them."""
    rows.write.mode("append").option("compression", "gzip").json(source)
    if broken is not None:
        broken.write.mode("append").option("compression", "gzip").text(source)


def _broken(names: DataFrame, column: str) -> DataFrame:
    return names.select(F.concat(F.lit('{"id": "'), F.col(column)).alias("value"))


@query("""SELECT (SELECT count(*) FROM orders) AS kept, (SELECT count(*) FROM customer) AS dropped,
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS lines, true AS skipped""")
def counted_drops(t: Tables) -> DataFrame:
    """Works and broken lines counted in the pass that reads them, and files passed over."""
    source = new_path(t.spark, "counted")
    raw = tt.raw_works(t, ["counts_by_year"])
    _deliver(raw, source, _broken(t.customer, "c_name"))
    t.region.write.mode("append").json(source)  # not a gz file
    rows, seen = snapshot.read_counted(t.spark, source)
    kept = materialize(snapshot.compact_work(rows), "counted")
    skipped = snapshot.skipped_files(t.spark, source).agg(
        (F.count_if(F.col("path").endswith(".json")) > 0).alias("skipped"))
    return kept.agg(F.count("id").alias("kept")).select(
        "kept", F.lit(seen.get["dropped"]).alias("dropped"), F.lit(seen.get["lines"]).alias("lines"),
        skipped.scalar().alias("skipped"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS batch, o_orderkey
  FROM orders),
b AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS batch, count(*) AS dropped
  FROM customer GROUP BY 1)
SELECT o.batch::BIGINT AS batch, count(*) AS works, count(DISTINCT o_orderkey) AS ids,
  count(*) + any_value(dropped) AS lines, any_value(dropped) AS dropped
FROM o JOIN b ON o.batch = b.batch GROUP BY 1""")
def replayed_ingest(t: Tables) -> DataFrame:
    """Two deliveries; each batch fails once between its files and its entry in the
    manifest, and is taken again."""
    source, target, state = (new_path(t.spark, n) for n in ("arriving", "batches", "state"))
    raw = tt.raw_works(t, ["counts_by_year"])
    number = F.element_at(F.split("id", "W"), -1).cast("bigint")

    def lost(batch: int) -> None:
        raise RuntimeError(f"batch {batch} is lost before it is entered")

    for rest in (F.col("n") % 3 != 0, F.col("n") % 3 == 0):
        _deliver(raw.withColumn("n", number).filter(rest).drop("n"), source,
                 _broken(t.customer.withColumn("n", F.col("c_custkey")).filter(rest), "c_name"))
        try:
            ingest.ingest_batches(t.spark, source, target, state, zstd_level=3, before_commit=lost)
        except StreamingQueryException:
            pass
        ingest.ingest_batches(t.spark, source, target, state, zstd_level=3)
    works = ingest.read_ingested(t.spark, target).groupBy(F.col("batch").cast("bigint").alias("batch")) \
        .agg(F.count(F.lit(1)).alias("works"), F.count_distinct("id").alias("ids"))
    return works.join(ingest.manifest(t.spark, target), "batch")


@query("""SELECT 'W' || o_orderkey AS id, '10.1000/' || o_orderkey AS doi,
  'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
  coalesce(n, 0) AS authors, coalesce(c, 0) AS citations FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT year(l_shipdate)) AS c FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey
UNION ALL SELECT 'N' || n_nationkey, NULL, n_nationkey::VARCHAR, '2020', 0, 1 FROM nation""")
def inferred_ingest(t: Tables) -> DataFrame:
    """Works read under the schema found in their lines; some lines hold numbers and texts
    where others hold texts and lists."""
    source = new_path(t.spark, "inferred")
    odd = F.format_string('{"id": "N%d", "title": %d, "publication_date": 2020, "authorships": "none",'
                          ' "counts_by_year": [{"year": "2020", "cited_by_count": "7"}], "more": {"x": 1}}',
                          "n_nationkey", "n_nationkey")
    _deliver(tt.raw_works(t, ["authorships", "counts_by_year"]), source,
             t.nation.select(odd.alias("value")).unionByName(_broken(t.region, "r_name").select("value")))
    works = snapshot.compact_work(inferred.read_inferred(t.spark, source))
    return works.select("id", "doi", "title", "publication_date", *[
        F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c) for c in ("authors", "citations")])


@query("""SELECT unnest(['authors', 'authors', 'works', 'works']) AS what,
  unnest([1, 2, 1, 2])::INT AS deliveries, true AS within_3_percent""")
def approximate_distinct(t: Tables) -> DataFrame:
    """Distinct authors and works estimated from sketches of stored slices, before and after
    a delivery adds slices; compared with exact counts."""
    target = new_path(t.spark, "sketches")
    rows = tables.with_slice(tt.mentions(t).withColumn("row_id", F.col("work")), step=SLICE)
    first = F.col("slice_head") < t.orders.agg(F.max("o_orderkey") / 2).scalar()
    out = None
    for deliveries, part, seen in ((1, first, first), (2, ~first, F.lit(True))):
        for what, column in (("authors", "author"), ("works", "work")):
            writers.append(stats.distinct_sketches(rows.filter(part), column, "slice_head")
                           .withColumn("what", F.lit(what)), target)
            kept = t.spark.read.parquet(target).filter(F.col("what") == what)
            exact = rows.filter(seen).agg(F.count_distinct(column).alias("exact"))
            row = (stats.distinct_estimate(materialize(kept, "sketches"), "n")
                   .select(F.lit(what).alias("what"), F.lit(deliveries).alias("deliveries"),
                           (F.abs(F.col("n") / exact.scalar() - 1) <= 0.03).alias("within_3_percent")))
            out = row if out is None else out.unionByName(row)
    return out
