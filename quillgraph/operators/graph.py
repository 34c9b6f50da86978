"""Author–work and co-author graphs, selection and enrichment.

The operators read the *authorship* relation ``(work, author, team_size)``,
which nested works give without a shuffle, or teams ``(work, team)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.skew import as_build_side, count_rows, groups_of_size
from quillgraph.session import materialize

# Thresholds of the published graph: bounds are inclusive.
TEAM_SIZE = (2, 10)
WORKS_PER_AUTHOR = (2, 20)
WORK_COLOR = "#ffa630"
AUTHOR_COLOR = "#0474BA"
_NO_AUTHOR = "\u0000"


def authorships(works: DataFrame, drop_null_authors: bool = True) -> DataFrame:
    """Nested works → ``(work, author, position, team_size)``, no shuffle."""
    rows = works.select(F.col("id").alias("work"), F.size("authors.id").alias("team_size"),
                        F.posexplode("authors.id").alias("position", "author"))
    if drop_null_authors:
        rows = rows.filter(F.col("author").isNotNull())
    return rows.select("work", "author", "position", "team_size")


def teams(works: DataFrame) -> DataFrame:
    """Nested works → ``(work, team)``, the author ids in order."""
    return works.select(F.col("id").alias("work"), F.col("authors.id").alias("team"))


def within_team_size(rows: DataFrame, smallest: int = TEAM_SIZE[0],
                     largest: int | None = TEAM_SIZE[1]) -> DataFrame:
    kept = F.col("team_size") >= smallest
    if largest is not None:
        kept = kept & (F.col("team_size") <= largest)
    return rows.filter(kept)


def bipartite_edges(rows: DataFrame, team_size: tuple[int, int] = TEAM_SIZE,
                    works_per_author: tuple[int, int] = WORKS_PER_AUTHOR,
                    dedup: bool = False) -> DataFrame:
    """Edges ``(author, work)`` between moderately active authors and small teams.

    A repeated author counts, and gives an edge, once per mention unless
    ``dedup``. No author's works are collected: an author past the upper bound
    is cut to one row more than the bound before the only shuffle.
    """
    pairs = within_team_size(rows, *team_size).select("author", "work")
    if dedup:
        # The first of equal rows in their order: rows of a work lie sorted as it is, and a
        # sort takes less memory a row than two hash tables of a distinct.
        same = Window.partitionBy("work", "author").orderBy("author")
        pairs = pairs.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").drop("_copy")
    return groups_of_size(pairs, "author", ["work"], *works_per_author).drop("n")


def author_selection(rows: DataFrame, min_team: int = 2, min_works: int = 2,
                     legacy_null_group: bool = False) -> DataFrame:
    """``(work, authors)``: works of teams with their repeated authors.

    An author counts when found in ``min_works`` distinct works. Null ids are
    left out; ``legacy_null_group`` pools them into one author that selects
    works without being listed.
    """
    pairs = within_team_size(rows, min_team, None).select("work", "author")
    if legacy_null_group:
        pairs = pairs.withColumn("author", F.coalesce(F.col("author").cast("string"),
                                                      F.lit(_NO_AUTHOR)))
    # Read twice, by the counts and by the rows that they select.
    pairs = materialize(pairs.distinct(), "selection-pairs")
    kept = groups_of_size(pairs, "author", ["work"], min_works, None)
    # Distinct pairs: an array can only be as long as the team of its work.
    listed = F.when(F.col("author").cast("string") != _NO_AUTHOR, F.col("author"))
    return kept.groupBy("work").agg(F.array_sort(F.collect_set(listed)).alias("authors"))


def works_per_author(edges: DataFrame, min_works: int) -> DataFrame:
    """Edges of authors with at least ``min_works`` edges, with that number.

    The long form of "collect the works of each author, filter by length,
    explode": no array of unbounded length is built.
    """
    return groups_of_size(edges, "author", ["work"], min_works, None, "n_works")


def top_authors(edges: DataFrame, n: int = 5000, min_works: int = 3) -> DataFrame:
    """All edges of the ``n`` authors with most works."""
    best = (count_rows(edges, "author", "n_works").filter(F.col("n_works") >= min_works)
            .orderBy(F.desc("n_works"), "author").limit(n))
    return edges.join(as_build_side(best.select("author")), "author", "left_semi")


def select_works(works: DataFrame, selector: DataFrame, key: str = "id",
                 keep_key: bool = False) -> DataFrame:
    """Works named in ``selector.work`` (unique); optionally with that column."""
    chosen = selector.select("work")
    return works.join(chosen, F.col(key) == F.col("work"), "inner" if keep_key else "left_semi")


def enrich(papers: DataFrame, works: DataFrame, paper_key: str, work_key: str,
           name: str = "alex") -> DataFrame:
    """Attach the matching work as struct ``name``, null where there is none.

    One row per paper: of several works with one key the smallest (by its columns in
    order) is attached, chosen with map-side combination. Keys are DOI values; bring
    both sides to one form first (``doi_url``); null keys match nothing.
    """
    packed = (works.filter(F.col(work_key).isNotNull()).groupBy(F.col(work_key).alias("_key"))
              .agg(F.min(F.struct(*works.columns)).alias(name))
              .withColumn("_piece", F.lit(0)))
    # Papers without a key match nothing but are kept: spread them over tasks.
    piece = F.when(F.col(paper_key).isNull(), F.pmod(F.xxhash64(*papers.columns), F.lit(1024)))
    spread = papers.withColumn("_piece", F.coalesce(piece, F.lit(0)).cast("int"))
    same = (F.col(paper_key) == F.col("_key")) & (spread["_piece"] == packed["_piece"])
    return spread.join(packed, same, "left").drop("_key", "_piece")


def keep_keyed(works: DataFrame, key: str, table: str, path: str, buckets: int = 200,
               name: str = "alex") -> DataFrame:
    """Store one work per ``key`` (the smallest, as :func:`enrich` chooses) as a table in
    sorted buckets of the key, and read it: what is joined to it by key moves, it doesn't."""
    packed = (works.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
              .agg(F.min(F.struct(*works.columns)).alias(name)))
    (packed.repartition(buckets, "_key").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "_key").sortBy("_key").saveAsTable(table))
    return works.sparkSession.read.table(table)


def enrich_kept(papers: DataFrame, kept: DataFrame, paper_key: str, name: str = "alex") -> DataFrame:
    """:func:`enrich` against a table of :func:`keep_keyed`, without a shuffle of its works.
    Papers that have ``name`` already, or no key, are passed by."""
    if name not in papers.columns:
        papers = papers.withColumn(name, F.lit(None).cast(kept.schema[name].dataType))
    wanted = F.col(name).isNull() & F.col(paper_key).isNotNull()
    asked = papers.filter(wanted).drop(name)
    found = asked.join(kept.hint("merge"), F.col(paper_key) == F.col("_key"), "left").drop("_key")
    return found.unionByName(papers.filter(~wanted))


def not_found(papers: DataFrame, works: DataFrame, paper_key: str, work_key: str) -> DataFrame:
    """Papers without a matching work. Papers without a key need no join."""
    keys = works.select(F.col(work_key).alias("_key"))
    keyed = papers.filter(F.col(paper_key).isNotNull())
    return (keyed.join(keys, F.col(paper_key) == F.col("_key"), "left_anti")
            .unionByName(papers.filter(F.col(paper_key).isNull())))


def coauthor_pairs(team_rows: DataFrame, max_team: int = TEAM_SIZE[1]) -> DataFrame:
    """Ordered pairs ``(work, src, dst)`` of different authors of one work.

    Expanded inside the row, without a join. Larger teams are left out as in
    the published graph, so a row gives at most ``max_team * (max_team - 1)``.
    """
    return (team_rows.filter(F.size("team") <= max_team)
            .select("work", "team", F.explode("team").alias("src"))
            .select("work", "src", F.explode("team").alias("dst"))
            .filter(F.col("src") != F.col("dst")))


def index_edges(edges: DataFrame, index: DataFrame, key: str = "author",
                ix: str = "author_ix") -> DataFrame:
    """``edges`` with ``src`` and ``dst`` replaced by their numbers in ``index``; other
    columns stay. Edges with an end that is not in the index are dropped."""
    numbers = index.select(key, ix)
    source = numbers.select(F.col(key).alias("src"), F.col(ix).alias("_src_ix"))
    target = numbers.select(F.col(key).alias("dst"), F.col(ix).alias("_dst_ix"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    joined = edges.join(as_build_side(source), "src").join(as_build_side(target), "dst")
    return joined.select(F.col("_src_ix").alias("src"), F.col("_dst_ix").alias("dst"), *rest)


def undirected_edges(edges: DataFrame, drop_self_loops: bool = True,
                     parts: int | None = None) -> DataFrame:
    """One row ``(src, dst, weight)`` per unordered pair, ``src <= dst``.

    ``parts`` is the number of partitions to count in. Pairs hardly repeat in a large graph,
    so a task's memory is that of its share of them; without ``parts`` the share is what
    the session's settings make it.
    """
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    if drop_self_loops:
        pairs = pairs.filter(F.col("src") != F.col("dst"))
    if parts is not None:
        pairs = pairs.repartition(parts, "src", "dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def symmetric_edges(edges: DataFrame, drop_self_loops: bool = True,
                    parts: int | None = None) -> DataFrame:
    """Each edge in both directions, once; ``parts`` as for :func:`undirected_edges`."""
    undirected = undirected_edges(edges, drop_self_loops, parts)
    both = F.explode(F.when(
        F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    return undirected.select(both.alias("e")).select("e.src", "e.dst")


def graph_nodes(edges: DataFrame, work: str = "work", author: str = "author") -> DataFrame:
    """Node list ``(id, color)`` of a bipartite graph."""
    def coloured(column: str, color: str) -> DataFrame:
        return (edges.select(F.col(column).cast("string").alias("id")).distinct()
                .withColumn("color", F.lit(color)))

    return coloured(work, WORK_COLOR).unionByName(coloured(author, AUTHOR_COLOR))


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edge list ``(target, source)`` of a bipartite graph."""
    return edges.select(F.col("work").alias("target"), F.col("author").alias("source"))


def degrees(edges: DataFrame, node: str = "src") -> DataFrame:
    return count_rows(edges, node, "degree")
