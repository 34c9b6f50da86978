"""Physical plans, the entry file, and every query against its oracle."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_file
from quillgraph.operators import graph, stats
from quillgraph.plans import ORACLES, QUERIES
from quillgraph.schemas import COMPACT_WORK
from quillgraph.sources.tables import read_works

FOLDER = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(FOLDER)) if f.endswith(".parquet")]

SLOW = {"codec_profile", "link_model_scores"}


@pytest.fixture(scope="module")
def works(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("works") / "w")
    spark.createDataFrame([], COMPACT_WORK).write.parquet(path)
    return read_works(spark, path)


def read_schemas(df):
    return re.findall(r"ReadSchema: (\S+)", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("plan, expected", [
    (stats.dataset_size, "struct<>"),
    (stats.unique_authors, "struct<authors:array<struct<id:string>>>"),
    (stats.unique_teams, "struct<authors:array<struct<id:string>>>"),
    (lambda w: stats.works_by_concept(w), "struct<concepts:array<struct<name:string>>>"),
    (lambda w: graph.bipartite_edges(graph.authorships(w)),
     "struct<id:string,authors:array<struct<id:string>>>"),
    (lambda w: graph.coauthor_pairs(graph.teams(w)),
     "struct<id:string,authors:array<struct<id:string>>>"),
])
def test_scans_read_only_needed_leaves(works, plan, expected):
    assert set(read_schemas(plan(works))) == {expected}


def test_narrow_schema_prunes_arrays_in_arrays(spark, tmp_path):
    path = str(tmp_path / "w")
    row = (None,) * 5 + ([("a", "A", [("I", "x", "FR")])],) + (None,) * 7
    spark.createDataFrame([row], COMPACT_WORK).write.parquet(path)
    works = read_works(spark, path, leaves=["id", "authors.institutions.country"])
    counts = stats.works_by_country(works)
    assert set(read_schemas(counts)) == {
        "struct<authors:array<struct<institutions:array<struct<country:string>>>>>"}
    assert [tuple(r) for r in counts.collect()] == [("FR", 1)]


def test_flagship_from_nested_works_shuffles_once(works):
    plan = graph.bipartite_edges(graph.authorships(works))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text
    assert "SinglePartition" not in text


def test_coauthor_pairs_need_no_shuffle(works):
    text = graph.coauthor_pairs(graph.teams(works))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_no_query_has_a_cross_join_or_a_global_window(spark):
    for name in ("bipartite_edges", "author_selection", "pair_cosine", "topk_partners", "ndcg_at_k",
                 "country_shares", "hard_negatives", "neighbor_sample"):
        text = entry_file.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert not re.search(r"Window \[[^\]]*\], \[\]", text), name


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["author", "work"] and df.count() == 169


def test_registry():
    assert set(ORACLES) <= set(entry_file.queries())


def plain(value):
    return round(value, 4) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_oracle(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = con.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
    assert got == want
