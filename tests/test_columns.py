"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import hashing


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame(
        [(C.ID_PREFIX + "A5",), ("A5",), (None,), (C.ID_PREFIX,)], "id string")


def test_strip_prefix_removes_all_of_it(ids, rows):
    once = C.strip_prefix(F.col("id"), C.ID_PREFIX)
    assert rows(ids.select(once)) == sorted([("A5",), ("A5",), (None,), ("",)], key=repr)
    twice = C.strip_prefix(once, C.ID_PREFIX)
    assert ids.filter(~once.eqNullSafe(twice)).count() == 0


def test_legacy_trim_keeps_last_prefix_character(ids, rows):
    kept = ids.select(C.trim_prefix_legacy(F.col("id"), C.ID_PREFIX))
    assert rows(kept) == sorted([("/A5",), ("A5",), (None,), ("/",)], key=repr)


def test_counts_of_citations(spark, rows):
    df = spark.createDataFrame(
        [(1, [(2020, 5), (2021, 7)]), (2, []), (3, None), (4, [(2020, None)])],
        "id int, c array<struct<year:bigint,count:bigint>>")
    got = rows(df.select("id", C.last_count(F.col("c")), C.total_count(F.col("c"))))
    assert got == [(1, 7, 12), (2, 0, 0), (3, 0, 0), (4, None, 0)]


def test_path_with_index(spark, rows):
    df = spark.sql("SELECT named_struct('a', array(named_struct('b', 7))) AS s, array(1) AS l")
    assert rows(df.select(C.path(F.col("s"), "a[0].b"), C.path(F.col("l"), "[3]"))) == [(7, None)]


def test_parse_rename_and_keys(spark, rows):
    df = spark.createDataFrame([("2020-01-31", "10.1/A"), ("soon", "https://doi.org/10.1/a")],
                               "`Update-Date` string, d string")
    named = C.rename_columns(df, C.metadata_name())
    assert named.columns == ["arxiv_update_date", "arxiv_d"]
    got = named.select(C.parse_day(F.col("arxiv_update_date")).isNull(),
                       C.doi_url(F.col("arxiv_d"))).collect()
    assert [tuple(r) for r in got] == [(False, "https://doi.org/10.1/a"),
                                       (True, "https://doi.org/10.1/a")]


def test_update_field_and_team(spark, rows):
    df = spark.createDataFrame([([("b", 1), (None, 2), ("a", 3)],)],
                               "a array<struct<id:string,n:int>>")
    upper = C.update_field(F.col("a"), "id", F.upper)
    assert df.select(upper.getField("id")).first()[0] == ["B", None, "A"]
    assert df.select(C.team(F.col("a"))).first()[0] == ["a", "b", None]


def test_uniform_numbers_spread_and_repeat(spark):
    df = spark.range(20000)
    share = df.filter(hashing.below(0.05, "s", F.col("id"))).count() / 20000
    assert 0.04 < share < 0.06
    a = df.select(F.sum(hashing.uniform32("s", F.col("id")))).first()[0]
    b = df.repartition(5).select(F.sum(hashing.uniform32("s", F.col("id")))).first()[0]
    assert a == b
