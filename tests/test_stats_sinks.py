"""Statistics, writers, slices, the overview job and session helpers."""

import pytest
from pyspark.sql import functions as F

from quillgraph import session as Z
from quillgraph.operators import stats as A
from quillgraph.plans import overview
from quillgraph.schemas import COMPACT_WORK
from quillgraph.sinks import writers as K
from quillgraph.sources import tables as S
from quillgraph.sources.snapshot import add_flat_columns


def work(i, authors=None, concepts=None, field=None, citations=None):
    return (i, None, None, None, None, authors, concepts, None, (None, None, field), None, None,
            None, citations)


FR, DE, NO = ("I1", "x", "FR"), ("I2", "y", "DE"), ("I3", "z", None)


@pytest.fixture(scope="module")
def works(spark):
    return add_flat_columns(spark.createDataFrame([
        work("w1", [("a", "A", [FR, FR]), ("b", "B", [DE])], [("C1", "x", .9)], "f", [(2020, 4)]),
        work("w2", [("b", "B", None), ("a", "A", [NO])], [("C2", "x", .1), ("C3", "y", .6)], "f"),
        work("w3", [], None, None, []),
        work("w4", None, [], "g", [(2020, 1), (2021, 2)]),
        work("w4", [(None, "N", [DE])], None, "g"),
    ], COMPACT_WORK))


def test_counts(works, rows):
    one = lambda df: df.first()[0]
    assert one(A.dataset_size(works)) == 5 and one(A.unique_works(works)) == 4
    assert one(A.unique_authors(works)) == 2 and one(A.unique_authors(works, approx=True)) == 2
    # {a, b} twice, the empty team, the team of one unnamed author; null is none.
    assert one(A.unique_teams(works)) == 3


def test_groupings(works, rows):
    assert rows(A.works_by_country(works)) == sorted(
        [("FR", 2), ("DE", 2), (None, 1)], key=repr)
    assert rows(A.works_by_country(works, distinct_works=True)) == sorted(
        [("FR", 1), ("DE", 2), (None, 1)], key=repr)
    assert rows(A.works_by_concept(works)) == [("x", 2), ("y", 1)]
    assert rows(A.works_by_topic(works)) == sorted([("f", 2), ("g", 2), (None, 1)], key=repr)
    assert [r.works for r in A.in_order(A.works_by_concept(works), "concept").collect()] == [1, 2]


def test_citations(works, rows):
    assert rows(A.citation_distribution(works, keep_id=True)) == [
        ("w1", 4, 4), ("w2", 0, 0), ("w3", 0, 0), ("w4", 0, 0), ("w4", 2, 3)]


def test_reshaping(spark, rows):
    c = spark.createDataFrame([("FR", 60), ("DE", 40), (None, 60), ("IT", 40)], "k string, works int")
    assert rows(A.merge_small(c, "k", 50)) == sorted([("FR", 60), (None, 60), ("other", 80)], key=repr)
    assert dict((r.k, r.share) for r in A.shares(c).collect())["FR"] == pytest.approx(.3)
    assert [r.k for r in A.top(c, "k", 2).collect()] == [None, "FR"]
    assert rows(A.over(c, 50), "k") == [("FR",), (None,)]
    people = spark.createDataFrame([("FR", 1000), ("DE", 100)], "k string, persons int")
    per = A.per_capita(c, people, "k").collect()
    assert [(r.k, r.papers_per_capita) for r in per] == [("DE", 400.0), ("FR", 60.0)]


def test_histogram_and_box(spark, rows):
    v = spark.createDataFrame([(x,) for x in [0, 0, 1, 2, 9]], "v int")
    assert rows(A.histogram(v, "v", 2)) == [(0, 3), (2, 1), (8, 1)]
    assert tuple(A.box_summary(v, "v").first()) == (0, 0.0, 1.0, 2.0, 9)
    assert rows(A.mean_by(v.withColumn("g", F.lit(1)), "g", "v")) == [(1, 2.4)]


@pytest.fixture()
def table(spark):
    return spark.range(2500).select(F.col("id").alias("row_id"), F.sha2(
        F.col("id").cast("string"), 256).alias("text"))


def test_parquet_writers(spark, table, tmp_path, rows):
    target = str(tmp_path / "p")
    K.write_parquet(table, target, mode="errorifexists", zstd_level=17, rows_per_file=1000)
    names = [p.name for p in (tmp_path / "p").glob("*.parquet")]
    assert len(names) >= 3 and all(".zstd." in n for n in names)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_parquet(table, target, mode="errorifexists")
    K.write_parquet(table, target, codec="snappy")
    assert all(".snappy." in p.name for p in (tmp_path / "p").glob("*.parquet"))
    K.append(table, target)
    assert spark.read.parquet(target).count() == 5000 and K.stored_bytes(spark, target) > 0


def test_slices(spark, table, tmp_path, rows):
    plan = S.slices(table, step=1000)
    assert rows(plan) == [(0, 1000), (1000, 2000), (2000, 2500)]
    assert S.read_slice(table, 1000, 2000).count() == 1000
    assert S.slices(table.filter("row_id < 0")).count() == 0
    target = str(tmp_path / "s")
    K.write_slices(S.with_slice(table, step=1000), target, 3)
    K.write_slices(S.with_slice(S.read_slice(table, 1000, 1500), step=1000), target, 3)
    back = spark.read.parquet(target)
    assert {r.slice_head: r.n for r in back.groupBy("slice_head").agg(
        F.count("*").alias("n")).collect()} == {0: 1000, 1000: 500, 2000: 500}
    assert "PartitionFilters: [isnotnull(slice_head" in back.filter(
        "slice_head = 0")._jdf.queryExecution().toString()
    done = plan.filter("slice_head < 2000")
    assert tuple(S.slice_status(plan, done).first()) == (3, 2, 1)


def test_graph_vocabulary_and_profile(spark, table, tmp_path, rows):
    e = spark.createDataFrame([("a", "w")], "author string, work string")
    K.write_graph(e, str(tmp_path))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "graph"))) == [("w", "a")]
    v = spark.createDataFrame([("FR", 0), (None, 1)], "term string, ix bigint")
    K.write_vocabulary(v, str(tmp_path / "v"))
    assert rows(S.lookup_terms(spark.range(2).toDF("ix"), S.read_matrix(
        spark, str(tmp_path / "v")), "ix")) == [(0, "FR"), (1, None)]
    profile = K.codec_profile(table, (1, 17), repeats=2).collect()
    assert [r.level for r in profile] == [1, 17] and profile[0].size > profile[1].size > 0


def test_overview_goes_on_after_a_failure(spark, works, tmp_path):
    plans = {"bad": lambda w: w.select("nothing"), **overview.OVERVIEW}
    report = {r.stat: r.status for r in overview.run(works, str(tmp_path), plans).collect()}
    assert report.pop("bad") == "failed" and set(report.values()) == {"ok"} and len(report) == 9
    assert spark.read.parquet(str(tmp_path / "dataset_size")).first()[0] == 5


def test_title_search_and_pending(spark, rows):
    t = spark.createDataFrame([("Deep Sea life",), ("Life",), (None,)], "title string")
    assert rows(S.title_search(t, "sea LIFE")) == [("Deep Sea life",)]
    p = spark.createDataFrame([("x", None), ("y", 1), (None, None)], "arxiv_doi string, alex int")
    assert rows(S.pending(p), "arxiv_doi") == [("x",)]


def test_session_helpers(spark, monkeypatch):
    monkeypatch.setenv("ACCESS_KEY", "k")
    monkeypatch.setenv("SECRET_KEY", "s")
    conf = Z.object_store_conf("storage.example")
    assert conf["spark.hadoop.fs.s3a.connection.maximum"] == "50"
    assert conf["spark.hadoop.fs.s3a.secret.key"] == "s"
    monkeypatch.delenv("SECRET_KEY")
    assert "spark.hadoop.fs.s3a.access.key" not in Z.object_store_conf("storage.example")
    assert Z.work_dir(spark) == Z.work_dir(spark) and Z.new_path(spark, "a") != Z.new_path(spark, "a")


def test_work_folder_is_given_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "_PATHS", [])
    monkeypatch.setattr(Z, "work_dir", lambda _: str(tmp_path))
    assert Z.materialize(spark.range(3), "kept").count() == 3
    assert list(tmp_path.iterdir()) and Z.drop_work(spark) == 1
    assert not list(tmp_path.iterdir())


def test_scratch_gives_back_its_own_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "_PATHS", [])
    monkeypatch.setattr(Z, "work_dir", lambda _: str(tmp_path))
    kept = Z.new_path(spark, "kept")
    with pytest.raises(RuntimeError), Z.scratch(spark):
        Z.materialize(spark.range(4), "step").write.parquet(kept)
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == [kept.rsplit("/", 1)[1]]
    assert spark.read.parquet(kept).count() == 4 and Z._PATHS == [kept]


class Unset:
    """A session without the folder setting."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, key, default):
        return default


def test_only_local_sessions_get_a_folder_of_their_own():
    assert Z.work_dir(Unset("local[2]")) == Z.work_dir(Unset("local[2]"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        Z.work_dir(Unset("spark://host:7077"))
