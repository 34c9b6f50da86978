"""Ingestion of raw records: lenient and strict mode, malformed lines."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import spec as S
from quillgraph.functions.columns import ID_PREFIX, trim_prefix_legacy
from quillgraph.schemas import COMPACT_WORK, EXTRACTED_WORK, RAW_WORK
from quillgraph.sources import snapshot
from quillgraph.streaming.ingest import ingest_new

P = ID_PREFIX


def author(n, name="N", inst=()):
    return {"author": {"id": n and P + n, "display_name": name}, "raw_author_name": name,
            "countries": ["FR"], "institutions": [
                {"id": P + i, "display_name": i, "country_code": c} for i, c in inst]}


def record(**changes):
    base = {"id": P + "W1", "doi": "https://doi.org/10.1/x", "title": "T",
            "publication_date": "2020-01-01",
            "authorships": [author("A1", "Ann", [("I1", "FR"), ("I2", None)]), author("A2")],
            "concepts": [{"id": P + "C1", "display_name": "c", "score": 0.9}],
            "topics": [{"id": P + "T1", "display_name": "t", "domain": {"display_name": "d"},
                        "field": {"display_name": "f"}}],
            "primary_topic": {"display_name": "t", "domain": {"display_name": "d"},
                              "field": {"display_name": "f"}},
            "referenced_works": [P + "W2"], "related_works": [],
            "keywords": [{"display_name": "k"}],
            "counts_by_year": [{"year": 2021, "cited_by_count": 3}]}
    base.update(changes)
    return {k: v for k, v in base.items() if v != "absent"}


LINES = [
    json.dumps(record()),
    json.dumps(record(id=P + "W2", authorships=None)),
    json.dumps(record(id="W3", authorships=[], doi=None, primary_topic=None)),
    json.dumps(record(id=P + "W4", concepts="absent")),
    json.dumps(record(id=P + "W5", counts_by_year=[{"year": "soon", "cited_by_count": 1}])),
    json.dumps(record(id=P + "W6", authorships=[{"author": None, "countries": [],
                                                 "institutions": []}])),
    json.dumps(record(id=P + "W7", authorships=[{"countries": [], "institutions": []}])),
    json.dumps(record(id=P + "W8", counts_by_year=[{"year": 2020}])),
    "{bad",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshot")
    (root / "date=1").mkdir()
    with gzip.open(root / "date=1" / "part_000.gz", "wt") as f:
        f.write("\n".join(LINES))
    return str(root)


def test_lenient_keeps_nulls_and_drops_malformed(spark, folder, rows):
    works = snapshot.ingest(spark, folder)
    assert works.schema.simpleString() == COMPACT_WORK.simpleString()
    got = {r["id"]: r for r in works.collect()}
    assert set(got) >= {"W1", "W2", "W3", "W4", "W6", "W7", "W8"} and None not in got
    one = got["W1"]
    assert one["doi"] == "10.1/x" and one["referenced_works"] == ["W2"]
    assert [a["id"] for a in one["authors"]] == ["A1", "A2"]
    assert [tuple(i) for i in one["authors"][0]["institutions"]] == [
        ("I1", "I1", "FR"), ("I2", "I2", None)]
    assert tuple(one["primary_topic"]) == ("t", "d", "f") and one["keywords"] == ["k"]
    assert got["W2"]["authors"] is None and got["W3"]["authors"] == []
    assert got["W3"]["doi"] is None and tuple(got["W3"]["primary_topic"]) == (None, None, None)
    assert got["W7"]["authors"][0]["id"] is None


def test_options_of_compact(spark, folder):
    raw = snapshot.read_snapshot(spark, folder)
    old = snapshot.compact_work(raw, strip=trim_prefix_legacy, null_doi_as_empty=True)
    got = {r["id"]: r for r in old.select("id", "doi", "authors.id").toDF("id", "doi", "a").collect()}
    assert got["/W1"]["a"] == ["/A1", "/A2"] and got["W3"]["doi"] == ""


def test_strict_rejects_with_reason(spark, folder):
    good, rejects = snapshot.extract_strict(snapshot.read_lines(spark, folder))
    assert good.schema.simpleString() == EXTRACTED_WORK.simpleString()
    got = {r["work_id"]: r for r in good.collect()}
    assert set(got) == {"W1", "W3", "W7"}
    assert got["W3"]["doi"] == "" and got["W7"]["authors"][0]["id"] is None
    one = got["W1"]["authors"][0]
    assert one["raw_name"] == "Ann" and one["country_codes"] == ["FR"]
    assert [i["id"] for i in one["institutions"]] == ["I1", "I2"]
    assert got["W1"]["citations"][0].asDict() == {"year": 2021, "count": 3}
    why = {json.loads(r["value"])["id"][-2:] if r["reason"] != "malformed" else "bad": r["reason"]
           for r in rejects.collect()}
    assert why == {"W2": "authors: no list", "W4": "concepts: no list",
                   "W5": "citations.year: no int", "W6": "authors: null at author",
                   "W8": "citations.count: no int", "bad": "malformed"}


def test_every_line_is_good_or_rejected(spark, folder):
    good, rejects = snapshot.extract_strict(snapshot.read_lines(spark, folder))
    assert good.count() + rejects.count() == len(LINES)


def test_example_has_the_shape_of_the_spec(spark):
    shown = S.example(spark, S.WORK_SPEC)
    assert shown.schema.simpleString() == EXTRACTED_WORK.simpleString()
    row = shown.first()
    assert row["title"] == "string" and len(row["authors"]) == 3
    assert row["citations"][0]["year"] == 1 and row["concepts"][2]["score"] == 0.5


def test_flat_columns(spark, folder):
    works = snapshot.add_flat_columns(snapshot.ingest(spark, folder))
    row = works.filter(F.col("id") == "W1").first()
    assert row["primary_topic_flat"] == "f" and row["high_concepts_flat"] == "c"


def test_schema_inference(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1}, "l": ["x"]}\n')
    found = {r["path"]: r["type"] for r in snapshot.infer_schema(spark, str(tmp_path)).collect()}
    assert found == {"a": "struct", "a.b": "long", "l": "array", "l[]": "string"}


def test_stream_takes_only_new_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(name, *lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        with gzip.open(tmp_path / "in" / name, "wt") as f:
            f.write("\n".join(lines))

    deliver("one.gz", LINES[0], LINES[-1])
    ingest_new(spark, source, target, state)
    deliver("two.gz", LINES[1])
    ingest_new(spark, source, target, state)
    ingest_new(spark, source, target, state)
    done = spark.read.parquet(target)
    assert sorted(r["id"] for r in done.collect()) == ["W1", "W2"]


def test_unknown_mode(spark, folder):
    with pytest.raises(ValueError):
        snapshot.ingest(spark, folder, "loose")


def test_raw_schema_has_fifteen_fields():
    assert len(RAW_WORK.fields) == 15
