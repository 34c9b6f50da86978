"""Edge cases and brute-force versions of the text operators."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import (
    bpe, exact, html, lines, minhash, packing, pii, queries, rules, substrings, toxicity)

SF = "/root/testdata/sf0.001"
BYTE = queries.tokenizer("byte_bpe_50k.json")
WORD = queries.tokenizer("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = [
    "the quick brown fox jumps over the lazy dog while the sun goes down behind the old hills",
    "a small river runs through the green valley and turns the wheel of the ancient water mill",
    "nobody in the village knew who had painted the door of the empty house in such a bright red",
]
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long,"
          " digest string, bucket int, key long, chunk long")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and
    columns whose names the operators use themselves."""
    texts = [PROSE[0], PROSE[0] + " ", None, "", " \n\t ", LONG, PROSE[1], PROSE[1] + "\n" + PROSE[1],
             "é" * 300, "call +1 (644) 555-7859 or mail a.b@c-d.org.", "0" * 5000, "a" * 5000,
             PROSE[2] + "\n" + PROSE[0] + "\n" + PROSE[2], LONG + " end"]
    rows = [(i, t, None, None, len(t) if t else None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[0], rows[6], (None, PROSE[0], "en", "s", 3, None, None, None, None),
             (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect() if r.doc_id is not None}


# --- the queries and the pipeline ------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for name_of in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF}/{name_of}.parquet'")
    answer = con.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in answer.description)
    assert names == sorted(df.columns)
    order = [[c[0] for c in answer.description].index(n) for n in names]
    want = sorted(tuple(r[i] for i in order) for r in answer.fetchall())
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, none, name, stage):
    assert stage(spark, none, SF).count() == 0
    out = stage(spark, odd, SF)
    if name != "pack":
        assert out.columns == odd.columns
    assert out.count() > 0


def test_pipeline(spark, docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(texts_of(kept))
    sizes = collections.Counter()
    for r in packed.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= packing.CAPACITY


# --- 1 exact dedup ------------------------------------------------------------------------------

def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    made = exact.PerfectHash.build(keys)
    assert sorted(made.slots(keys)) == list(range(5000))
    assert exact.PerfectHash.build(keys[:0]).slots(keys).max() == -1


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id))
    return {(d, min(g)[1], len(g)) for g in groups.values() for _, d in g}


def test_exact_dedup(spark, odd, none):
    assert exact.dedup(none).count() == 0 and exact.unique_documents(none).columns == none.columns
    rows = [(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None]
    some = odd.where("doc_id IS NOT NULL")
    want = brute_exact(rows)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact.dedup(some).collect()} == want
    for low in (0, 5):  # whatever counts as history
        history, batch = some.where(f"doc_id < {low}"), some.where(f"doc_id >= {low}")
        got = exact.dedup(batch, history).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {w for w in want if w[0] >= low}
    everyone = {(r.doc_id, r.keep_id) for r in exact.dedup(odd).collect()}
    assert (None, 1) in everyone  # the same text as documents 0 and 1; 1 is longer
    assert (None, 4) in everyone and (3, 4) in everyone
    left = [r.doc_id for r in exact.unique_documents(odd).collect()]
    assert 0 not in left and 1 in left and 2 not in left


# --- 2 html ----------------------------------------------------------------------------------------

PAGE = ("<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a>"
        "</li></ul></nav><div class='ad'>Buy our things today for a very good price.</div>"
        "<{tag}><h1>Head &amp; tail</h1><p>First <b>bold</b>\n  text of it.</p><script>var a='<p>no</p>'"
        "</script><aside>See also this</aside><p>Second&nbsp;one &lt;here&gt; it goes on.<br>"
        "<div class='comments'><p>I like it</p></div></{tag}><footer>&copy; us and nobody else</footer>"
        "</body></html>")
MAIN = "Head & tail\nFirst bold text of it.\nSecond one <here> it goes on."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html.main_text(PAGE.format(tag=tag), html.Weights({})) == MAIN


@pytest.mark.parametrize("old, new", [
    ("</head>", ""), ("</title><style>p{{}}</style></head><body>", "</title><meta charset=u>"),
    ("<body>", "<body class='has-sidebar'>"), ("<body>", "<body class='social'>"),
    ("<html>", "<html class='no-sidebar' id=widget>"), ("<body>", "<body><div class='with-sidebar'>"),
    ("<{tag}>", "<{tag} class='post social'>")])
def test_main_text_where_the_head_is_open_or_names_look_like_hints(old, new):
    page = PAGE.replace(old, new)
    assert page != PAGE and html.main_text(page.format(tag="article"), html.Weights({})) == MAIN


def test_formulas_stay_in_their_line():
    page = PAGE.format(tag="article").replace(
        "text of it.", "text of <math class='ad'><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup>"
        "<mi>c</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>E=mc^2"
        "</annotation></semantics></math> it.")
    assert html.main_text(page, html.Weights({})) == MAIN.replace("text of it", "text of E=mc2 it")
    page = page.replace("</annotation></semantics></math> it.", "")
    assert html.main_text(page, html.Weights({})).endswith("Second one <here> it goes on.")


def test_html_edge_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", PAGE.format(tag="article"), None, None), (None, None, None, None, None),
            (2, "v", "", "t", 1), (2, "v", "", "t", 1), (3, None, "<p>only <b", None, 1),
            (4, "w", "<article><p>" + "long " * 50_000, None, None), (5, "x", "<nav>a</nav>", "", 0)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in
           html.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, "u"] == (MAIN, len(MAIN))
    assert got[None, None] == got[2, "v"] == ("", 0) and got[5, "x"] == ("", 0)
    assert got[3, None] == ("only", 4) and got[4, "w"][1] == 249_999


# --- 3 substrings ------------------------------------------------------------------------------------

def brute_copies(texts, length=substrings.LENGTH):
    seen, out = set(), {}
    for doc_id in sorted(texts):
        data = texts[doc_id].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_longest_previous_factors_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = lambda a, b: next((k for k in range(len(text)) if a[k:k + 1] != b[k:k + 1]
                                    or not a[k:k + 1]), len(text))
        common = np.array([0] + [shared(text[i:], text[j:]) for i, j in
                                 zip(order[:-1], order[1:], strict=True)][:max(0, len(text) - 1)])
        want = [max([shared(text[i:], text[j:]) for j in range(i)], default=0) for i in range(len(text))]
        got = substrings.longest_previous_factors(np.array(order, np.int64), common[:len(text)])
        assert got.tolist() == want


def test_suffix_dedup(spark, odd, none):
    assert substrings.dedup(none).count() == 0
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcd ") for _ in range(400)) for _ in range(4)]
    made = []
    for i in range(60):
        text = "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90)))
        for _ in range(rnd.randint(0, 3)):
            b, at = rnd.choice(base), rnd.randint(0, 250)
            text += b[at:at + rnd.randint(60, 200)] + rnd.choice(["", "é", "q" * 120])
        made.append((i, text))
    some = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    for df in (some, odd.where("doc_id IS NOT NULL")):
        want = brute_copies(texts_of(df))
        for r in substrings.dedup(df, with_kept=True).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert substrings.dedup(odd).where("doc_id IS NULL").count() == 2


def test_open_runs_of_a_hot_anchor_are_spread(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_TEXTS", 20)
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    made = [(i, noise(150) + passage + noise(150)) for i in range(300)]
    df = spark.createDataFrame(made + made[7:9], "doc_id long, text string").repartition(5)
    met = []
    whole = substrings._open_texts
    monkeypatch.setattr(substrings, "_open_texts", lambda *a: met.append(whole(*a)) or met[0])
    want = brute_copies(texts_of(df))
    for r in substrings.dedup(df).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    largest = met[0].where("key IS NOT NULL").groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest < 100  # of 302 rows with the passage


def test_suffix_dedup_query(spark, docs):
    want = brute_copies(texts_of(docs))
    got = queries.QUERIES["op3_suffix_array_dedup"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


# --- 4 bpe ---------------------------------------------------------------------------------------------

def test_bpe_equals_library(spark, odd, none):
    assert bpe.round_trip(none, BYTE).count() == 0
    library, own = Tokenizer.from_file(BYTE), bpe.codec(BYTE)
    rnd = random.Random(1)
    pool = [*"abtheTHE    \n\n\t\r.,'s1éß好  \x1c😀", "<|endoftext|>", "'ll", " the", "I'M"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["abcab" * 4000, "x" * 70, "é" * 500]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    for r in bpe.round_trip(odd, BYTE, with_ids=True, with_text=True).join(
            odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id").collect():
        assert r.decoded == r.t and len(r.ids) == r.n_tokens
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_bpe_query(spark, docs):
    library = Tokenizer.from_file(BYTE)
    texts = texts_of(docs)
    for r in queries.QUERIES["op4_bpe_round_trip"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- 5 pii ----------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    figures = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(figures)) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 13 <= len(number) <= 19 and luhn(number),
                "phone": 9 <= len(number) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, odd, none):
    assert pii.detect(none).count() == 0
    rnd = random.Random(2)
    pool = [*"aé.@-_+ 0123456789()😀\n", "4111 1111 1111 1111", "1.2.3.4", "+1 (644) 555-7859",
            "a.b@c.de", "999.1.1.1", ".1.2", "x@y", "@z.", "378282246310005"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["a@b.c._d@e.f", "1.2.3.4.5.6.7.8", "a." * 3000 + "b@c" + ".d" * 3000, "1-" * 20_000 + "1"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for df in (some, odd.where("doc_id IS NOT NULL")):
        known = texts_of(df)
        for r in pii.detect(df).collect():
            assert [tuple(s) for s in r.base_spans] == brute_pii(known[r.doc_id]), known[r.doc_id]
            assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))
    assert pii.detect(odd).count() == odd.count()


def test_pii_learns_to_add_spans_and_redacts(spark):
    rows = [(i, f"please call me at 555-{i:03d}-{4000 + i} or mail joe{i} [at] mail [dot] com, +1 (644) 555-{7000 + i}")
            for i in range(40)]
    rows += [(100, None), (101, "no personal data here, version 1.2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(df).collect()}
    assert found[3] == ["email", "phone", "phone"] and found[100] == found[101] == []
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[3].text == "please call me at <PHONE> or mail <EMAIL>, <PHONE>"
    assert clean[3].n_chars == len(clean[3].text)
    assert clean[100].text is None and clean[101].text == rows[-1][1]


def test_expectation_maximisation_tells_good_labelers_from_bad():
    rnd = random.Random(4)
    counts = collections.Counter()
    for _ in range(4000):
        truth = rnd.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rnd.random() < p else -1) for p in (0.95, 0.9, 0.85, 0.6))
        counts[votes] += 1
    rows = [dict(zip(pii.LABELERS, v, strict=True), n=n) for v, n in counts.items()]
    _, reliability = pii.expectation_maximisation(rows)
    for name, p in zip(pii.LABELERS, (0.95, 0.9, 0.85, 0.6), strict=True):
        assert reliability[name] == pytest.approx(p, abs=0.04)


# --- 6 near-duplicates --------------------------------------------------------------------------------------

def brute_near(texts, near):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc_id, text in texts.items():
        w = WORDS.findall(text.translate(lower))
        sets[doc_id] = {tuple(w[i:i + near.words]) for i in range(max(1, len(w) - near.words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and near.linked(common, len(sets[a]), len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("near", [minhash.Near(), minhash.Near(3, 85, 24, 5)])
def test_near_groups(spark, odd, none, near):
    assert minhash.group(none, near).count() == 0
    rnd = random.Random(6)
    base = [[rnd.choice("abcdefghijk") * rnd.randint(1, 4) for _ in range(120)] for _ in range(5)]
    made = []
    for i in range(150):
        words = list(rnd.choice(base[:3] if i % 3 else base[:1]))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 6])):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(40)}"
        made.append((i, " ".join(words)))
    some = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for df in (some, odd.where("doc_id IS NOT NULL")):
        want = brute_near(texts_of(df), near)
        for r in minhash.group(df, near).collect():
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    lost = [r for r in minhash.group(odd, near).collect() if r.doc_id is None]
    assert len(lost) == 2 and all(r.kept and r.component_id is None for r in lost)


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 20)
    near = minhash.Near(1, 80, 32, 4)
    rnd = random.Random(8)
    made = [(i, " ".join(sorted({f"w{k}" for k in range(30)} - {f"w{rnd.randrange(30)}" for _ in range(5)})))
            for i in range(120)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.group(df, near).collect()}
    assert got == brute_near(dict(made), near)


def test_super_minhash_estimates_similarity():
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.arange(101, 501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signature = minhash.super_minhash(np.concatenate([a, b]), np.array([400, 400]), 128)
    assert (signature[0] == signature[1]).mean() == pytest.approx(0.6, abs=0.12)


# --- 7 toxicity ------------------------------------------------------------------------------------------------

def test_toxicity(spark, odd, none):
    rnd = random.Random(9)
    rows, truth = [], []
    for i in range(900):
        words = [rnd.choice("lamp tree road stone house river cloud".split()) + str(rnd.randrange(30)) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(40)] = "grobian" + rnd.choice(["", "s", "ish", "esk"])
        rows.append((i, " ".join(words)))
        truth.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(truth, "doc_id long, toxic int")
    got = toxicity.detect(docs, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(r.predicted, truth[r.doc_id][1]) for r in got if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert toxicity.detect(none, labels).count() == 0
    strange = toxicity.detect(odd, labels.union(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    assert all(0 <= r.score <= 1 for r in strange.collect()) and strange.count() == odd.count()
    empty = toxicity.detect(docs, labels.limit(0))
    assert empty.select("score").distinct().count() == 1


def test_machine_learns_pairs():
    """Two terms that only tell together: the linear weights can't, the vectors can."""
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    terms = [np.array([t for t, on in ((1, x), (2, y), (3, not x), (4, not y)) if on])
             for x, y in zip(a, b, strict=True)]
    labels = (a == b).astype(float)
    monkey, toxicity.LEAST_CHI = toxicity.LEAST_CHI, 0.0
    try:
        machine = toxicity.train(terms, labels, epochs=60)
    finally:
        toxicity.LEAST_CHI = monkey
    slots = [np.array([machine.slot_of[t] for t in x]) for x in terms]
    starts = np.cumsum([0, *(len(s) for s in slots)])[:-1]
    right = (machine.margins(np.concatenate(slots), starts) > 0) == (labels > 0.5)
    assert right.mean() > 0.95


def test_machine_learns_pairs_as_it_is_used():
    """The same with the constants and epochs of the query: terms that are as frequent in
    toxic as in clean documents get no weight, but vectors."""
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    terms = [np.array([t for t, on in ((1, x), (2, y), (3, not x), (4, not y)) if on])
             for x, y in zip(a, b, strict=True)]
    labels = (a == b).astype(float)
    machine = toxicity.train(terms, labels)
    assert sorted(machine.slot_of) == [1, 2, 3, 4] and not machine.weights.any()
    slots = np.array([machine.slot_of[t] for x in terms for t in x])
    right = (machine.margins(slots, np.arange(0, len(slots), 2)) > 0) == (labels > 0.5)
    assert right.mean() > 0.95


# --- 8 packing ----------------------------------------------------------------------------------------------------

def brute_bins(sizes, capacity):
    """Fewest bins, by trying all ways (few items)."""
    best = len(sizes)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= sizes[i] and free[k] not in free[:k]:
                place(i + 1, [*free[:k], free[k] - sizes[i], *free[k + 1:]])
        place(i + 1, [*free, capacity - sizes[i]])

    place(0, [])
    return best


def test_plan_fills_each_place_once_and_reduction_is_safe():
    rnd = random.Random(7)
    for _ in range(150):
        capacity = rnd.choice([8, 10, 16, 50])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9))), reverse=True)
        histogram = collections.Counter(sizes)
        left = [histogram.get(n, 0) for n in range(capacity + 1)]
        reduced = packing.Plan(capacity)
        reduced.reduce(left)
        rest = [n for n in range(capacity, 0, -1) for _ in range(left[n])]
        assert reduced.sequences + brute_bins(rest, capacity) == brute_bins(sizes, capacity)
        made = packing.plan(dict(histogram), capacity)
        length, rank, sequence, each, offset = made.arrays()
        bins = collections.defaultdict(list)
        for n, times in histogram.items():
            for r in range(times):
                k = max(i for i in range(len(length)) if length[i] == n and rank[i] <= r)
                q, o = divmod(r - rank[k], each[k])
                bins[sequence[k] + q].append((offset[k] + n * o, n))
        assert len(bins) == made.sequences
        for places in bins.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= capacity


def test_word_ids_equal_library():
    library, own = Tokenizer.from_file(WORD), packing.encoder(WORD)
    rnd = random.Random(1)
    pool = [*"abtheTHE    \n\n\t\r.,'s1éßİΣς好  \x1c😀́", "<|endoftext|>", "<|startoftext|>", "'ll", "I'M", "ﬁ"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, odd, none, docs):
    assert packing.pack(none, WORD).count() == 0
    library = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        rows = packing.pack(df, WORD, with_ids=True).collect()
        texts = texts_of(df)
        by_doc = collections.defaultdict(list)
        bins = collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            bins[r.sequence_id].append((r.offset, r.length))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        for doc_id, text in texts.items():
            ids = library.encode(text, add_special_tokens=False).ids + [0]
            got = sorted({(r.piece, r.start, tuple(r.ids)) for r in by_doc[doc_id]})
            assert [i for _, _, part in got for i in part] == ids
            assert all(start == 2048 * k for k, start, _ in got)
        for places in bins.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 2048


# --- 9 rules ---------------------------------------------------------------------------------------------------------

def brute_measures(text):
    w = WORDS.findall(text)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    own = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered))


def test_rules(spark, odd, none):
    assert rules.judge(none).count() == 0 and rules.passing(none).columns == none.columns
    rnd = random.Random(11)
    pool = ["a", "b", "c", " ", " ", "\n", "\t", "é", "#", "A!!", "a b c d e ", "\x0b", " "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (some, odd.where("doc_id IS NOT NULL")):
        known = texts_of(df)
        kept = set()
        for r in rules.judge(df).collect():
            want = brute_measures(known[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            kept |= {r.doc_id} if r.kept else set()
        assert {r.doc_id for r in rules.passing(df).collect()} == kept
    assert rules.judge(odd).count() == odd.count()


def test_cascade_order_changes_no_verdict(spark, docs):
    steps = rules.plan(docs)
    assert {s["rule"].name for s in steps} == {r.name for r in rules.RULES}
    kept = []
    for order in (steps, steps[::-1]):
        verdict = rules.cascade(order, lambda rule: rule.rejects(F.col("text")))
        kept.append({r.doc_id for r in docs.where(verdict.isNull()).collect()})
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


# --- 10 lines -----------------------------------------------------------------------------------------------------------

def test_lines(spark, odd, none):
    assert lines.dedup(none).count() == 0
    got = {r.doc_id: r for r in lines.dedup(odd).collect()}
    assert got[0].text == PROSE[0] and got[0].n_removed == 0  # repeated row, one document
    assert got[1].text == "" and got[1].n_removed == 1
    assert got[6].n_removed == 0 and got[7].n_removed == 2 and got[7].text == ""
    assert got[12].text == PROSE[2] and [tuple(s) for s in got[12].spans] == [
        (len(PROSE[2]) + 1, len(PROSE[2]) + 1 + len(PROSE[0])),
        (len(PROSE[2]) + len(PROSE[0]) + 2, 2 * len(PROSE[2]) + len(PROSE[0]) + 2)]
    assert got[3].text == "" and got[3].n_lines == 1 and got[4].text == " \n\t "
    assert got[None].n_removed in (0, 1)
