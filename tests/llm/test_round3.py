"""Brute-force versions and edge cases of conversation repair, lexical search and
frequent lines."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import frequent, html, lexical, lines, packing, queries, rules, toxicity, turns

SF = "/root/testdata/sf0.001"


# --- 11 conversation repair ------------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    """(conv_id, turn, role, text) after damage, in the order given."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else \
            "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def brute_edit(initials, faults):
    """Cheapest cost and ASCII-least audit, row by row over beginnings of the pattern."""
    best = None
    layer = {"": (0, "")}  # shortest equivalent beginning -> (cost, audit)

    def add(to, made, cost, audit):
        if PATTERN.fullmatch(made) or PATTERN.fullmatch(made + "a") or made == "s":
            made = made if made in ("", "s") else "u" if made[-1] == "u" else "ua"
            if made not in to or (cost, audit) < to[made]:
                to[made] = (cost, audit)

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for made, (cost, audit) in list(out.items()):
                for letter in "ua":
                    add(out, made + letter, cost + 3, audit + "I")
        return out

    for initial, fault in zip(initials, faults, strict=True):
        new = {}
        for made, (cost, audit) in with_inserts(layer).items():
            add(new, made, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial in ("s", "u", "a"):
                    add(new, made + initial, cost + more, audit + "K")
                for letter in "ua":
                    add(new, made + letter, cost + more + 3, audit + "R")
        layer = new
    for made, found in with_inserts(layer).items():
        if PATTERN.fullmatch(made) and (best is None or found < best):
            best = found
    return best


def brute_apply(rows, audit):
    lines, last, waiting = [], "", iter(rows)
    for edit in audit:
        must = "assistant" if last == "u" else "user"
        if edit == "I":
            lines.append(f"{must}:")
            last = must[0]
            continue
        _, _, role, text = next(waiting)
        if edit == "R":
            lines.append(f"{must}:{text}")
            last = must[0]
        if edit == "K":
            lines.append(f"{role}:{text}")
            last = role[0]
    assert next(waiting, None) is None
    return lines


def brute_repair(rows, order):
    convs = collections.defaultdict(list)
    for row in brute_damage(rows):
        convs[row[0]].append(row)
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=order)
        faults = brute_faults(own)
        initials = [r[2][:1] for r in own]
        known = {r[1] for r in own if r[1] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        cost, audit = brute_edit(initials, faults)
        lines = brute_apply(own, audit)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert PATTERN.fullmatch("".join(x[0] for x in lines))
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
                 cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def by_turn(row):
    digest = hashlib.sha256(f"{row[2]}\0{row[3]}".encode()).digest()[:16]
    return (row[1] is not None, row[1] or 0, digest)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def repaired(df):
    out = df.select(COLUMNS).collect()
    assert len({r[0] for r in out}) == len(out)
    return {tuple(r) for r in out}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_conversations_equal_brute_force(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/conversations.parquet")
    want = brute_repair([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()],
                        by_turn)
    got = repaired(queries.QUERIES["op11_structure_repair"](spark, f"/root/testdata/{folder}"))
    assert got == want


def odd_conversations():
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \n", None, "Why?", "Well!  ", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts))
            for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(77, 5, "user", "Same.")] * 4
    rows += [(88, t, rng.choice(roles[:3]), f"{rng.choice(texts)}{t % 50}.") for t in range(3_000)]
    rows += [(c, 0, "user", "a.") for c in range(200, 260)]  # some lose their only row
    return rows


def test_odd_conversations(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string,"
                               " text string, digest string, copy int").repartition(5)
    want = brute_repair(rows, by_turn)
    assert repaired(turns.damaged_and_repaired(df)) == want
    assert turns.damaged_and_repaired(df.limit(0)).count() == 0
    monkeypatch.setattr(turns, "CHUNK", 7)  # conversations of many chunks
    assert repaired(turns.damaged_and_repaired(df)) == want


def test_grammar_is_used_and_keeps_sequences(spark):
    rng = random.Random(1)
    sequences = [bytes(rng.choice([3, 6, 3, 6, 0, 4, 8]) for _ in range(rng.randint(1, 80)))
                 for _ in range(300)]
    rules = turns.grammar(spark.createDataFrame([(bytearray(s),) for s in sequences], "symbols binary"))
    assert rules and len(rules) + turns.SYMBOLS <= 256
    tables = turns.matrices(rules)

    def plain(sequence):
        return b"".join(plain(bytes(rules[s - turns.SYMBOLS])) if s >= turns.SYMBOLS else bytes([s])
                        for s in sequence)

    for sequence in sequences:
        short = turns.compress(sequence, rules)
        assert plain(short) == sequence and len(short) <= len(sequence)
        own = turns.finish(turns.advance(turns.begin(), sequence, rules, tables))
        assert own == turns.finish(turns.advance(turns.begin(), sequence, [], tables))
    assert sum(len(turns.compress(s, rules)) for s in sequences) < 0.6 * sum(map(len, sequences))


# --- 12 lexical search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_search(docs, items):
    counted = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:20])]
    return sorted(out, key=repr)


def searched(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_of_odd_rows_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    pick = lambda n: " ".join(rng.choice(words[:rng.choice([5, 30, 120])]) for _ in range(n))
    texts = [pick(rng.randint(1, 60)) for _ in range(400)] + [None, "", " .-", "A" * 5000, pick(20_000)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[9]), (None, None)]
    items = [(k, pick(rng.randint(1, 30))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "zzzz"), (93, "A, b; A"), (94, texts[9]), (None, "b c")]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int,"
                                 " terms string").repartition(3)
    right = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    want = brute_search(docs, items)
    assert searched(lexical.search(left, right)) == want
    assert searched(lexical.search(left, right, query_block=7, shard_docs=50)) == want
    assert lexical.search(left.limit(0), right).count() == 0
    assert lexical.search(left, right.limit(0)).count() == 0


def test_pair_bounds_skip_more_than_single_ones(spark):
    """The same results from fewer candidates than with bounds of single terms."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = lexical.Block()
    for item in items:
        block.add(*item)
    rows = []
    for doc_id, text in docs:
        found = lexical.terms((text or "").encode())
        tf = collections.Counter(found)
        held = [(block.vocabulary[t], tf[t]) for t in tf if t in block.vocabulary]
        if found:
            rows.append({"doc_id": doc_id, "n": len(found), "terms": [t for t, _ in held],
                         "tfs": [k for _, k in held]})
    import pyarrow as pa
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                       ("tfs", pa.list_(pa.int32()))])
    table = pa.Table.from_pylist(rows, kinds)
    block.weigh(len(rows), collections.Counter(t for r in rows for t in r["terms"]))
    index = pa.Table.from_batches([lexical.shard_rows(0, table, block, len(rows), sum(r["n"] for r in rows))])
    shard = lexical.Shard(index)
    single = {pair: k for k, pair in enumerate(block.pairs)}
    loose = lexical.Shard(index)
    loose.joint = {k: (d, sum(int(loose.lists[u[0]][1].max()) * u[1] for u in pair))
                   for pair, k in single.items() if k in shard.joint for d, _ in [shard.joint[k]]}
    tight_read, loose_read = collections.Counter(), collections.Counter()
    for groups in block.groups:
        a = shard.search(groups, block.pairs, 1, tight_read)
        b = loose.search(groups, block.pairs, 1, loose_read)
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert tight_read["candidates"] < loose_read["candidates"] < len(rows) * len(items)


# --- 13 frequent lines --------------------------------------------------------------------------

def brute_frequent(docs):
    held = collections.defaultdict(set)
    rank = lambda i: (i is None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc_id)
    gone = {k: max(v, key=rank) for k, v in held.items() if len(v) >= 3}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stays = [x for x in lines if key(x) not in gone or gone[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def odd_lines():
    rng = random.Random(2)
    pool = ["é" * 19, "é" * 20, "Short line", "A line that is long enough ", "a LINE that is long enough",
            "\ta line that is long enough\r", "x" * 20_000, "", "   ", "Übung macht den Meister, sagt man",
            "İstanbul is a very large city", "a\x0cline that is long enough"]
    pool += [f"line number {k} of all the lines" for k in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    return docs + [(500, None), (501, ""), (502, "\n\n"), (3, docs[3][1]), (4, pool[3]), (None, pool[3]),
                   (None, pool[12] + "\n" + pool[13]), (503, "\n".join([pool[3]] * 3_000))]


@pytest.mark.parametrize("bits", [frequent.MOST_BITS, 256])  # 256: cut into slices
def test_frequent_lines_equal_brute_force(spark, bits):
    docs = odd_lines()
    df = spark.createDataFrame([(*d, "e", b"q") for d in docs], "doc_id long, text string, lost string,"
                               " digest binary").repartition(4)
    got = frequent.dedup(df, most_bits=bits).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_frequent(docs)
    assert frequent.dedup(df.limit(0)).count() == 0


def test_twice_seen_lets_no_repeat_out_and_few_others_in(spark):
    keys = [(i, f"a line of its own, number {i:06}" if i % 10 else f"shared by some others {i // 10 % 50:04}")
            for i in range(4_000)]
    found = frequent.keys(spark.createDataFrame(keys, "doc_id long, text string").repartition(7))
    bits = 1 << 20
    out = frequent.suspects(found, frequent.twice_seen(found, bits), bits).collect()
    repeats = {i for i, _ in keys if i % 10 == 0}
    assert repeats <= {r.doc_id for r in out} and len(out) < len(repeats) + 10


# --- 10 repeated lines and paragraphs ---------------------------------------------------------

def brute_lines(docs):
    """doc_id -> (removed lines, text that stays, words removed, passages)."""
    norm = lambda x: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w)
    seen, blocks, out = set(), set(), {}
    for doc_id, text in sorted(docs):
        split = (text or "").split("\n")
        gone, start = set(), 0
        for k, line in enumerate(split):
            if norm(line) in seen and norm(line):
                gone.add(k)
            seen.add(norm(line))
        for k in range(len(split) + 1):
            if k == len(split) or not norm(split[k]):
                whole = " ".join(map(norm, split[start:k]))
                if whole and whole in blocks:
                    gone |= set(range(start, k))
                blocks.add(whole)
                start = k + 1
        runs, run = [0], False
        for k, line in enumerate(split):
            if k in gone:
                runs[-1] += len(norm(line).split(" "))
            elif norm(line):
                runs.append(0)
        out[doc_id] = (len(gone), "\n".join(x for k, x in enumerate(split) if k not in gone),
                       sum(runs), sum(r >= lines.PASSAGE_WORDS for r in runs))
    return out


def test_short_lines_and_wrapped_paragraphs(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    passages = [" ".join(rng.sample(words, 60)) for _ in range(8)]

    def wrapped(text):
        parts, width = text.split(), rng.randint(4, 9)
        return "\n".join(" ".join(parts[i:i + width]) for i in range(0, len(parts), width))

    docs = []
    for i in range(120):
        own = [wrapped(" ".join(rng.sample(words, 40)))]
        if i % 3 == 0:
            own.append(wrapped(rng.choice(passages)))
        if i % 4 == 0:
            own.append(rng.choice(["Yes.", " yes.\t", "page 1", "\r"]))
        rng.shuffle(own)
        docs.append((i, "\n\n".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.text, r.n_removed_words, r.n_passages)
           for r in lines.dedup(df).collect()}
    assert got == brute_lines(docs)
    first = {}
    for i, text in docs:
        for p in passages:
            if p in " ".join(text.split()):
                assert (got[i][3] >= 1) == (p in first)
                first.setdefault(p, i)


# --- 9 the cascade ------------------------------------------------------------------------------

def test_a_rejected_document_meets_no_later_rule(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, "")], "doc_id long, text string")
    few = rules.Rule("few", lambda t: F.length(t) < 50)
    boom = rules.Rule("boom", lambda t: F.raise_error(F.lit("evaluated")).isNotNull())
    short = rules.cascade([{"rule": few}, {"rule": boom}], lambda r: r.rejects(F.col("text")))
    assert {r[0] for r in docs.select(short).collect()} == {"few"}
    other = rules.cascade([{"rule": boom}, {"rule": few}], lambda r: r.rejects(F.col("text")))
    with pytest.raises(Exception, match="evaluated"):
        docs.select(other).collect()


def test_cheap_and_telling_rules_come_first(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(3_000)], "doc_id long, text string")
    half = lambda t: F.crc32(t) % 2 == 0
    slow = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(3_000)), F.length(t), lambda s, x: s + x) > 0
    given = (rules.Rule("slow", lambda t: slow(t) & half(t)), rules.Rule("useless", lambda t: F.length(t) < 0),
             rules.Rule("cheap", half))
    for _ in range(2):  # on every run
        assert [s["rule"].name for s in rules.plan(docs, given)] == ["cheap", "slow", "useless"]


def test_query_computes_what_is_not_reported_inside_the_cascade(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    optimised = rules.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    for text in (r"\P{Lu}+", "[^!]+"):
        assert text in optimised
        for line in optimised.splitlines():
            if text in line:
                assert line.index("CASE WHEN") < line.index(text)


# --- 7 pairs of terms ------------------------------------------------------------------------------

def test_parts_equal_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    weights, vectors = rng.normal(size=30), rng.normal(size=(30, 4))
    sets = [rng.choice(30, n, replace=False) for n in (5, 0, 1, 12, 0)]
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    got = toxicity._parts(weights, vectors, np.concatenate(sets).astype(int), starts)[0]
    want = [sum(weights[i] for i in s) + sum(vectors[i] @ vectors[j] for i, j in itertools.combinations(s, 2))
            / math.sqrt(max(1, len(s))) for s in sets]
    assert np.allclose(got, want)


def test_pairs_decide_among_150_other_words():
    """Two terms that tell only together, in long documents, with the query's constants;
    without the vectors nothing is left."""
    rng = np.random.default_rng(1)

    def drawn(n):
        a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
        terms = [np.unique(np.concatenate([[t for t, on in ((1, x), (2, y), (3, not x), (4, not y)) if on],
                                           10 + rng.integers(0, 2_000, 150)]))
                 for x, y in zip(a, b, strict=True)]
        return terms, a == b

    terms, truth = drawn(12_000)
    machine = toxicity.train(terms, truth.astype(float))
    held, truth = drawn(1_500)
    slots = [np.array([machine.slot_of[t] for t in x if t in machine.slot_of]) for x in held]
    starts = np.cumsum([0, *map(len, slots)])[:-1]
    assert ((machine.margins(np.concatenate(slots), starts) > 0) == truth).mean() > 0.95
    machine.vectors = np.zeros_like(machine.vectors)
    assert ((machine.margins(np.concatenate(slots), starts) > 0) == truth).mean() < 0.6


# --- 2 the scan over a page -------------------------------------------------------------------------

def test_region_is_the_best_run_of_all():
    rng = random.Random(6)
    for _ in range(300):
        pieces = []
        for _ in range(rng.randint(0, 25)):
            feature = rng.choice(["w:p", "w:div", "w:hint", "t:p", "t:div", "t:nav", "t:hint"])
            pieces.append(html.Piece(feature, "a " * rng.randint(1, 4) if feature[0] == "w" else "",
                                     False, feature[0] == "t", False))
        weights = html.Weights({f: (rng.randint(0, 50), rng.randint(0, 50)) for f in (
            "w:p", "w:div", "w:hint", "t:p", "t:div", "t:nav", "t:hint")})
        scores = [weights.score(p) for p in pieces]
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        low, high = html.region(pieces, weights)
        assert abs(sum(scores[low:high]) - best) < 1e-9 and (high > low or best == 0)


def test_scan_decides_where_markup_names_nothing(spark):
    """Boilerplate without element or class names that tell: only the scan leaves it out."""
    words = " ".join(f"word{k}" for k in range(60))
    links = "".join(f"<ul><li><a href=#>go {k}</a></li></ul><table><tr><td>x</td></tr></table>" for k in range(12))
    body = f"<p>{words} one</p><p>{words} two</p>"
    labelled = [(i, "u", f"<body><div>{links}</div><article>{body}</article><div>{links}</div></body>")
                for i in range(30)]
    pages = spark.createDataFrame([*labelled, (99, "u", f"<body><div>{links}</div><div>{body}</div>"
                                              f"<div>{links}</div></body>")], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert text[99] == f"{words} one\n{words} two"
    pieces = html.parse(pages.where("page_id = 99").first().html)
    everything = " ".join(p.text for p in pieces if not p.blocked)
    assert "go 3" in everything  # without the scan it would stay


@pytest.mark.parametrize("page", ["<div>" * 60_000, "<div>a" * 60_000, "<p>" * 60_000 + "</b></i>" * 20_000,
                                  "<div><ul>" * 20_000 + "</td>" * 60_000, "<section>" * 30_000 + "x</div>" * 30_000])
def test_deep_pages_take_linear_time(page):
    import time
    begun = time.process_time()
    html.main_text(page, html.Weights({}))
    assert time.process_time() - begun < 6


# --- the pipeline against plain Python ------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keeps(text):
    """The quality rules of the pipeline, one after the other."""
    words = WORD.findall(text)
    lines_ = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    upper, letters = (sum(map(test, text)) for test in (str.isupper, str.isalpha))
    return not (len(words) < 10 or 100 * len(covered) > 20 * len(words)
                or 100 * len(re.findall("[#*$%&|<>]", text)) > 25 * len(words) or 100 * upper > 50 * letters
                or 100 * text.count("!") > 50 * len(words)
                or 100 * sum(a == b for a, b in itertools.pairwise(words)) > 30 * len(words)
                or 100 * (len(lines_) - len(set(lines_))) > 50 * len(lines_))


def shingles(text):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pipeline(docs):
    docs = {i: t for i, t in docs if t is not None and keeps(t)}
    groups = collections.defaultdict(list)
    for i, t in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    docs = {i: docs[i] for i in sorted(min(g)[1] for g in groups.values())}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in docs.items()}
    for a, b in itertools.combinations(docs, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    docs = {i: t for i, t in docs.items() if find(i) == i}
    for pattern, kind in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
                          (r"\+[0-9][\x20().0-9-]+[0-9]", "<PHONE>"),
                          (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<IP>")):
        docs = {i: re.sub(pattern, kind, t) for i, t in docs.items()}
    return docs


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu re so ta vi".split() for b in "ba de fo gu ha ji".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(rng.randint(30, 120))) for i in range(60)]
    docs += [(100 + i, docs[i][1].replace(" ", "  ")) for i in range(8)]              # exact, longer
    docs += [(200 + i, f"{docs[10 + i][1]} {prose(2)}") for i in range(8)]            # near
    docs += [(300, prose(6)), (301, "word " * 60), (302, prose(40).upper()), (303, "! ! ".join(prose(30).split())),
             (304, "\n".join([prose(12)] * 9)), (305, " # * ".join(prose(30).split())), (306, None), (307, "")]
    docs += [(400, f"{prose(40)} jan.doe@mail.example.org {prose(20)} +1 (644) 555-7859 {prose(3)}"),
             (401, f"{prose(40)} 10.11.12.13 and a@b.co {prose(20)}"), (402, prose(9_000))]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string,"
                          " lang string, source string, n_chars long").repartition(4) \
        .write.parquet(f"{folder}/documents.parquet")
    packed = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    want = plain_pipeline(docs)
    assert {200, 300, 301, 302, 303, 304, 305, 306, 307}.isdisjoint(want) and {100, 402} <= set(want)
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    pieces = set()
    for i, text in want.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces |= {(i, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))
                   for k, at in enumerate(range(0, len(ids), 2048))}
    assert {(p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in packed} == pieces
    full = collections.defaultdict(list)
    for p in packed:
        full[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in full.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(full) <= 1 + -(-sum(n for *_, n, _ in pieces) // 2048)


def test_words_of_plain_texts_are_told_apart_without_case_and_marks():
    own = packing.WordEncoder(queries.tokenizer("word_bpe_49k.json"))
    texts = ["Foo, foo Foo. FOO! foo\nfoo; end", "Hi). there!? x_. y 5. ½: É, a.\tb. ", "<b>, İ. Ab. ", ""]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(
            text, add_special_tokens=False).ids
    own.forget()
    own.encode_all(texts[:1])
    assert {w for w in own.words if w.isalpha()} == {"foo", "end"}
    assert not [w for w in own.words if len(w) > 1 and not w.isalpha()]
