"""Metrics against brute force on small random rankings."""

import numpy as np
import pytest

from quillgraph.operators import metrics as M


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return 0.0
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def brute_ap(y, s):
    out, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = ((s >= t) & (y == 1)).sum()
        out += (tp / y.sum() - last) * tp / (s >= t).sum()
        last = tp / y.sum()
    return out


def brute_dcg(y, s, k):
    disc = np.array([1 / np.log2(i + 2) if i < k else 0 for i in range(len(y))])
    order = np.argsort(-s, kind="stable")
    total = 0.0
    for t in set(s):
        where = [r for r, i in enumerate(order) if s[i] == t]
        total += y[s == t].sum() * disc[where].mean()
    return total


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(0)
    data = [(g, int(rng.random() < 0.4), float(rng.integers(0, 12)))
            for g, n in enumerate([5, 30, 200, 40]) for _ in range(n)]
    data += [(9, 0, 1.0), (9, 0, 2.0)]
    return data, spark.createDataFrame(data, "g int, label int, score double").repartition(5)


def arrays(data, g=None):
    pick = [r for r in data if g is None or r[0] == g]
    return np.array([r[1] for r in pick]), np.array([r[2] for r in pick])


def test_auc_and_ap(ranked):
    data, df = ranked
    y, s = arrays(data)
    assert M.roc_auc(df).first()[0] == pytest.approx(brute_auc(y, s))
    assert M.average_precision(df).first()[0] == pytest.approx(brute_ap(y, s))
    # Unchanged by a monotone change of scores.
    moved = df.selectExpr("label", "exp(score) AS score")
    assert M.roc_auc(moved).first()[0] == pytest.approx(brute_auc(y, s))


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "label int, score double")
    assert M.roc_auc(df).first()[0] == 0 and M.average_precision(df).first()[0] == 0


def test_grouped_metrics(ranked):
    data, df = ranked
    ap = {r.g: r.average_precision for r in M.average_precision(df, ["g"]).collect()}
    nd = {r.g: r.ndcg for r in M.ndcg_at_k(df, ["g"], 10).collect()}
    assert ap[9] == 0 and nd[9] == 0
    for g in range(4):
        y, s = arrays(data, g)
        assert ap[g] == pytest.approx(brute_ap(y, s))
        assert nd[g] == pytest.approx(brute_dcg(y, s, 10) / brute_dcg(y, y, 10))
    mean = M.ranking_metrics(df, ["g"], 10).first()
    assert mean.ndcg == pytest.approx(np.mean([nd[g] for g in (1, 2, 3)]))
    assert mean.map_at_k == pytest.approx(np.mean([ap[g] for g in (1, 2, 3)]))


def test_classification(spark):
    data = [(1, 1)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(data, "label int, predicted int")
    r = M.classification_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 4)
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((.7, .75, .6, 2 / 3))
    scored = spark.createDataFrame([(0.5,), (0.6,)], "score double")
    assert [x.predicted for x in M.at_threshold(scored).orderBy("score").collect()] == [0, 1]
