"""Exact search, whitening and hard negatives against plain versions."""

import collections

import numpy as np
import pytest

from vecforest.llm import negatives, topk, whitening

AWKWARD = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: None, 4: [0.0, 0.0], 5: [float("nan"), 1.0], 6: [None, 1.0], 7: [0.0, 2.0], 8: [1.0], 50: [float("inf"), 0.0], 100: [0.5, -0.5], 150: [0.0, 0.0]}


def clustered(n, width, seed, spread=0.05):
    """Rows of many lengths around a few directions, some of them repeated, some zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, width))[rng.integers(9, size=n)] + spread * rng.normal(size=(n, width))
    x *= np.exp(rng.normal(size=(n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 3 : n // 3 + n // 10] = x[n // 3]
    x[-3:] = 0
    return x.astype(np.float32).astype(float)


def frame(spark, x, labels=None, ids=None):
    rows = [(int(i), v, None if lab is None else int(lab), 1, 2) for i, v, lab in zip(range(len(x)) if ids is None else ids, x.tolist(), labels if labels is not None else [0] * len(x), strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, bucket int").withColumnRenamed("rank", "my col").repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, x, i % 3, 7, 7) for i, x in AWKWARD.items()] + [(None, [1.0, 1.0], 1, 7, 7), (9, [1.0, 0.5], None, 7, 7)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int, `a.b` int")


def best(ids, score, k):
    order = np.lexsort((ids, -score))
    return [(int(ids[j]), int(score[j])) for j in order if score[j] > -(10**15)][:k]


def plain_top_k(ids, x, k, every=50):
    w = np.floor(256 * x).astype(np.int64)
    return {int(ids[i]): best(ids[ids != ids[i]], (w @ w[i])[ids != ids[i]], k) for i in range(len(ids)) if ids[i] % every == 0}


def found(df, key, *columns):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[tuple(r[c] for c in key) if len(key) > 1 else r[key[0]]].append(tuple(r[c] for c in columns))
    return dict(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_exact_top_k(spark, spread):
    x = clustered(700, 6, 3, spread)
    got = topk.exact_top_k(frame(spark, x), bucket=64, query_block=5)
    assert found(got, ["query_id"], "vec_id", "score") == plain_top_k(np.arange(700), x, 5)
    assert all(r == list(range(1, 6)) for r in ([x[0] for x in v] for v in found(got, ["query_id"], "rank").values()))


def test_both_prunings_of_a_bucket_are_exact():
    rng = np.random.default_rng(1)
    for spread, want in ((0.05, "coordinate"), (5.0, "length")):
        n = 20_000 if want == "coordinate" else 4000
        x = clustered(n, 16, 4, spread)
        if want == "coordinate":  # of like lengths, so that only directions tell rows apart
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        x = np.floor(256 * x).astype(np.int64)
        q, ids = x[rng.integers(n, size=200)] + 1, np.arange(n)
        score = q @ x.T
        exact = [best(ids, s, 5) for s in score]
        bound = np.array([e[-1][1] for e in exact])
        bound[:20] = topk.NONE
        qid, vid, got, seen = topk.bucket_hits(ids, x, -1 - np.arange(200), q, bound, 5, np.float64)
        rows = collections.defaultdict(list)
        for a, b, s in zip(qid.tolist(), vid.tolist(), got.tolist(), strict=True):
            rows[-1 - a].append((b, s))
        assert [sorted(rows[i], key=lambda r: (-r[1], r[0])) for i in range(200)] == exact
        assert seen[want] > 100 and seen["products"] < score.size


def test_products_beyond_doubles_are_exact(spark):
    x = np.array([[3e7, 1.0], [3e7, 3.0], [2e7, -5.0], [1e7, 1e7]])
    assert found(topk.exact_top_k(frame(spark, x), scale=1), ["query_id"], "vec_id", "score") == {0: [(1, 9 * 10**14 + 3), (2, 6 * 10**14 - 5), (3, 3 * 10**14 + 10**7)]}
    with pytest.raises(ValueError, match="long"):
        topk.exact_top_k(frame(spark, x * 1000))


def test_exact_top_k_of_awkward_rows(awkward):
    got = found(topk.exact_top_k(awkward), ["query_id"], "vec_id", "score")
    assert got[0] == [(1, 65536), (2, 65536), (9, 65536), (100, 32768), (4, 0)]
    assert got[150] == [(0, 0), (1, 0), (2, 0), (4, 0), (7, 0)] and got.keys() == {0, 100, 150}


def test_rows_of_one_id(spark):
    x = np.array([[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [0.5, 0.0]])
    got = found(topk.exact_top_k(frame(spark, x, ids=[0, 0, 7, 7])), ["query_id"], "vec_id", "score")
    assert got == {0: [(7, 512 * 256), (7, 512 * 128)]}


# Whitening


def plain_whitening(x):
    w = (np.floor(1024 * x) + 100_000).astype(np.int64)
    c = w - w.mean(0)
    value, vector = np.linalg.eigh(c.T @ c / len(c))
    return w, c, value[::-1], vector[:, ::-1]


@pytest.mark.parametrize("scales", [[5, 4, 3, 2.5, 2, 1.5, 1, 0.7, 0.5, 0.1], [400, 90, 20, 8, 3, 1, 0.4, 0.2, 0.1, 0.05]])
def test_whitening(spark, scales):
    x = np.random.default_rng(0).normal(size=(600, 10)) * scales @ np.linalg.qr(np.random.default_rng(1).normal(size=(10, 10)))[0]
    x = x.astype(np.float32).astype(float)
    w, c, value, vector = plain_whitening(x)
    rows = whitening.whitening(frame(spark, x)).collect()
    assert len(rows) == 4800 and {r.n for r in rows} == {600}
    got = np.zeros((600, 8))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-6) and r.identity_error < 1e-9
        assert int(r.deviation) == sum((600 * int(a) - int(s)) ** 2 for a, s in zip(w[r.vec_id], w.sum(0), strict=True))
    want = c @ vector[:, :8] / np.sqrt(value[:8])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-6
    assert np.abs(got.T @ got / 600 - np.eye(8)).max() < 1e-9


def test_the_triangular_factor_of_badly_scaled_rows(spark):
    """Singular values over eleven orders of magnitude, which a covariance in double precision cannot hold."""
    from vecforest.llm.vectors import moments

    rng = np.random.default_rng(2)
    x = (rng.normal(size=(500, 4)) * [1e12, 1e8, 1e4, 30]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    x = np.floor(x).astype(np.int64)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>")
    total, _ = moments(df, 4)
    r = whitening.triangular_factor(df, 500, total)
    exact = np.linalg.svd(whitening.centred(x, 500, total), compute_uv=False)
    assert np.abs(np.linalg.svd(r, compute_uv=False) / exact - 1).max() < 1e-4


def test_whitening_without_variance(spark):
    x = np.zeros((40, 3))
    x[:, 0] = np.arange(40)
    rows = whitening.whitening(frame(spark, x)).collect()
    assert len(rows) == 120 and all((r.whitened is None) == (r.component > 1) for r in rows)
    assert all(r.identity_error < 1e-9 and r.explained == (1.0 if r.component == 1 else pytest.approx(0, abs=1e-12)) for r in rows)
    same = whitening.whitening(frame(spark, np.ones((5, 2)))).collect()
    assert len(same) == 10 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)


def test_whitening_of_awkward_rows(awkward):
    rows = whitening.whitening(awkward).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 4, 7, 9, 100, 150} and len(rows) == 16 and {r.n for r in rows} == {8}


# Hard negatives


def plain_negatives(ids, x, label, positives=5, negatives=3):
    w = np.floor(256 * x).astype(np.int64)
    out = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            score, others = w @ w[i], ids != ids[i]
            for p, ps in best(ids[others & (label == label[i])], score[others & (label == label[i])], positives):
                fits = others & (label != label[i]) & (50 * ps <= 100 * score) & (100 * score <= 95 * ps)
                if rows := best(ids[fits], score[fits], negatives):
                    out[int(ids[i]), p, ps] = rows
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_hard_negatives(spark, monkeypatch, spread):
    for name, value in (("ZONE", 8), ("GROUP", 4), ("ANCHORS", 3), ("ZONES", 16)):
        monkeypatch.setattr(negatives, name, value)
    x = clustered(900, 6, 5, spread)
    label = np.random.default_rng(2).integers(4, size=900)
    label[label == 3] = 0  # one label holds half of all rows
    got = found(negatives.hard_negatives(frame(spark, x, label)), ["anchor_id", "positive_id", "positive_score"], "negative_id", "negative_score")
    assert got == plain_negatives(np.arange(900), x, label)


def test_the_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = negatives.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, size=(5, 40, 7)), rng.integers(-300, 300, size=(9, 7))
    low, high = negatives.score_bounds(q, x.min(1), x.max(1))
    score = np.einsum("qd,znd->qzn", q, x)
    assert (low <= score.min(2)).all() and (score.max(2) <= high).all()


def test_zones_out_of_reach_are_not_read(spark, monkeypatch):
    """Tight clusters: most zones cannot hold a hit."""
    for name, value in (("ZONE", 16), ("GROUP", 4)):
        monkeypatch.setattr(negatives, name, value)
    masks, needed = [], negatives.Zones.needed
    monkeypatch.setattr(negatives.Zones, "needed", lambda self, *a: masks.append((a[2], out := needed(self, *a))) or out)
    x = clustered(2000, 8, 6, 0.02)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    negatives.hard_negatives(frame(spark, x, np.arange(2000) % 5)).count()
    read = sum(bin(r.mask).count("1") for best_only, df in masks if not best_only for r in df.collect())
    assert read < 0.5 * 40 * 125  # of the zones of both searches together, for 40 anchors


def test_hard_negatives_of_awkward_rows(awkward):
    rows = [(r.vec_id, r.embedding, r.label) for r in awkward.collect()] + [(30, [1.0, 0.0], 0), (31, [0.75, 0.1], 1), (32, [0.7, 0.0], 1), (32, [0.7, 0.0], 1)]
    df = awkward.sparkSession.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = found(negatives.hard_negatives(df), ["anchor_id", "positive_id", "positive_score"], "negative_id", "negative_score")
    good = [r for r in rows if r[0] in (0, 1, 2, 4, 7, 100, 150, 30, 31, 32)]
    assert got == plain_negatives(*(np.array(c) for c in zip(*good, strict=True)))
    assert got[0, 30, 65536] == [(31, 192 * 256), (32, 179 * 256), (32, 179 * 256)] and got[150, 0, 0]  # the rows of id 32 each count


def test_empty_vector_tables(spark, nothing):
    df = nothing.selectExpr("*", "cast(null as int) label")
    assert [x.count() for x in (topk.exact_top_k(df), whitening.whitening(df), negatives.hard_negatives(df))] == [0, 0, 0]
