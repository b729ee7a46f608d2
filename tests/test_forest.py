"""Known small answers and invariants of the forest operators."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecforest.functions import scalars as S
from vecforest.operators import clustering as C
from vecforest.operators import layout as L
from vecforest.operators import relations as R
from vecforest.operators import tree as T
from vecforest.params import Params
from vecforest.plans import catalog as K
from vecforest.sources import files as Files

SF = "/root/testdata/sf0.001"


def unit(*v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, str(leaf), str(root)) for i, v, leaf, root in rows], R.FIELDS)


@pytest.fixture(scope="module")
def pairs(spark):
    return frame(spark, [(0, unit(1, 0), 0, 0), (1, unit(0.99, 0.1), 0, 0), (2, unit(0, 1), 1, 0), (3, unit(0.1, 0.99), 1, 0)])


def test_nearest_of_two_pairs(pairs):
    assert sorted((r.src, r.dst) for r in R.knn(pairs, "root", 1).collect()) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_blocks_do_not_change_neighbours(spark):
    v = Files.synthetic_corpus(spark, 300, 16).withColumns({"leaf": (F.col("doc_id") % 3).cast("string"), "root": F.lit("r")})
    a = {tuple(r) for r in R.knn(v, "leaf", 4).collect()}
    assert a == {tuple(r) for r in R.knn(v.repartition(7), "leaf", 4, block=20).collect()}


def test_k_means_of_pairs_and_of_equal_vectors(spark, pairs):
    got = {r.doc_id: r.cluster for r in C.spherical_k_means(pairs, 2)[0].collect()}
    assert got[0] == got[1] != got[2] == got[3]
    same = frame(spark, [(i, [1.0, 0.0], 0, 0) for i in range(4)])
    assert sorted(r.doc_id for r in C.spherical_k_means(same, 4)[0].collect()) == [0, 1, 2, 3]


def test_k_means_query_runs_to_its_stop(spark):
    """Plain k-means with four centres until no label changes, or 30 rounds."""
    from vecforest import queries as Q

    rows = sorted(Q.vecs(spark, "/root/testdata/sf0.01").select("doc_id", "vector").collect())
    x = np.array([r.vector for r in rows])
    centres, labels = x[:1], None
    while len(centres) < 4:
        centres = np.vstack([centres, x[np.round(x @ centres.T, 9).max(1).argmin()]])
    for _ in range(30):
        before, labels = labels, np.round(x @ centres.T, 9).argmax(1)
        assert set(labels) == {0, 1, 2, 3}
        if before is not None and (before == labels).all():
            break
        centres = np.array([x[labels == c].sum(0) for c in range(4)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    got = {r.doc_id: r.cluster for r in Q.QUERIES["spherical_k_means"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: c for r, c in zip(rows, labels.tolist(), strict=True)}


def test_linkage_of_pairs(pairs):
    rows = sorted((r.step, r.score) for r in C.average_linkage(pairs, "root").collect())
    x = np.array([unit(1, 0), unit(0.99, 0.1), unit(0, 1), unit(0.1, 0.99)])
    assert rows[-1][1] == pytest.approx((x[:2] @ x[2:].T).mean())


def test_linkage_of_groups_weighs_members(spark):
    v = frame(spark, [(0, unit(1, 0), 0, 0), (1, unit(0.9, 0.1), 0, 0), (2, unit(0.8, 0.2), 1, 0), (3, unit(0, 1), 2, 0), (4, unit(0.1, 0.99), 2, 0)])
    x = np.array([r.vector for r in v.orderBy("doc_id").collect()])
    last = max(C.group_linkage(v, "root", "leaf").collect(), key=lambda r: r.step)
    assert last.score == pytest.approx((x[:3] @ x[3:].T).mean())
    assert last["size"] == 5


def test_protected_groups_join_small_parts(spark):
    v = frame(spark, [(0, unit(1, 0), 0, 0), (1, unit(0.99, 0.1), 0, 0), (2, unit(0.8, 0.6), 0, 0)])
    assert {r.part for r in C.protected_groups(v, "root", 0.98, 2).collect()} == {0}


@pytest.fixture(scope="module")
def large_groups(spark):
    """Groups of 90, 60 and 8 rows, with 40 equal vectors in the first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(158, 8)) + rng.normal(size=(6, 8))[rng.integers(6, size=158)]
    x[10:50] = x[10]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, [0] * 90 + [1] * 60 + [2] * 8, frame(spark, [(i, v, 0, 0 if i < 90 else 1 if i < 150 else 2) for i, v in enumerate(x.tolist())])


def plain_linkage(x):
    """All merges one by one, each score the mean over all cross pairs."""
    s, groups, out = x @ x.T, {i: [i] for i in range(len(x))}, []
    while len(groups) > 1:
        pairs = [(-round(float(s[np.ix_(groups[a], groups[b])].mean()), 11), min(groups[a] + groups[b]), max(groups[a][0], groups[b][0]), a, b) for a in groups for b in groups if groups[a][0] < groups[b][0]]
        score, *_, a, b = min(pairs)
        merged = sorted(groups.pop(a) + groups.pop(b))
        groups[len(x) + len(out)] = merged
        out.append((a, b, -score, merged))
    return out


def test_linkage_of_large_groups_is_the_one_by_one_linkage(large_groups):
    x, label, v = large_groups
    got = C.average_linkage(v, "root", 12).collect()
    for g in range(3):
        mine = x[[i for i in range(158) if label[i] == g]]
        rows = sorted((r.step, r.left, r.right, r["size"], r.score) for r in got if r.root == str(g))
        want = plain_linkage(mine)
        assert [r[:4] for r in rows] == [(i, a, b, len(m)) for i, (a, b, _, m) in enumerate(want)]
        assert [r[4] for r in rows] == pytest.approx([w[2] for w in want], abs=1e-9)


def test_linkage_keeps_a_null_group(large_groups):
    v = large_groups[2].withColumn("root", F.when(F.col("root") != "0", F.col("root")))
    assert C.average_linkage(v, "root", 12).filter("root IS NULL").count() == 89
    assert C.protected_groups(v, "root", 0.6, 3, 12).filter("root IS NULL").count() == 90


def test_parts_of_large_groups(large_groups):
    x, label, v = large_groups
    got = {r.doc_id: (r.root, r.part) for r in C.protected_groups(v, "root", 0.6, 3, 12).collect()}
    for g in range(3):
        ids = [i for i in range(158) if label[i] == g]
        s = x[ids] @ x[ids].T
        parts = {i: [i] for i in range(len(ids))}
        for k, (a, b, score, m) in enumerate(plain_linkage(x[ids])):
            if score >= 0.6:
                parts[len(ids) + k] = sorted(parts.pop(a) + parts.pop(b))
        parts = sorted(parts.values())
        while len(parts) > 1 and min(map(len, parts)) < 3:
            small = min(parts, key=lambda m: (len(m), m))
            into = max((m for m in parts if m is not small), key=lambda m: s[np.ix_(small, m)].mean())
            parts = sorted([m for m in parts if m is not small and m is not into] + [sorted(small + into)])
        assert {ids[i]: (str(g), p) for p, m in enumerate(parts) for i in m} == {i: got[i] for i in ids}


def plain_tree(x, parts, depth):
    """{(members, depth, kind): score} by joining the parts one by one on the mean of all cross pairs."""
    s, groups, tree = x @ x.T, {i: sorted(p) for i, p in enumerate(parts)}, {}
    while len(groups) > 1:
        _, a, b = min((-round(float(s[np.ix_(groups[a], groups[b])].mean()), 12), a, b) for a in groups for b in groups if a < b)
        score = float(s[np.ix_(groups[a], groups[b])].mean())
        new = len(parts) + len(tree)
        tree[new] = (a, b, score, groups[a] + groups[b])
        groups[new] = sorted(groups.pop(a) + groups.pop(b))
    out = {}

    def grow(i, level):
        score, m = (tree[i][2], tree[i][3]) if i in tree else (None, parts[i])
        split = i in tree and level < depth
        out[frozenset(m), level] = ("root" if not level else "branch" if split else "leaf", None if score is None else round(score, 9))
        for child in tree[i][:2] if split else ():
            grow(child, level + 1)

    top = max(groups)
    grow(top, 0) if tree else out.update({(frozenset(parts[0]), 0): ("root", None), (frozenset(parts[0]), 1): ("leaf", None)})
    return out


@pytest.mark.parametrize(("most", "tau", "least", "depth"), [(400, 0.6, 3, 7), (12, 0.97, 1, 3)])
def test_topic_tree(large_groups, most, tau, least, depth):
    from vecforest.operators.topics import topic_tree

    x, label, v = large_groups
    part = {r.doc_id: (int(r.root), r.part) for r in C.protected_groups(v, "root", tau, least, most).collect()}
    members, nodes = topic_tree(v, "root", tau, least, depth, most)
    paths = {r.doc_id: r.path for r in members.collect()}
    assert sorted(paths) == list(range(158))
    got = {g: {} for g in range(3)}
    for r in nodes.collect():
        below = frozenset(i for i, p in paths.items() if p == r.node or p.startswith(r.node + "/"))
        assert len(below) == r.n and r.root == f"t:{label[min(below)]}" and r.depth <= depth
        got[label[min(below)]][below, r.depth] = (r.kind, r.score)
    for g in range(3):
        mine = {}
        for i, (h, p) in part.items():
            if h == g:
                mine.setdefault(p, []).append(i)
        want = plain_tree(x, [mine[p] for p in sorted(mine)], depth)
        assert got[g].keys() == want.keys()
        assert all(got[g][k][0] == kind and got[g][k][1] == pytest.approx(score, abs=1e-8) for k, (kind, score) in want.items())


def test_linkage_of_many_parts_is_that_of_one_task(spark):
    """Members count in a mean, whichever way the parts are merged."""
    v = Files.synthetic_corpus(spark, 160, 8).withColumns({"leaf": (F.col("doc_id") % 40).cast("string"), "root": F.lit("r")})
    rows = lambda most: sorted((r.step, r.left, r.right, r["size"], round(r.score, 9)) for r in C.group_linkage(v, "root", "leaf", most).collect())
    whole = rows(400)
    assert len(whole) == 39 and whole == rows(15)


@pytest.mark.parametrize("rows", ["spread", "equal", "two"])
def test_bounded_hierarchy(spark, rows):
    if rows == "spread":
        v = Files.synthetic_corpus(spark, 700, 16)
    else:
        v = spark.range(400).select(F.col("id").alias("doc_id"), F.array(F.when((F.col("id") % 2 == 0) | (F.lit(rows) == "equal"), 1.0).otherwise(-1.0), F.lit(0.0)).alias("vector"))
    got = C.bounded_hierarchy(v).collect()
    assert len(got) == len({r.doc_id for r in got}) == v.count()
    sizes, children = {}, {}
    for r in got:
        sizes[r.path] = sizes.get(r.path, 0) + 1
        parts = r.path.split("/")
        for i in range(1, len(parts)):
            children.setdefault("/".join(parts[:i]), set()).add(parts[i])
    assert max(sizes.values()) <= 32
    assert max(map(len, children.values())) <= 8


def test_append_keeps_top_cells(spark):
    v = Files.synthetic_corpus(spark, 200, 16)
    top = lambda df: {r.doc_id: r.cell for r in C.cells(df.withColumn("path", F.lit("r"))).collect()}
    before, after = top(v.filter("doc_id < 150")), top(v)
    assert all(after[i] == c for i, c in before.items())


def test_capped_is_the_sequential_greedy(spark):
    rng = np.random.default_rng(3)
    for trial in range(3):
        rows = [(i, 1000 + i, round(float(rng.random()), 2), f"l{rng.integers(6)}", f"m{rng.integers(6)}") for i in range(40)]
        got = {(r.i, r.j) for r in R.capped(spark.createDataFrame(rows, "i long, j long, score double, leaf_i string, leaf_j string"), 2).collect()}
        used, want = {}, set()
        for i, j, _, a, b in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if used.get(a, 0) < 2 and used.get(b, 0) < 2:
                want.add((i, j))
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        assert got == want
    assert R.capped(spark.createDataFrame(rows, "i long, j long, score double, leaf_i string, leaf_j string"), 0).count() == 0


def test_neighbours_found_without_all_pairs(spark):
    from vecforest.operators import neighbours as H

    v = Files.synthetic_corpus(spark, 2500, 32).withColumn("root", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string")))
    exact = R.knn(v.withColumn("root", F.coalesce("root", F.lit("-"))), "root", 4)
    got = H.approximate_knn(v, "root", 4, width=16, cell=64, trees=2).cache()
    r = H.recall(got, exact).first()
    assert r.rows == 10_000 and r.recall >= 0.95
    assert got.groupBy("src").count().filter("count <> 4").count() == 0
    same = spark.range(300).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"), F.lit("r").alias("root"))
    assert H.approximate_knn(same, "root", 4, width=8, cell=32, trees=1, rounds=2).filter("score = 1").count() == 1200
    few = Files.synthetic_corpus(spark, 40, 8).withColumn("root", F.lit("r"))
    assert {tuple(e) for e in H.approximate_knn(few, "root", 4).collect()} == {tuple(e) for e in R.knn(few, "root", 4).collect()}


def test_codes_travel_to_meetings_where_news_are(spark, monkeypatch):
    from vecforest.operators import neighbours as H

    x = np.random.default_rng(4).normal(size=(60, 32)) * np.repeat([1.0, 1e-3, 1e4, 0.0, 1e-200, 5e-324], 10)[:, None]
    y, error, length, coded = H.decoded(pa.array([c.tobytes() for c in H.codes_of(x)]))
    slack = error[:, None] * length + coded[:, None] * error
    assert (np.abs(x @ x.T - y @ y.T) <= slack * (1 + 1e-9) + 1e-12 * (1 + length[:, None] * length)).all()
    met, join = [], H.local_join
    monkeypatch.setattr(H, "local_join", lambda df: met.append(df) or join(df))
    v = Files.synthetic_corpus(spark, 1200, 32).withColumn("root", F.lit("r"))
    H.approximate_knn(v, "root", 4, width=12, cell=64, trees=2).count()
    assert len(met) > 2
    for df in met:
        assert df.columns == ["v", "u", "fresh", "least", "code"] and df.filter("length(code) > 24 + 2 * 32").isEmpty()
        assert df.groupBy("v").agg(F.max("fresh").alias("new")).filter("not new").isEmpty()


@pytest.mark.parametrize(("tau", "spread"), [(0.3, 1.0), (0.9, 0.1), (-0.5, 1.0)])
def test_bridges_lose_no_pair(spark, tau, spread):
    """Pruned blocks give the pairs of a plain matrix product; tight topics leave most pairs of blocks out."""
    from vecforest.operators import bridges as B

    rng = np.random.default_rng(8)
    leaf = rng.integers(12, size=500)
    x = rng.normal(size=(12, 16))[leaf] + spread * rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8] * 1.5  # no unit vector
    v = frame(spark, [(i, row, leaf[i], leaf[i] % 3) for i, row in enumerate(x.tolist())])
    score = np.round(x @ x.T, 6)
    want = {(i, j, round(float(score[i, j]), 6)) for i in range(500) for j in range(i + 1, 500) if leaf[i] % 3 != leaf[j] % 3 and score[i, j] >= tau}
    got = {(r.i, r.j, round(r.score, 6)) for r in R.cross_candidates(v, tau, block=16).collect()}
    assert {p[:2] for p in got} == {p[:2] for p in want} and all(abs(score[i, j] - s) < 2e-6 for i, j, s in got)
    why = {r.why: r.n for r in B.pruning(B.block_pairs(B.block_summaries(B.like_blocks(v, 16)), tau)).collect()}
    assert sum(why.values()) == 32 * 33 // 2 and why["one root"] > 100
    assert why.get("out of reach", 0) > 200 if spread < 1 else True


def test_bridges_send_a_row_as_often_at_any_size(spark, monkeypatch):
    """The groups grow with the rows, and small strips and batches give the same pairs, also where all are copies."""
    from vecforest.operators import bridges as B

    rng = np.random.default_rng(9)
    x = rng.normal(size=(480, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent = []
    for n in (240, 480):
        rows = B.like_blocks(frame(spark, [(i, row, i % 6, i % 3) for i, row in enumerate(x[:n].tolist())]), 4)
        met = B.meetings(rows, B.block_pairs(B.block_summaries(rows), -1.0), 4)
        sent.append(met.filter("kind > 0").count() / n)
    assert sent[1] < 1.1 * sent[0] and sent[1] <= B.GROUPS + 1
    assert B.group_size(100_000, 256, 64) * 256 * 64 * 8 <= B.HELD and B.group_size(100_000, 256, 1024) * 256 * 1024 * 8 <= B.HELD
    for name, value in {"GROUPS": 3, "LEAST": 1, "STRIP": 7, "SENT": 5}.items():
        monkeypatch.setattr(B, name, value)
    x[100:130] = x[100]
    v = frame(spark, [(i, row, i % 6, i % 3) for i, row in enumerate(x[:200].tolist())])
    score = np.round(x @ x.T, 6)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if i % 3 != j % 3 and score[i, j] >= 0.5}
    got = [(r.i, r.j) for r in R.cross_candidates(v, 0.5, block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = {}
    for i, j in sorted(want, key=lambda ij: (-score[ij], ij)):
        best.setdefault(frozenset((i % 6, j % 6)), (i, j))
    assert {(r.i, r.j) for r in R.best_leaf_pairs(R.cross_candidates(v, 0.5, True, block=8)).collect()} == set(best.values())


def test_no_link_where_no_length_is_allowed(spark, pairs):
    pos = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(4)], "doc_id long, x double, y double, z double")
    split = pairs.withColumn("root", F.col("leaf"))
    assert R.cross_links(split, pos, 0.0, 0.0, 2).count() == 0
    assert R.cross_links(split, pos, 0.0, 1.0, 2).count() == 1


def test_placement_classes(spark):
    anchors = spark.createDataFrame([("a", [1.0, 0.0, 0.0], -100.0, 0.0, 0.0), ("b", [0.0, 1.0, 0.0], 100.0, 0.0, 0.0)], "leaf string, centroid array<double>, x double, y double, z double")
    v = frame(spark, [(0, unit(1, 1, 0), 0, 0), (1, [1.0, 0.0, 0.0], 0, 0), (2, [0.0, 0.0, 1.0], 0, 0)])
    got = {r.doc_id: r for r in L.place_documents(v, anchors, 0.45, 0.8).collect()}
    assert [got[i].placement for i in range(3)] == ["bridge", "cluster", "outlier"]
    assert got[0].x == pytest.approx(0) and got[1].x == pytest.approx(-100)


def plain_place(i, v, anchors, floor, density, scopes=(), axes=(), extent=None):
    """One document at a time: (leaf, placement, place)."""
    names, c, pos, radius = zip(*sorted(anchors), strict=True)
    c, pos = np.array(c), np.array(pos)
    score = np.round(c @ v, 6)
    order = np.argsort(-score, kind="stable")
    top = order[0]
    active = [j for j in order[:3] if score[j] > floor]
    scope = max((s @ v for s in scopes), default=None)
    if not active or (scope is not None and scope < floor):
        state, d = i + 452, []
        for _ in range(3):
            state = (state * 1664525 + 1013904223) % 2**32
            d.append(state / 2**32 - 0.5)
        reach = max(np.linalg.norm(p) + r for p, r in zip(pos, radius, strict=True)) if extent is None else extent
        return names[top], "outlier", np.array(d) / np.linalg.norm(d) * (reach + 225 * (1.2 + max(0, floor - (score[top] if scope is None else scope))))
    w = np.array([((score[j] - floor) / (1 - floor)) ** 2 * math.exp((score[j] - score[top]) / 0.07) for j in active])
    dominance = 1 if len(w) == 1 else 1 - w[1] / w[0]
    p = (1 - density * dominance) * (w @ pos[active] / w.sum()) + density * dominance * pos[top]
    raw = np.array([a @ (v - c[top]) for a in axes] or [0, 0, 0])
    size = np.linalg.norm(raw)
    if size > 1e-10:
        p = p + raw / size * min(radius[top], size * 225 * 0.7 * (1 - 0.65 * density)) * dominance
    return names[top], "bridge" if dominance < 0.35 else "cluster", p


@pytest.mark.parametrize("most", [2048, 4])
def test_placement_is_that_of_one_document_at_a_time(spark, most):
    """With themes and residual axes; also where anchors are too many for one task."""
    rng = np.random.default_rng(4)
    u = lambda *shape: (lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True))(rng.normal(size=shape))
    c, x, scopes, axes = u(11, 6), u(80, 6), u(3, 6), u(3, 6)
    anchors = [(f"l{i}", c[i].tolist(), rng.normal(size=3).tolist(), float(rng.uniform(8, 30))) for i in range(11)]
    df = spark.createDataFrame([(n, v, *p, r) for n, v, p, r in anchors], "leaf string, centroid array<double>, x double, y double, z double, radius double")
    v = frame(spark, [(i, row, 0, 0) for i, row in enumerate(x.tolist())])
    seen = set()
    for s, a in ((scopes, axes), (None, None)):
        got = {r.doc_id: r for r in L.place_documents(v, df, 0.45, 0.8, s, a, most=most).collect()}
        for i in range(80):
            leaf, kind, p = plain_place(i, x[i], anchors, 0.45, 0.8, () if s is None else s, () if a is None else a)
            r = got[i]
            assert (r.nearest_leaf, r.placement) == (leaf, kind) and np.allclose([r.x, r.y, r.z], p, atol=1e-6)
            assert r.distance == pytest.approx(np.linalg.norm(p - np.array(dict((n, q) for n, _, q, _ in anchors)[leaf])), abs=1e-6)
            seen.add(kind)
    assert seen == {"outlier", "bridge", "cluster"}


def test_places_move_with_topics_and_tighten_with_density(spark):
    rows = lambda dx: spark.createDataFrame([("a", [1.0, 0.0, 0.0], -100.0 + dx, 0.0, 0.0), ("b", [0.0, 1.0, 0.0], 100.0 + dx, 0.0, 0.0)], "leaf string, centroid array<double>, x double, y double, z double")
    v = frame(spark, [(0, unit(1, 1, 0), 0, 0), (1, unit(0.8, 0.6, 0), 0, 0), (2, [1.0, 0.0, 0.0], 0, 0)])
    at = lambda *a, **k: {r.doc_id: r for r in L.place_documents(v, *a, **k).collect()}
    assert at(rows(1000.0), 0.45, 0.8)[0].x == pytest.approx(1000) and at(rows(0.0), 0.45, 0.8)[2].distance == pytest.approx(0)
    assert at(rows(0.0), 0.45, 1.0)[1].distance < at(rows(0.0), 0.45, 0.0)[1].distance
    assert {r.placement for r in at(rows(0.0), 0.45, 0.8, scopes=np.array([[0.0, 0.0, 1.0]])).values()} == {"outlier"}
    assert L.place_documents(v.limit(0), rows(0.0), 0.45, 0.8).count() == 0


def test_landmarks_fit_nearly_as_well_as_all_topics_together(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(8, 12))[rng.integers(8, size=160)] + 0.6 * rng.normal(size=(160, 12))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    kind = ["root" if i < 4 else "leaf" for i in range(160)]
    rows = [("s", f"t{i:03}", kind[i], v) for i, v in enumerate(c.tolist())] + [("few", "a", "leaf", c[0].tolist()), ("few", "b", "leaf", c[1].tolist())]
    df = spark.createDataFrame(rows, "scope string, topic string, kind string, centroid array<double>")
    root = np.array(kind) == "root"
    target, weight = L._targets(c, c, root, root, 0.5)
    np.fill_diagonal(weight, 0)

    def rms(got):
        p = np.array([[r.x, r.y, r.z] for r in sorted(got, key=lambda r: r.topic) if r.scope == "s"])
        assert p.shape == (160, 3) and np.allclose(p.mean(0), 0, atol=1e-6)
        d = np.linalg.norm(p[:, None] - p[None], axis=2)
        return math.sqrt((weight * (d - target) ** 2).sum() / weight.sum())

    full, fast = L.fit_topics(df, "scope", 0.5).collect(), L.fit_topics(df, "scope", 0.5, most=100, landmarks=48).collect()
    assert len(full) == len(fast) == 162
    assert rms(fast) <= 1.05 * rms(full)
    assert next(r.rms for r in fast if r.scope == "s") == pytest.approx(rms(fast), rel=0.1)


def test_topic_fit(spark):
    rows = [("s", str(i), "leaf", unit(*v)) for i, v in enumerate([(1, 0), (0.99, 0.1), (-1, 0)])]
    got = sorted(L.fit_topics(spark.createDataFrame(rows, "scope string, topic string, kind string, centroid array<double>"), "scope", 0.0).collect(), key=lambda r: r.topic)
    p = np.array([[r.x, r.y, r.z] for r in got])
    assert np.linalg.norm(p[0] - p[1]) < 0.2 * 225 and np.linalg.norm(p[0] - p[2]) > 1.3 * 225
    assert np.allclose(p.mean(0), 0) and got[0].rms < 4.5


def test_representatives(spark):
    rows = spark.createDataFrame([("p", "a", 8, 0), ("p", "b", 2, 100), ("p", "c", 5, 0)], "parent string, node string, n long, s long")
    assert [r.node for r in sorted(T.representatives(rows, "parent", F.col("s"), 2).collect(), key=lambda r: r["rank"])] == ["b", "a"]


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a, b = (sorted((r.doc_id, tuple(r.vector)) for r in Files.synthetic_corpus(spark, 40, 8, partitions=p).collect()) for p in (1, 5))
    assert a == b


def test_json_files(spark, tmp_path):
    shapes = {
        "m.json": {"files": [{"file": "a.json", "count": 1, "bytes": 2}]}, "g.json": {"nodes": [], "edges": []}, "t.json": {"texts": [{"id": "x", "title": "t"}]}, "l.json": ["a", "b"],
        "b.json": {"overview_cards": [{"id": "1", "title": "c", "summary": "s"}], "deep_dive_analysis": [{"topic": "d", "evolution_and_updates": "e", "perspectives": {"k": "v"}, "long_term_impact": "f"}], "briefing_flash": [{"headline": "h", "source": "s"}]},
        "u.json": {"other": 1},
    }
    for name, value in shapes.items():
        (tmp_path / name).write_text(("﻿" if name == "t.json" else "") + json.dumps(value))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bad.json").write_text("{no")
    files = Files.read_json_files(spark, f"file://{tmp_path}")
    got = {r.path.rpartition("/")[2]: r.format for r in files.collect()}
    assert got == {"m.json": "manifest", "g.json": "graph", "t.json": "texts", "l.json": "array", "b.json": "briefing", "u.json": None, "bad.json": None}
    assert {r.title: r.text for r in Files.adapt_briefing(files).collect()} == {"c": "s", "d": "e\n\nk：v\n\nf", "h": "h"}
    assert sorted((r.title, r.text) for r in Files.adapt_items(files.filter("format = 'array'")).collect()) == [("a", "a"), ("b", "b")]
    assert Files.local_ids(Files.adapt_items(files.filter("format = 'texts'"))).first().doc_id.endswith(":x")


def test_catalogue_reads_one_chunk(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    members = docs.select("doc_id", F.lit("r/system").alias("path"))
    edges = spark.createDataFrame([(1, 40, 0.5)], "src long, dst long, score double")
    K.write_catalog(docs, edges, members, f"file://{tmp_path}/c")
    got = K.read_catalog(spark, f"file://{tmp_path}/c", [33])
    assert [(r.doc_id, r.chunk) for r in got.collect()] == [(33, 1)]
    assert len(got.select(F.input_file_name()).distinct().collect()) == 1


def test_dates_and_paths(spark):
    rows = spark.createDataFrame([("2026-02-31",), ("2026-02-28T10:00",), ("2026-02-2",), (None,)], "s string")
    assert [r[0] for r in rows.select(S.article_date(F.col("s"))).collect()] == [None, "2026-02-28", None, None]
    links = spark.createDataFrame([("https://github.com/o/r/tree/main/d?x=1",), ("http://a/b",), ("https://u:p@a/b",)], "s string")
    got = [r[0] for r in links.select(S.parse_source_link(F.col("s"))).collect()]
    assert (got[0].kind, got[0].first, got[0].second) == ("tree", "o", "r") and got[1].kind is None and got[2].kind is None


def test_parameters():
    Params().validate()
    for wrong in ({"k_roots": 1}, {"knn": 17}, {"density": 1.5}, {"relevance_floor": 0.96}, {"max_wormholes": 5}):
        with pytest.raises(ValueError):
            Params(**wrong).validate()


def test_empty_vectors(spark):
    none = spark.createDataFrame([], R.FIELDS)
    assert R.knn(none, "leaf", 3).count() == R.cross_candidates(none, 0.5).count() == C.bounded_hierarchy(none.select("doc_id", "vector")).count() == 0


def test_chunks_of_many_rows(spark):
    """Ranks of a range sort of more rows than its sample holds."""
    rows = K.chunk_numbers(spark.range(0, 3_000_000, 1, 12).select(F.col("id").alias("doc_id")), "doc_id")
    assert rows.filter(F.col("chunk") != F.floor(F.col("doc_id") / 32)).count() == 0 and rows.count() == 3_000_000


def test_a_replayed_batch_keeps_its_documents(spark, tmp_path):
    import shutil

    from vecforest.operators import embed as E
    from vecforest.streaming import incremental as Inc

    at = f"file://{tmp_path}"
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 15).alias("text"))
    docs.write.parquet(f"{at}/in")
    spark.createDataFrame([], "row_key string, vector array<double>").write.parquet(f"{at}/cache/batch=none")
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(f"{at}/in")
        Inc.embed_stream(stream, f"{at}/cache", f"{at}/out", E.hashed_ngrams(), "cfg", f"{at}/state").awaitTermination()
        assert spark.read.parquet(f"{at}/out").filter("vector is not null").count() == 20
        shutil.rmtree(tmp_path / "state" / "commits")  # as if the run had ended before it could commit the batch


def test_a_large_json_graph_is_read_by_ranges(spark, tmp_path):
    """Every size of range gives what a JSON parser gives, whatever is in the texts."""
    from vecforest.sources import ranges as G

    rng = np.random.default_rng(1)
    odd = ['a "quoted" word', "back\\slash \\\\ end\\", "brackets ]}[{,:", "日本語 🙂", "", "\n\t", '\\"', "x" * 300]
    graph = {
        "meta": {"list": [1, [2, "]"]], "n": 3}, "roots": ["r1", "r2"],
        "nodes": [{"id": f"n{i}", "label": odd[i % 8], "pos": rng.normal(size=3).round(3).tolist(), "children": [{"x": [i]}] * (i % 3)} for i in range(60)],
        "empty": [], 'na"me ]': [[1, 2], [3]], "edges": [{"source": "n1", "target": f"n{i}", "score": i / 7} for i in range(40)], "schema": "v1",
    }
    for indent in (None, 1):
        text = json.dumps(graph, ensure_ascii=bool(indent), indent=indent)
        (tmp_path / f"g{indent}.json").write_text(text, encoding="utf-8")
        for size in (230, 1 << 20) if indent is None else (497,):
            got = {}
            for r in sorted(G.read_json_elements(spark, f"file://{tmp_path}/g{indent}.json", size).collect(), key=lambda r: r.offset):
                got.setdefault(r.list, []).append(json.loads(r.text))
            assert got == {k: v for k, v in graph.items() if isinstance(v, list) and v}
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = G.structure(raw, False, False)
    for cut in range(1, len(raw), 61):  # two parts in a row are as the whole
        one = G.structure(raw[:cut], False, False)
        n = len(raw[:cut].tobytes()) - len(raw[:cut].tobytes().rstrip(b"\\"))
        two = G.structure(raw[cut:], n % 2 == 1, one[2])
        assert (np.concatenate([one[1], two[1]]) == whole[1]).all()
    tables = G.read_graph_json(spark, f"{tmp_path}/gNone.json", {"nodes": "id string, label string, pos array<double>", "edges": "source string, target string, score double"}, 500)
    assert [(r.id, r.label, r.pos) for r in tables["nodes"].orderBy("offset").collect()] == [(n["id"], n["label"], n["pos"]) for n in graph["nodes"]]
    assert [r.score for r in tables["edges"].orderBy("offset").collect()] == [e["score"] for e in graph["edges"]]
    (tmp_path / "list.json").write_text('[1, "a,]", {"b": [2, 3]}]')
    assert [r.text for r in G.read_json_elements(spark, f"{tmp_path}/list.json", 6).orderBy("offset").collect()] == ["1", '"a,]"', '{"b": [2, 3]}']
    (tmp_path / "cut.json").write_text('{"a": [1, 2')
    with pytest.raises(ValueError, match="whole"):
        G.read_json_elements(spark, f"{tmp_path}/cut.json")


def test_npy_files_are_read_by_ranges(spark, tmp_path):
    from vecforest.sources import ranges as G

    x = np.random.default_rng(0).normal(size=(501, 6))
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "a.npy", x.astype("<f4"))
    np.save(tmp_path / "v" / "b.npy", np.asfortranarray(x))
    (tmp_path / "v" / "note.txt").write_text("no matrix")
    rows = G.read_npy(spark, f"file://{tmp_path}/v", 1500).withColumn("task", F.spark_partition_id()).collect()
    for name, kind in (("a", np.float32), ("b", np.float64)):
        mine = sorted((r.row, r.vector, r.task) for r in rows if r.path.endswith(f"{name}.npy"))
        assert len({t for *_, t in mine}) > 5 and [r for r, *_ in mine] == list(range(501))
        assert (np.array([v for _, v, _ in mine]) == x.astype(kind)).all()
    (tmp_path / "bad.npy").write_bytes((tmp_path / "v" / "a.npy").read_bytes()[:-4])
    with pytest.raises(Exception, match="length does not fit"):
        G.read_npy(spark, f"{tmp_path}/bad.npy").count()


def test_a_forest_in_one_job(spark, tmp_path):
    """Both ways: every document in one leaf and placed, the tree whole, edges right, the same forest again; then published and read back."""
    from vecforest.plans import forest as G

    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 12))[rng.integers(6, size=130)] + 0.25 * rng.normal(size=(130, 12))
    x[40:80] = x[40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = frame(spark, [(i, row, 0, 0) for i, row in enumerate(x.tolist())])
    for exact in (400, 1):
        params = Params(tau_in=0.8, tau_cross=0.3, relevance_floor=0.2, max_worm_length=1.5)
        made = G.build_forest(v, params, exact=exact)
        assert G.forest_violations(made).collect() == []
        nodes = {r.node: r for r in made["nodes"].collect()}
        paths = {r.doc_id: r.path for r in made["members"].collect()}
        places = {r.doc_id: r for r in made["places"].collect()}
        assert sorted(paths) == sorted(places) == list(range(130)) and all(nodes[p].kind == "leaf" for p in paths.values())
        assert sum(r.n for r in nodes.values() if r.kind == "root") == 130
        edges = made["edges"].collect()
        for e in edges:
            roots = {paths[e.src].split("/")[0], paths[e.dst].split("/")[0]}
            assert e.score == pytest.approx(x[e.src] @ x[e.dst], abs=1e-5) and len(roots) == (2 if e.type == "cross" else 1)
        if exact == 1:
            assert max(r.n for r in nodes.values() if r.kind == "leaf") <= 32 and {e.type for e in edges} == {"knn"}
            deep = next(p for p in sorted(paths.values(), key=lambda p: (-p.count("/"), p)))
            i = min(i for i, p in paths.items() if p == deep)
            home = nodes[deep.rpartition("/")[0]]
            state, jitter = int.from_bytes(b"", "big"), []
            state = 2166136261
            for c in str(i):
                state = ((state ^ ord(c)) * 16777619) % 2**32
            for _ in range(3):
                state = (state * 1664525 + 1013904223) % 2**32
                jitter.append(state / 2**32 - 0.5)
            want = np.array([home.x, home.y, home.z]) + (24 * C.seeded_planes(home.node, 3, 12) @ x[i] + 8 * np.array(jitter)) / (deep.count("/") + 1)
            assert np.allclose([places[i].x, places[i].y, places[i].z], want)
            branch = next(n for n in nodes.values() if n.kind == "branch" and not n.node.rpartition("/")[2].startswith("h"))
            below = x[[i for i, p in paths.items() if p.startswith(branch.node + "/")]].sum(0)
            up = nodes[branch.parent]
            assert np.allclose([branch.x - up.x, branch.y - up.y, branch.z - up.z], 225 * C.seeded_planes(branch.parent, 3, 12) @ (below / np.linalg.norm(below)) / 2**branch.depth)
        else:
            assert {e.type for e in edges} == {"knn", "cross"} and {p.placement for p in places.values()} >= {"cluster"}
    docs = spark.range(130).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    G.publish_forest(made, docs, f"file://{tmp_path}/out")
    assert [r.text for r in K.read_catalog(spark, f"file://{tmp_path}/out/catalogue", [77]).collect()] == ["text 77"]
    again = K.read_graph(spark, f"file://{tmp_path}/out/graph", ["nodes", "edges"])
    assert again["nodes"].count() == len(nodes) and again["edges"].count() == len(edges)


def test_links_of_sources(spark):
    links = {
        "https://github.com/a/b": ("github", "a", "b", None, "", "", None), "https://github.com/a/b.git/": ("github", "a", "b", None, "", "", None), "https://github.com/a/b/tree/main/x%20y/z?q#f": ("github", "a", "b", "tree", "main", "x y/z", None),
        "https://github.com/a/b/blob/v1/c+d.json": ("github", "a", "b", "blob", "v1", "c+d.json", None), "https://drive.google.com/drive/folders/1Yk-_?usp=x": ("drive", None, None, None, None, None, "1Yk-_"),
        "https://docs.google.com/open?x=1&id=9z": ("drive", None, None, None, None, None, "9z"), "https://github.com/a/b/blob/v1": None, "https://github.com/a/b/tree": None, "https://github.com/a/b/raw/v1/x": None, "http://github.com/a/b": None,
        "https://u:p@github.com/a/b": None, "https://github.com:8443/a/b": None, "https://github.com/a": None, "https://drive.google.com/file/d/": None, "https://example.com/a/b": None, "no link": None,
    }
    rows = spark.createDataFrame([(u,) for u in links], "url string").select("url", S.source_parts(F.col("url")).alias("p")).collect()
    assert {r.url: r.p and (r.p.kind, r.p.owner, r.p.repo, r.p.mode, r.p.ref, r.p.path, r.p.id) for r in rows} == links


def test_numbers_of_a_body_that_fills_a_file(spark):
    """Copies are numbered by one range sort, whose partitions all hold some of them."""
    from vecforest.operators import imports as I

    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "f").otherwise("g").alias("file"), F.col("id").alias("position"), F.when(F.col("id") % 10 > 0, "same").otherwise(F.col("id").cast("string")).alias("hash"))
    got = I.mark_duplicates(rows)
    hot = got.filter("hash = 'same'")
    assert hot.count() == 36_000 and hot.agg(F.min("copy"), F.max("copy"), F.count_distinct("copy")).first() == (1, 36_000, 36_000)
    assert hot.filter("copy <> position - floor(position / 10)").count() == 0 and got.filter("hash <> 'same' and copy <> 1").count() == 0
    one = I.dedupe_records(rows).filter("hash = 'same'").collect()
    assert len(one) == 1 and one[0].copies == 36_000 and one[0].position == 1


def test_cells_that_are_taken(spark):
    """One child after another, by name: a plain version of the spread, with crowds, single children and galaxies."""
    rng = np.random.default_rng(9)
    rows = [("s", f"n{i:03}", "planet", *map(float, p)) for i, p in enumerate(np.repeat(rng.normal(size=(60, 3)) * 10, 2, axis=0))] + [("one", "x", "planet", 5.0, 5.0, 5.0)]
    rows += [("crowd", f"c{i}", "planet", 1.0, 1.0, 1.0) for i in range(5)] + [("sky", f"g{i}", "galaxy", float(i), 0.0, 0.0) for i in range(4)] + [("alone", "g", "galaxy", 3.0, 1.0, 2.0)]
    got = {(r.scope, r.node): ([r.x, r.y, r.z], r.moved) for r in T.scene_layout(spark.createDataFrame(rows, "scope string, node string, role string, x double, y double, z double")).collect()}
    for scope in ("s", "one", "crowd", "sky", "alone"):
        mine = sorted(r for r in rows if r[0] == scope)
        p = np.array([r[3:] for r in mine]) - np.mean([r[3:] for r in mine], axis=0)
        reach, taken, n = max(1.0, np.linalg.norm(p, axis=1).max()), set(), len(mine)
        for i, r in enumerate(mine):
            state = 2166136261
            for c in r[1]:
                state = ((state ^ ord(c)) * 16777619) % 2**32
            around = lambda h, a, size: np.array([math.cos(a) * math.sqrt(1 - h * h) * size, h * size, math.sin(a) * math.sqrt(1 - h * h) * size])
            cell = lambda q: tuple(np.floor(q / 15 + 0.5))
            q = p[i] / reach * 65
            moved = cell(q) in taken or (n > 1 and reach <= 1)
            if moved:
                q = around((i + 0.5) / n * 2 - 1, state / 2**32 * 2 * math.pi, 58)
            taken.add(cell(q))
            if scope == "sky":
                q, moved = around(1 - 2 * (i + 0.5) / n, i * math.pi * (3 - math.sqrt(5)), 68), got[r[:2]][1]
            assert np.allclose(got[r[:2]][0], q, atol=1e-6) and got[r[:2]][1] == moved


def test_check_build_query_checks_the_true_bridges(spark, monkeypatch):
    from vecforest import queries as Q

    seen, real = [], Q.T.check_build
    monkeypatch.setattr(Q.T, "check_build", lambda nodes, members, edges, *rest: seen.append(edges) or real(nodes, members, edges, *rest))
    d = "/root/testdata/sf0.001"
    Q.check_build(spark, d)
    cross = {(r.src, r.dst) for r in seen[0].filter("type = 'cross'").collect()}
    links = {(r.i, r.j) for r in Q.cross_links(spark, d).collect()}
    assert links and links <= cross


def test_embedder_hashes_each_ngram_once(monkeypatch):
    import hashlib

    import pandas as pd

    from vecforest.operators import embed as E

    texts = ["the same words again and again " * 40] * 50 + [None, "", "a", "日本🙂語 the end"]
    hashed, real = [], hashlib.blake2b
    monkeypatch.setattr(E.hashlib, "blake2b", lambda b, **k: hashed.append(b) or real(b, **k))
    monkeypatch.setattr(E, "PIECE", 100)
    got = list(E.hashed_ngrams()([pd.Series(texts)]))[0].tolist()
    grams = [[t[i : i + 3] for i in range(max(1, len(t) - 2))] for t in (f" {t or ''} " for t in texts)]
    assert len(hashed) <= len({g for gs in grams for g in gs}) + 1
    for gs, v in zip(grams, got, strict=True):
        want = np.zeros(32)
        for g in gs:
            h = int.from_bytes(real(g.encode(), digest_size=8).digest(), "little")
            want[h % 32] += 1 if h >> 63 else -1
        want[0] = want[0] if want.any() else 1
        assert v == (want / np.linalg.norm(want)).tolist()


def test_linkage_from_vectors_and_in_rounds_is_the_one_by_one_linkage(large_groups, monkeypatch):
    x, label, v = large_groups
    rng = np.random.default_rng(3)
    y, n = rng.normal(size=(700, 6)), rng.integers(1, 5, 700)
    for m, w in ((y / np.linalg.norm(y, axis=1, keepdims=True), n), (x[:10], np.ones(10)), (x[:1], np.ones(1))):
        tree = lambda merges: {(round(s, 9), size) for _, _, s, size in merges}
        assert tree(C._chain(m, w)) == tree(C._merge(m @ m.T, w))
    key = lambda r: tuple(r)[:4] + (r["size"], round(r.score, 9))
    want = sorted(map(key, C.average_linkage(v, "root").collect()), key=str)
    for most, rest in ((12, 12), (12, 60), (60, 4096)):
        monkeypatch.setattr(C, "MATRIX", most)
        got = sorted(map(key, C.average_linkage(v, "root", most, rest).collect()), key=str)
        assert [g[:1] + g[4:] for g in got if g[0] == "1"] == [w[:1] + w[4:] for w in want if w[0] == "1"] and len(got) == len(want)
        parts = lambda *a: sorted(map(tuple, C.protected_groups(v, "root", 0.6, 3, *a).collect()))
        assert parts(most, rest) == parts(most, 12)


def test_linkage_of_1200_rows_needs_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 8))
    v = frame(spark, [(i, u.tolist(), 0, 0) for i, u in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))])
    monkeypatch.setattr(C, "_nearest", lambda *a: pytest.fail("a round on Spark"))
    assert C.average_linkage(v, "root").count() == 1199


@pytest.mark.parametrize("held", [1 << 26, 16 * 8 * 6 * 3])
def test_largest_difference_sends_a_row_to_few_groups(spark, monkeypatch, held):
    """40 blocks: a row went to as many others as there are blocks; now to one group after another, with the same result."""
    from vecforest.operators import embed as E

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 315, 6))
    y = x + 0.3 * y
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    met = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(315)], "doc_id long, x array<double>, y array<double>")
    sent, real = [], E._difference_meetings
    monkeypatch.setattr(E, "_difference_meetings", lambda *a: sent.append(real(*a)) or sent[-1])
    most, compared = E.largest_difference(met, 315, 8, held)
    d = np.abs(x @ x.T - y @ y.T)
    np.fill_diagonal(d, 0)
    error = np.sort(np.linalg.norm(x - y, axis=1))[::-1]
    own = max(d[np.ix_(b, b)].max() for b in np.split(np.argsort(-np.linalg.norm(x - y, axis=1)), range(8, 315, 8)))
    tops = error[::8]
    assert most == pytest.approx(d.max(), abs=1e-12)
    assert compared == 40 + sum(tops[i] + tops[j] > own for i in range(40) for j in range(i + 1, 40))
    groups = -(-40 // (4 if held > 1 << 20 else 3))
    assert 315 < sent[0].count() <= 315 * (groups + 1)
    same = met.withColumn("y", F.col("x"))
    assert E.largest_difference(same, 315, 8, held) == (0.0, 40)


def test_unit_of_vectors_without_direction(spark):
    from vecforest.functions.vectors import unit as unit_column

    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],)], "v array<double>")
    assert [r[0] for r in v.select(unit_column(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None]


def test_large_groups_merge_in_one_task_from_kept_lists(spark, monkeypatch):
    """6,000 rows of a group, more than the 4,096 that a task took before; few are compared with all others again, and the parts are those of rounds on Spark."""
    from vecforest.operators import linkage as K

    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 12)) + 2 * rng.normal(size=(40, 12))[rng.integers(40, size=6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = frame(spark, [(i, u, 0, 0) for i, u in enumerate(x.tolist())])
    want = sorted(map(tuple, C.protected_groups(v, "root", 0.8, 3, 400, 2000).collect()))
    with monkeypatch.context() as m:
        m.setattr(C, "_nearest", lambda *a: pytest.fail("a round on Spark"))
        assert sorted(map(tuple, C.protected_groups(v, "root", 0.8, 3).collect())) == want
    compared, real = [], K.nearest_lists
    monkeypatch.setattr(K, "nearest_lists", lambda y, nodes: compared.append(len(nodes)) or real(y, nodes))
    assert len(K.linkage(x, np.ones(6000))) == 5999
    assert compared[0] == 6000 and sum(compared) < 4 * 6000


@pytest.mark.parametrize("few", [0.0, 0.001, 0.5])
@pytest.mark.parametrize("rows", ["spread", "dense", "equal"])
def test_linkage_from_kept_lists_is_the_one_by_one_linkage(monkeypatch, few, rows):
    from vecforest.operators import linkage as K

    monkeypatch.setattr(K, "FEW", few)
    monkeypatch.setattr(K, "COLUMNS", 64)
    monkeypatch.setattr(K, "STRIP", 100)
    rng = np.random.default_rng(9)
    x, w = rng.normal(size=(500, 6)), rng.integers(1, 5, 500)
    if rows != "spread":
        x[50:300] = x[50] + (0.05 * rng.normal(size=(250, 6)) if rows == "dense" else 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def groups(merges):
        g, caps = [frozenset([i]) for i in range(500)], [9.0] * 500
        for a, b, score, size in merges:
            g.append(g[a] | g[b])
            caps.append(min(round(score, 9), caps[a], caps[b]))
            assert size == w[list(g[-1])].sum()
        return {(m, c) for m, c in zip(g[500:], caps[500:], strict=True)}

    want, got = groups(C._merge(x @ x.T, w)), groups(K.linkage(x, w))
    if rows == "equal":  # ties among equal rows leave their order open
        tied = set(range(50, 300))
        want, got = ({m for m in g if not m[0] <= tied} for g in (want, got))
    assert got == want
    assert groups(K.linkage(x, w, 0.7)) == {m for m in groups(K.linkage(x, w)) if m[1] >= 0.7}
    # Small nodes join the most similar one, the smallest first.
    parts = K.Linkage(x, w, None)
    parts.absorb(4)
    mean, n, of = x.copy(), w.astype(float), np.arange(500)
    while n.min() < 4:
        i = int(n.argmin())
        s = np.round(mean @ mean[i], 12)
        s[i] = s[np.isinf(n)] = -np.inf
        a, b = sorted((i, int(s.argmax())))
        mean[a], n[a] = (mean[a] * n[a] + mean[b] * n[b]) / (n[a] + n[b]), n[a] + n[b]
        n[b], of[of == b] = np.inf, a
    assert (parts.roots(np.arange(500)) == of).all()


def test_topic_tree_makes_the_parts_once(large_groups, monkeypatch):
    from vecforest.operators import topics

    v, real = large_groups[2], topics.protected_groups
    times = v.sparkSession.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(part):
        times.add(1)
        return part

    monkeypatch.setattr(topics, "protected_groups", lambda *a: real(*a).withColumn("part", seen("part")))
    members, _ = topics.topic_tree(v, "root", 0.6, 3, 7, 12)
    assert members.count() == 158 and times.value == 158


def test_first_comparison_of_a_large_group_is_dealt_to_tasks(large_groups, monkeypatch):
    from vecforest.operators import linkage as K

    x, label, v = large_groups
    key = lambda r: tuple(r)[:4] + (r["size"], round(r.score, 9))
    monkeypatch.setattr(C, "MATRIX", 12)
    links, parts = sorted(map(key, C.average_linkage(v, "root", 12).collect()), key=str), sorted(map(tuple, C.protected_groups(v, "root", 0.6, 3, 12).collect()))
    nodes = v.select(F.col("root").alias("g"), F.col("doc_id").alias("at"), "vector", (F.col("doc_id") == 3).alias("closed"))
    assert C._with_lists(nodes).filter("kept is not null").count() == 0
    for name, value in (("MANY", 50), ("DEALT", 20), ("ROWS", 7), ("FIRST", 30)):
        monkeypatch.setattr(C, name, value)
    found = {r["at"]: r for r in C._with_lists(nodes).collect()}
    assert len(found) == 158 and found[3].kept is None and found[157].kept is None
    for i in range(150):
        if i != 3:
            near = [j for j in range(158) if label[j] == label[i] and j not in (3, i)]
            s = np.sort(x[near] @ x[i])[::-1]
            assert len(set(found[i].kept)) == K.KEPT and set(found[i].kept) <= set(near)
            assert x[found[i].kept] @ x[i] == pytest.approx(s[: K.KEPT], abs=1e-6) and found[i].bound == pytest.approx(s[K.KEPT - 1], abs=1e-6)
    assert sorted(map(key, C.average_linkage(v, "root", 12).collect()), key=str) == links
    assert sorted(map(tuple, C.protected_groups(v, "root", 0.6, 3, 12).collect())) == parts
