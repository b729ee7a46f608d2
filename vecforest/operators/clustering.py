"""Groups of vectors: centroids, themes, cells, k-means, linkage and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from vecforest.functions.scalars import fnv1a32, short_label
from vecforest.functions.vectors import dot, unit
from vecforest.operators.linkage import FIRST, KEPT, Kept, Linkage
from vecforest.operators.linkage import STRIP as ROWS
from vecforest.operators.linkage import linkage as _chain
from vecforest.operators.stats import ranks
from vecforest.sources.tables import materialize

LEAF, BRANCHES, DEPTH = 32, 8, 5


def majority(df: DataFrame, group: str, col: str, fallback: str) -> DataFrame:
    """Most frequent value of each group, nulls and blanks aside; ties go to the smallest value."""
    counts = df.filter(F.coalesce(F.trim(F.col(col)), F.lit("")) != "").groupBy(group, col).count()
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("count"), col))).filter("rank = 1")
    return df.select(group).distinct().join(top.select(group, F.col(col).alias("value")), group, "left").fillna(fallback, ["value"])


def vector_sums(vecs: DataFrame, *keys: str) -> DataFrame:
    """(keys, sum array<double>, n): component sums. Each batch of rows sends one sum for each of its keys, whose components are then added up, before the shuffle once more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch["vector"].flatten().to_numpy().reshape(len(batch), -1)
                which = pa.Table.from_batches([batch]).select(list(keys)).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
                sums = np.zeros((which.max() + 1, x.shape[1]))
                np.add.at(sums, which, x)
                first = pa.array(np.unique(which, return_index=True)[1])
                yield pa.record_batch([*(batch[k].take(first) for k in keys), pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(which))], [*keys, "sum", "n"])

    fields = [*(vecs.schema[k] for k in keys), T.StructField("sum", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
    parts = vecs.select(*keys, "vector").mapInArrow(partial, T.StructType(fields))
    each = parts.select(*keys, "n", F.posexplode("sum").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"), F.max("n").alias("n"))


def centroids(vecs: DataFrame, key: str) -> DataFrame:
    """(key, centroid, n): the sum of the members at length 1; where it vanishes, the member with the smallest id."""
    sums = vector_sums(vecs, key)
    first = vecs.groupBy(key).agg(F.min_by("vector", "doc_id").alias("first"))
    return sums.join(first, key).select(key, F.when(dot(F.col("sum"), F.col("sum")) < 1e-20, F.col("first")).otherwise(unit(F.col("sum"))).alias("centroid"), "n")


def assign_themes(vecs: DataFrame, themes: DataFrame) -> DataFrame:
    """(doc_id, theme, score): the most similar of the themes (theme, centroid), of any number; ties go to the smallest. One matrix product for each batch of rows."""
    from vecforest.operators.layout import anchor_candidates

    anchors = themes.select(F.col("theme").alias("leaf"), "centroid", *[F.lit(0.0).alias(c) for c in "xyz"])
    best = F.col("candidates")[0]
    return anchor_candidates(vecs, anchors, None, None).select("doc_id", best["leaf"].alias("theme"), best["score"].alias("score"))


def representatives(vecs: DataFrame, cents: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, score): the member closest to its centroid; ties go to the smallest id."""
    scored = vecs.join(cents.select(key, "centroid"), key).select(key, "doc_id", F.round(dot(F.col("vector"), F.col("centroid")), 6).alias("score"))
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b")).select(key, "b.doc_id", (-F.col("b.s")).alias("score"))


def name_topics(vecs: DataFrame, docs: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """(key, doc_id, label): the short title of each topic's representative."""
    reps = representatives(vecs, centroids(vecs, key), key)
    return reps.join(docs.select("doc_id", "title"), "doc_id").select(key, "doc_id", F.concat(F.lit(prefix), short_label(F.col("title"))).alias("label"))


def seeded_planes(path: str, count: int, dims: int) -> np.ndarray:
    """Unit normals that depend on the path alone."""
    seed = 2166136261
    for c in path:
        seed = ((seed ^ ord(c)) * 16777619) & 0xFFFFFFFF
    out = np.empty((count, dims))
    for r in range(count):
        for d in range(dims):
            seed = (seed * 1664525 + 1013904223) % 2**32
            out[r, d] = seed / 2**32 - 0.5
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def cells(vecs: DataFrame, path: str = "path", planes: int = 3) -> DataFrame:
    """Adds the cell of each vector among the planes of its path: one bit for each plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["vector"]
            out = np.zeros(len(batch), np.int32)
            if len(batch):
                x = v.flatten().to_numpy().reshape(len(batch), -1)
                coded = batch[path].dictionary_encode()
                which = coded.indices.to_numpy()
                for i, p in enumerate(coded.dictionary.to_pylist()):
                    at = np.flatnonzero(which == i)
                    side = np.round(x[at] @ seeded_planes(p, planes, x.shape[1]).T, 12) >= 0
                    out[at] = side @ (1 << np.arange(planes))
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    schema = T.StructType([*vecs.schema.fields, T.StructField("cell", T.IntegerType())])
    return vecs.mapInArrow(run, schema)


def round_robin(rows: DataFrame, group: str, order: str, cells: int = BRANCHES) -> DataFrame:
    """Adds `cell`: each row's rank within its group modulo `cells`, by one range sort for all groups. Rows carry no column g."""
    dealt = ranks(rows.withColumn("g", F.col(group)), [order], "_rank")
    return dealt.withColumn("cell", F.pmod("_rank", F.lit(cells)).cast("int")).drop("g", "_rank")


def theme_roots(vecs: DataFrame, themes: DataFrame | None = None, most: int = 32) -> DataFrame:
    """(doc_id, root): the most similar theme (theme, centroid); without themes, or with more than `most`, the cell of three fixed planes."""
    if themes is not None and 0 < themes.count() <= most:
        return assign_themes(vecs, themes).select("doc_id", F.concat(F.lit("nebula:"), "theme").alias("root"))
    fixed = vecs.select("doc_id", "vector", F.lit("nebulae").alias("path"))
    return cells(fixed).select("doc_id", F.concat(F.lit("nebula:"), F.col("cell").cast("string")).alias("root"))


def bounded_hierarchy(vecs: DataFrame, leaf: int = LEAF, depth: int = DEPTH, roots: DataFrame | None = None) -> DataFrame:
    """(doc_id, path): a leaf path for each vector; leaves hold at most `leaf` documents, branches at most eight children.

    The paths start from one root, or from the roots (doc_id, root) of theme_roots(). A
    cell with more members is cut by three planes that its path seeds. Where that gives
    one cell, or below `depth` levels, members are dealt by a hash of path and id, and
    where that fails too, round-robin by id, which always ends; such cells have an h
    before their number.
    """
    start = vecs.select("doc_id", "vector", F.lit("r").alias("path")) if roots is None else vecs.select("doc_id", "vector").join(roots.select("doc_id", F.col("root").alias("path")), "doc_id")
    open_rows = materialize(start.withColumn("how", F.lit("plane")))
    done = None
    level = 0
    while True:
        sizes = open_rows.groupBy("path").agg(F.count("*").alias("n"))
        marked = open_rows.join(sizes, "path")
        ended = marked.filter(F.col("n") <= leaf).select("doc_id", F.concat("path", F.lit("/system")).alias("path"))
        done = ended if done is None else done.unionByName(ended)
        large = marked.filter(F.col("n") > leaf).drop("n")
        if large.isEmpty():
            return done
        level += 1
        how = F.when((F.lit(level) > depth) & (F.col("how") == "plane"), "hash").otherwise(F.col("how"))
        large = large.withColumn("how", how)
        hashed = F.pmod(F.xxhash64("path", "doc_id"), F.lit(BRANCHES)).cast("int")
        dealt = cells(large.filter("how <> 'round'")).withColumn("cell", F.when(F.col("how") == "plane", F.col("cell")).otherwise(hashed))
        last = large.filter("how = 'round'")
        if not last.isEmpty():
            dealt = dealt.unionByName(round_robin(last, "path", "doc_id").select(*dealt.columns))
        dealt = materialize(dealt)
        used = dealt.groupBy("path").agg(F.count_distinct("cell").alias("used"))
        after = dealt.join(used, "path")
        next_how = F.when(F.col("used") > 1, F.col("how")).when(F.col("how") == "plane", "hash").otherwise("round")
        shard = F.when(F.col("how") == "plane", "").otherwise("h")  # a cell that says nothing on what its members are like
        next_path = F.when(F.col("used") > 1, F.concat("path", F.lit("/"), shard, F.col("cell").cast("string"))).otherwise(F.col("path"))
        open_rows = materialize(after.select("doc_id", "vector", next_path.alias("path"), next_how.alias("how")))


def identity_shard(path, doc_id):
    """The shard of a document in a degenerate cell, by FNV-1a of path and id."""
    return F.pmod(fnv1a32(F.concat(path, F.lit("|"), doc_id.cast("string"))), F.lit(BRANCHES))


def spherical_k_means(vecs: DataFrame, k: int, rounds: int = 30) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, cluster) and the centres. Per round one pass sends k partial sums a batch; vectors never move.

    The first centre is the row with the smallest id, each further one the row that
    is least like the centres so far (ties: smallest id). An empty cluster takes the
    row that is farthest from its own centre. The labels are those of the last round,
    where none changed any more or `rounds` were made.
    """
    rows = vecs.select("doc_id", "vector")
    n = rows.count()
    k = min(k, n)
    if not k:
        return vecs.sparkSession.createDataFrame([], "doc_id long, cluster int"), np.zeros((0, 0))
    centres = np.array([rows.orderBy("doc_id").first().vector])

    def scan(c: np.ndarray, schema: str, f) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = batch["vector"].flatten().to_numpy().reshape(len(batch), -1)
                    yield f(batch["doc_id"].to_numpy(), x, np.round(x @ c.T, 9))

        return rows.mapInArrow(run, schema)

    def farthest(ids, x, s):
        own = s.max(1)
        at = np.lexsort((ids, own))[: k + 1]
        return pa.record_batch([pa.array(own[at]), pa.array(ids[at]), pa.array(x[at].tolist())], ["own", "id", "x"])

    def partial(ids, x, s):
        at = s.argmax(1)
        sums = np.zeros((s.shape[1], x.shape[1]))
        np.add.at(sums, at, x)
        return pa.record_batch([pa.array(range(len(sums))), pa.array(sums.tolist()), pa.array(np.bincount(at, minlength=len(sums)))], ["cluster", "sum", "n"])

    while len(centres) < k:
        best = scan(centres, "own double, id long, x array<double>", farthest).orderBy("own", "id").first()
        centres = np.vstack([centres, best.x])
    for _ in range(rounds - 1):
        out = scan(centres, "cluster long, sum array<double>, n long", partial)
        summed = out.select("cluster", "n", F.posexplode("sum").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        sums, count = np.zeros_like(centres), np.zeros(len(centres))
        for r in summed.collect():  # k times the dimension
            sums[r.cluster, r.pos], count[r.cluster] = r.x, r.n
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(size > 1e-10, sums / np.maximum(size, 1e-10), centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = scan(centres, "own double, id long, x array<double>", farthest).orderBy("own", "id").limit(len(empty)).collect()
            for e, r in zip(empty, far, strict=False):
                moved[e] = r.x
        if np.allclose(moved, centres, atol=1e-12, rtol=0):
            break
        centres = moved

    def label(ids, x, s):
        return pa.record_batch([pa.array(ids), pa.array(s.argmax(1).astype(np.int32))], ["doc_id", "cluster"])

    return scan(centres, "doc_id long, cluster int", label), centres


#: Nodes of a group whose matrix of similarities a task holds, bytes of vectors of the nodes that it holds beyond that, such nodes at least, nodes of a group above which many tasks compare them, nodes that one of these compares with all, and rows that are compared at once.
MATRIX, HELD, LEAST, MANY, DEALT, STRIP = 400, 1 << 27, 4096, 1 << 16, 8192, 512


def _merge(score: np.ndarray, weight: np.ndarray, stop: int = 1) -> list[tuple[int, int, float, int]]:
    """Repeated merges of the two groups with the best mean similarity; ties go to the first pair. New groups are numbered on."""
    n = len(score)
    s = score.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    name, w, alive, out = list(range(n)), weight.astype(float).copy(), np.ones(n, bool), []
    for step in range(n - stop):
        live = np.flatnonzero(alive)
        sub = np.round(s[np.ix_(live, live)], 12)
        a, b = divmod(int(sub.argmax()), len(live))
        a, b = live[min(a, b)], live[max(a, b)]
        out.append((name[a], name[b], float(s[a, b]), int(w[a] + w[b])))
        s[a] = s[:, a] = (s[a] * w[a] + s[b] * w[b]) / (w[a] + w[b])
        s[a, a] = -np.inf
        s[b] = s[:, b] = -np.inf
        w[a] += w[b]
        alive[b], name[a] = False, n + step
    return out


def _linked(mean: np.ndarray, weight: np.ndarray, tau: float | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, float, int]]:
    """All merges; with tau at least those that reach it."""
    return _merge(mean @ mean.T, weight) if len(mean) <= MATRIX else _chain(mean, weight, tau, known)


def _with_lists(nodes: DataFrame) -> DataFrame:
    """Adds to the nodes (g, at, vector, closed) of groups with over MANY nodes that can merge the `at` of their nearest (-1: none) and a bound for the others, for linkage(). All other nodes have nulls.

    The first comparison of all nodes is most of the work of a linkage. A task holds a part of
    a group, DEALT nodes or a thirty-second, and reads the whole group as it comes, in single precision.
    """
    live = nodes.filter("not closed")
    sizes = materialize(live.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("g", F.least(F.lit(32), F.ceil(F.col("n") / DEALT)).cast("int").alias("parts")))
    if sizes.isEmpty():
        return nodes.withColumns({"kept": F.lit(None).cast("array<long>"), "bound": F.lit(None).cast("double")})
    rows = live.join(F.broadcast(sizes), "g").select("g", "at", F.col("vector").cast("array<float>").alias("y"), F.pmod(F.xxhash64("at"), "parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ids, y, strips = None, [], None, None, []

        def show(other: np.ndarray, z: np.ndarray) -> None:
            order = np.argsort(other)
            other, z = other[order], z[order]
            for s in range(0, len(ids), ROWS):
                mine = ids[s : s + ROWS]
                for start, end in ((0, FIRST), (FIRST, len(other))):
                    some = other[start:end]
                    if len(some):
                        d = y[s : s + ROWS] @ z[start:end].T
                        place = np.minimum(np.searchsorted(some, mine), len(some) - 1)
                        same = np.flatnonzero(some[place] == mine)
                        d[same, place[same]] = -np.inf
                        strips[s // ROWS].add(d, some)

        def begin() -> None:
            nonlocal ids, y, strips
            ids, y = (np.concatenate(c) for c in zip(*held, strict=True))
            strips = [Kept(len(ids[s : s + ROWS])) for s in range(0, len(ids), ROWS)]
            for other, z in held:
                show(other, z)
            held.clear()

        def found() -> pa.RecordBatch:
            lists = np.concatenate([k.lists(-1) for k in strips])
            return pa.record_batch([pa.array([group[0]] * len(ids)), pa.array(ids), pa.array(list(lists), pa.list_(pa.int64())), pa.array(np.concatenate([k.bound for k in strips]))], ["g", "at", "kept", "bound"])

        for batch in batches:
            g, i, kind = np.array(batch["g"].to_pylist() + [None], object)[:-1], batch["i"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (kind[1:] != kind[:-1]))) if len(g) else np.zeros(0, int)
            for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(g)], strict=False):
                if group != (g[start], i[start]):
                    if held:
                        begin()
                    if group is not None and strips:
                        yield found()
                    group, strips = (g[start], i[start]), []
                t = batch.slice(start, end - start)
                some = t["at"].to_numpy(), t["y"].flatten().to_numpy().reshape(len(t), -1)
                if kind[start] == 1:
                    held.append(some)
                    continue
                if held:
                    begin()
                if strips:
                    show(*some)
        if held:
            begin()
        if strips:
            yield found()

    rows = rows.withColumn("kind", F.when(F.col("own") == F.col("i"), 1).otherwise(2)).select("g", "i", "kind", "at", "y")
    lists = rows.repartition("g", "i").sortWithinPartitions("g", "i", "kind").mapInArrow(search, "g string, at long, kept array<long>, bound double")
    return nodes.join(lists, ["g", "at"], "left")


def _known(t: pa.Table, which: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What _with_lists() found for the nodes at these places of the table, in the order of at."""
    if not len(which) or not t["bound"][int(which[0])].is_valid:
        return None
    rows = pa.array(which)
    at, kept = t["at"].to_numpy()[which], t["kept"].take(rows).combine_chunks().flatten().to_numpy().reshape(len(which), KEPT)
    return np.where(kept < 0, len(at), np.searchsorted(at, kept)), t["bound"].to_numpy()[which]


def _rest(vecs: DataFrame, rest: int | None) -> int:
    """How many nodes of a group a task may hold: as many as have HELD bytes of vectors, if `rest` does not say."""
    if rest is None:
        first = vecs.select(F.size("vector")).first()
        rest = max(LEAST, HELD // (8 * max(1, first[0]))) if first else LEAST
    return rest


def _in_order(t: pa.Table) -> tuple[np.ndarray, ...]:
    """at, vectors and n of nodes, and their places in the table, in the order of at."""
    at = t["at"].to_numpy()
    order = np.argsort(at)
    return at[order], t["vector"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)[order], t["n"].to_numpy()[order].astype(float), order


def _nearest(nodes: DataFrame, block: int = 8192) -> DataFrame:
    """(src, dst, score): the node of the same group g with the best mean similarity; ties go to the smallest. Two blocks of nodes meet in a task."""
    from vecforest.operators.relations import _blocks, _matrix

    def best(t: pa.Table) -> pa.Table:
        ids, own, x = t["doc_id"].to_numpy(), t["own"].to_numpy(), _matrix(t)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        out = []
        for a, b in {(i, j), (j, i)}:
            rows, cols = np.flatnonzero(own == a), np.flatnonzero(own == b)
            cols = cols[np.argsort(ids[cols])]
            y = x[cols].T
            for s in range(0, len(rows) if len(cols) else 0, STRIP):
                some = rows[s : s + STRIP]
                score = np.round(x[some] @ y, 12)
                score[ids[some][:, None] == ids[cols][None]] = -np.inf
                at = score.argmax(1)
                out.append((ids[some], ids[cols][at], score[np.arange(len(some)), at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["src", "dst", "score"])

    found = _blocks(nodes.select(F.col("at").alias("doc_id"), "vector", "g"), "g", block).select("g", "i", "j", "own", "doc_id", "vector").groupBy("g", "i", "j").applyInArrow(best, "src long, dst long, score double")
    first = F.min(F.struct((-F.col("score")).alias("s"), "dst")).alias("b")
    return found.filter(F.col("score") > float("-inf")).groupBy("src").agg(first).select("src", "b.dst", (-F.col("b.s")).alias("score"))


MERGES = "g string, round int, at long, sub int, name string, left string, right string, score double, size long, cap double"


def _equal_first(rows: DataFrame, tau: float | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """The start of _merge_rounds() for rows (g, doc_id, vector): equal vectors, of length 1, merge first. Nodes, merges, and with tau the members of nodes."""
    own = dot(F.col("vector"), F.col("vector"))
    alone = F.lit(None).cast("long") if tau is None else F.when(own < tau, F.col("doc_id"))
    keyed = rows.select("g", "doc_id", "vector", alone.alias("alone"))
    w = W.partitionBy("g", "vector", "alone")
    keyed = materialize(keyed.withColumns({"at": F.min("doc_id").over(w), "k": F.row_number().over(w.orderBy("doc_id"))}))
    name = lambda k: F.when(k == 1, F.concat(F.lit("d:"), "at")).otherwise(F.concat(F.lit("0:"), "at", F.lit(":"), k))
    k = F.col("k")
    cap = F.round(own, 12)
    merges = [keyed.filter("k > 1").select("g", F.lit(0).alias("round"), "at", k.alias("sub"), name(k).alias("name"), name(k - 1).alias("left"), F.concat(F.lit("d:"), "doc_id").alias("right"), own.alias("score"), k.cast("long").alias("size"), cap.alias("cap"))]
    members = None if tau is None else keyed.select("doc_id", "g", "at")
    last = keyed.groupBy("g", "at").agg(F.max("k").alias("k"), F.max(F.when(k == 1, F.col("vector"))).alias("vector"))
    nodes = materialize(last.select("g", "at", name(k).alias("name"), "vector", k.cast("long").alias("n"), F.when(k > 1, cap).otherwise(float("inf")).alias("cap"), F.lit(False).alias("closed")))
    return nodes, merges, members


def _merge_rounds(nodes: DataFrame, merges: list[DataFrame], most: int, tau: float | None = None, members: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Average linkage of the nodes (g, at, name, vector, n, cap, closed) of large groups until `most` nodes of each are left that can merge: nodes, merges, and the members of nodes. `at` is unique over all groups.

    Two nodes that are each other's nearest merge in the same round in all places, as
    no other merge can come between them: a mean similarity to a merged node is never
    above the better one to its halves. So the merges are those of the one-by-one
    linkage. With tau, nodes whose nearest is below it are closed.
    """
    done = None
    step = 0
    while True:
        sizes = nodes.groupBy("g").agg(F.count_if(~F.col("closed")).alias("live"))
        marked = nodes.join(sizes, "g")
        ended = marked.filter((F.col("live") <= most) | F.col("closed")).drop("live")
        done = ended if done is None else done.unionByName(ended)
        live = marked.filter((F.col("live") > most) & ~F.col("closed")).drop("live")
        if live.isEmpty():
            return done, merges, members
        step += 1
        near = materialize(_nearest(live))
        other = near.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        pairs = near.filter("src < dst").join(other, ["src", "dst"])
        if tau is not None:
            pairs = pairs.filter(F.col("score") >= tau)
        ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("src").alias("pair"), F.lit(0).alias("side"), F.col("score")), F.struct(F.col("dst").alias("at"), F.col("src").alias("pair"), F.lit(1).alias("side"), F.col("score")))).alias("e")).select("e.*")
        found = materialize(live.join(ends, "at", "left").join(near.select(F.col("src").alias("at"), F.col("score").alias("best")), "at", "left"))
        side = lambda i: F.max(F.when(F.col("side") == i, F.struct("name", "vector", "n", "cap"))).alias(f"s{i}")
        both = found.filter("pair IS NOT NULL").groupBy("g", "pair").agg(side(0), side(1), F.max("score").alias("score"))
        size = F.col("s0.n") + F.col("s1.n")
        mean = F.zip_with("s0.vector", "s1.vector", lambda a, b: (a * F.col("s0.n") + b * F.col("s1.n")) / (F.col("s0.n") + F.col("s1.n")))
        joined = materialize(both.select("g", F.lit(step).alias("round"), F.col("pair").alias("at"), F.lit(0).alias("sub"), F.concat(F.lit(f"{step}:"), "pair").alias("name"), F.col("s0.name").alias("left"), F.col("s1.name").alias("right"), "score", size.alias("size"), F.least("score", "s0.cap", "s1.cap").alias("cap"), mean.alias("vector")))
        merges.append(joined.drop("vector"))
        closed = F.lit(False) if tau is None else F.col("best") < tau
        nodes = joined.select("g", "at", "name", "vector", F.col("size").alias("n"), "cap", F.lit(False).alias("closed")).unionByName(found.filter("pair IS NULL").select("g", "at", "name", "vector", "n", "cap", closed.alias("closed")))
        nodes = materialize(nodes)
        if members is not None:
            to = ends.select("at", "pair")
            members = materialize(members.join(to, "at", "left").select("doc_id", "g", F.coalesce("pair", "at").alias("at")))


def _by_size(vecs: DataFrame, group: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (g, doc_id, vector) of groups up to `most` rows, and of larger ones. g is never null, so that a null group meets itself in joins; _group_of() gives the group."""
    rows = vecs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), "doc_id", "vector")
    sized = rows.join(rows.groupBy("g").agg(F.count("*").alias("_n")), "g")
    return sized.filter(F.col("_n") <= most).drop("_n"), sized.filter(F.col("_n") > most).drop("_n")


def _group_of(group: str):
    return F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias(group)


LINKED = "step int, left int, right int, score double, size int"


def _link_rest(t: pa.Table) -> pa.Table:
    """The last merges of a group, whose remaining nodes fit in a task."""
    _, x, n, order = _in_order(t)
    names, caps = t["name"].take(pa.array(order)).to_pylist(), t["cap"].to_numpy()[order].tolist()
    out = {c: [] for c in ("sub", "name", "left", "right", "score", "size", "cap")}
    for i, (a, b, score, size) in enumerate(_linked(x, n, None, _known(t, order))):
        caps.append(min(round(score, 12), caps[a], caps[b]))
        for c, v in zip(out, (i, f"last:{i}", names[a], names[b], score, size, caps[-1]), strict=True):
            out[c].append(v)
        names.append(f"last:{i}")
    m = len(out["sub"])
    columns = {"g": [t["g"][0].as_py()] * m, "round": [1 << 30] * m, "at": [0] * m} | out
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.table({c: pa.array(columns[c], kinds[k]) for c, k in (f.split() for f in MERGES.split(", "))})


def _numbered(nodes: DataFrame, merges: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(g, step, left, right, score, size): the merges in the order of the one-by-one linkage, with leaves (g, name, number) numbered from 0 and merges numbered on."""
    every = _with_lists(nodes.select("g", "at", "name", "vector", "n", "cap", "closed")).groupBy("g").applyInArrow(_link_rest, MERGES)
    for m in merges:
        every = every.unionByName(m)
    every = materialize(ranks(every, [F.desc("cap"), "round", "at", "sub"], "step"))
    rows = leaves.groupBy("g").agg(F.count("*").alias("rows"))
    number = materialize(leaves.select("g", "name", "number").unionByName(every.join(rows, "g").select("g", "name", (F.col("rows") + F.col("step")).alias("number"))))
    for c in ("left", "right"):
        every = every.join(number.select("g", F.col("name").alias(c), F.col("number").alias(f"{c}_number")), ["g", c])
    return every.select("g", F.col("step").cast("int").alias("step"), *[F.col(f"{c}_number").cast("int").alias(c) for c in ("left", "right")], "score", F.col("size").cast("int").alias("size"))


def average_linkage(vecs: DataFrame, group: str, most: int = 400, rest: int | None = None) -> DataFrame:
    """(group, step, left, right, score, size): average linkage within each group, of any size. A task holds the matrix of at most `most` nodes or the vectors of `rest` (by default of HELD bytes); larger groups are merged in rounds on Spark until no more are left."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.stack(pdf["vector"].to_numpy())
        rows = _merge(x @ x.T, np.ones(len(x)))
        return pd.DataFrame([(pdf["g"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["g", "step", "left", "right", "score", "size"])

    small, large = _by_size(vecs, group, most)
    every = small.groupBy("g").applyInPandas(link, f"g string, {LINKED}")
    if not large.isEmpty():
        start, merges, _ = _equal_first(large)
        nodes, merges, _ = _merge_rounds(start, merges, _rest(vecs, rest))
        leaves = ranks(large.select("g", "doc_id"), ["doc_id"], "number").select("g", F.concat(F.lit("d:"), "doc_id").alias("name"), "number")
        every = every.unionByName(_numbered(nodes, merges, leaves))
    return every.select(_group_of(group), "step", "left", "right", "score", "size")


def protected_groups(vecs: DataFrame, group: str, tau: float, least: int, most: int = 400, rest: int | None = None) -> DataFrame:
    """(group, doc_id, part): parts of each group whose merges reach tau; parts under `least` members join the most similar part.

    In groups over `most` rows equal ones merge first; where over `rest` nodes are left (by default those of HELD bytes of vectors), they merge in rounds on Spark, and one mean for each of their parts reaches a task.
    """

    def cut(t: pa.Table) -> pa.Table:
        at, mean, n, order = _in_order(t)
        into = np.arange(len(at))

        def join(a: int, b: int) -> int:
            a, b = min(a, b), max(a, b)
            mean[a] = (mean[a] * n[a] + mean[b] * n[b]) / (n[a] + n[b])
            n[a] += n[b]
            into[b] = a
            return a

        live = np.flatnonzero(~np.array(t["closed"])[order].astype(bool))
        place = live.tolist()
        for a, b, score, _ in _linked(mean[live], n[live], tau, _known(t, order[live])) if len(live) else ():
            place.append(join(place[a], place[b]) if round(score, 12) >= tau and place[a] >= 0 and place[b] >= 0 else -1)
        while not np.array_equal(into[into], into):
            into = into[into]
        first, part = np.unique(into, return_inverse=True)
        parts = Linkage(mean[first], n[first], None)
        parts.absorb(least)
        part = np.unique(parts.roots(np.arange(len(first))), return_inverse=True)[1][part]
        return pa.table([t["g"], pa.array(at), pa.array(part.astype(np.int32))], ["g", "at", "part"])

    small, large = _by_size(vecs, group, most)
    nodes = small.select("g", F.col("doc_id").alias("at"), "vector", F.lit(1).cast("long").alias("n"), F.lit(False).alias("closed"))
    members = small.select("doc_id", "g", F.col("doc_id").alias("at"))
    if not large.isEmpty():
        start, merges, of = _equal_first(large, tau)
        merged, _, of = _merge_rounds(start, merges, _rest(vecs, rest), tau, of)
        nodes, members = nodes.unionByName(merged.select("g", "at", "vector", "n", "closed")), members.unionByName(of)
    parts = _with_lists(nodes).groupBy("g").applyInArrow(cut, "g string, at long, part int")
    return members.join(parts, ["g", "at"]).select(_group_of(group), "doc_id", "part")


def numbered_parts(vecs: DataFrame, group: str, part: str) -> DataFrame:
    """(g, part, number, at, vector, n): the parts of each group with their mean vectors, numbered from 0 in their order; `at` is unique over all groups."""
    means = vector_sums(vecs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(part).alias("part"), "vector"), "g", "part")
    means = means.select("g", "part", F.transform("sum", lambda x: x / F.col("n")).alias("vector"), "n")
    means = ranks(means, ["part"], "number")
    before = F.sum("m").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1))  # one row for each group
    sizes = means.groupBy("g").agg(F.count("*").alias("m"))
    return materialize(means.join(sizes.select("g", F.coalesce(before, F.lit(0)).alias("before")), "g").withColumn("at", F.col("before") + F.col("number")).drop("before"))


def part_linkage(parts: DataFrame, most: int = 400, rest: int | None = None) -> DataFrame:
    """(g, step, left, right, score, size): linkage of numbered_parts(), where a score is the mean over all cross pairs of members.

    The mean of all cross pairs is the product of the parts' mean vectors, so that one
    mean for each part is enough. Groups over `rest` parts (by default those of HELD bytes of vectors) are merged in rounds on Spark.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        x = np.stack(pdf["vector"].to_numpy())
        rows = _merge(x @ x.T, pdf["n"].to_numpy())
        return pd.DataFrame([(pdf["g"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["g", "step", "left", "right", "score", "size"])

    sized = parts.join(parts.groupBy("g").agg(F.count("*").alias("_m")), "g")
    small, large = sized.filter(F.col("_m") <= most), sized.filter(F.col("_m") > most)
    every = small.groupBy("g").applyInPandas(link, f"g string, {LINKED}")
    if large.isEmpty():
        return every
    leaf = F.concat(F.lit("d:"), "at").alias("name")
    start = large.select("g", "at", leaf, "vector", "n", F.lit(float("inf")).alias("cap"), F.lit(False).alias("closed"))
    nodes, merges, _ = _merge_rounds(start, [], _rest(parts, rest))
    return every.unionByName(_numbered(nodes, merges, large.select("g", leaf, "number")))


def group_linkage(vecs: DataFrame, group: str, part: str, most: int = 400) -> DataFrame:
    """(group, step, left, right, score, size): linkage of the parts of each group, of any number."""
    return part_linkage(numbered_parts(vecs, group, part), most).select(_group_of(group), "step", "left", "right", "score", "size")


def theme_scores(roots: DataFrame, themes: DataFrame) -> DataFrame:
    """Every root with every theme (both few): root, theme, score."""
    return roots.select("root", "centroid").crossJoin(themes.select("theme", F.col("centroid").alias("t"))).select("root", "theme", F.round(dot(F.col("centroid"), F.col("t")), 6).alias("score"))


def name_roots(scores: DataFrame) -> DataFrame:
    """One theme for each root and one root for each theme, by falling score."""
    from vecforest.operators.relations import capped

    number = lambda c, n: ranks(scores.select(F.lit("").alias("g"), c).distinct(), [c], n).drop("g")
    numbered = scores.join(number("root", "i"), "root").join(number("theme", "j"), "theme")
    links = numbered.select("i", "j", "score", F.concat(F.lit("r:"), "root").alias("leaf_i"), F.concat(F.lit("t:"), "theme").alias("leaf_j"))
    return capped(links, 1).select(F.substring("leaf_i", 3, 1 << 20).alias("root"), F.substring("leaf_j", 3, 1 << 20).alias("theme"), "score")
