"""Nearest neighbours: inverted file, product-quantised residuals, exact reranking, and bounds that leave no neighbour out.

Coarse centroids and residual codebooks are fitted by k-means on a bounded sample
(SAMPLE_VALUES numbers, chosen by hash of the id); every vector is indexed. Lists go
to tasks in groups, a long list and many queries in blocks by hash, so a task holds
at most a block of vectors and a block of queries.

A query first probes its nearest lists. There, asymmetric distance tables rank the
vectors, and the best share of them is measured exactly on the original vectors: the
k-th distance found is a bound. The second pass takes every list whose centroid less
its radius is within the bound, and in it measures every vector whose distance by the
tables less its own coding error is. Both follow from the triangle inequality, so the
result is that of comparing all rows, however these lie; rows that cluster only leave
more out.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part, as queries or as candidates; ties
go to the smaller id; with fewer candidates than wanted, all are returned; an
empty table gives an empty result; rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.llm.common import table

SAMPLE_VALUES, CODES, SUBSPACE, MAX_LISTS = 1_000_000, 256, 4, 4096
PROBE_SHARE, RERANK_SHARE, RERANK_LEAST = 0.1, 1 / 6, 40
VECTOR_BLOCK, QUERY_BLOCK = 16384, 4096
#: Queries and vectors of a list that are compared at once in a task, and pairs that are measured at once.
QUERIES, VECTORS, PAIRS = 512, 1024, 50_000


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector array<double>) that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("vector") == (lengths[0]["size"] if lengths else 0))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids**2).sum(1)
    return np.concatenate([(half - x[s : s + 4096] @ centroids.T).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and one codebook for each few dimensions of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = k_means(sample, lists, 8, 1)
        residual = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = list(range(0, sample.shape[1], SUBSPACE))
        self.books = [k_means(residual[:20_000, s : s + SUBSPACE], CODES, 6, 2 + s) for s in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centroids)
        residual = x - self.centroids[at]
        return at, np.stack([nearest(residual[:, s : s + SUBSPACE], b) for s, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to all centroids, by differences, which lose no digits."""
        return np.stack([np.sqrt(((q - c) ** 2).sum(1)) for c in self.centroids], axis=1)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[at] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def asymmetric(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of coded vectors of a list (rows) to queries (columns), from one table per query and codebook."""
        r = q - self.centroids[which]
        out = np.zeros((len(codes), len(q)))
        for j, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = r[:, s : s + SUBSPACE]
            tables = (part**2).sum(1) + (b**2).sum(1)[:, None] - 2 * b @ part.T
            out += tables[codes[:, j]]
        return out


def first_equal(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions, by rising id, of at most so many rows of each vector: of equal vectors only those with the smallest ids can be among the nearest."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(x[order] + 0.0).view(f"V{8 * x.shape[1]}").ravel()
    same = np.unique(raw, return_inverse=True)[1].ravel()
    by = np.argsort(same, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(same[by], same[by])
    return order[np.sort(by[place < most])]


def first_of_queries(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], ids[best], score[best]


def nearest_neighbours(df: DataFrame, k: int = 10, query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", probe_share: float = PROBE_SHARE) -> DataFrame:
    """For each row whose vec_id meets the query condition: its k nearest other rows, as query_id, rank, vec_id, score (Euclidean distance)."""
    spark = df.sparkSession
    query = F.col("vec_id") % 100 == 0 if query is None else query
    rows = usable(df, id_col, vector_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = F.size("vector")
    width = rows.select(size.alias("s")).first().s
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_VALUES // width)).select("vector").toPandas()["vector"]
    index = Index(np.stack(sample.to_numpy()).astype(np.float64), min(MAX_LISTS, max(1, round(n**0.5))))
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS + CODES vectors
    slack = 1e-9  # relative; sums of squares and tables lose less than this

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch["vector"].flatten().to_numpy().reshape(len(batch), -1)
                at, codes = shared.value.encode(x)
                away = lambda y: pa.array(np.sqrt(((x - y) ** 2).sum(1)))  # noqa: B023, E731
                yield pa.record_batch([pa.array(at.astype(np.int32)), batch["vec_id"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), away(shared.value.decode(at, codes)), away(shared.value.centroids[at])], ["list", "vec_id", "codes", "vector", "error", "away"])

    base = table(rows.mapInArrow(coded, "list int, vec_id long, codes binary, vector binary, error double, away double"), "index")
    held, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in base.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # at most MAX_LISTS
        held[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    # Short lists share a group, a long one has a group of its own in blocks.
    most = min(VECTOR_BLOCK, max(1, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    group, blocks, filled = np.zeros(len(held), np.int32), [], 0
    for i, m in enumerate(held.tolist()):
        if not blocks or filled + m > most:
            blocks.append(0)
            filled = 0
        group[i], filled, blocks[-1] = len(blocks) - 1, filled + m, max(1, -(-m // VECTOR_BLOCK))
    of_list = F.broadcast(spark.createDataFrame([(i, int(g), blocks[g]) for i, g in enumerate(group)], "list int, group int, vb int"))
    of_group = F.broadcast(spark.createDataFrame([(g, b) for g, b in enumerate(blocks)], "group int, vb int"))
    asked = rows.filter(query).withColumn("bound", F.lit(float("inf")))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))

    def probing(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["group", "query_id", "vector", "bound", "lists"]
            for batch in batches:
                x, bound = batch["vector"].flatten().to_numpy().reshape(len(batch), -1), batch["bound"].to_numpy()
                far = shared.value.distances(x) if len(batch) else np.zeros((0, len(held)))
                if first:  # the nearest lists, and as many more as hold k other rows
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(held[order], axis=1) - held[order]
                    wanted = (np.arange(len(held)) < max(1, int(np.ceil(probe_share * len(held))))) | (before <= k)
                    take = np.zeros(far.shape, bool)
                    np.put_along_axis(take, order, wanted, 1)
                else:
                    take = ~(far * (1 - slack) - radius * (1 + slack) > bound[:, None])
                take &= held > 0
                out = []
                for i in range(len(batch)):
                    lists = np.flatnonzero(take[i])
                    cut = np.flatnonzero(np.diff(group[lists])) + 1
                    raw = x[i].tobytes()
                    out += [(int(group[some[0]]), batch["vec_id"][i].as_py(), raw, float(bound[i]), some.tolist()) for some in np.split(lists, cut) if len(some)]
                    if len(out) > 2000 or i == len(batch) - 1:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int32())), strict=True)], names) if out else pa.record_batch([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int32()))], names)
                        out = []

        return run

    def nearest_by_tables(q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, which: int, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance): the share of a list that is best by the tables, measured."""
        depth = min(len(x), max(RERANK_LEAST, k + 1, int(np.ceil(RERANK_SHARE * len(x)))))
        near = np.concatenate([np.argpartition(shared.value.asymmetric(q[s : s + 64], which, codes), depth - 1, axis=0)[:depth] for s in range(0, len(q), 64)], axis=1)
        row, col = np.repeat(np.arange(len(q)), depth), near.T.ravel()
        return row, col, measured(q, x, row, col)

    def measured(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((x[col[s : s + PAIRS]] - q[row[s : s + PAIRS]]) ** 2).sum(1)) for s in range(0, len(row), PAIRS)] or [np.zeros(0)])

    def all_within(q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, which: int, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance): all vectors of a list within the bounds. Tables less coding errors leave out most; products find what to measure of the rest."""
        out = []
        limit = (bound * (1 + slack)) ** 2
        lengths, c = (q**2).sum(1), shared.value.centroids[which]
        rounding = slack * (np.sqrt(lengths) + np.sqrt(((q - c) ** 2).sum(1)) + np.sqrt((c**2).sum()))
        for s in range(0, len(x), VECTORS):
            y = x[s : s + VECTORS]
            square = shared.value.asymmetric(q, which, codes[s : s + VECTORS])
            maybe = ~(square > (bound * (1 + slack) + rounding + (error[s : s + VECTORS] * (1 + slack))[:, None]) ** 2)
            some = np.flatnonzero(maybe.any(1))
            if len(some):
                y, size = y[some], (y[some] ** 2).sum(1)[:, None]
                square = size + lengths - 2 * (y @ q.T)
                col, row = np.nonzero(maybe[some] & ~(square - slack * (size + lengths) > limit))
                score = measured(q, y, row, col)
                keep = ~(score > bound[row])
                out.append((row[keep], some[col[keep]] + s, score[keep]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def searching(find):
        def search(b: pa.Table, a: pa.Table) -> pa.Table:
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(a) and len(b):
                lists, ids = b["list"].to_numpy(), b["vec_id"].to_numpy()
                codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
                x = np.frombuffer(b"".join(b["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
                error, asking, bound = b["error"].to_numpy(), a["query_id"].to_numpy(), a["bound"].to_numpy()
                q = np.frombuffer(b"".join(a["vector"].to_pylist()), np.float64).reshape(len(a), -1)
                wanted = a["lists"].combine_chunks()
                of = np.repeat(np.arange(len(a)), np.diff(wanted.offsets.to_numpy()))
                wanted = wanted.flatten().to_numpy()
                for which in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == which)
                    at = at[first_equal(x[at], ids[at], k + 1)]
                    who = of[wanted == which]
                    for s in range(0, len(who), QUERIES):
                        w = who[s : s + QUERIES]
                        with np.errstate(over="ignore", invalid="ignore"):
                            row, col, score = find(q[w], x[at], codes[at], error[at], which, bound[w], asking[w])
                        other = ids[at][col] != asking[w][row]
                        hits.append(first_of_queries(asking[w][row][other], ids[at][col][other], score[other], k))
            found = first_of_queries(*(np.concatenate(c) for c in zip(*hits, strict=True)), k)
            return pa.table([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        return search

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        routed = asking.select("vec_id", "vector", "bound").mapInArrow(probing(first), "group int, query_id long, vector binary, bound double, lists array<int>").join(of_group, "group")
        routed = routed.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select("group", "v", "q", "query_id", "vector", "bound", "lists")
        dealt = base.join(of_list, "list").withColumn("v", F.pmod(F.xxhash64("vec_id"), "vb").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("group", "v", "q", "list", "vec_id", "codes", "vector", "error")
        found = dealt.groupBy("group", "v", "q").cogroup(routed.groupBy("group", "v", "q")).applyInArrow(searching(nearest_by_tables if first else all_within), "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    bounds = table(searched(asked, True).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("found")), "bounds")
    asked = rows.filter(query).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("found", F.lit(float("inf"))))
    return searched(asked, False).select("query_id", "rank", "vec_id", "score")
