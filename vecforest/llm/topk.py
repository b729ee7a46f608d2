"""Exact search for the largest inner products: norm-bucketed retrieval.

Vectors are sorted by falling length and cut into buckets. The longest bucket is
searched first for every query; the k-th best score there is a bound below which
no further vector counts. Divided by the length of the query and the longest
length in a bucket, the bound is a local threshold for the cosine in that bucket:

- over 1, the bucket is skipped; blocks of queries are joined only with buckets that
  some query of theirs can use;
- in a bucket, a cut between the local thresholds is chosen by the rows that would
  be touched. Queries below it use length pruning: the bucket's prefix of vectors
  that are long enough. Queries above it use coordinate pruning: the threshold bounds
  each coordinate of a unit vector to an interval, and only rows in the intervals of
  the query's few largest coordinates remain.

What remains is verified by exact products of whole numbers. A task holds one bucket
and one block of queries; both sides are shuffled, neither is broadcast. Buckets
of equally long vectors are cut by id, so no length gets a task of its own.

Defined results: vectors that are null, or hold null or non-finite components, or are
of another length than most, and rows with a null id take no part; zero vectors do.
Ties go to the smaller id; with fewer candidates than k all are returned. Rows that
share an id are all candidates for other ids; as a query such an id is asked once,
with its greatest vector. An empty table gives an empty result. A product that does
not fit in a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforest.llm.common import table
from vecforest.llm.vectors import NONE, best_of_rows, first_ranks, matrix, number_type, ranked, whole_vectors

SCALE, BUCKET, LEAST_BUCKET, QUERY_BLOCK, STEP = 256, 32_768, 1024, 8192, 128
#: Coordinates that bound a query's rows, and what coordinate pruning costs, each row and each query, against a row of a matrix product.
FOCUS, GATHER, START = 3, 2, 1000
HITS = "query_id long, vec_id long, score long"


def local_thresholds(bound: np.ndarray, query_length: np.ndarray, longest: float) -> np.ndarray:
    """The cosine that a vector of a bucket needs at least to reach the bound."""
    most = query_length * longest
    return np.where(most > 0, bound / np.where(most > 0, most, 1), np.where(bound > 0, np.inf, -np.inf))


def intervals(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of a unit vector may lie, if its cosine with a unit query of coordinate q is to reach `cosine`."""
    angle, reach = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, angle + reach)) - 1e-9, np.cos(np.maximum(0, angle - reach)) + 1e-9


def bucket_hits(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, kind: type, focus: int = FOCUS) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(query, vec_id, score) of each query's k best rows of a bucket that reach its bound (NONE where it has none), and how many queries used which pruning and how many products were verified."""
    x, q = x.astype(kind), q.astype(kind)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -length))
    ids, x, length = ids[order], x[order], length[order]
    of = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    least = np.where(bound == NONE, -np.inf, bound.astype(np.float64))
    local = local_thresholds(least, of, length[0] if len(length) else 0.0)
    used = np.flatnonzero(local <= 1 + 1e-9)
    local, of, least = local[used], of[used], least[used]
    enough = np.divide(least, of, out=np.where(least > 0, np.inf, -np.inf), where=of > 0)
    prefix = np.searchsorted(-length, -(enough * (1 - 1e-9) - 1e-9), side="right")
    # Coordinate pruning: for each of a query's largest coordinates, the rows within its interval.
    focus = min(focus, x.shape[1])
    unit_x = x / np.where(length > 0, length, 1)[:, None]
    unit_q = q[used] / np.where(of > 0, of, 1)[:, None]
    at = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :focus]
    low, high = intervals(np.take_along_axis(unit_q, at, 1), local[:, None])
    lists, left, right = {}, np.zeros(at.shape, int), np.full(at.shape, len(ids))
    may = local > 0
    for f in np.unique(at[may]).tolist():
        lists[f] = np.argsort(unit_x[:, f], kind="stable")
        values = unit_x[lists[f], f]
        r, c = np.nonzero((at == f) & may[:, None])
        left[r, c], right[r, c] = np.searchsorted(values, low[r, c], side="left"), np.searchsorted(values, high[r, c], side="right")
    # The cut between the local thresholds that touches least: below it length pruning, above it coordinate pruning.
    by = np.argsort(local, kind="stable")
    gather = np.where(may, START + GATHER * (right - left).min(1), np.inf)[by]
    cut = int(np.argmin(np.append(0, np.cumsum(prefix[by])) + np.append(np.cumsum(gather[::-1])[::-1], 0)))
    by_length, by_coordinate = by[:cut], by[cut:]
    out, seen = [], {"length": len(by_length), "coordinate": len(by_coordinate), "skipped": len(q) - len(used), "products": 0}

    def keep(rows: np.ndarray, among: np.ndarray) -> None:
        score = (q[used[rows]] @ x[among].T).astype(np.int64)
        seen["products"] += score.size
        score[(query_ids[used[rows]][:, None] == ids[among]) | (score < bound[used[rows]][:, None])] = NONE
        r, c = best_of_rows(score, ids[among], k)
        out.append((used[rows][r], ids[among][c], score[r, c]))

    by_length = by_length[np.argsort(prefix[by_length], kind="stable")]
    for s in range(0, len(by_length), STEP):
        keep(by_length[s : s + STEP], np.arange(prefix[by_length[s : s + STEP]].max()))
    for j in by_coordinate.tolist():
        first = int(np.argmin(right[j] - left[j]))
        rows = lists[at[j, first]][left[j, first] : right[j, first]]
        for c in range(focus):
            v = unit_x[rows, at[j, c]]
            rows = rows[(v >= low[j, c]) & (v <= high[j, c])]
        keep(np.array([j]), rows)
    which, found, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return query_ids[which], found, score, seen


def exact_top_k(df: DataFrame, k: int = 5, query: Column | None = None, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", bucket: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose vec_id meets the query condition: the k other rows with the highest inner products of whole-number vectors, as query_id, rank, vec_id, score."""
    spark = df.sparkSession
    whole = whole_vectors(df, scale, 0, id_col, vector_col)
    if not whole.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = number_type(whole.width, whole.largest)
    bucket = bucket or min(BUCKET, max(LEAST_BUCKET, -(-whole.n // spark.sparkContext.defaultParallelism)))
    squared = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    rows = ranked(whole.rows.withColumn("squared", squared), F.desc("squared"), "vec_id")
    rows = table(rows.select(F.floor(F.col("rank") / bucket).cast("int").alias("bucket"), "vec_id", "x", "squared"), "buckets")
    asked = whole.rows.filter(F.col("vec_id") % 50 == 0 if query is None else query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("x").alias("x"))
    asked = table(asked.withColumn("own", squared), "queries")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // query_block)))).cast("int"))
    longest = rows.groupBy("bucket").agg(F.max("squared").alias("longest"))
    last = -(-whole.n // bucket) - 1

    def search(b: pa.Table, a: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 3
        if len(a) and len(b):
            bound = a["bound"].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False)
            columns = bucket_hits(b["vec_id"].to_numpy(), matrix(b), a["query_id"].to_numpy(), matrix(a), bound, k, kind)[:3]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def found(queries: DataFrame, buckets: Column) -> DataFrame:
        """The hits of queries (with bound) in those of the buckets that one of their block can use."""
        needs = queries.groupBy("block").agg(F.min(F.coalesce(F.col("bound") / F.sqrt("own"), F.when(F.col("bound") > 0, float("inf")).otherwise(float("-inf")))).alias("needs"))
        pairs = needs.withColumn("bucket", F.explode(buckets)).join(longest, "bucket").filter(F.sqrt("longest") >= F.col("needs") * (1 - 1e-9) - 1e-9)
        pairs = table(pairs.select("block", "bucket"), "pairs")  # both joins with it can be split, as Spark knows its size
        mine, theirs = rows.join(pairs, "bucket"), queries.join(pairs, "block")
        return mine.select("bucket", "block", "vec_id", "x").groupBy("bucket", "block").cogroup(theirs.select("bucket", "block", "query_id", "x", "bound").groupBy("bucket", "block")).applyInArrow(search, HITS)

    first = table(found(asked.withColumn("bound", F.lit(None).cast("long")), F.array(F.lit(0))), "first")
    if last > 0:
        bound = first_ranks(first, k, "query_id").filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        rest = found(asked.join(bound, "query_id", "left"), F.sequence(F.lit(1), F.lit(last)))
        first = first.unionByName(rest)
    return first_ranks(first, k, "query_id").select("query_id", "rank", "vec_id", "score")
