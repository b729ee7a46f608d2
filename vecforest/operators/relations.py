"""Neighbours, cross-group pairs and links between groups of unit vectors.

Vectors come as rows (doc_id, vector, leaf, root). Similarities of many rows are
matrix products in blocks: a group is cut into blocks by hash, two blocks meet in
a task, and each task keeps only what the result needs, so no group has to fit in
one task and no pair of rows is sent that cannot count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.functions.vectors import distance3
from vecforest.operators import bridges
from vecforest.sources.tables import materialize

BLOCK, STRIP, DIGITS, SCALE = 8192, 512, 6, 225.0
FIELDS = "doc_id long, vector array<double>, leaf string, root string"


def _matrix(t: pa.Table) -> np.ndarray:
    v = t["vector"].combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1)


def _blocks(vecs: DataFrame, group: str | None, block: int) -> DataFrame:
    """Rows dealt to (group, i, j), i <= j: every two blocks of a group meet once."""
    name = F.col(group).cast("string") if group else F.lit("")
    rows = vecs.withColumn("g", name)
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    return (
        rows.join(sizes, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "other")
    )


def knn(vecs: DataFrame, group: str, k: int, block: int = BLOCK) -> DataFrame:
    """Directed edges (src, dst, score): the k most similar other rows of the same group; ties go to the smaller id."""

    def best(t: pa.Table) -> pa.Table:
        ids, own, x = t["doc_id"].to_numpy(), t["own"].to_numpy(), _matrix(t)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        out = []
        for a, b in {(i, j), (j, i)}:
            rows, cols = np.flatnonzero(own == a), np.flatnonzero(own == b)
            cols = cols[np.argsort(ids[cols])]
            y = x[cols].T
            for s in range(0, len(rows), STRIP):
                some = rows[s : s + STRIP]
                score = np.round(x[some] @ y, DIGITS) + 0.0
                score[ids[some][:, None] == ids[cols][None]] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(some), -np.inf)
                r, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                order = np.lexsort((c, -score[r, c], r))
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[first], c[first]
                out.append((ids[some][r], ids[cols][c], score[r, c]))
        out = out or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["src", "dst", "score"])

    found = _blocks(vecs.select("doc_id", "vector", group), group, block).select("g", "i", "j", "own", "doc_id", "vector").groupBy("g", "i", "j").applyInArrow(best, "src long, dst long, score double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("score").alias("score"))


def knn_edges(vecs: DataFrame, group: str, k: int) -> DataFrame:
    return undirected(knn(vecs, group, k))


def cross_candidates(vecs: DataFrame, tau: float, best_per_leaf_pair: bool = False, block: int = bridges.BLOCK, pos: DataFrame | None = None, max_length: float | None = None) -> DataFrame:
    """Pairs i < j of different roots with a similarity of tau or more: i, j, score, leaf_i, leaf_j. Blocks of rows that can hold none are not compared.

    With pos (doc_id, x, y, z) and max_length, pairs that are farther apart are dropped where
    they are found; with best_per_leaf_pair each task then sends only its best pair of two leaves.
    """
    if pos is not None:
        vecs = vecs.join(pos.select("doc_id", "x", "y", "z"), "doc_id")
    rows = bridges.like_blocks(vecs, block)
    pairs = bridges.block_pairs(bridges.block_summaries(rows), tau)
    return bridges.compared(rows, pairs, tau, best_per_leaf_pair, max_length, block)


def best_leaf_pairs(cands: DataFrame) -> DataFrame:
    """The strongest pair of each two leaves; ties go to the smaller ids."""
    w = W.partitionBy(F.least("leaf_i", "leaf_j"), F.greatest("leaf_i", "leaf_j")).orderBy(F.desc("score"), "i", "j")
    return cands.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def link_length(edges: DataFrame, pos: DataFrame, scale: float = SCALE, src: str = "src", dst: str = "dst") -> DataFrame:
    """Adds the length of each link over positions (doc_id, x, y, z), in units of the scale."""
    a = pos.select(F.col("doc_id").alias(src), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = pos.select(F.col("doc_id").alias(dst), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = distance3([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"])
    return edges.join(a, src).join(b, dst).withColumn("length", d / scale).drop(*[f"{s}{c}" for s in "ab" for c in "xyz"])


def drop_long_links(edges: DataFrame, pos: DataFrame, limit: float, scale: float = SCALE, src: str = "src", dst: str = "dst") -> DataFrame:
    return link_length(edges, pos, scale, src, dst).filter(F.col("length") <= limit + 1e-9)


def capped(links: DataFrame, cap: int) -> DataFrame:
    """Greedy choice in rounds: links by falling score, while both leaves have fewer than cap.

    A round takes every link that is among the first remaining ones of both its
    leaves; this is what taking one link after another gives.
    """
    if cap <= 0:
        return links.limit(0)
    left = materialize(links.select("i", "j", "score", "leaf_i", "leaf_j"))
    taken = None
    while not left.isEmpty():
        ends = left.select("i", "j", "score", F.explode(F.array("leaf_i", "leaf_j")).alias("leaf"))
        used = None if taken is None else taken.select(F.explode(F.array("leaf_i", "leaf_j")).alias("leaf")).groupBy("leaf").count().withColumnRenamed("count", "used")
        rank = F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("score"), "i", "j"))
        ends = ends.withColumn("rank", rank)
        ends = ends.withColumn("used", F.lit(0)) if used is None else ends.join(used, "leaf", "left").fillna(0, ["used"])
        ends = ends.withColumns({"fits": F.col("rank") + F.col("used") <= cap, "open": F.col("used") < cap})
        state = ends.groupBy("i", "j").agg(F.min("fits").alias("fits"), F.min("open").alias("open"))
        step = materialize(left.join(state, ["i", "j"]))
        now = step.filter("fits").drop("fits", "open")
        taken = now if taken is None else taken.unionByName(now)
        left = step.filter("not fits and open").drop("fits", "open")
    return left.select("i", "j", "score", "leaf_i", "leaf_j") if taken is None else taken


def cross_links(vecs: DataFrame, pos: DataFrame, tau: float, max_length: float, cap: int) -> DataFrame:
    """Links between roots: similar and short enough, the best for each two leaves, at most cap for each leaf."""
    return capped(best_leaf_pairs(cross_candidates(vecs, tau, True, pos=pos, max_length=max_length)), cap)


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge under both its ends."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), "score").select("e.node", "e.other", "score")


def align_vectors(docs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Documents and vectors by id, with what is missing on either side: doc_id, status."""
    a = docs.select("doc_id", F.lit(True).alias("has_doc"))
    b = vecs.select("doc_id", F.lit(True).alias("has_vec"))
    status = F.when(F.col("has_doc").isNull(), "no document").when(F.col("has_vec").isNull(), "no vector").otherwise("aligned")
    return a.join(b, "doc_id", "full").select("doc_id", status.alias("status"))


def vector_violations(vecs: DataFrame, dims: int | None = None, vector: str | Column = "vector") -> DataFrame:
    """(doc_id, rule) for vectors of a wrong length, with a value that is no number, or of zeros only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    size = F.size(v)
    wrong = (size < 2) | (size > 4096) | ((size != dims) if dims else F.lit(False))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rules = F.array(
        F.when(v.isNull() | wrong, "dimension"), F.when(F.coalesce(odd, F.lit(False)), "not finite"), F.when(F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False)), "zero")
    )
    return vecs.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
