"""Vectors for texts, computed once for each distinct text and kept in a cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.functions.vectors import dot, norm, unit
from vecforest.operators.stats import ranks
from vecforest.sources.tables import materialize

#: Characters of texts that are counted at once, and n-grams whose hashes a task keeps.
PIECE, MOST_GRAMS = 1 << 20, 1 << 20
#: Groups of rows that meet, bytes of vectors of a group that a task holds, and rows of it that are compared at once.
GROUPS, HELD, STRIP = 12, 1 << 26, 4096
Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def row_key(config: str, text: str = "text"):
    return F.sha2(F.concat(F.lit(config), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256)


def split_cached(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct inputs (row_key, text): those that the cache holds with a usable vector, and those to compute."""
    good = cache.filter(F.size("vector") > 0).filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)).select("row_key", "vector").dropDuplicates(["row_key"])
    distinct = inputs.select("row_key", "text").dropDuplicates(["row_key"])
    return distinct.join(good, "row_key"), distinct.join(good, "row_key", "left_anti")


def hashed_ngrams(dims: int = 32, n: int = 3) -> Embedder:
    """A stand-in embedder: signed counts of hashed character n-grams at length 1. A row's vector depends on its text alone."""

    bins: dict[int | str, int] = {}  # of n-grams met before: twice the dimension, and one more for a positive sign

    def bin_of(gram: str) -> int:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        return h % dims * 2 + (h >> 63)

    def bins_of(keys: list[int] | list[str]) -> np.ndarray:
        if len(bins) > MOST_GRAMS:
            bins.clear()
        for key in keys:
            if key not in bins:
                bins[key] = bin_of(key if isinstance(key, str) else "".join(chr(key >> (21 * i) & 0x1FFFFF) for i in range(n)))
        return np.array([bins[key] for key in keys], np.int64)

    def add_counts(total: np.ndarray, pieces: list[tuple[int, str]]) -> None:
        """Adds the n-grams of pieces (row, text) to the rows' counts by bin; each distinct one is hashed once."""
        row = np.repeat([r for r, _ in pieces], [max(0, len(t) - n + 1) for _, t in pieces])
        if n > 3:  # a code point has 21 bits
            at, grams = pd.factorize(np.array([t[i : i + n] for _, t in pieces for i in range(len(t) - n + 1)], object))
        else:
            points = np.frombuffer("".join(t for _, t in pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
            keys = sum(points[i : len(points) - n + 1 + i] << (21 * i) for i in range(n))
            end = np.cumsum([len(t) for _, t in pieces])
            whole = np.ones(len(points), bool)
            for i in range(1, n):
                whole[end - i] = False  # such an n-gram would go on in the next piece
            at, grams = pd.factorize(keys[whole[: len(keys)]])
        total += np.bincount(row * 2 * dims + bins_of(grams.tolist())[at], minlength=total.size).reshape(total.shape)

    def counted(texts: list[str]) -> np.ndarray:
        total = np.zeros((len(texts), 2 * dims), np.int64)
        pieces, held = [], 0
        for i, text in enumerate(texts):
            if len(text) < n:
                total[i, bin_of(text)] += 1
            for s in range(0, len(text) - n + 1, PIECE):
                pieces.append((i, text[s : s + PIECE + n - 1]))
                held += len(pieces[-1][1])
                if held >= PIECE:
                    add_counts(total, pieces)
                    pieces, held = [], 0
        if pieces:
            add_counts(total, pieces)
        return total

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            total = counted([f" {text or ''} " for text in batch])
            v = (total[:, 1::2] - total[:, ::2]).astype(float)
            v[~v.any(1), 0] = 1
            yield pd.Series([(x / np.linalg.norm(x)).tolist() for x in v], index=batch.index)

    return run


def embed_missing(missing: DataFrame, embedder: Embedder) -> DataFrame:
    return missing.select("row_key", F.pandas_udf(embedder, "array<double>")("text").alias("vector"))


def embed_documents(df: DataFrame, cache: DataFrame, embedder: Embedder, config: str, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with vectors, new cache rows, and one row of counts. Only distinct texts that the cache lacks are computed."""
    rows = df.withColumn("row_key", row_key(config, text))
    known, missing = split_cached(rows.select("row_key", F.col(text).alias("text")), cache)
    fresh = materialize(embed_missing(missing, embedder))
    vectors = known.select("row_key", "vector").unionByName(fresh)
    return rows.join(vectors, "row_key"), fresh, embed_metrics(rows, known)


def embed_metrics(rows: DataFrame, known: DataFrame) -> DataFrame:
    flagged = rows.select("row_key").join(known.select("row_key", F.lit(True).alias("hit")), "row_key", "left")
    return flagged.agg(F.count("*").alias("inputs"), F.count_distinct("row_key").alias("unique_inputs"), F.count_if("hit").alias("reused_rows"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("row_key"))).alias("computed_rows"))


def embedding_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per id: cosine of two vectors and both norms."""
    met = a.select("doc_id", F.col("vector").alias("x")).join(b.select("doc_id", F.col("vector").alias("y")), "doc_id")
    return met.select("doc_id", (dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("cosine"), norm(F.col("x")).alias("norm_a"), norm(F.col("y")).alias("norm_b"))


def _moments(met: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and the matrix of products of the columns of (z array<double>). A task sends one row for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = batch["z"].flatten().to_numpy().reshape(len(batch), -1)
                n, total, products = n + len(z), total + z.sum(0), products + z.T @ z
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width), pa.array(total), pa.array(products.tolist(), pa.list_(pa.float64()))], ["i", "n", "total", "products"])

    rows = met.select("z").mapInArrow(run, "i int, n long, total double, products array<double>")
    sums = rows.select("i", "n", "total", F.posexplode("products").alias("j", "value")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("value").alias("value"))
    n, total, products = 0, np.zeros(width), np.zeros((width, width))
    for r in sums.collect():  # the square of the dimension
        n, total[r.i], products[r.i, r.j] = r.n, r.total, r.value
    return n, total, products


def _difference_meetings(rows: DataFrame, tops: np.ndarray, most: float, group: int) -> DataFrame:
    """What two groups p <= q of `group` blocks need to be compared: the rows of p (kind 1) and those of q (kind 2), where a bound is above `most`."""
    heads = tops[::group]  # of blocks by falling bound
    near = [int(np.count_nonzero(heads[p] + heads[p:] > most)) for p in range(len(heads))]
    own = F.floor(F.col("block") / group).cast("int")
    reach = F.array(*[F.lit(p + k - 1) for p, k in enumerate(near)])  # the last group that p meets
    fields = ["block", "doc_id", "x", "y"]
    dealt = rows.withColumns({"own": own, "last": reach[own]})
    left = dealt.filter("last >= own").select(F.col("own").alias("p"), F.explode(F.sequence("own", "last")).alias("q"), F.lit(1).alias("kind"), *fields)
    meets = F.filter(F.sequence(F.lit(0), F.col("own")), lambda p: F.get(reach, p) >= F.col("own"))
    right = dealt.select(F.explode(meets).alias("p"), F.col("own").alias("q"), F.lit(2).alias("kind"), *fields)
    return left.unionByName(right)


def largest_difference(met: DataFrame, n: int, block: int = 1024, held: int = HELD) -> tuple[float, int]:
    """The largest absolute difference of the two cosines of a pair, over rows (doc_id, x, y) of unit vectors, and the number of pairs of blocks compared.

    The cosines of a pair differ by at most the lengths of both rows' own differences
    x - y. Rows are cut into blocks by falling length of that; a block is compared with
    itself first, and then only pairs of blocks whose bound is above the largest found.
    Blocks meet in groups: a task holds the rows of one group, at most `held` bytes of
    vectors, and reads those of the other as they come. Up to GROUPS groups a row is sent
    about as often at any number of rows. Single precision with its error bound tells
    which strips may hold more than the largest so far; those are measured in double.
    """
    error = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rows = ranks(met.withColumns({"g": F.lit(""), "error": error}), [F.desc("error"), F.asc("doc_id")], "at")
    rows = materialize(rows.select(F.floor(F.col("at") / block).alias("block"), "doc_id", "x", "y", "error"))
    # One number for each block.
    tops = np.array([r.top for r in rows.groupBy("block").agg(F.max("error").alias("top")).orderBy("block").collect()])
    wide = lambda t, c: (t[c].combine_chunks() if isinstance(t, pa.Table) else t[c]).flatten().to_numpy().reshape(len(t), -1)

    def difference(ids: np.ndarray, x: np.ndarray, y: np.ndarray, other: tuple[np.ndarray, ...]) -> float:
        d = np.abs(x @ other[1].T - y @ other[2].T)
        d[ids[:, None] == other[0]] = 0.0
        return float(d.max())

    def own(t: pa.Table) -> pa.Table:
        a = (t["doc_id"].to_numpy(), wide(t, "x"), wide(t, "y"))
        return pa.table([[difference(*a, a)]], ["most"])

    most = rows.select("block", "doc_id", "x", "y").groupBy("block").applyInArrow(own, "most double").agg(F.max("most")).first()[0] or 0.0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, parts, best = None, None, [], most
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("p", "q", "kind", "block")], 1)
            edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)) if len(key) else np.zeros(1, int)
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                p, q, kind, number = key[start].tolist()
                if at != (p, q):
                    at, left, parts = (p, q), None, []
                t = batch.slice(start, end - start)
                a = (t["doc_id"].to_numpy(), wide(t, "x"), wide(t, "y"))
                if kind == 1:
                    parts.append((np.full(len(t), number), *a))
                    continue
                if left is None:
                    left = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    parts, close = [], np.hstack(left[2:]).astype(np.float32)
                turned = np.hstack((a[1], -a[2])).astype(np.float32).T
                slack = 2 * (len(turned) + 4) * 2.0**-24  # of rounding to single precision, as the factors have length 1
                for s in range(0, int(np.searchsorted(left[0], number, "right")), STRIP):
                    e = min(s + STRIP, int(np.searchsorted(left[0], number, "right")))
                    if tops[left[0][s]] + tops[number] <= best:
                        break  # blocks come by falling bound
                    d = close[s:e] @ turned
                    if max(float(d.max()), -float(d.min())) + slack > best:
                        best = max(best, difference(*(c[s:e] for c in left[1:]), a))
        yield pa.record_batch([pa.array([best])], ["most"])

    width = rows.select(F.size("x").alias("d")).first()
    group = max(1, min(-(-len(tops) // GROUPS), held // (16 * block * max(1, width.d if width else 1))))
    met_groups = _difference_meetings(rows, tops, most, group).repartition("p", "q").sortWithinPartitions("p", "q", "kind", "block")
    found = met_groups.mapInArrow(search, "most double").agg(F.max("most")).first()[0]
    others = [np.count_nonzero(tops[i] + tops[i + 1 :] > most) for i in range(len(tops))]
    return max(most, found or 0.0), len(tops) + int(sum(others))


def pair_agreement(a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """One row on the cosines of all pairs of ids in two embeddings: pairs, mean and variance in each, mean, root mean square and largest absolute difference, and the pairs of blocks compared for that.

    Sums over all pairs come from the sums of the vectors and the matrix of their products,
    in one pass; only the largest difference looks at pairs. Vectors without a direction take no part.
    """
    met = a.select("doc_id", unit(F.col("vector")).alias("x")).join(b.select("doc_id", unit(F.col("vector")).alias("y")), "doc_id").filter("x is not null and y is not null")
    met = materialize(met)
    schema = "pairs long, mean_a double, variance_a double, mean_b double, variance_b double, mean_difference double, rms_difference double, largest_difference double, compared long"
    first = met.select(F.size("x").alias("d"), (F.size("x") + F.size("y")).alias("w")).first()
    if first is None:
        return a.sparkSession.createDataFrame([(0, *[None] * 8)], schema)
    n, total, products = _moments(met.select(F.concat("x", "y").alias("z")), first.w)
    pairs = n * (n - 1) // 2
    if not pairs:
        return a.sparkSession.createDataFrame([(0, *[None] * 8)], schema)
    d = first.d
    of = lambda s: (float(s @ s) - n) / 2  # noqa: E731  sums of the products of all pairs of unit rows, and of pairs of such products
    both = lambda m: (float((m * m).sum()) - n) / 2
    sa, sb, aa, bb = of(total[:d]), of(total[d:]), both(products[:d, :d]), both(products[d:, d:])
    # The products of both embeddings on the diagonal are one as well.
    ab = both(products[:d, d:])
    ma, mb = sa / pairs, sb / pairs
    most, compared = largest_difference(met, n, block)
    rms = max(0.0, aa + bb - 2 * ab) / pairs
    return a.sparkSession.createDataFrame([(pairs, ma, aa / pairs - ma * ma, mb, bb / pairs - mb * mb, ma - mb, rms**0.5, most, compared)], schema)
