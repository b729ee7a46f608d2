"""Whole-number vectors, exact products, column moments and ranks, for the operators on vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.llm.common import quoted, table

#: Sums below this are exact in double precision.
EXACT = 1 << 53
#: A score that does not count.
NONE = np.iinfo(np.int64).min


class Whole(NamedTuple):
    """Rows (vec_id, x, kept columns) with their number, the vectors' length and the largest absolute component."""

    rows: DataFrame
    n: int
    width: int
    largest: int


def whole_vectors(df: DataFrame, scale: int, offset: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", **kept: Column) -> Whole:
    """Each component c, as double, becomes floor(scale * c) + offset.

    Vectors that are null or hold null or non-finite components, rows with a null id
    or a null kept column, and vectors of another length than most (of equally
    frequent lengths the smaller counts) take no part.
    """
    number = lambda c: c.cast("double")
    bad = lambda c: number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))
    v = F.col(quoted(vector_col))
    rows = df.filter(v.isNotNull() & ~F.exists(v, bad)).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(number(c) * scale) + offset).alias("x"), *[c.alias(k) for k, c in kept.items()])
    for name in ("vec_id", *kept):
        rows = rows.filter(F.col(name).isNotNull())
    most = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    found = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.max(most).alias("largest")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not found or not found[0].width:
        return Whole(rows.limit(0), 0, 0, 0)
    n, width, largest = found[0].n, found[0].width, found[0].largest
    if largest >= 1 << 62:
        raise ValueError("a component does not fit in a long")
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"
    return Whole(rows.filter(F.size("x") == width).withColumn("x", F.col("x").cast(f"array<{kind}>")), n, width, largest)


def matrix(t: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    v = t[name].combine_chunks() if isinstance(t, pa.Table) else t[name]
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def number_type(width: int, largest: int) -> type:
    """In which products of such vectors are exact: doubles, which are fast, or 64-bit integers."""
    most = width * largest * largest
    if most >= 1 << 63:
        raise ValueError("a product does not fit in a long")
    return np.float64 if most < EXACT else np.int64


def moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the components of x, and sums of their squares as doubles. A task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(width, np.int64), np.zeros(width)
        for batch in batches:
            if len(batch):
                x = matrix(batch).astype(np.int64)
                total += x.sum(0)
                squares += (x.astype(np.float64) ** 2).sum(0)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(total), pa.array(squares)], ["pos", "total", "squares"])

    out = rows.select("x").mapInArrow(run, "pos int, total long, squares double").groupBy("pos").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    total, squares = np.zeros(width, np.int64), np.zeros(width)
    for r in out.collect():  # one row for each dimension
        total[r.pos], squares[r.pos] = r.total, r.squares
    return total, squares


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Writes a table in an order and adds the rank from 0: a range sort, written once, with one number carried for each partition."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = table(rows.withColumns({"__part": F.shiftright("__at", 33).cast("int"), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row for each partition
    base = rows.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    return rows.join(base, "__part").withColumn("rank", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def best_of_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row that are not NONE, ties to the smaller id."""
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), NONE)
    row, col = np.nonzero((score >= least[:, None]) & (score > NONE))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def first_ranks(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k hits of each key with the highest score, ties to the smaller vec_id, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
