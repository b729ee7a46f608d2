"""Bulk-synchronous best-fit packing of documents into sequences.

Documents longer than a sequence are cut into pieces, the first of which may be
shorter. Full pieces fill a sequence; pieces of over half a sequence open one
each. What is left is matched in rounds, each a few Spark jobs over narrow rows:

1. Gaps and pieces are range-sorted together by size, largest first, gaps before
   pieces of the same size.
2. A sweep over the partitions finds each piece's successor gap, the smallest
   free gap that holds it: gaps open brackets and pieces close them, so a piece
   belongs to the last open bracket. The bracket depth is a running sum, carried
   from partition to partition by one pair of numbers each.
3. Where several pieces want a gap, rank decides: at each depth the rows are
   numbered, and a piece takes the gap just before it.
4. Matched gaps shrink. When a round leaves pieces for which few gaps are left,
   the largest of them open as many sequences as their total length needs.

Rounds end when no piece is left. No row is ever handled on the driver: it sees
one pair of numbers per partition and the counts of the lengths (under 1024).

Defined results: null text counts as empty, which is the end id alone; repeated
rows are packed each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.llm.common import drop_table, table, text_rows
from vecforest.llm.textops import spare, tidy
from vecforest.llm.tokens import encode_batch

#: Rows of a partition of the sort, and the least share of pieces that a round must match before new sequences open.
SORT_ROWS, LEAST_MATCHED = 200_000, 0.1
GAP, PIECE = 0, 1
SWEPT = "kind int, id long, size int, part int, sum long, low long"


def pieces_of(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id (of the piece), doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, off = encode_batch(batch["text"], tokenizer_path, end_id)
            ids = ids.astype("<u4")
            total = np.diff(off)
            count = -(-total // capacity)
            first = total - (count - 1) * capacity
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = off[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [pa.array(number + np.arange(len(row))), batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            number += len(row)
            yield pa.record_batch(columns, ["id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return text_rows(df, id_col, text_col).mapInArrow(tidy(run), "id long, doc_id long, piece int, start long, length long, ids_crc32 long")


def swept(rows: DataFrame, n: int) -> DataFrame:
    """Range-sorts gaps and pieces and adds, within a partition, the bracket sum before each row and its lowest value so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, low = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            step = np.where(batch["kind"].to_numpy() == GAP, 1, -1)
            before = total + np.cumsum(step) - step
            lows = np.minimum(np.minimum.accumulate(before), low) if len(step) else before
            if len(step):
                total, low = int(before[-1] + step[-1]), int(lows[-1])
            yield pa.record_batch([*(batch[c] for c in ("kind", "id", "size")), pa.array(np.full(len(step), part, np.int32)), pa.array(before), pa.array(lows)], ["kind", "id", "size", "part", "sum", "low"])

    keys = [F.desc("size"), F.asc("kind"), F.xxhash64("id")]
    return rows.repartitionByRange(max(1, -(-n // SORT_ROWS)), *keys).sortWithinPartitions(*keys).mapInArrow(run, SWEPT)


def matched(sweep: DataFrame) -> DataFrame:
    """Each gap and piece with the other that it is matched with, if any."""
    step = F.when(F.col("kind") == GAP, 1).otherwise(-1)
    # One row per partition of the sort, for SORT_ROWS rows each: the sum over it and the lowest point in it.
    ends = sorted((r.part, r.total, r.low) for r in sweep.groupBy("part").agg(F.sum(step).alias("total"), F.min(F.col("sum") + F.least(step, F.lit(0))).alias("low")).collect())
    depth, into = 0, {}
    for part, total, low in ends:
        into[part] = depth
        depth = max(depth + total, total - min(low, 0))
    enter = sweep.sparkSession.createDataFrame(list(into.items()), "part int, enter long")
    before = F.greatest(F.col("enter") + F.col("sum"), F.col("sum") - F.least(F.col("low"), F.lit(0)))
    rows = sweep.join(enter, "part").withColumn("level", F.when(F.col("kind") == GAP, before + 1).otherwise(before))
    none = rows.filter((F.col("kind") == PIECE) & (F.col("level") <= 0)).select("kind", "id", "size", F.lit(None).cast("long").alias("other"), F.lit(None).cast("int").alias("other_size"))
    at = W.partitionBy("level").orderBy(F.desc("size"), "kind", F.xxhash64("id"))
    side = lambda c: F.when(F.col("kind") == PIECE, F.lag(c).over(at)).when(F.lead("kind").over(at) == PIECE, F.lead(c).over(at))
    paired = rows.filter((F.col("kind") == GAP) | (F.col("level") > 0)).select("kind", "id", "size", side("id").alias("other"), side("size").alias("other_size"))
    return paired.unionByName(none)


def openers(lengths: list[tuple[int, int]], capacity: int, number: int) -> tuple:
    """Which of the pieces left open a sequence: the longest, as many as their total length needs; of the last length a share chosen by hash."""
    need = -(-sum(length * n for length, n in lengths) // capacity)
    for length, n in sorted(lengths, reverse=True):
        if n >= need:
            share = 1.0 if n <= 64 else min(1.0, max(need, 8) / n)
            chosen = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 20)) < int(share * (1 << 20))
            return (F.col("size") > length) | ((F.col("size") == length) & chosen)
        need -= n
    return F.lit(True)


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """For rows (id, length): id, sequence_id, offset. Sequence ids are ids of the pieces that open them."""
    size = F.col("length").cast("int").alias("size")
    opens = pieces.filter(F.col("length") * 2 > capacity)
    places = [opens.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.filter(F.col("length") * 2 <= capacity).select(F.lit(PIECE).alias("kind"), "id", size)
    gaps = opens.filter(F.col("length") < capacity).select(F.lit(GAP).alias("kind"), "id", (capacity - F.col("length")).cast("int").alias("size"))
    counts = {(r.kind, r.size): r["count"] for r in left.unionByName(gaps).groupBy("kind", "size").count().collect()}
    number = 0
    while any(kind == PIECE for kind, _ in counts):
        number += 1
        least = min(s for kind, s in counts if kind == PIECE)
        n = sum(c for (kind, s), c in counts.items() if kind == PIECE or s >= least)
        sweep = table(swept(left.unionByName(gaps.filter(F.col("size") >= least)), n), "sweep")
        result = table(matched(sweep), "match")
        drop_table(sweep)
        done = result.filter((F.col("kind") == PIECE) & F.col("other").isNotNull())
        places.append(done.select("id", F.col("other").alias("sequence_id"), (capacity - F.col("other_size")).cast("long").alias("offset")))
        rest = result.filter((F.col("kind") == PIECE) & F.col("other").isNull()).select("kind", "id", "size")
        gaps = result.filter(F.col("kind") == GAP).select("kind", "id", (F.col("size") - F.coalesce("other_size", F.lit(0))).alias("size"))
        counts = {(r.kind, r.size): r["count"] for r in rest.unionByName(gaps).groupBy("kind", "size").count().collect()}
        lengths = [(s, c) for (kind, s), c in counts.items() if kind == PIECE]
        still, before = sum(c for _, c in lengths), n - sum(c for (kind, s), c in counts.items() if kind == GAP)
        left = rest
        if still and (before - still) < LEAST_MATCHED * before:
            opening = openers(lengths, capacity, number)
            first = rest.filter(opening)
            left = rest.filter(~opening)
            places.append(first.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            gaps = gaps.unionByName(first.select(F.lit(GAP).alias("kind"), "id", (capacity - F.col("size")).alias("size")))
            counts = {(r.kind, r.size): r["count"] for r in left.unionByName(gaps).groupBy("kind", "size").count().collect()}
    out = places[0]
    for more in places[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = table(pieces_of(df, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pieces.join(best_fit(pieces, capacity), "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
