"""Hard negatives by score windows over Hilbert-ordered Parquet blocks with zone maps.

Candidates are written as Parquet in the order of label and place on a Hilbert curve
through the dimensions of the largest variance. ZONE rows in that order are a zone,
GROUP zones a block. A zone map keeps the least and the largest value of every
dimension in a zone, and its labels. For an anchor, interval arithmetic over these
gives bounds of its inner products in a zone: where the bounds miss all of the
anchor's windows, or the zone has no row of the wanted labels, it is not read. Only
blocks with a zone that some anchor of a block of anchors needs are joined with it.

A search has two passes. The first reads, for every anchor, the zone that promises the
highest scores; the score of the k-th hit in a window then raises the lower end
of that window, and the second pass reads the zones that can still hold a better hit.
Positives are such a search over the anchor's own label with an open window; negatives
one over the other labels, with a window for each positive.

Defined results: rows with a null id or label, and vectors that are null, or hold
null or non-finite components, or are of another length than most take no part; zero
vectors do. Ties go to the smaller id; where fewer rows fit, all are returned. Rows
that share an id are each a row, for other ids; as an anchor such an id is asked once,
with its greatest vector and label. A window of a negative positive score is empty. An
empty table gives an empty result. A product that does not fit in a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.llm.common import table
from vecforest.llm.vectors import NONE, best_of_rows, first_ranks, matrix, moments, number_type, ranked, whole_vectors

SCALE, ZONE, GROUP, ANCHORS, ZONES, STEP = 256, 256, 16, 800, 4096, 128
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
OPEN = 1 << 62
HITS = "anchor_id long, slot int, vec_id long, score long"


def hilbert_keys(cell: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole coordinates with `bits` bits (Skilling's transform)."""
    x = cell.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    q = bit
    while q > 1:
        below = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), bit
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve(rows: DataFrame, n: int, width: int) -> DataFrame:
    """Adds the place of each row on the Hilbert curve through the dimensions of the largest variance."""
    total, squares = moments(rows, width)
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    dims = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMENSIONS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(0, np.int64)
            if len(batch):
                place = (matrix(batch)[:, dims] - mean[dims]) / np.where(spread[dims] > 0, 6 * spread[dims], 1) + 0.5
                key = hilbert_keys(np.clip(np.floor(place * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.record_batch([*batch.columns, pa.array(key)], [*batch.schema.names, "curve"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, curve long")


def zone_maps(rows: DataFrame) -> DataFrame:
    """(zone, least, largest, label_least, label_largest): a task merges the rows of a zone before they are shuffled."""

    def merged(table_: pa.Table | pa.RecordBatch, low: str, high: str, label_low: str, label_high: str) -> list[pa.RecordBatch]:
        zone = table_["zone"].to_numpy()
        if not len(zone):
            return []
        order = np.argsort(zone, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(zone[order]) != 0))
        lists = lambda m: pa.array(list(m.astype(np.int64)), pa.list_(pa.int64()))
        columns = [pa.array(zone[order][at]), lists(np.minimum.reduceat(matrix(table_, low)[order], at)), lists(np.maximum.reduceat(matrix(table_, high)[order], at))]
        columns += [pa.array(f.reduceat(table_[c].to_numpy()[order], at)) for f, c in ((np.minimum, label_low), (np.maximum, label_high))]
        return [pa.record_batch(columns, ["zone", "least", "largest", "label_least", "label_largest"])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from merged(batch, "x", "x", "label", "label")

    def whole(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(merged(t, "least", "largest", "label_least", "label_largest"))

    schema = "zone long, least array<long>, largest array<long>, label_least long, label_largest long"
    return rows.select("zone", "label", "x").mapInArrow(partial, schema).groupBy("zone").applyInArrow(whole, schema)


def score_bounds(q: np.ndarray, least: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of each row of q with all vectors between least and largest, by interval arithmetic."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ least.T + down @ largest.T, up @ largest.T + down @ least.T


class Zones:
    """Blocks of n candidates (block, zone, vec_id, label, x) and their zone maps, which searches choose from for blocks of anchors."""

    def __init__(self, rows: DataFrame, n: int, anchor_blocks: int, kind: type):
        self.rows, self.anchor_blocks, self.kind = rows, anchor_blocks, kind
        self.maps = table(zone_maps(rows), "zones").withColumn("part", F.floor(F.col("zone") / ZONES).cast("int"))
        self.parts = -(-n // (ZONE * ZONES))

    def needed(self, asked: DataFrame, same: bool, best: bool) -> DataFrame:
        """(ab, at, block, mask): the zones of a block, as bits, that each anchor's windows must read; with best only the zone of the highest upper bound."""
        kind = self.kind

        def choose(z: pa.Table, a: pa.Table) -> pa.Table:
            names, out = ["ab", "at", "block", "mask", "bound"], []
            if len(z) and len(a):
                order = np.argsort(z["zone"].to_numpy())
                zone = z["zone"].to_numpy()[order]
                low, high = (c.astype(np.int64) for c in score_bounds(matrix(a).astype(kind), matrix(z, "least").astype(kind)[order], matrix(z, "largest").astype(kind)[order]))
                first, last, label = z["label_least"].to_numpy()[order], z["label_largest"].to_numpy()[order], a["label"].to_numpy()[:, None]
                fits = (first <= label) & (label <= last) if same else ~((first == label) & (last == label))
                near = np.zeros_like(fits)
                for row, windows in enumerate(a["windows"].to_pylist()):
                    for w in windows:
                        near[row] |= (high[row] >= w["low"]) & (low[row] <= w["high"])
                fits &= near
                if best:
                    top = np.where(fits, high, NONE)
                    row = np.flatnonzero(fits.any(1))
                    col = top[row].argmax(1)
                else:
                    row, col = np.nonzero(fits)
                key = row * (1 << 32) + zone[col] // GROUP  # by rising row and zone
                at = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, int)
                mask = np.add.reduceat(1 << (zone[col] % GROUP), at) if len(at) else np.zeros(0, np.int64)
                row, col = row[at], col[at]
                out = [a["ab"].to_numpy()[row], a["at"].to_numpy()[row], zone[col] // GROUP, mask, high[row, col]]
            return pa.table([pa.array(c) for c in out] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)

        # ZONES zone maps meet a block of anchors in a task.
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = self.maps.withColumn("ab", every(self.anchor_blocks)).groupBy("part", "ab")
        right = asked.select("ab", "at", "label", "x", "windows").withColumn("part", every(self.parts)).groupBy("part", "ab")
        out = left.cogroup(right).applyInArrow(choose, "ab int, at int, block long, mask long, bound long")
        if best:
            out = out.groupBy("ab", "at").agg(F.max(F.struct("bound", "block", "mask")).alias("b")).select("ab", "at", "b.block", "b.mask")
        return table(out.select("ab", "at", "block", "mask"), "needed")

    def search(self, asked: DataFrame, same: bool, k: int, needed: DataFrame) -> DataFrame:
        """(anchor_id, slot, vec_id, score): the k best rows of each window in the blocks that are needed."""
        kind = self.kind

        def hits(b: pa.Table, a: pa.Table) -> pa.Table:
            out = []
            if len(b) and len(a):
                ids, x, label = b["vec_id"].to_numpy(), matrix(b).astype(kind), b["label"].to_numpy()
                bit = 1 << (b["zone"].to_numpy() % GROUP)
                anchor, q, own, mask = a["anchor_id"].to_numpy(), matrix(a).astype(kind), a["label"].to_numpy(), a["mask"].to_numpy()
                windows = a["windows"].to_pylist()
                for s in range(0, len(a), STEP):
                    rows = np.arange(s, min(s + STEP, len(a)))
                    read = np.flatnonzero(bit & np.bitwise_or.reduce(mask[rows]))
                    score = (q[rows] @ x[read].T).astype(np.int64)
                    alike = own[rows][:, None] == label[read]
                    score[(alike if not same else ~alike) | (anchor[rows][:, None] == ids[read]) | ((mask[rows][:, None] & bit[read]) == 0)] = NONE
                    for place in range(max(len(windows[r]) for r in rows)):
                        some = np.array([i for i, r in enumerate(rows) if place < len(windows[r])])
                        w = [windows[rows[i]][place] for i in some]
                        low, high, slot = (np.array([v[c] for v in w])[:, None] for c in ("low", "high", "slot"))
                        mine = score[some]
                        mine[(mine < low) | (mine > high)] = NONE
                        r, c = best_of_rows(mine, ids[read], k)
                        out.append((anchor[rows[some]][r], slot[r, 0], ids[read][c], mine[r, c]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "vec_id", "score"])

        left = self.rows.join(needed.select("ab", "block").distinct(), "block").select("ab", "block", "zone", "vec_id", "label", "x").groupBy("ab", "block")
        right = asked.join(needed, ["ab", "at"]).select("ab", "block", "anchor_id", "label", "x", "windows", "mask").groupBy("ab", "block")
        return left.cogroup(right).applyInArrow(hits, HITS)

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, slot, rank, vec_id, score): the k best rows of every window of the anchors (ab, at, anchor_id, label, x, windows)."""
        first = first_ranks(self.search(asked, same, k, self.needed(asked, same, True)), k, "anchor_id", "slot")
        least = first.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("least"))  # one entry for each window
        raised = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.try_element_at(F.col("least"), w["slot"]))))
        asked = table(asked.join(least, "anchor_id", "left").withColumn("windows", raised).drop("least"), "asked")
        return table(first_ranks(self.search(asked, same, k, self.needed(asked, same, False)), k, "anchor_id", "slot"), "best")


def whole_part(product: str) -> str:
    """SQL for a hundredth of a product of longs, rounded down, without rounding errors."""
    return f"(({product}) - pmod({product}, 100L)) div 100L"


def hard_negatives(
    df: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, anchor: Column | None = None, label: Column | None = None, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each anchor and each of its positives, the first negatives with least % to most % of the positive's score: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col("label") if label is None else label
    whole = whole_vectors(df, scale, 0, id_col, vector_col, label=label.cast("long"))
    if not whole.n:
        return spark.createDataFrame([], schema)
    kind = number_type(whole.width, whole.largest)
    asked = whole.rows.filter(F.col("vec_id") % 50 == 0 if anchor is None else anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.max(F.struct("x", "label")).alias("r"))
    asked = table(asked.select("anchor_id", "r.*"), "anchors")
    anchor_blocks = max(1, -(-asked.count() // ANCHORS))
    order = ranked(curve(whole.rows, whole.n, whole.width), "label", "curve", "vec_id")
    zone = F.floor(F.col("rank") / ZONE)
    blocks = order.select(F.floor(zone / GROUP).alias("block"), zone.alias("zone"), "vec_id", "label", "x").sortWithinPartitions("zone")
    zones = Zones(table(blocks, "candidates"), whole.n, anchor_blocks, kind)
    ab = F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_blocks)).cast("int")
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    asked = asked.withColumn("ab", ab).withColumn("at", F.row_number().over(W.partitionBy("ab").orderBy("anchor_id")))
    asked = table(asked.withColumn("windows", F.array(window(F.lit(0), F.lit(-OPEN), F.lit(OPEN)))), "asked")
    chosen = zones.best(asked, True, positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = F.expr(f"-({whole_part(f'-{least}L * positive_score')})"), F.expr(whole_part(f"{most}L * positive_score"))
    windows = chosen.select("anchor_id", window(F.col("slot"), low, high).alias("w")).filter("w.low <= w.high").groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # one for each positive
    found = zones.best(table(asked.drop("windows").join(windows, "anchor_id"), "asked"), False, negatives)
    return found.join(chosen, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
