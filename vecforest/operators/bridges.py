"""Similar pairs across roots, with blocks of rows that cannot hold any left out.

Rows are cut into blocks of like vectors: in the order of root, leaf and side of a few
seeded planes. A block is summed up by its roots, its mean direction, the largest angle
of a member to that, and its longest vector. For two blocks the angle between the
directions less both largest angles bounds the cosine of every pair from above, so
pairs of blocks below the threshold are not compared, nor are two blocks of one and the
same root. The bounds are exact: no pair is lost.

Blocks meet in groups. A task holds the rows of one group and reads those of the other
block by block, so what it holds does not depend on how many pairs it finds. The blocks
are cut into GROUPS groups, so that a row is sent about as many times at any number of
rows, until a group's vectors have HELD bytes; beyond that there are more groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vecforest.operators.clustering import seeded_planes
from vecforest.sources.tables import materialize

#: Rows of a block, summaries of blocks compared at once, and planes that order the rows of a leaf.
BLOCK, SUMMARIES, PLANES = 256, 1024, 12
#: Groups of blocks, least blocks of a group, and bytes of vectors that a task holds at most; rows that meet a block at once, and pairs that a task collects before it sends them.
GROUPS, LEAST, HELD, STRIP, SENT = 12, 4, 1 << 25, 2048, 1 << 16
DIGITS, SCALE = 6, 225.0
PAIRS = "i long, j long, score double, leaf_i string, leaf_j string"


def _matrix(t: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    v = t[name].combine_chunks() if isinstance(t, pa.Table) else t[name]
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def like_blocks(vecs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Writes rows (block, doc_id, vector, leaf, root, x, y, z) in blocks of like vectors."""

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            if len(batch):
                x = _matrix(batch)
                code = (x @ seeded_planes("blocks", PLANES, x.shape[1]).T >= 0) @ (1 << np.arange(PLANES))
            yield pa.record_batch([*batch.columns, pa.array(code)], [*batch.schema.names, "side"])

    place = [F.col(c).cast("double").alias(c) if c in vecs.columns else F.lit(0.0).alias(c) for c in "xyz"]
    rows = vecs.select("doc_id", "vector", F.col("leaf").cast("string").alias("leaf"), F.col("root").cast("string").alias("root"), *place)
    rows = rows.mapInArrow(side, "doc_id long, vector array<double>, leaf string, root string, x double, y double, z double, side long")
    order = ["root", "leaf", "side", "doc_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumns({"part": F.shiftright("at", 33).cast("int"), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row for each partition
    base = rows.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return materialize(rows.join(base, "part").withColumn("block", F.floor((F.col("base") + F.col("at")) / block)).drop("part", "at", "base", "side"))


def block_summaries(rows: DataFrame) -> DataFrame:
    """(block, n, first_root, last_root, direction, angle, longest) of blocks, whose size is bounded."""

    def summary(t: pa.Table) -> pa.Table:
        x, root = _matrix(t), t["root"].to_pylist()
        length = np.linalg.norm(x, axis=1)
        unit = x / np.where(length > 0, length, 1)[:, None]
        mean = unit.sum(0)
        size = np.linalg.norm(mean)
        c = mean / size if size > 1e-10 else unit[0]
        angle = np.arccos(np.clip(unit @ c, -1, 1))[length > 0].max(initial=0.0) if np.linalg.norm(c) > 0 else np.pi
        return pa.table([[t["block"][0].as_py()], [len(x)], [min(root)], [max(root)], [c.tolist()], [float(angle)], [float(length.max())]], ["block", "n", "first_root", "last_root", "direction", "angle", "longest"])

    known = rows.select("block", F.coalesce("root", F.lit("")).alias("root"), "vector")
    return materialize(known.groupBy("block").applyInArrow(summary, "block long, n long, first_root string, last_root string, direction array<double>, angle double, longest double"))


def block_pairs(summaries: DataFrame, tau: float) -> DataFrame:
    """(i, j, why) over all pairs of blocks i <= j, summed up: the pairs to compare with why null, and for each of i the number of others by why they are left out.

    SUMMARIES summaries meet as many others in a task, which sends the pairs that remain.
    """
    n = summaries.agg(F.max("block")).first()[0]
    parts = 0 if n is None else n // SUMMARIES + 1

    def compare(t: pa.Table) -> pa.Table:
        a, b = t["p"][0].as_py(), t["q"][0].as_py()
        own = t["part"].to_numpy()
        out = {"i": [], "j": [], "why": [], "n": []}
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        block, c, angle, longest = t["block"].to_numpy(), _matrix(t, "direction"), t["angle"].to_numpy(), t["longest"].to_numpy()
        first, last = np.array(t["first_root"].to_pylist()), np.array(t["last_root"].to_pylist())
        between = np.arccos(np.clip(c[left] @ c[right].T, -1, 1)) - angle[left][:, None] - angle[right] - 1e-7
        most = np.cos(np.maximum(between, 0)) * longest[left][:, None] * longest[right]
        most = np.where(np.cos(np.minimum(np.maximum(between, 0), np.pi)) < 0, 0.0, most)
        pair = block[left][:, None] <= block[right]
        same = pair & (first[left] == last[left])[:, None] & (first[left][:, None] == first[right]) & (first[right] == last[right])
        far = pair & ~same & (most < tau - 10.0**-DIGITS)
        r, s = np.nonzero(pair & ~same & ~far)
        out["i"] += block[left][r].tolist()
        out["j"] += block[right][s].tolist()
        out["why"] += [None] * len(r)
        out["n"] += [1] * len(r)
        for why, which in (("one root", same), ("out of reach", far)):
            count = which.sum(1)
            some = np.flatnonzero(count)
            out["i"] += block[left][some].tolist()
            out["j"] += [None] * len(some)
            out["why"] += [why] * len(some)
            out["n"] += count[some].tolist()
        return pa.table([pa.array(out["i"], pa.int64()), pa.array(out["j"], pa.int64()), pa.array(out["why"], pa.string()), pa.array(out["n"], pa.int64())], ["i", "j", "why", "n"])

    rows = summaries.withColumn("part", F.floor(F.col("block") / SUMMARIES)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts - 1, 0)).cast("long"))))
    rows = rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other")
    return materialize(rows.groupBy("p", "q").applyInArrow(compare, "i long, j long, why string, n long"))


def pruning(pairs: DataFrame) -> DataFrame:
    """(why, n): how many pairs of blocks were compared, and how many left out because of what."""
    return pairs.groupBy(F.coalesce("why", F.lit("compared")).alias("why")).agg(F.sum("n").alias("n"))


def group_size(blocks: int, block: int, width: int) -> int:
    """How many blocks of `block` rows go to a task together."""
    return max(LEAST, min(-(-blocks // GROUPS), HELD // (8 * block * max(width, 1))))


def _best_of_leaves(i: np.ndarray, j: np.ndarray, s: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs those with the best score of their two leaves; ties go to the smaller ids."""
    low, high = np.where(p < q, p, q).astype(str), np.where(p < q, q, p).astype(str)
    order = np.lexsort((j, i, -s, high, low))
    first = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
    return tuple(z[order[first]] for z in (i, j, s, p, q))


def meetings(rows: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the groups p and q need to be compared: which blocks meet a block of p (kind 0), the rows of p (kind 1), and those of q (kind 2)."""
    last, first = pairs.agg(F.max("i")).first()[0], rows.select(F.size("vector")).first()
    group = group_size(0 if last is None else last + 1, block, first[0] if first else 0)
    where = materialize(pairs.filter("why IS NULL").select("i", "j", F.floor(F.col("i") / group).alias("p"), F.floor(F.col("j") / group).alias("q")))
    fields = ["doc_id", "vector", "leaf", "root", "x", "y", "z"]
    lists = where.groupBy("p", "q", F.col("i").alias("block")).agg(F.collect_list("j").alias("others")).withColumn("kind", F.lit(0))
    left = rows.join(where.select("p", "q", F.col("i").alias("block")).distinct(), "block").withColumn("kind", F.lit(1))
    right = rows.join(where.select("p", "q", F.col("j").alias("block")).distinct(), "block").withColumn("kind", F.lit(2))
    return left.unionByName(right).select("p", "q", "kind", "block", *fields).unionByName(lists, allowMissingColumns=True)


def compared(rows: DataFrame, pairs: DataFrame, tau: float, best_per_leaf_pair: bool = False, max_length: float | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs i < j of different roots with a similarity of tau or more, from the pairs of blocks to compare: i, j, score, leaf_i, leaf_j.

    With max_length, places farther apart (in units of SCALE) are dropped in the task;
    with best_per_leaf_pair a task then sends only its best pair of two leaves.
    """

    def arrays(t: pa.RecordBatch) -> dict[str, np.ndarray]:
        texts = {c: np.array(t[c].to_pylist() + [None], object)[:-1] for c in ("leaf", "root")}
        return texts | {"block": t["block"].to_numpy(), "ids": t["doc_id"].to_numpy(), "vector": _matrix(t), "place": np.stack([t[d].to_numpy() for d in "xyz"], 1)}

    def meet(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        score = a["vector"] @ b["vector"].T
        r, c = np.nonzero(score >= tau - 2 * 10.0**-DIGITS)
        s = np.round(score[r, c], DIGITS) + 0.0
        keep = (s >= tau) & (a["root"][r] != b["root"][c]) & ((a["block"][r] != b["block"][c]) | (a["ids"][r] < b["ids"][c]))
        if max_length is not None:
            keep &= np.sqrt(((a["place"][r] - b["place"][c]) ** 2).sum(1)) / SCALE <= max_length + 1e-9
        r, c, s = r[keep], c[keep], s[keep]
        i, j, p, q = a["ids"][r], b["ids"][c], a["leaf"][r], b["leaf"][c]
        swap = i > j
        i, j, p, q = np.where(swap, j, i), np.where(swap, i, j), np.where(swap, q, p), np.where(swap, p, q)
        return _best_of_leaves(i, j, s, p, q) if best_per_leaf_pair and len(i) else (i, j, s, p, q)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, partners, held, left, found = None, {}, [], None, []

        def sent() -> pa.RecordBatch:
            columns = [np.concatenate(z) for z in zip(*found, strict=True)]
            found.clear()
            return pa.record_batch([pa.array(c if t != pa.string() else c.tolist(), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()), strict=True)], ["i", "j", "score", "leaf_i", "leaf_j"])

        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("p", "q", "kind", "block")], 1)
            edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)) if len(key) else np.zeros(1, int)
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                p, q, kind, number = key[start].tolist()
                if at != (p, q):
                    at, partners, held, left = (p, q), {}, [], None
                part = batch.slice(start, end - start)
                if kind == 0:
                    for others in part["others"].to_pylist():
                        for other in others:
                            partners.setdefault(other, []).append(number)
                    continue
                if kind == 1:
                    held.append(arrays(part))
                    continue
                if left is None:
                    left = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                    held = []
                own = np.flatnonzero(np.isin(left["block"], partners[number]))
                b = arrays(part)
                for k in range(0, len(own), STRIP):
                    some = own[k : k + STRIP]
                    found.append(meet({c: z[some] for c, z in left.items()}, b))
                    if sum(len(f[0]) for f in found) >= SENT:
                        if best_per_leaf_pair:
                            found[:] = [_best_of_leaves(*(np.concatenate(z) for z in zip(*found, strict=True)))]
                        if not best_per_leaf_pair or len(found[0][0]) >= SENT // 2:
                            yield sent()
        if found:
            if best_per_leaf_pair and any(len(f[0]) for f in found):
                found[:] = [_best_of_leaves(*(np.concatenate(z) for z in zip(*found, strict=True)))]
            yield sent()

    return meetings(rows, pairs, block).repartition("p", "q").sortWithinPartitions("p", "q", "kind", "block").mapInArrow(search, PAIRS)
