"""Long repeated byte strings, by sampled suffixes and induced order.

A full suffix array of a large corpus needs several bytes of disk for each byte of
text. Here only sampled suffixes are sorted, and the order and common-prefix
values of the others are induced from them, in shards that do not depend on each
other. Spark's sort, which spills to disk, stands for the disk-backed queues.

1. Of every string of `width` bytes, the gram (GRAM bytes) with the least hash is
   its sample; the last of equal ones counts. The choice depends on the string's
   bytes alone, so equal strings have equal samples at equal places. The strings
   of one sample start one after another: a sampled suffix stands for all of them.
2. Samples with a gram that occurs once are done: their strings are unique.
   Samples with equal surroundings (all bytes of their strings) are all repeated.
3. What is left is dealt out by gram and sorted: by the bytes right of the sample
   and, read backwards, by the bytes left of it, with the common-prefix value of
   each neighbour. Suffix by suffix to the left, two strings are equal if neither
   a common-prefix value between their right parts nor one between their left
   parts is too short; both follow from the sorted samples.
4. A gram with more than MANY different surroundings does not go to one task: its
   strings are counted over the cluster, each by a digest of all its bytes.

Strings count as equal by their bytes (3.) or, where these are not side by side, by
128 bits of BLAKE2b over all of them (2., 4.); the rolling hash only chooses samples.

Defined results: null text counts as empty; texts shorter than the width lose
nothing; repeated rows repeat each other's strings; rows with the same id and
text get the same result, also where the id is null; a text of any length is sampled
whole, in about 60 bytes of memory a byte; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.llm.common import kept_row, row_key, split_by, table, whole_text, with_row
from vecforest.llm.textops import RollingHash, buffer_of, parts_by_bytes, spare, tidy

GRAM, MANY, BATCH_ROWS = 100, 20_000, 8_000
#: Samples whose bytes are put side by side or compared at once.
STRIP = 1_000
LOW = np.uint64((1 << 36) - 1)
SAMPLES = "key binary, start int, strings int, left int, gram long, around binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, by minima within blocks from both sides."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def samples_of(raw: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each sample: document, first string's start in the buffer, number of strings, bytes from that start to the sample, hash of the gram."""
    if len(raw) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = RollingHash(raw).fixed(gram)
    at = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h & ~LOW) | (LOW - at), width - gram + 1)
    sample = (LOW - (least & LOW)).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int64)
    ends = off[1:]
    first = np.maximum(off[:-1], ends - width + 1)
    np.add.at(inside, first, 1)
    np.add.at(inside, ends, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(sample)] == 0)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    s = sample[start]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (start[1:] != start[:-1] + 1)]))
    strings = np.diff(np.append(new, len(start)))
    begin, at = start[new], s[new]
    doc = np.searchsorted(off, begin, side="right") - 1
    return doc, begin, strings, at - begin, h[at].view(np.int64)


def digest(data: bytes | memoryview) -> bytes:
    """By which bytes count as equal where they are not side by side: 128 bits of a cryptographic hash."""
    return hashlib.blake2b(data, digest_size=16).digest()


def equal_strings(group: np.ndarray, left: np.ndarray, strings: np.ndarray, around: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of some samples occur in two or more of the same group: (row, bytes from the string's start to the sample).

    Rows are sorted by the bytes right of the sample and by those left of it, read
    backwards. A class of right parts of n bytes ends where a neighbour's common
    prefix is shorter than n; likewise on the left. A string that starts d bytes
    before the sample has the left class of d and the right class of width - d.
    """
    n = len(group)
    raw = np.frombuffer(b"".join(around), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in around])])
    middle = begin[:-1] + left

    def classes(reach: int, at: np.ndarray, end: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        wide = 8 + 2 * reach
        keys = np.zeros((n, wide), np.uint8)
        keys[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
        grid = keys[:, 8:].view(">u2")
        for s in range(0, n, STRIP):  # a place takes eight bytes for the two that it puts into the grid
            place = at[s : s + STRIP, None] + sign * np.arange(reach)
            fits = place < end[s : s + STRIP, None] if sign > 0 else place >= end[s : s + STRIP, None]
            grid[s : s + STRIP] = np.where(fits, raw[np.clip(place, 0, len(raw) - 1)].astype(np.uint16) + np.uint16(1), np.uint16(0))
        order = np.argsort(keys.view(f"V{wide}").ravel(), kind="stable")
        common = np.full(n, -1)
        for s in range(1, n, STRIP):
            differs = grid[order[s : s + STRIP]] != grid[order[s - 1 : min(s + STRIP, n) - 1]]
            common[s : s + STRIP] = np.where(differs.any(axis=1), differs.argmax(axis=1), reach)
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
        return order, common

    longest = int(left.max(initial=0))
    right_order, right_common = classes(width, middle, begin[1:], 1)
    left_order, left_common = classes(max(longest, 1), middle - 1, begin[:-1], -1)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    rows, starts = [], []
    for d in range(longest + 1):
        here = np.flatnonzero((left >= d) & (left - strings < d))
        if len(here) < 2:
            continue
        right_class[right_order] = np.cumsum(right_common < width - d)
        left_class[left_order] = np.cumsum(left_common < d)
        both = left_class[here] * (n + 1) + right_class[here]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        twice = here[count[inverse] > 1]
        rows.append(twice), starts.append(np.full(len(twice), d))
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of a row: row, first, last."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], at[first], at[last]


def repeated_spans(docs: DataFrame, width: int, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """For rows (key, text): rows (key, begin, end), byte ranges of which each part is under a repeated string. Ranges may overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"]):
                raw, off = buffer_of(part)
                doc, begin, strings, left, h = samples_of(raw, off, width, gram)
                keys = batch["key"].slice(done, len(part)).take(pa.array(doc))
                done += len(part)
                view = memoryview(np.ascontiguousarray(raw))
                around = pa.array([digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + strings - 1 + width).tolist(), strict=True)], pa.binary())
                yield pa.record_batch([keys, *(pa.array(c.astype(np.int32)) for c in (begin - off[doc], strings, left)), pa.array(h), around], [c.split()[0] for c in SAMPLES.split(", ")])

    every = table(docs.mapInArrow(tidy(find), SAMPLES), "samples")
    twice = table(every.groupBy("gram").count().filter("count > 1").select("gram"), "twice")  # a table of its own, so that Spark can split a hot gram in the join
    hits = table(every.join(twice, "gram"), "hits")
    same = ["gram", "around", "left", "strings"]
    contexts = table(hits.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("at")), "contexts")
    whole = hits.join(contexts.filter("n > 1").select(*same), same).select("key", F.col("start").alias("begin"), (F.col("start") + F.col("strings") - 1 + width).alias("end"))

    # Grams with several surroundings, at least one of which stands alone.
    open_grams = table(contexts.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("gram", "m"), "open")
    asked = contexts.join(open_grams, "gram").select("gram", "m", "left", "strings", "n", "at.key", "at.start")
    per_text = table(asked.groupBy("key").agg(F.collect_list(F.struct("gram", "m", "left", "strings", "n", "start")).alias("asked")), "asked")
    texts, _ = split_by(docs, "key", per_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 100) for b in batches for s in range(0, len(b), 100)):
            for key, text, asked in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
                raw = text.encode()
                rows = {c: [a[c] for a in asked] for c in ("gram", "m", "left", "strings", "n", "start")}
                around = [raw[s : s + k - 1 + width] for s, k in zip(rows["start"], rows["strings"], strict=True)]
                yield pa.record_batch([pa.array([key] * len(asked), pa.binary()), *(pa.array(rows[c], pa.int64()) for c in rows), pa.array(around, pa.binary())], ["key", *rows, "around"])

    fields = "key binary, gram long, m long, left long, strings long, n long, start long, around binary"
    cuts = table(per_text.join(texts, "key").select("key", "text", "asked").mapInArrow(tidy(cut), fields), "cuts")

    def spans(t: pa.Table) -> pa.RecordBatch:
        key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        places = np.stack([t["gram"].to_numpy(), key, t["start"].to_numpy()], axis=1)
        t = t.take(pa.array(np.unique(places, axis=0, return_index=True)[1]))  # rows with equal id and text come twice
        _, group = np.unique(t["gram"].to_numpy(), return_inverse=True)
        left, start = t["left"].to_numpy(), t["start"].to_numpy()
        row, before = equal_strings(group, left, t["strings"].to_numpy(), t["around"].to_pylist(), width)
        alone = t["n"].to_numpy()[row] == 1
        row, first, last = _runs(row[alone], (start + left)[row[alone]] - before[alone])
        return pa.record_batch([t["key"].take(pa.array(row)).combine_chunks(), pa.array(first), pa.array(last + width)], ["key", "begin", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= BATCH_ROWS:
                t = pa.Table.from_batches(kept).combine_chunks()
                end = int(np.flatnonzero(t["gram"].to_numpy() != t["gram"][-1].as_py())[-1:].max(initial=-1)) + 1
                if end:
                    yield spans(t.slice(0, end))
                kept = t.slice(end).to_batches()
        if sum(map(len, kept)):
            yield spans(pa.Table.from_batches(kept))

    found = cuts.filter(F.col("m") <= many).repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(compare), "key binary, begin long, end long")

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram_hash, key, left, start, n, around in zip(*(batch[c].to_pylist() for c in ("gram", "key", "left", "start", "n", "around")), strict=True):
                view = memoryview(around)
                h = [digest(view[s : s + width]) for s in range(len(around) - width + 1)]
                k = len(h)
                yield pa.record_batch([pa.array([gram_hash] * k, pa.int64()), pa.array(left - np.arange(k)), pa.array(h, pa.binary()), pa.array([key] * k, pa.binary()), pa.array(start + np.arange(k)), pa.array([n] * k, pa.int64())], ["gram", "before", "hash", "key", "begin", "n"])

    large = cuts.filter(F.col("m") > many)
    each = large.mapInArrow(tidy(strings_of), "gram long, before long, hash binary, key binary, begin long, n long").distinct()
    again = each.groupBy("gram", "before", "hash").count().filter("count > 1").drop("count")
    hot = each.filter("n = 1").join(again, ["gram", "before", "hash"]).select("key", "begin", (F.col("begin") + width).alias("end"))
    return whole.unionByName(found).unionByName(hot)


def without_repeats(df: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), gram: int = GRAM, many: int = MANY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the kept columns in a struct `row`.

    kept_text leaves out characters of which a part was removed.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), kept_row(keep).alias("row"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    spans = repeated_spans(rows.select("key", "text"), width, gram, many)
    per_text = table(spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    some, rest = split_by(rows, "key", per_text)
    none = F.lit(None).cast("array<struct<begin:bigint,end:bigint>>")
    ready = some.join(per_text, "key", "left").select("doc_id", "text", "row", "spans").unionByName(rest.select("doc_id", "text", "row", none.alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw = text.encode()
                merged: list[list[int]] = []
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if merged else text))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)] if out else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()] * 2]
            yield pa.record_batch([batch["doc_id"], *columns, batch["row"]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "row"])

    return ready.mapInArrow(tidy(cut), with_row("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", rows))
