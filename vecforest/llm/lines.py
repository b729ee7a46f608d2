"""Repeated runs of lines, found by content-defined chunks.

A rolling hash over the hashes of WINDOW lines ends a chunk where it meets a fixed
pattern, so chunks are cut alike wherever the same lines stand. A chunk has two lines
that are not empty unless its text has fewer, and in periodic lines a chunk is a
period. Chunks are counted over the corpus by hash; those that repeat bring their
texts together.

A repeated run hardly ever ends with a chunk, so chunks are extended to both sides: in
a repeated chunk and the chunks beside it, windows that reach from one line that is not
empty to the next are compared, first by hash, then by their bytes, which only
repeated hashes send. Windows that stand at an earlier place too, at a smaller id or
nearer the start of the text, go; a longer run is the union of its windows, as chunks
inside it repeat themselves. So what goes is always a byte-equal run of two or more
lines that are not empty, and all of a run goes that holds a whole chunk; a short run
that no chunk fits in stays. The first window stays; of three or more equal lines in a
row, two stay. A line's first place in the corpus never goes. Empty lines before and
after a run stay. A chunk counts as removed if all of it lies in removed lines.

Defined results: null text counts as empty; lines end at line feeds, and bytes are
compared without the last line feed; a null id comes after all others; rows with the
same id and text are told apart by nothing, so their first windows stay in both; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.llm.common import kept_row, row_key, split_by, table, whole_text, with_row
from vecforest.llm.textops import RollingHash, buffer_of, mix, parts_by_bytes

WINDOW, LINES_A_CHUNK = 2, 2
#: Longest period, in lines, that ends chunks.
PERIOD = 8
CHUNKS = "key binary, begin int, hash long"
WINDOWS = "key binary, doc_id long, begin int, second int, end int, hash long"


def text_lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line: document, begin and end in the buffer, the end without its line feed."""
    feed = np.flatnonzero(raw == 0x0A)
    start = np.union1d(feed + 1, off[:-1])
    start = start[start < len(raw)]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    doc = np.searchsorted(off, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(raw)), off[doc + 1])
    return doc, start, end - (raw[end - 1] == 0x0A)


def line_windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each two lines that are not empty and have only empty lines between them: document, begin of both, end of the second without its line feed, hash."""
    doc, start, bare = text_lines(raw, off)
    full = np.flatnonzero(bare > start)
    one, two = full[:-1], full[1:]
    same = doc[one] == doc[two]
    one, two = one[same], two[same]
    return doc[one], start[one], start[two], bare[two], RollingHash(raw).of(start[one], bare[two]).view(np.int64)


def periodic_ends(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in two or more periods of up to PERIOD lines, and those of them that end a period, counted from the first line of the run; a period of one line ends at every second."""
    n = np.arange(len(h))
    inside, ends = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for p in range(1, PERIOD + 1):
        same = (n - p >= first) & (h == h[np.maximum(n - p, 0)])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            a -= p
            if b - a >= max(2 * p, 3) and not inside[a:b].any():
                inside[a:b] = True
                ends[a + max(p, 2) - 1 : b : max(p, 2)] = True
                if a:
                    ends[a - 1] = True
    return inside, ends


def line_chunks(raw: np.ndarray, off: np.ndarray, window: int, lines: int) -> tuple[np.ndarray, ...]:
    """For each chunk: document, number in it, begin and end in the buffer (the end without the last line feed), lines, lines that are not empty, hash."""
    doc, start, bare = text_lines(raw, off)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    rolling = RollingHash(raw)
    h = rolling.of(start, bare)
    first = np.searchsorted(start, off[:-1])[doc]  # the first line of each line's document
    n = np.arange(len(start))
    rolled = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(window):
            at = n - back
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + np.where(at >= first, h[np.maximum(at, 0)], np.uint64(0))
    last = (mix(rolled) % np.uint64(lines) == 0) & (n - first >= window - 1)
    inside, period = periodic_ends(h, first)
    last = np.where(inside, period, last | period)
    closing = np.append(doc[1:] != doc[:-1], True)
    filled = np.append(0, np.cumsum(bare > start))
    ends = np.flatnonzero(last | closing)
    stop: list[int] = []
    since, opened = 0, True  # filled lines before this chunk; no chunk of this document yet
    for e, f, c in zip(ends.tolist(), filled[ends + 1].tolist(), closing[ends].tolist(), strict=True):
        if f - since > 1:
            stop.append(e)
            since, opened = f, False
        elif c and not opened:
            stop[-1] = e  # what is too short at the end of a text goes to the chunk before
        elif c:
            stop.append(e)
        if c:
            since, opened = f, True
    stop = np.array(stop)
    begin = np.append(0, stop[:-1] + 1)
    d = doc[begin]
    return d, np.arange(len(d)) - np.searchsorted(d, d), start[begin], bare[stop], stop - begin + 1, filled[stop + 1] - filled[begin], rolling.of(start[begin], bare[stop]).view(np.int64)


def windows_near(raw: np.ndarray, off: np.ndarray, repeated: list[np.ndarray], window: int, lines: int) -> tuple[np.ndarray, ...]:
    """The line_windows() in chunks that begin at the places `repeated` of each document, and in the chunks beside them."""
    d, _, begin, *_ = line_chunks(raw, off, window, lines)
    doc, one, two, end, h = line_windows(raw, off)
    if not len(doc):
        return doc, one, two, end, h
    wanted = np.concatenate([r + o for r, o in zip(repeated, off[:-1], strict=True)]) if repeated else np.zeros(0, np.int64)
    hit = np.isin(begin, wanted)
    beside = d[1:] == d[:-1]
    near = hit.copy()
    near[1:] |= hit[:-1] & beside
    near[:-1] |= hit[1:] & beside
    keep = near[np.searchsorted(begin, one, side="right") - 1] & near[np.searchsorted(begin, two, side="right") - 1]
    return doc[keep], one[keep], two[keep], end[keep], h[keep]


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges of whole lines (ends without line feeds), those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, lines: int = LINES_A_CHUNK, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, n_removed_bytes, kept_sha256, kept_text, row (the kept columns). The result does not depend on hash_bits."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), kept_row(keep).alias("row"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"]):
                raw, off = buffer_of(part)
                doc, _, begin, _, _, filled, h = line_chunks(raw, off, window, lines)
                some = filled > 1
                doc, begin, h = doc[some], begin[some], h[some]
                yield pa.record_batch([batch["key"].take(pa.array(doc + done)), pa.array((begin - off[doc]).astype(np.int32)), pa.array(h)], ["key", "begin", "hash"])
                done += len(part)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"]):
                raw, off = buffer_of(part)
                repeated = [np.array(r, np.int64) for r in batch["chunks"].slice(done, len(part)).to_pylist()]
                doc, begin, second, end, h = windows_near(raw, off, repeated, window, lines)
                at = pa.array(doc + done)
                done += len(part)
                yield pa.record_batch([batch["key"].take(at), batch["doc_id"].take(at), *(pa.array((c - off[doc]).astype(np.int32)) for c in (begin, second, end)), pa.array(h >> (64 - hash_bits))], [c.split()[0] for c in WINDOWS.split(", ")])

    chunks = table(rows.select("key", "text").mapInArrow(find, CHUNKS), "chunks")
    # Tables, so that joins with them can be split at a hash that a third of the texts have.
    common = table(chunks.groupBy("hash").count().filter("count > 1").select("hash"), "common")
    met = table(chunks.join(common, "hash").groupBy("key").agg(F.collect_set("begin").alias("chunks")), "met")
    near, _ = split_by(rows.select("key", "doc_id", "text"), "key", met)
    windows = table(near.join(met, "key").select("key", "doc_id", "text", "chunks").mapInArrow(extend, WINDOWS), "windows")
    twice = table(windows.groupBy("hash").count().filter("count > 1").select("hash"), "twice")
    per_text = table(windows.join(twice, "hash").groupBy("key").agg(F.collect_set(F.struct("doc_id", "begin", "second", "end", "hash")).alias("windows")), "asked")
    texts, _ = split_by(rows.select("key", "text"), "key", per_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts_by_bytes(batch["text"]):
                raw, off = buffer_of(part)
                asked = batch["windows"].slice(done, len(part))
                text = np.repeat(np.arange(len(part)), asked.value_lengths().to_numpy())
                found = asked.flatten()
                begin, end = (found.field(c).to_numpy() + off[text] for c in ("begin", "end"))
                ends = np.append(0, np.cumsum(end - begin))
                data = raw[np.repeat(begin - ends[:-1], end - begin) + np.arange(ends[-1])]
                cuts = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.record_batch([batch["key"].take(pa.array(text + done)), *(found.field(c) for c in ("doc_id", "begin", "second", "end", "hash")), cuts], ["key", "doc_id", "begin", "second", "end", "hash", "bytes"])
                done += len(part)

    sent = per_text.join(texts, "key").select("key", "text", "windows").mapInArrow(cut, f"{WINDOWS}, bytes binary")
    # The bytes themselves are compared: where the least and the greatest of a hash agree, all are equal. Each task sends one row for each hash; members meet the first in a join that Spark can split.
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"), F.col("begin"), F.col("end"))
    firsts = table(sent.groupBy("hash").agg(F.min(place).alias("first"), (F.min("bytes") != F.max("bytes")).alias("mixed")), "firsts")
    member = per_text.select("key", F.inline("windows")).join(firsts.filter("not mixed"), "hash")
    mixed = firsts.filter("mixed").select("hash")
    if not mixed.isEmpty():  # different bytes of one hash: told apart by the bytes
        apart = sent.join(mixed, "hash")
        member = member.drop("mixed").unionByName(apart.join(apart.groupBy("hash", "bytes").agg(F.min(place).alias("first")), ["hash", "bytes"]).drop("bytes"))
    # The line that a window shares with its own first stays.
    shared = (F.col("key") == F.col("first.key")) & (F.col("begin") <= F.col("first.end"))
    range_ = F.struct(F.when(shared, F.col("second")).otherwise(F.col("begin")).alias("begin"), "end")
    gone = table(member.filter(place != F.col("first")).groupBy("key").agg(F.collect_set(range_).alias("gone")), "gone")
    some, rest = split_by(rows, "key", gone)
    none = F.lit(None).cast(gone.schema["gone"].dataType)
    ready = some.join(gone, "key", "left").select("doc_id", "text", "row", "gone").unionByName(rest.select("doc_id", "text", "row", none.alias("gone")))
    fields = ["n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "n_removed_bytes"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            chunks: list[tuple[np.ndarray, np.ndarray]] = []
            for part in parts_by_bytes(batch["text"]):
                raw, off = buffer_of(part)
                d, _, begin, end, *_ = line_chunks(raw, off, window, lines)
                at = np.searchsorted(d, np.arange(1, len(part)))
                chunks += zip(np.split(begin - off[d], at), np.split(end - off[d], at), strict=True)
            for text, (begins, ends), gone in zip(batch["text"].to_pylist(), chunks, batch["gone"].to_pylist(), strict=True):
                raw = text.encode()
                gone = joined_ranges([(g["begin"], g["end"]) for g in gone or ()])
                kept, at, n_gone, chunks_gone = [], 0, 0, 0
                for begin, end in gone:
                    kept.append(raw[at:begin])
                    at = min(len(raw), end + 1)
                    n_gone += raw.count(b"\n", begin, end) + 1
                    chunks_gone += int(((begins >= begin) & (ends <= end)).sum())
                kept = b"".join([*kept, raw[at:]])
                n = raw.count(b"\n") + (bool(raw) and not raw.endswith(b"\n"))
                out.append((n, len(begins), chunks_gone, n_gone, len(raw) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode() if gone else text))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.record_batch([batch["doc_id"], *columns, batch["row"]], ["doc_id", *fields, "kept_sha256", "kept_text", "row"])

    return ready.mapInArrow(remove, with_row(f"doc_id long, {', '.join(f'{f} long' for f in fields)}, kept_sha256 string, kept_text string", rows))
