"""Token ids in compressed binary blocks with one shared zstandard dictionary.

Format: a block is one binary value, a row of a Parquet table, and so is
committed by Spark and can lie in any store that Spark writes to:

    magic "VFT1", sha256 of the dictionary (32 bytes), id width in bytes (u1),
    number of documents n (u4), doc ids (n x i8), null flags of the ids (n x u1),
    token counts (n x u4), offsets of the frames (n + 1 x u8), frames

All numbers are little-endian. Each document is a zstandard frame of its own, so
one document is read by its offset without the rest of the block. Rows carry the
smallest and largest id of the block, by which Parquet skips other blocks, and
the number of ids before the block in its part. Parts are ranges of ids.

The dictionary is trained on at most SAMPLE_DOCS documents and the first SAMPLE_IDS ids
of each (a model's sample, as documented); it changes the size of the files, never what is read back.

Defined results: null text counts as empty and is the end id alone; a null id
comes before all others; repeated ids stand in order of their token counts and
bytes; a text of any length is one frame; an empty table makes an empty file.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vecforest.llm.common import new_path, table, text_rows
from vecforest.llm.tokens import encode_batch

MAGIC = b"VFT1"
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES, LEVEL = 400, 1 << 15, 64 << 10, 3
BLOCK_BYTES = 2 << 20
#: Bytes of input text that a part should hold.
PART_BYTES = 32 << 20
RUN = 4096
FRAMES = "part int, doc_id long, n_tokens long, frame binary"
BLOCKS = "part int, block int, first_id long, last_id long, n_docs long, n_tokens long, start_in_part long, payload binary"


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample; empty where zstandard finds too little to train on."""
    import zstandard

    sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("text")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, off = encode_batch(batch["text"], tokenizer_path, end_id)
            ids = ids.astype(f"<u{width}")
            yield pa.record_batch([pa.array([ids[a:b][:SAMPLE_IDS].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in sample.mapInArrow(arrays, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


@functools.lru_cache(maxsize=2)
def codecs(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def pack_block(rows: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int) -> bytes:
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], "u1")
    count = np.array([r[1] for r in rows], "<u4")
    at = np.zeros(len(rows) + 1, "<u8")
    at[1:] = np.cumsum([len(r[2]) for r in rows])
    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<BI", width, len(rows))
    return b"".join([head, ids.tobytes(), null.tobytes(), count.tobytes(), at.tobytes(), *(r[2] for r in rows)])


class Block:
    """Reads a block; document(i) decompresses one document only."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:4] != MAGIC or payload[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of this dictionary")
        self.width, n = struct.unpack_from("<BI", payload, 36)
        at = 41
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.null = np.frombuffer(payload, "u1", n, at := at + 8 * n)
        self.counts = np.frombuffer(payload, "<u4", n, at := at + n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at := at + 4 * n)
        self.frames = memoryview(payload)[at + 8 * (n + 1) :]
        self.decompress = codecs(dictionary)[1].decompress

    def document(self, i: int) -> np.ndarray:
        frame = self.frames[int(self.offsets[i]) : int(self.offsets[i + 1])]
        return np.frombuffer(self.decompress(frame), f"<u{self.width}").astype("<u4")


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, vocab_size: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes blocks in ascending order of ids under path/blocks, the dictionary under path/dictionary."""
    spark = df.sparkSession
    docs = text_rows(df, id_col, text_col)
    width = 2 if vocab_size <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = codecs(dictionary)[0].compress
        for batch in batches:
            ids, off = encode_batch(batch["text"], tokenizer_path, end_id)
            ids = ids.astype(f"<u{width}")
            packed = [compress(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            part = np.searchsorted(bounds, batch["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            yield pa.record_batch([pa.array(part), batch["doc_id"], pa.array(np.diff(off)), pa.array(packed, pa.binary())], ["part", "doc_id", "n_tokens", "frame"])

    # Ranges of ids from the id column alone: a range sort of the frames would encode every text twice.
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-(stats.chars or 0) // PART_BYTES))
    bounds = docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 and stats.n else []
    bounds = np.array(sorted({int(b) for b in bounds}), np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, at, number, before = [], 0, None, 0, 0

        def out() -> pa.RecordBatch:
            ids = [r[0] for r in rows if r[0] is not None]
            tokens = sum(r[1] for r in rows)
            values = [at, number, min(ids, default=None), max(ids, default=None), len(rows), tokens, before, pack_block(rows, dictionary, width)]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()], strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for p, doc, n, frame in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"].to_pylist(), strict=True):
                if rows and (p != at or size >= BLOCK_BYTES):
                    yield out()
                    number, before = (0, 0) if p != at else (number + 1, before + sum(r[1] for r in rows))
                    rows, size = [], 0
                at = p
                rows.append((doc, n, frame))
                size += len(frame)
        if rows:
            yield out()

    (
        docs.mapInArrow(frames, FRAMES).repartitionById(len(bounds) + 1, "part")
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
        .mapInArrow(blocks, BLOCKS).write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(f"{path}/blocks")
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids. With doc_ids only the blocks that may hold them are read."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # Ids before each part: sums within runs of RUN parts, then over the runs, so that no task sorts all parts.
    sums = blocks.groupBy("part", F.floor(F.col("part") / RUN).alias("run")).agg(F.sum("n_tokens").alias("n"))
    runs = sums.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A table of its own: Spark knows its size, and sends it out where it is small instead of shuffling the blocks.
    base = table(sums.withColumn("within", within).join(runs, "run").select("part", (F.col("within") + F.col("earlier")).alias("base")), "starts")
    if doc_ids is not None:
        wanted = F.lit(False)
        for i in doc_ids:
            wanted = wanted | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.filter(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(batch["start"].to_pylist(), batch["payload"], strict=True):
                block = Block(payload.as_py(), dictionary)
                picked = [i for i in range(len(block.doc_ids)) if doc_ids is None or block.doc_ids[i] in doc_ids and not block.null[i]]
                starts = before + np.concatenate([[0], np.cumsum(block.counts.astype(np.int64))])
                for some in (picked[i : i + 500] for i in range(0, len(picked), 500)):
                    ids = [block.document(i) for i in some]
                    if any(len(x) != block.counts[i] for i, x in zip(some, ids, strict=True)):
                        raise ValueError("a document's length differs from the index")
                    yield pa.record_batch([
                        pa.array(block.doc_ids[some], mask=block.null[some] == 1), pa.array(starts[:-1][some]), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), *([pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    placed = blocks.join(base, "part").select((F.col("start_in_part") + F.col("base")).alias("start"), "payload")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_file_digests(df: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = new_path(df.sparkSession, "tokens")
    write_token_files(df, path, tokenizer_path, end_id, vocab_size, id_col, text_col)
    return read_token_files(df.sparkSession, path, with_ids=False)
