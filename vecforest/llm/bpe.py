"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before a space that follows a letter or digit. The
pre-splitting pattern never matches across such a place, and nothing before it
looks beyond it, so the parts' ids joined are the whole text's ids. A stretch of
more than HUGE characters without such a place is split by the pattern itself.

Defined results: null text counts as empty and gives no ids; repeated rows give
repeated results; other columns are not touched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecforest.llm.common import text_rows

LONG, HUGE = 20_000, 40_000
SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) ")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, long: int = LONG) -> Iterator[str]:
    at = 0
    while len(text) - at > long and (cut := SAFE.search(text, at + long)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, rank_file: str, pattern: str, long: int = LONG, huge: int = HUGE) -> list[int]:
    enc = encoding(rank_file, pattern)
    ids: list[int] = []
    for part in safe_parts(text, long):
        if len(part) <= huge:
            ids += enc.encode_ordinary(part)
        else:
            for match in regex.finditer(pattern, part):
                ids += enc._encode_single_piece(match[0].encode())
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes; ids need not end at a character's end."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def bpe_round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch["text"].to_pylist():
                ids = encode(text, rank_file, pattern)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves, for use by other jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(text, rank_file, pattern) for text in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")
