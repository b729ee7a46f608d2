"""Token ids by the tokenizers library, a batch at a time.

Byte-level pre-splitting never matches across a safe cut (textops.safe_cuts), and no
cut stands in an added token such as `<|endoftext|>`, which becomes its own id. So a batch's distinct pieces are encoded once and their ids gathered for every
place where they stand. Pieces that meet at such cuts are encoded in one string, whose ids
are told apart by the bytes that each stands for. A worker remembers a bounded number of pieces.
"""

from __future__ import annotations

import functools
import itertools
import os
from array import array

import numpy as np
import pyarrow as pa

from vecforest.llm import textops

#: Pieces and ids that a Python worker remembers before it forgets those that it met once, pieces encoded at once, pieces in one string.
MEMO_PIECES, MEMO_IDS, AT_ONCE, JOINED = 200_000, 4_000_000, 20_000, 64
#: Bytes of text that are handled at once.
PART_BYTES = 2 << 20


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[bytes, ...]:
    """Strings that the library takes for one token wherever they stand in a text."""
    return tuple(t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values())


@functools.lru_cache(maxsize=4)
def id_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id stands for: a byte-level token has one sign for each."""
    added = {i: len(t.content.encode()) for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    size = {i: len(token) for token, i in tokenizer(path).get_vocab().items()} | added
    out = np.zeros(max(size) + 1, np.int64)
    out[list(size)] = list(size.values())
    return out


class Memo:
    """Ids of the pieces met so far: a number for each piece, and its ids in one flat array."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.start = array("I"), array("q", [0])
        self.again = bytearray()

    def shrink(self) -> None:
        """Keeps the pieces that were asked for again since the last time, or none where these are over half of the bound."""
        keep = np.flatnonzero(np.frombuffer(self.again, np.uint8))
        flat, start, names = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64), list(self.number)
        n = np.diff(start)[keep]
        ends = np.cumsum(n)
        self.clear()
        if len(keep) and len(keep) <= MEMO_PIECES // 2 and ends[-1] <= MEMO_IDS // 2:
            self.flat.frombytes(flat[np.repeat(start[keep] - ends + n, n) + np.arange(ends[-1])].tobytes())
            self.start.frombytes(ends.tobytes())
            self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
            self.again = bytearray(len(keep))

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        if len(self.number) > MEMO_PIECES or len(self.flat) > MEMO_IDS:
            self.shrink()
        raw, off = textops.buffer_of(distinct)
        data, edges = raw.tobytes(), off.tolist()
        keys = list(map(data.__getitem__, map(slice, edges[:-1], edges[1:])))
        found = np.fromiter(map(self.number.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        np.frombuffer(self.again, np.uint8)[found[found >= 0]] = 1
        missing = np.flatnonzero(found < 0)
        joins = textops.joins(raw, off[missing], off[missing + 1], added_tokens(self.path))
        for which, encode in ((missing[joins], self.joined), (missing[~joins], self.single)):
            for some in (which[s : s + AT_ONCE] for s in range(0, len(which), AT_ONCE)):
                mine = [keys[i] for i in some.tolist()]
                n = encode(mine, off[some + 1] - off[some])
                first = len(self.start) - 1
                found[some] = np.arange(first, first + len(mine))
                self.number.update(zip(mine, range(first, first + len(mine)), strict=True))
                self.start.frombytes((self.start[-1] + np.cumsum(n)).astype(np.int64).tobytes())
                self.again.extend(bytes(len(mine)))
        return found

    def single(self, pieces: list[bytes], size: np.ndarray) -> np.ndarray:
        """Encodes pieces one by one into the flat array; how many ids each has."""
        found = [e.ids for e in tokenizer(self.path).encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        for ids in found:
            self.flat.extend(ids)
        return np.fromiter(map(len, found), np.int64, len(found))

    def joined(self, pieces: list[bytes], size: np.ndarray) -> np.ndarray:
        """The same for pieces that may meet in one string; where its ids do not end with the pieces, these are encoded one by one."""
        parts = [slice(s, s + JOINED) for s in range(0, len(pieces), JOINED)]
        counts = []
        for part, e in zip(parts, tokenizer(self.path).encode_batch_fast([b"".join(pieces[p]).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            done, ends = np.cumsum(id_bytes(self.path)[ids]), np.cumsum(size[part])
            last = np.searchsorted(done, ends)
            if len(ids) and done[-1] == ends[-1] and (done[last] == ends).all():
                self.flat.frombytes(ids.tobytes())
                counts.append(np.diff(last, prepend=-1))
            else:
                counts.append(self.single(pieces[part], size[part]))
        return np.concatenate(counts)


@functools.lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    return Memo(path)


textops.HELD.append(memo.cache_clear)


def _encode_part(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, and how many each has."""
    raw, off = textops.buffer_of(texts)
    which, distinct, first = textops.coded_pieces(raw, off, added_tokens(path))
    known = memo(path)
    which = known.numbers(distinct)[which]
    flat, start = np.frombuffer(known.flat, np.uint32) if known.flat else np.zeros(1, np.uint32), np.frombuffer(known.start, np.int64)
    n = np.diff(start)[which]
    at = np.concatenate([[0], np.cumsum(n)])
    narrow = np.int32 if max(at[-1], len(flat)) < 1 << 31 else np.int64
    place = np.repeat((start[which] - at[:-1]).astype(narrow), n)
    place += np.arange(at[-1], dtype=narrow)
    ids = flat[place]
    first = at[first]
    if end_id is not None:
        ids = np.insert(ids, first[1:], end_id)
        first = first + np.arange(len(first))
    return ids.astype(np.uint32, copy=False), np.diff(first)


def encode_batch(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch (uint32) and the n + 1 offsets of its documents; end_id is appended to each document."""
    found = [_encode_part(part, path, end_id) for part in textops.parts_by_bytes(texts, PART_BYTES)]
    ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint32)
    return ids, np.concatenate([[0], *(np.cumsum(np.concatenate([n for _, n in found])) if found else [[]],)]).astype(np.int64)
