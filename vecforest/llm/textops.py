"""Vectorised helpers on Arrow string batches, shared by the text operators.

A batch is seen as one byte buffer with document offsets; words, lines, pieces
and rolling hashes are NumPy passes over that buffer, never per-row Python.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are handled at once: a bound on the memory of a Python worker. LARGE_PART is for work that keeps only a few arrays.
PART_BYTES, LARGE_PART = 1 << 20, 4 << 20
KEPT_POWERS = PART_BYTES + (1 << 17)
LONG_WORD = 255
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 1 << 64)


#: What frees the memory that an operator holds from task to task in a Python worker.
HELD: list[Callable[[], None]] = []


def spare(held: bool = True) -> None:
    """Gives memory back to the machine that earlier tasks of this Python worker left behind: workers serve one operator after another."""
    for free in HELD if held else []:
        free()
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], held: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives its memory back at its end, so that a worker that waits for its next task holds little."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        spare(held)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that low and high bits are usable alike."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One random-looking 64-bit value for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for usual parts of a batch are kept."""
    if n <= KEPT_POWERS:
        if base not in _powers:
            _powers[base] = _new_powers(KEPT_POWERS, base)
        return _powers[base][:n]
    return _new_powers(n, base)


def _new_powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * U(pow(base, have, 1 << 64))
            have += take
    return out


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n + 1 offsets of the documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts_by_bytes(texts: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of whole texts of about this many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


class RollingHash:
    """Hashes of any byte ranges of a buffer from one prefix sum.

    Sums of byte values times powers of an odd number, modulo 2**64; a range's
    sum is scaled back by the inverse power, and its length is mixed in.
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        with np.errstate(over="ignore"):
            self.sums = np.empty(n + 1, dtype=np.uint64)
            self.sums[0] = 0
            terms = BYTE_VALUES[raw]
            terms *= powers(n, MULT)
            np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(n + 1, MULT_INV)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(h + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words; those over LONG_WORD bytes by a digest, as long words can be made that sums modulo 2**64 do not tell apart."""
        h = self.of(start, end)
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def fixed(self, width: int) -> np.ndarray:
        """The hash of every range of this many bytes."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: n - width + 1])


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5)


#: True for the separators 0x20 and 0x09 to 0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-separators within a document, and the number of words of each document."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = ~SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, off))
    return start, end, counts


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for every `width` word hashes in a row."""
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            s = (s ^ h[j : j + n]) * U(MULT)
            s ^= s >> U(29)
    return s


def long_shingles(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The shingle set of one long text in lower case, its words hashed about PART_BYTES at a time."""
    found, at = [], 0
    while at + width <= len(start):
        stop = max(at + width, int(np.searchsorted(end, start[at] + PART_BYTES)))
        part = raw[start[at] : end[stop - 1]]
        h = RollingHash(part).words(part, start[at:stop] - start[at], end[at:stop] - start[at])
        found.append(np.unique(mix(chained(h, width))))
        at = stop - width + 1
    return np.unique(np.concatenate(found))


def shingles(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and the n + 1 offsets into them.

    Words are split at ASCII white space and compared with A-Z in lower case. A
    document with fewer words than the width has one shingle of all of them; one
    without words has none.
    """
    raw = lower_ascii(raw)
    start, end, counts = words(raw, off)
    if len(off) == 2 and len(raw) > 2 * PART_BYTES and len(start) >= width:
        found = long_shingles(raw, start, end, width)
        return found, np.array([0, len(found)])
    h = RollingHash(raw).words(raw, start, end)
    first = np.concatenate([[0], np.cumsum(counts)])
    n_docs = len(counts)
    parts_doc, parts_hash = [], []
    with np.errstate(over="ignore"):
        if len(h) >= width:
            s = chained(h, width)
            n = len(s)
            doc = np.repeat(np.arange(n_docs), counts)
            whole = doc[:n] == doc[width - 1 :]
            parts_doc.append(doc[:n][whole])
            parts_hash.append(mix(s[whole]))
        for k in range(1, width):
            d = np.flatnonzero(counts == k)
            if len(d):
                s = np.full(len(d), k, np.uint64)
                for j in range(k):
                    s = (s ^ h[first[d] + j]) * U(MULT)
                    s ^= s >> U(29)
                parts_doc.append(d)
                parts_hash.append(mix(s + U(k)))
    if not parts_doc:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    doc, val = np.concatenate(parts_doc), np.concatenate(parts_hash)
    if len(parts_doc) > 1:
        order = np.argsort(doc, kind="stable")
        doc, val = doc[order], val[order]
    at = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    sets = [np.unique(val[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


#: ASCII marks that end a run of letters, and ASCII letters.
MARK = np.isin(np.arange(256), list(b"!,.:;?|*#$%&)"))
LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))


def closed(last: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether a text ends in a character that is surely no white space: a printable ASCII character or a two-byte character with a lead byte from C3 to DF."""
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF))


def safe_cuts(raw: np.ndarray, off: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where a text can be cut so that byte-level tokenizers see each part alone.

    A cut stands before a space or line feed that follows a character that is
    surely no white space: a printable ASCII character or a two-byte character
    with a lead byte from C3 to DF. No token of the pre-splitting pattern goes on
    from such a character into white space. Another stands between a letter (ASCII, or
    U+00C0 to U+00FF) and a mark, as no token goes on from a letter into a mark. None stands within one
    of the strings `whole`. Document starts are cuts as well, and the end of the buffer is the last.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(1, np.int64)
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[at > 1]
    cuts = np.zeros(n + 1, bool)
    cuts[at[closed(raw[at - 1], raw[at - 2])]] = True
    mark = np.flatnonzero(MARK[raw])
    mark = mark[mark > 1]
    before, lead = raw[mark - 1], raw[mark - 2]
    cuts[mark[LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    data = raw.tobytes() if whole else b""
    for token in whole:
        found = data.find(token)
        while found >= 0:
            cuts[found + 1 : found + len(token)] = False
            found = data.find(token, found + len(token))
    cuts[off] = True
    return np.flatnonzero(cuts)


def joins(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Which pieces can stand side by side in one string: where two of them meet is a safe cut, and no string of `whole` can run over it."""
    fits = end - begin > 1
    if any(b" " in token or b"\n" in token for token in whole):
        fits[:] = False
    begin, end = begin[fits], end[fits]
    fits[fits] = ((raw[begin] == 0x20) | (raw[begin] == 0x0A)) & closed(raw[end - 1], raw[end - 2])
    return fits


def coded_pieces(raw: np.ndarray, off: np.ndarray, whole: tuple[bytes, ...] = ()) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cuts a batch at safe_cuts: the index of each piece's distinct text, the distinct texts, and the n + 1 offsets of documents into the pieces."""
    cuts = safe_cuts(raw, off, whole)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    arr = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = arr.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(cuts, off)


def pieces(raw: np.ndarray, off: np.ndarray, whole: tuple[bytes, ...] = ()) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The same with the distinct texts as strings."""
    which, distinct, first = coded_pieces(raw, off, whole)
    return which, distinct.to_pylist(), first
