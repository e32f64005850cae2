"""Words, lines and windows of whole texts as NumPy arrays over Arrow buffers.

Texts stay UTF-8 bytes. A slice of a batch (about ``SLICE_BYTES``, one text at least) becomes one
byte array; words are (start, end) pairs in it. Their 64-bit hashes are multilinear: each byte times a
random key of its place in the span, so that two different spans collide with probability 2**-56 at
most, whatever their structure. ``distinct`` numbers words by their bytes, without a hash. Prefix
sums of a polynomial give the hash of any span in O(1), but have structured collisions: they only
find candidates that are verified afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text, and the lower-casing of A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
INK_BYTES = np.ones(256, bool)
INK_BYTES[[32, 9, 10, 11, 12, 13]] = False

_keys: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` of the step and of its inverse."""
    global _powers
    if len(_powers[0]) <= n:
        made = []
        for base in (_STEP, _BACK):
            p = np.full(n + 1, base, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def keys(n: int, which: int = 0) -> np.ndarray:
    """At least ``n`` random keys, one for each place in a span; ``which``: one of two independent series."""
    if len(_keys[which]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _keys[which] = mix(mix(np.arange(size, dtype=U) + U(0x5851F42D4C957F2D + which)) + U(0x14057B7EF767814F * (which + 1) % (1 << 64)))
    return _keys[which]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a hash (finaliser of a public 64-bit hash)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Slice:
    """Some texts of a batch: ``buf`` holds their bytes, ``at[i]:at[i + 1]`` those of text ``i``."""

    def __init__(self, first: int, buf: np.ndarray, at: np.ndarray):
        self.first, self.buf, self.at, self.n = first, buf, at, len(at) - 1

    def prefix(self, codes: np.ndarray = _CODES) -> np.ndarray:
        """Prefix sums for ``poly_hash``; ``codes`` maps a byte to its 64-bit code (0: ignored)."""
        p, _ = powers(len(self.buf))
        h = np.zeros(len(self.buf) + 1, U)
        np.cumsum(codes[self.buf] * p[: len(self.buf)], out=h[1:])
        return h

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of true bytes (or of one class above 0) that stay within one text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(len(inside) + 1, bool)
        joined[1:-1] = inside[1:] == inside[:-1]
        joined[self.at] = False
        on = inside > 0
        return np.flatnonzero(on & ~joined[:-1]), np.flatnonzero(on & ~joined[1:]) + 1

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """Offsets of each text's spans in ``starts`` (n + 1 of them)."""
        return np.searchsorted(starts, self.at).astype(np.int64)


def poly_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of any spans from the prefix sums of ``Slice.prefix``; for candidates only."""
    _, back = powers(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * back[starts])


def _inside(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the symbols of all spans, end to end, and the place of each in its own span."""
    own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return own + np.repeat(starts, size), own


def span_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Multilinear hashes of the spans of ``symbols`` (bytes or code points)."""
    size = ends - starts
    out = np.zeros(len(size), U)
    full = np.flatnonzero(size)
    if len(full):
        at, own = _inside(starts, size)
        value = symbols[at].astype(U)
        value += U(1)
        value *= keys(int(size.max()), which)[own]
        out[full] = np.add.reduceat(value, (np.cumsum(size) - size)[full])
    return mix(out + size.astype(U))


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words among the spans (as bytes, in order of appearance), and the number of each span's word."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at, _ = _inside(starts, size)
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(buf[at])])
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def spans_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words that ``distinct`` gives."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], at[1:]


def windows(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words within a text, and the index of their first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for back in range(1, k):  # windows that would cross the start of a text
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return window_hash(h, at, k), at


def window_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each word index in ``at``."""
    factor = keys(k, 1)
    total = h[at] * factor[0]
    for j in range(1, k):
        total += h[at + j] * factor[j]
    return mix(total + U(k))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of strings into slices; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Slice(lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi
    pa.default_memory_pool().release_unused()  # else a worker keeps the room of several batches


def with_doc(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The columns of ``docs`` other than ``text`` (``whole``: all of them) in the struct ``doc``, so that no name can clash, and the text."""
    kept = [F.col(f"`{c}`") for c in docs.columns if whole or c != "text"]
    return docs.select(F.struct(*(kept or [F.lit(None).cast("string").alias("none")])).alias("doc"), F.col("text").alias("_text"))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets (empty ranges give 0)."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """Index of the text of each span, from its per-text offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def code_points(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (one entry more than bytes)."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total
