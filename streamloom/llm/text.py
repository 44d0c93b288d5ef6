"""Vectorised text primitives shared by the corpus operators.

Everything works on slices of an Arrow batch of bounded size, so a worker's
memory follows ``SLICE_BYTES`` (or the longest single text), never the batch.
Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 16 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums H with H[e] - H[s] the polynomial hash of data[s:e], scaled by BASE**s."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * _power(_BASE, "up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    inverse = _power(_BASE_INV, "down", len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Bytes of a word from which it is hashed by itself: polynomials modulo 2^64 of long strings have structured collisions.
LONG_WORD = 32


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, which are short but for a few; those go through XXH3."""
    out = span_hash(prefix_hash(data, lower), start, end)
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        word = data[start[i] : end[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


class Slice:
    """Consecutive rows of a batch: their bytes end to end, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end, document index and hash of each word, in order."""
        ws = _WS[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        solid = ~ws
        begins, ends = solid.copy(), solid.copy()
        if len(solid):
            begins[1:] &= ws[:-1] | edge[1:-1]
            ends[:-1] &= ws[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(self.offsets, start, side="right") - 1
        return start, end, doc, word_hash(self.data, start, end, lower)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def shingles(words: np.ndarray, doc: np.ndarray, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each k-word shingle; a text of 1 to k-1 words gives its whole sequence as one."""
    n = len(words)
    count = np.bincount(doc, minlength=docs)
    out_doc, out_hash = [], []
    if n >= k:
        with np.errstate(over="ignore"):
            h = np.zeros(n - k + 1, dtype=np.uint64)
            for i in range(k):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i])
        whole = doc[: n - k + 1] == doc[k - 1 :]
        out_doc.append(doc[: n - k + 1][whole])
        out_hash.append(h[whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        h = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            more = count[short] > i
            h[more] = mix(h[more] * np.uint64(0x9FB21C651E98DF25) + words[first[more] + i] + np.uint64(1))
        out_doc.append(short)
        out_hash.append(h)
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, h = np.concatenate(out_doc), np.concatenate(out_hash)
    order = np.argsort(d, kind="stable")
    return d[order], h[order]
