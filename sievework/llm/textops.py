"""Vectorised text primitives shared by the Arrow operators.

Texts stay as UTF-8 bytes in Arrow buffers.  Words are maximal runs of bytes other than ASCII white space
(`[^\\x20\\x09-\\x0D]+`), which is the same on bytes as on code points because UTF-8 continuation bytes are
all above 0x7F.  Word and n-gram hashes are 64-bit polynomials followed by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xC2B2AE3D27D4EB4F

#: Bytes of text handled at once inside a Python worker; 64-bit temporaries take eight times as much each.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Alphanumeric words of benchmark matching: every byte but `\x00-\x2F \x3A-\x60 \x7B-\x7F`.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        step, filled = base, 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * U64(step)
            step, filled = step * step % (1 << 64), 2 * filled
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the published splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """Byte view of some documents: `data` uint8, document i at offsets[i]:offsets[i + 1]; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]

    @staticmethod
    def of(texts: list[bytes]) -> Texts:
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))


def view(column: pa.Array) -> Texts:
    """Zero-copy view of an Arrow string column (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return Texts(raw[first : int(offsets[-1])], offsets - first)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch into runs of rows of about `most` bytes of text (a longer text is a run of its own)."""
    whole = view(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(whole)
    while i < n:
        j = max(i + 1, int(np.searchsorted(whole.offsets, whole.offsets[i] + most, "right")) - 1)
        a, b = whole.offsets[i], whole.offsets[j]
        yield batch.slice(i, j - i), Texts(whole.data[a:b], whole.offsets[i : j + 1] - a)
        i = j


def words(t: Texts, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words in order; words of document i are first[i]:first[i + 1]."""
    inside = ~gap[t.data]
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[t.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, t.offsets)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for every span."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power_table(_BASE, n), out=total[1:])
    return mix((total[e] - total[s]) * _power_table(_BASE_INV, n + 1)[s] + (e - s).astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (one for each start; empty if there are fewer than k)."""
    if len(h) < k:
        return np.zeros(0, U64)
    have, done, out, at = {1: h}, 1, None, 0
    while done * 2 <= k:
        g = have[done]
        have[done * 2] = g[:-done] * U64(pow(_GRAM, done, 1 << 64)) + g[done:]
        done *= 2
    m = len(h) - k + 1
    for size in sorted(have, reverse=True):
        if k & size:
            part = have[size][at : at + m]
            out = part if out is None else out * U64(pow(_GRAM, size, 1 << 64)) + part
            at += size
    return mix(out + U64(k))


def owner(first: np.ndarray) -> np.ndarray:
    """Document number of every word, from words()'s `first`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the integer ranges start, ..., start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
