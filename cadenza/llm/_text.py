"""Vectorised text primitives over Arrow string columns.

Texts stay in the Arrow buffer: words are found, hashed and windowed with NumPy over slices of
about ``CHUNK`` bytes, so a Python worker's memory does not depend on the size of a batch, only on
the longest single text. Words are hashed eight bytes at a time (``word_hash``) wherever a hash proposes what may be
equal; what is equal is decided by ``exact_codes``, which compares bytes. ``span_hash``, a polynomial read off a prefix
sum, serves features only: long words made for it can share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every byte of a multi-byte character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


_BYTES = random_u64(256, 7)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                p = np.full(size, U64(base))
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte span."""
    up, _ = _grow(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _grow(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes over which a word is hashed by a digest.
_LONG = 256


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span. A step is a bijection of the eight bytes and of what came before, so spans of equal length that differ
    in one such block never share a hash. Spans over ``_LONG`` bytes take a keyed digest."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * U64(_BASE) + U64(1))
    if not len(size):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    blocks = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    at, own, left = starts, slice(None), size
    for done in range(0, _LONG, 8):
        out[own] = mix(out[own] ^ (blocks[at] & _MASKS[np.minimum(left, 8)])) + _M1
        more = left > 8
        own = np.flatnonzero(size > done + 8)
        if not len(own):
            return out
        at, left = at[more] + 8, left[more] - 8
    for k in own.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"words").digest(), "little")
    return out


def exact_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every byte span of ascending, disjoint ones: equal if and only if the bytes are."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    edges = np.empty(2 * n + 1, np.int64)  # spans and the gaps behind them in turn
    edges[:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1]
    every = pa.Array.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf))])
    return every.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


def exact_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for every ``n`` consecutive codes: equal if and only if the codes are. Windows with equal hashes are compared; if some differ, another
    hash is taken."""
    seed = 0
    while True:
        grams = gram_hash(mix(codes.astype(np.uint64) + U64(seed * _BASE % (1 << 64))), n)
        order = np.argsort(grams)
        new = np.ones(len(grams), bool)
        new[1:] = grams[order[1:]] != grams[order[:-1]]
        a, b = order[1:][~new[1:]], order[:-1][~new[1:]]
        if all((codes[a + k] == codes[b + k]).all() for k in range(n)):
            out = np.empty(len(grams), np.int64)
            out[order] = np.cumsum(new) - 1
            return out
        seed += 1


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and its texts' offsets into them, from 0."""
    data, offs = buffers(column)
    return data[offs[0] : offs[-1]], offs - offs[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        lengths = np.diff(offsets)
        if lengths[np.asarray(column.is_null())].any():
            return buffers(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, target: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of slices of about ``target`` bytes of whole texts."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(buf: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with ``latin`` also the two-byte capitals from À to Þ."""
    out = LOWER[buf]
    if latin and len(out) > 1:
        up = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` within each text: starts, ends, and the number of runs before each text."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offs[:-1][offs[:-1] < n]
    begin[cuts] |= inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offs[1:][offs[1:] > 0] - 1
    end[cuts] |= inside[cuts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes (texts' borders are the caller's)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    n, out, have = len(x) - w + 1, x, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)
