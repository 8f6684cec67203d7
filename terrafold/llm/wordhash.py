"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashing is a polynomial in
the bytes modulo 2^64 followed by an avalanche step, evaluated by prefix sums, so no Python
object is made per word. Two different words or shingles get one hash with a probability of
about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SEPARATORS = (0x20, *range(0x09, 0x0E))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_rng = np.random.default_rng(20240101)
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SEGMENT:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(column: pa.Array, fold: bool = True, trim: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row). fold: A-Z count as a-z; trim: ASCII bytes
    that do not count at either end of a word."""
    raw, off = buffers(column)
    total = len(raw)
    starts_doc = np.zeros(total + 1, bool)
    starts_doc[off[:-1]] = True
    hashes, begins = [], []
    table = _FOLDED if fold else _EXACT
    kept = np.ones(256, bool)
    kept[list(trim)] = False
    at = 0
    while at < total:
        end = min(total, at + SEGMENT)
        if end < total:
            gaps = np.flatnonzero(~_IS_WORD[raw[at:end]] | starts_doc[at:end])
            if len(gaps) and gaps[-1] > 0:
                end = at + int(gaps[-1])
            else:
                rest = end
                while rest < total:
                    more = np.flatnonzero(~_IS_WORD[raw[rest : rest + SEGMENT]] | starts_doc[rest : min(total, rest + SEGMENT)])
                    if len(more):
                        rest += int(more[0])
                        break
                    rest = min(total, rest + SEGMENT)
                end = rest
        part = raw[at:end]
        word = _IS_WORD[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | starts_doc[at + 1 : end]
        after = np.ones(len(part), bool)
        after[:-1] = ~word[1:] | starts_doc[at + 1 : end]
        s = np.flatnonzero(first)
        e = np.flatnonzero(word & after) + 1
        begin = s
        if trim:
            place = np.arange(len(part))
            inner = kept[part]
            following = np.minimum.accumulate(np.where(inner, place, len(part))[::-1])[::-1]
            s = np.minimum(following[s], e)
            e = np.maximum(np.maximum.accumulate(np.where(inner, place, -1))[e - 1] + 1, s)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _power(_BASE, len(part)), out=sums[1:])
        h = (sums[e] - sums[s]) * _power(_INVERSE, len(part) + 1)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        begins.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.diff(np.searchsorted(begin, off))


def shingles(column: pa.Array, width: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each row), repeats included.

    A row with fewer words than width, but at least one, has its whole sequence as one shingle.
    """
    w, counts = words(column, fold)
    ends = np.cumsum(counts)
    begins = ends - counts
    per_row = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    if not len(w):
        return np.zeros(0, np.uint64), per_row
    padded = np.concatenate([w, np.zeros(width, np.uint64)])
    all_at = np.zeros(len(w), np.uint64)
    for j in range(width):
        all_at += padded[j : j + len(w)] * _PLACE[j]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        all_at[begins[i]] = np.sum(w[begins[i] : ends[i]] * _PLACE[: counts[i]]) + np.uint64(counts[i])
    keep = np.zeros(len(w) + 1, np.int64)
    np.add.at(keep, begins[counts > 0], 1)
    np.add.at(keep, (begins + per_row)[counts > 0], -1)
    return mix(all_at[np.cumsum(keep[:-1]) > 0]), per_row
