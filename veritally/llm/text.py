"""Words of a batch of texts as arrays: where they lie and a hash of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers with well-spread bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xD6E8FEB86659FD93)
#: Masks of the lowest 0 to 8 bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 1024
_CHUNK = 1 << 20


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _spread(np.arange(1, 257, dtype=np.uint64) * MIX)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column back to back, and where each text begins (one more for the end)."""
    column = texts.fill_null("") if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (white space: 0x20 and 0x09-0x0D), and the text it is in."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    ink = (raw != 32) & ((raw < 9) | (raw > 13))
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    first = at[:-1][at[:-1] < at[1:]]
    starts[first] = ink[first]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = ink[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as an integer, zeros beyond the end."""
    wide = np.append(raw, np.zeros(24, np.uint8))
    return np.ndarray(len(wide) - 7, "<u8", wide.data, 0, (1,))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, by its bytes alone: eight at a time; words beyond ``LONG`` bytes by XXH64."""
    size, at = end - start, lanes(raw)
    out = _spread((at[start] & KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * MIX_2))
    live, step = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while live.size:
        lane = at[start[live] + step] & KEEP[np.minimum(size[live] - step, 8)]
        out[live] = _spread((out[live] ^ lane) * MIX + np.uint64(step))
        step += 8
        live = live[size[live] > step]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes())
    return out


def gram_hashes(word: np.ndarray, n: int, mix: np.uint64 = MIX) -> np.ndarray:
    """64 bits for every ``n`` consecutive words, in their order."""
    size = len(word) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(size, mix) * np.uint64(n)
    for j in range(n):
        x = (x ^ word[j : j + size]) * mix
        x ^= x >> np.uint64(29)
    return _spread(x)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def letters(raw: np.ndarray) -> np.ndarray:
    """Lower-case letters, all else a space; bytes beyond ASCII stay, but for the capitals of Latin-1."""
    out = _LETTER[raw]
    capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


def prefix_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: range):
    """(size, words, hash): for each size the longer words, and a hash of their first bytes."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _CHUNK, "right")))
        s, e = start[lo:hi], end[lo:hi]
        total = np.zeros(len(s), np.uint64)
        power, live = np.uint64(1), np.arange(len(s))
        with np.errstate(over="ignore"):
            for n in range(1, sizes.stop):
                live = live[e[live] - s[live] >= n]
                total[live] += _BYTE[raw[s[live] + n - 1]] * power
                power = power * MIX
                if n >= sizes.start and len(live):
                    yield n, live + lo, _spread(total[live] + np.uint64(n) * MIX_2 + np.uint64(1))
        lo = hi
