"""Vectorised words and word hashes of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``; UTF-8
continuation bytes never fall in that set, so bytes and code points agree on the word borders.  Texts are
hashed in slices of a quarter megabyte, so memory follows the slice and not the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
U64 = np.uint64
#: Odd multipliers of the two byte polynomials and of the two window polynomials.
BYTE_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_MULT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    """Words of a batch of documents; document d owns words ``first[d]:first[d + 1]``.

    ``data[start[w]:end[w]]`` are the bytes of word w, ``hash[w]`` its 64-bit hash, ``hash2`` a second one if asked for.
    """

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray | None

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def power_table(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(mult)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(mult, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, U64(mult)))), dtype=U64)
            down = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, U64(inverse)))), dtype=U64)
        have = _powers[mult] = (up, down)
    return have


def as_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large_string array, whatever the chunks; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    arr = as_array(column)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def cuts(column: pa.ChunkedArray | pa.Array, limit: int = 8 * SLICE, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of at most ``most`` consecutive texts of about ``limit`` bytes: what is worked on at once, whatever an Arrow batch holds."""
    size = pc.fill_null(pc.binary_length(column), 0)
    ends = np.cumsum(np.asarray(size, np.int64))
    out, i = [], 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        j = min(j, i + most)
        out.append((i, j))
        i = j
    return out


def pieces(batches, column: str, limit: int = 8 * SLICE, most: int = 1 << 20):
    """Record batches cut by the bytes and number of their texts."""
    for batch in batches:
        for i, j in cuts(batch.column(column), limit, most):
            yield batch.slice(i, j - i)


def words(column: pa.ChunkedArray | pa.Array, lower: bool = False, wide: bool = False, hashed: bool = True) -> Words:
    """Words of each text; ``lower`` maps A-Z to a-z before hashing, ``wide`` adds a second hash."""
    data, off = text_bytes(column)
    starts, ends, hashes = [], [], ([], [])
    begin, n = 0, len(off) - 1
    while begin < n:
        stop = int(np.searchsorted(off, off[begin] + SLICE, side="right")) - 1
        stop = min(max(stop, begin + 1), n)
        lo, hi = int(off[begin]), int(off[stop])
        if hi > lo:
            part = data[lo:hi]
            inside = ~_SPACE[part]
            edge = np.zeros(hi - lo + 1, bool)
            edge[off[begin : stop + 1] - lo] = True
            before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
            after = np.concatenate((inside[1:], [False])) & ~edge[1:]
            s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            if hashed:
                part = _LOWER[part] if lower else part
                wide_part = part.astype(U64) + U64(1)
                with np.errstate(over="ignore"):
                    for k in range(2 if wide else 1):
                        up, down = power_table(BYTE_MULT[k], hi - lo + 1)
                        total = np.concatenate(([U64(0)], np.cumsum(wide_part * up[: hi - lo], dtype=U64)))
                        hashes[k].append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0x9FB21C651E98DF25)))
            starts.append(s + lo)
            ends.append(e + lo)
        begin = stop
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(data, np.searchsorted(start, off), start, cat(ends, np.int64), cat(hashes[0], U64), cat(hashes[1], U64) if wide else None)


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k values from each position on; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out *= U64(WINDOW_MULT[which])
            out += h[i : i + n]
        return mix(out + U64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words of one document run on."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n - k + 1, bool)
    ends = first[1:]
    for i in range(1, k):
        at = ends - i
        ok[at[(at >= 0) & (at <= n - k)]] = False
    return np.flatnonzero(ok)
