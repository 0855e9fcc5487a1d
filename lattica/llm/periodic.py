"""Periodic runs of words, found from the longest Lyndon word at each position under an order and its reverse.

A run is a stretch of consecutive words with smallest period q, at least ``min_exponent`` periods and ``min_length``
words long, that no neighbouring word extends keeping period q.  Every run of two periods or more holds a Lyndon word
of its period under one of two opposite orders of the words, which is the longest Lyndon word that begins where it
begins.  So a stack, scanned from right to left once under each order, gives every position one candidate period:
the distance to the next smaller suffix.  Suffixes are compared by their longest common extension, which a binary
search over rolling hashes finds and the words confirm; what one comparison has confirmed, the next ones at the same
distance take over.  Candidates are then extended both ways by the same search, equal results collapse, and each run is
confirmed word by word.  Words are ordered by their hashes: any order of different words will do.  Where a hash should
fail, the text is gone through anew with the words themselves numbered.

Texts are read whole, each by itself, in pieces of about two megabytes; nothing shuffles.

Defined results: null and empty texts and texts of white space have no words and no runs, and the empty text is kept;
rows without an id and rows that repeat are each judged by themselves; an empty table gives an empty result; of the
input only the columns of ``carry`` are returned, which must not bear the names of result columns.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.tokens import U64, Words, mix, pieces, words

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("kept_text", T.StringType())])
#: Words compared one by one before hashes are asked.
NEAR = 4
#: Two primes and a base for each: hashes modulo a power of two would fail on Thue-Morse words.
PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_664_525_893, 1_013_904_223)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers, the known ones doubled in number each time."""
    out = np.ones(n, np.int64)
    have, top = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * top % prime
        have, top = have + more, top * top % prime
    return out


class Rolling:
    """Hashes of stretches of a sequence: equal stretches have equal hashes, others unlike ones almost surely."""

    def __init__(self, codes: np.ndarray, salt: int = 0):
        self.up, self.total = [], []
        with np.errstate(over="ignore"):
            mixed = mix(codes.astype(U64) + U64(salt << 40))
        for base, prime in zip(BASES, PRIMES, strict=True):
            up = _powers(base + 2 * salt, prime, len(codes) + 1)
            own = (mixed % U64(prime)).astype(np.int64) * up[:-1] % prime
            self.up.append(up)
            self.total.append(np.concatenate(([0], np.cumsum(own) % prime)))  # sums of fewer than 2**32 terms

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n values from a on seem to be those from b on, for a <= b."""
        same = np.ones(len(a), bool)
        for prime, up, total in zip(PRIMES, self.up, self.total, strict=True):
            same &= ((total[a + n] - total[a]) % prime * up[b - a] - total[b + n] + total[b]) % prime == 0
        return same

    def same(self, a: int, b: int, n: int) -> bool:
        """``equal`` of one pair."""
        return all((int(total[a + n] - total[a]) * int(up[b - a]) - int(total[b + n] - total[b])) % prime == 0 for prime, up, total in zip(PRIMES, self.up, self.total, strict=True))

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the sequences from a and from b on agree, or with ``back`` those that end before a and b."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


class Suffixes:
    """Longest common extensions of pairs of places in one sequence, confirmed by the sequence itself."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, rolled: Rolling):
        self.codes, self.raw, self.ends, self.rolled = codes, codes.tobytes(), ends, rolled
        self.known: dict[int, tuple[int, int]] = {}  # of a distance, the stretch confirmed last

    def common(self, i: int, j: int) -> int:
        """How many values from i on equal those from j on; the first ones do."""
        low, high = self.known.get(j - i, (-1, -1))
        if low - 1 <= i < high:
            self.known[j - i] = (min(low, i), high)
            return high - i
        n, codes = 1, self.codes
        while n < NEAR and codes[i + n] == codes[j + n]:  # the sequences end with values that no other place has
            n += 1
        if n == NEAR:
            n = self._search(i, j)
            sure = low - i if high == i + n and low > i else n
            if self.raw[8 * i : 8 * (i + sure)] != self.raw[8 * j : 8 * (j + sure)]:
                n = int(np.flatnonzero(codes[i : i + sure] != codes[j : j + sure])[0])
            self.known[j - i] = (i, i + n)
        return n

    def _search(self, i: int, j: int) -> int:
        low, high = NEAR, int(self.ends[np.searchsorted(self.ends, j, side="right")]) - j
        step = low
        while low < high:  # doubling steps first, halves then
            mid = min(low + step, high) if step else (low + high + 1) // 2
            if self.rolled.same(i, j, mid):
                low, step = mid, 2 * step
            else:
                high, step = mid - 1, 0
        return low


def next_smaller(codes: list[int], todo: list[int], common: Callable[[int, int], int]) -> list[int]:
    """Of each place the next one whose suffix is smaller: where the longest Lyndon word that begins there ends.

    ``todo``: the places, from right to left, whose next place does not hold a smaller value.
    """
    after = list(range(1, len(codes) + 1))
    for i in todo:
        own, j = codes[i], i + 1
        while True:
            other = codes[j]
            if own < other:
                j = after[j]
            elif own > other:
                break
            else:
                n = common(i, j)
                if codes[i + n] > codes[j + n]:
                    break
                j = after[j]
        after[i] = j
    return after


def runs_in(codes: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int, salt: int = 0) -> np.ndarray:
    """(start, end, period) of all runs of a sequence of values, in parts; -1 stands at the end of each part and nowhere else."""
    rolled = Rolling(np.where(codes < 0, np.arange(len(codes)) + codes.max(initial=0) + 1, codes), salt)
    inside = np.flatnonzero(codes >= 0)
    begin = np.concatenate(([0], ends[:-1] + 1))
    part = np.searchsorted(ends, inside, side="right")
    found = []
    for ordered in (codes, np.where(codes < 0, -1, codes.max(initial=0) - codes)):
        todo = inside[ordered[inside] <= ordered[inside + 1]][::-1].tolist()
        after = np.array(next_smaller(ordered.tolist(), todo, Suffixes(ordered, ends, rolled).common), np.int64)
        period, end = after[inside] - inside, ends[part]
        # the leftmost Lyndon word of a run lies in its first period, so that the rest of the run follows it
        rest = (min_exponent - 2) * period + 1
        able = np.flatnonzero((after[inside] + rest <= end) & (codes[inside] == codes[after[inside]]))
        able = able[rolled.equal(inside[able], after[inside[able]], rest[able])]
        i, j, p = inside[able], after[inside[able]], period[able]
        right = rolled.extend(i, j, end[able] - j)
        left = rolled.extend(i, j, i - begin[part[able]], back=True)
        found.append(np.stack((i - left, j + right, p), 1))
    out = np.unique(np.concatenate(found), axis=0)
    size = out[:, 1] - out[:, 0]
    return out[(size >= min_length) & (size >= min_exponent * out[:, 2])]


def _confirmed(w: Words, raw: bytes, found: np.ndarray) -> bool:
    """Whether every run repeats its own words, and none goes on."""
    start, stop = w.start, w.end
    word = lambda x: raw[start[x] : stop[x]]
    return all(word(x) == word(x + p) for s, e, p in found.tolist() for x in range(s, e - p))


def find_runs(w: Words, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, end, period) of all runs, by word number in the batch, in order of start and period."""
    n, docs = len(w.hash), len(w.first) - 1
    doc = w.doc_of()
    at = np.arange(n) + doc  # each text is followed by an end mark
    ends = w.first[1:] + np.arange(docs)
    raw = w.data.tobytes()
    codes = np.unique(w.hash, return_inverse=True)[1]
    for attempt in count():
        if attempt:
            number: dict[bytes, int] = {}
            codes = np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
        marked = np.full(n + docs, -1, np.int64)
        marked[at] = codes
        found = runs_in(marked, ends, min_length, min_exponent, attempt)
        if len(found):
            own = np.searchsorted(ends, found[:, 0], side="right")
            found[:, :2] -= own[:, None]
        if _confirmed(w, raw, found):
            return found[np.lexsort((found[:, 2], found[:, 0]))]


class PeriodicRuns:
    """Runs of at least ``min_exponent`` periods and ``min_length`` words, and texts without their repetitions."""

    def __init__(self, min_length: int = 6, min_exponent: int = 4, text_col: str = "text"):
        if min_exponent < 2 or min_length < 2:
            raise ValueError("min_length and min_exponent are at least 2")
        self.min_length, self.min_exponent, self.text_col = min_length, min_exponent, text_col

    def transform(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """The columns of ``carry``, n_words, runs (by start, then period; words counted from 0) and kept_text.

        Of each run the first period stays: a word goes if it lies in any run after that run's first period.  The
        words kept are joined by single spaces.
        """
        carry = ["doc_id"] if carry is None else carry
        text_col, least = self.text_col, (self.min_length, self.min_exponent)

        def runs(batches):
            for b in pieces(batches, text_col):
                w = words(b.column(text_col))
                found = find_runs(w, *least)
                change = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                base = w.first[np.searchsorted(w.first, found[:, 0], side="right") - 1] if len(found) else found[:, 0]
                spans = pa.StructArray.from_arrays([pa.array(found[:, 0] - base), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], w.first).astype(np.int32)), spans)
                out = {c: b.column(c) for c in carry} | {"n_words": pa.array(w.lengths.astype(np.int64)), "runs": lists, "kept_text": _kept(w, np.cumsum(change[:-1]) > 0)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        own = docs.select(*dict.fromkeys([*carry, text_col]))
        return own.mapInArrow(runs, T.StructType([docs.schema[c] for c in carry] + RESULT.fields))


def _kept(w: Words, gone: np.ndarray) -> pa.Array:
    """The words of each text that stay, joined by single spaces."""
    raw, texts = memoryview(w.data), []
    lost = np.concatenate(([0], np.cumsum(gone)))
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = bytes(raw[w.start[i] : w.end[j - 1]]).split() if j > i else []
        texts.append(b" ".join(compress(own, (~gone[i:j]).tolist()) if lost[j] > lost[i] else own).decode())
    return pa.array(texts, pa.string())
