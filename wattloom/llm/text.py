"""Vectorised words and hashes for batches of texts, used inside Python tasks.

A batch of strings becomes one array of code points; words are spans of it,
and a span's 64-bit hash comes from prefix sums of a polynomial modulo 2**64,
so no Python loop runs per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points with Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_U = np.uint64
#: Characters handled at once; a longer text is handled alone.
CHUNK = 1 << 18
#: Bytes of strings of an Arrow batch that Python holds at once.
SLICE = 1 << 22


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    out = np.full(0x110000, OTHER, np.uint8)
    kind = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[:] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


@lru_cache(1)
def word_chars() -> np.ndarray:
    """True for letters, numbers and combining marks."""
    marks = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    return np.isin(classes(), (LETTER, NUMBER)) | marks


@lru_cache(1)
def _random_codes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 0x110000, dtype=np.uint64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + CHUNK // 4)
        for k, base in enumerate((_MULT, _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], *columns: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in runs with about `size` bytes of strings in the
    columns (one row at least): what Python copies from a batch stays small."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(total)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, size + (total[lo - 1] if lo else 0), "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def chunks(texts: list[str], size: int = CHUNK):
    """Runs [lo, hi) of texts with about `size` characters each."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def flatten(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by newlines, their code points, and each text's start
    (with one more entry past the end)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return joined, codes, starts


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; the last entry is False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    return edge[0::2], edge[1::2]


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever the span stands; never 0."""
    power, inverse = _power(len(codes))
    acc = np.empty(len(codes) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(_random_codes()[codes] * power, out=acc[1:])
    h = (acc[end] - acc[start]) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64))
    h[h == 0] = 1
    return h


def words(texts: list[str]):
    """Lower-cased words (runs of letters, numbers, marks) of a batch: the joined
    text, start and end of each word in it, its hash, and the position of each
    text's first word (one more entry past the end)."""
    joined, codes, starts = flatten([t.lower() for t in texts])
    s, e = spans(word_chars()[codes])
    return joined, s, e, span_hash(codes, s, e), np.searchsorted(s, starts)


def keep_rows(docs: DataFrame, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs whose texts judge accepts, all columns as they are: a map alone."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and each text's first window.
    A text of 1 to n-1 words has one window: all its words."""
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(windows, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    owner = np.repeat(np.arange(len(count)), windows)
    begin = first[owner] + np.arange(at[-1]) - at[owner]
    size = np.minimum(count[owner], n)
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        out = out * _U(0xD1342543DE82EF95) + np.where(size > k, padded[begin + k], _U(0))
    return mix(out + size.astype(np.uint64)), at


class HashIndex:
    """A vectorised open-addressing map from non-zero 64-bit hashes to int32.

    It only saves repeated work: when half full it is emptied, so its memory
    has a fixed bound whatever the number of distinct words."""

    def __init__(self, bits: int = 21):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def room(self, n: int) -> bool:
        return self.used + n <= 1 << (self.bits - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        here = np.arange(len(h))
        while len(here):
            k = self.keys[slot]
            hit = k == h[here]
            out[here[hit]] = self.vals[slot[hit]]
            go = ~hit & (k != 0)
            here, slot = here[go], (slot[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Enter distinct absent hashes."""
        self.used += len(h)
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.vals[slot[won]] = v[won]
            h, v, slot = h[~won], v[~won], (slot[~won] + 1) & self.mask
