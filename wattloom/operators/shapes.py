"""Searches of similar shapes: nearest events under time warping, and unusual subsequences.

Both are exact and look at few pairs. Shapes are dealt to blocks in the order of a symbolic
word (their levels in a few segments), so that similar ones share a block. A block is first
searched by itself: for each shape the others come by rising lower bound of their distance,
and the search stops when the bound passes the best distance so far. That best, a shape's
nearest of its own block, then rules out other blocks: a pair of blocks is read only where
the bound between their ranges is not over it, and is searched in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.plans.ranks import numbered
from wattloom.session import cut, ship

Keys = Sequence[str]
#: Shapes of a block.
BLOCK = 512
#: Segments of a symbolic word, and levels of a segment.
SEGMENTS, LEVELS = 4, 4
#: What rounding may add to a bound.
SLACK = 1e-9


def segment_means(x: np.ndarray) -> np.ndarray:
    """Means of SEGMENTS parts of each row, as equal as their lengths allow."""
    edges = np.linspace(0, x.shape[1], SEGMENTS + 1).round().astype(int)
    return np.add.reduceat(x, edges[:-1], axis=1) / np.diff(edges)


def words(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """A number per row: the levels of its segments between low and high, as digits."""
    level = np.clip(((segment_means(x) - low) / (high - low) * LEVELS).astype(int), 0, LEVELS - 1)
    return level @ LEVELS ** np.arange(SEGMENTS)[::-1]


@dataclass(frozen=True)
class Measure:
    """A distance of shapes and what bounds it from below.

    exact(a, b, limit): distances of paired rows, infinite where they are known to pass the
    limit, and whether a distance was worked out to its end. bound(a, b): bounds of all pairs. reach(a) and
    spread(b): the ranges (low, high) in which a row's partner is free, and a row lies; where
    they are apart, `scale * (sum of the gaps ** power)` bounds the distance ** power."""

    prepare: Callable[[np.ndarray], np.ndarray]
    word: Callable[[np.ndarray], np.ndarray]
    exact: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    bound: Callable[[np.ndarray, np.ndarray], np.ndarray]
    reach: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    spread: Callable[[np.ndarray], np.ndarray]
    apart: int
    power: int = 1
    scale: float = 1.0


def search(measure: Measure, a: np.ndarray, at: np.ndarray, b: np.ndarray, other_at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, other, looked) of the rows of a: the nearest of b, at least measure.apart
    steps away, where it is not over best (of equals the first), and how many were measured to
    the end."""
    best, other, looked = best.copy(), np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
    low = measure.bound(a, b)
    low[np.abs(at[:, None] - other_at[None, :]) < measure.apart] = np.inf
    order = np.argsort(low, axis=1, kind="stable")
    rows = np.arange(len(a))
    for k in range(low.shape[1]):
        j = order[rows, k]
        value = low[rows, j]
        go = np.isfinite(value) & (value <= best[rows] + SLACK)
        rows, j = rows[go], j[go]
        if not len(rows):
            break
        d, whole = measure.exact(a[rows], b[j], best[rows])
        looked[rows] += whole
        closer = (d < best[rows]) | np.isfinite(d) & (d == best[rows]) & ((other[rows] < 0) | (other_at[j] < other[rows]))
        best[rows[closer]], other[rows[closer]] = d[closer], other_at[j[closer]]
    return best, other, looked


def nearest(shapes: DataFrame, shape: str, keys: Keys, at: str, measure: Measure) -> DataFrame:
    """(keys, at, other, distance, looked) of every shape that has a neighbour."""
    ship(shapes.sparkSession)
    kinds = ", ".join(f"`{k}` {t}" for k, t in shapes.select(*keys).dtypes)
    flat = lambda x: [r.tolist() for r in x]

    def prepared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = measure.prepare(np.array(f["s"].tolist(), float))
                yield f.assign(s=flat(x), word=measure.word(x))

    d = shapes.select(*keys, F.col(at).cast("long").alias("at"), F.col(shape).cast("array<double>").alias("s"))
    d = d.mapInPandas(prepared, f"{kinds}, at long, s array<double>, word long")
    d, _ = numbered(d, [*keys, "word", "at"], "_place")
    d = d.withColumn("block", F.floor(F.col("_place") / BLOCK).cast("long"))
    blocks = d.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("rows"))  # at most BLOCK shapes

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *key, block, rows in f.itertuples(index=False):
                x, where = np.array([list(r["s"]) for r in rows]), np.array([r["at"] for r in rows])
                best, other, looked = search(measure, x, where, x, where, np.full(len(x), np.inf))
                low, high = measure.reach(x)
                mine = measure.spread(x)
                out.append((*key, block, where.tolist(), flat(x), best.tolist(), other.tolist(), looked.tolist(), float(best.max()), low.min(0).tolist(), high.max(0).tolist(), mine.min(0).tolist(), mine.max(0).tolist()))
            yield pd.DataFrame(out, columns=[*keys, *OWN])

    OWN = ["block", "at", "s", "best", "other", "looked", "far", "reach_low", "reach_high", "low", "high"]
    table = cut(blocks.mapInPandas(own, f"{kinds}, block long, at array<long>, s array<array<double>>, best array<double>, other array<long>, looked array<long>, far double, reach_low array<double>, reach_high array<double>, low array<double>, high array<double>"))
    left = table.select(*keys, "block", "far", "reach_low", "reach_high")
    right = table.select(*keys, F.col("block").alias("with"), F.col("low").alias("l"), F.col("high").alias("h"))
    under = F.zip_with("l", "reach_high", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    over = F.zip_with("reach_low", "h", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gaps = F.zip_with(under, over, lambda x, y: F.pow(F.greatest(x, y), F.lit(measure.power)))
    bound = F.pow(measure.scale * F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / measure.power))
    # rows of a few numbers for each pair of blocks of a series; shapes follow for those that are left
    pairs = left.join(right, list(keys)).where((F.col("block") != F.col("with")) & (bound <= F.col("far") + SLACK)).select(*keys, "block", "with")
    partner = table.select(*keys, F.col("block").alias("with"), F.col("at").alias("at_b"), F.col("s").alias("s_b"))
    both = pairs.join(table.select(*keys, "block", "at", "s", "best"), [*keys, "block"]).join(partner, [*keys, "with"]).select(*keys, "at", "s", "best", "at_b", "s_b")

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *key, at_a, s_a, known, at_b, s_b in f.itertuples(index=False):
                a, b = (np.array([list(r) for r in s]) for s in (s_a, s_b))
                best, other, looked = search(measure, a, np.array(at_a), b, np.array(at_b), np.array(known, float))
                out += [(*key, int(p), int(o) if o >= 0 else None, float(v) if o >= 0 else None, int(n)) for p, o, v, n in zip(at_a, other, best, looked) if n]
            yield pd.DataFrame(out, columns=[*keys, "at", "other", "distance", "looked"]).astype({"other": "Int64", "distance": "Float64"})

    more = both.mapInPandas(across, f"{kinds}, at long, other long, distance double, looked long")
    first = table.select(*keys, F.inline(F.arrays_zip("at", "other", "best", "looked"))).select(*keys, "at", F.when(F.col("other") >= 0, F.col("other")).alias("other"), F.when(F.col("other") >= 0, F.col("best")).alias("distance"), "looked")
    found = F.min(F.when(F.col("other").isNotNull(), F.struct("distance", "other"))).alias("_b")
    return first.unionByName(more).groupBy(*keys, "at").agg(found, F.sum("looked").alias("looked")).where("_b is not null").select(*keys, "at", "_b.other", "_b.distance", "looked")


def dtw(a: np.ndarray, b: np.ndarray, band: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Time-warping distances of paired rows, whose steps may be at most band apart, and
    whether each was worked out: the table of partial costs by its antidiagonals, each from
    the two before it. A path has a cell in one of two neighbouring antidiagonals, and what its
    later steps lie outside of the other shape's envelope is still to come: pairs for which
    that passes the limit are given up (infinite)."""
    n, m = a.shape[1], b.shape[1]
    band = max(band, abs(n - m))
    out, whole = np.full(len(a), np.inf), np.zeros(len(a), bool)
    alive = np.arange(len(a))
    to_come = np.zeros((len(a), n + 1))  # at i: of the steps from i on
    if limit is not None and n == m:
        low, high = _envelope(b, band)
        outside = np.maximum(np.maximum(a - high, low - a), 0.0)
        to_come[:, :n] = outside[:, ::-1].cumsum(1)[:, ::-1]
    two, one = np.full((len(a), n + 1), np.inf), np.full((len(a), n + 1), np.inf)
    two[:, 0] = 0.0  # the corner; columns are steps of a
    for diagonal in range(2, n + m + 1):
        i = np.arange(max(1, diagonal - m, -(-(diagonal - band) // 2)), min(n, diagonal - 1, (diagonal + band) // 2) + 1)
        new = np.full_like(one, np.inf)
        if len(i):
            new[:, i] = np.abs(a[:, i - 1] - b[:, diagonal - i - 1]) + np.minimum(np.minimum(one[:, i - 1], one[:, i]), two[:, i - 1])
        two, one = one, new
        if limit is not None and diagonal < n + m:
            keep = np.minimum((one + to_come).min(1), (two + to_come).min(1)) <= limit[alive] + SLACK
            if not keep.all():
                alive, a, b, one, two, to_come = alive[keep], a[keep], b[keep], one[keep], two[keep], to_come[keep]
                if not len(alive):
                    return out, whole
    out[alive], whole[alive] = one[:, n], True
    return out, whole


def _envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value within band steps of each step."""
    wide = np.pad(x, ((0, 0), (band, band)), constant_values=np.nan)
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1, axis=1)
    return np.nanmin(near, axis=2), np.nanmax(near, axis=2)


def warping(band: int) -> Measure:
    """Banded time warping of shapes of one length, from 0 to 1. A step of one shape is matched
    with a step of the other's envelope, so what it lies outside of it is a bound, both ways."""

    def outside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = _envelope(a, band)
        return np.maximum(np.maximum(b[None, :, :] - high[:, None, :], low[:, None, :] - b[None, :, :]), 0.0).sum(2)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ends = np.abs(a[:, None, [0, -1]] - b[None, :, [0, -1]]).sum(2) if a.shape[1] > 1 else 0.0
        return np.maximum(np.maximum(outside(a, b), outside(b, a).T), ends)

    return Measure(lambda x: x, lambda x: words(x, 0.0, 1.0), lambda a, b, limit: dtw(a, b, band, limit), bound, lambda x: _envelope(x, band), lambda x: x, 1)


def nearest_dtw(shapes: DataFrame, shape: str, keys: Keys, at: str, band: int = 3) -> DataFrame:
    """Each event's nearest other event: keys, at_a, at_b, dtw, and warped: how many others were
    measured for it. Shapes have one length."""
    near = nearest(shapes, shape, keys, at, warping(band))
    return near.select(*keys, F.col("at").alias("at_a"), F.col("other").alias("at_b"), F.col("distance").alias("dtw"), F.col("looked").alias("warped"))


def straight(size: int) -> Measure:
    """Euclidean distance of subsequences of mean 0 and deviation 1 that do not overlap. Means
    of segments are nearer to each other than the subsequences, by the root of their length:
    SEGMENTS of them bound pairs of blocks, one for every two steps pairs of subsequences."""
    least = size // SEGMENTS

    def prepare(x: np.ndarray) -> np.ndarray:
        return (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-9)

    def halves(x: np.ndarray) -> np.ndarray:
        return (x[:, 0 : size - 1 : 2] + x[:, 1:size:2]) * np.sqrt(0.5)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = halves(a), halves(b)
        return np.sqrt(sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1])))

    def exact(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(len(a), np.inf)
        near = np.arange(len(a))
        for part in (size // 4, size // 2, 3 * size // 4):
            near = near[np.linalg.norm(a[near, :part] - b[near, :part], axis=1) <= limit[near] + SLACK]
        out[near] = np.linalg.norm(a[near] - b[near], axis=1)
        return out, np.isfinite(out)

    return Measure(prepare, lambda x: words(x, -1.5, 1.5), exact, bound, lambda x: (segment_means(x),) * 2, segment_means, size + 1, 2, float(least))


def discords(df: DataFrame, x: str, size: int, stride: int, keys: Keys, step: str) -> DataFrame:
    """Distance of every normalised subsequence of `size` steps (every `stride` steps) to its
    nearest one that does not overlap it: large ones are discords. keys, at, distance, looked.
    step is dense; size is SEGMENTS at least."""
    from wattloom.plans.halo import with_frames

    rows = with_frames(df.select(*keys, step, x), keys, step, 0, size - 1, lambda w: {"s": F.collect_list(x).over(w.rowsBetween(0, size - 1))})
    d = rows.where((F.size("s") == size) & (F.col(step) % stride == 0)).select(*keys, F.col(step).cast("long").alias("at"), "s")
    return nearest(d, "s", keys, "at", straight(size)).select(*keys, "at", "distance", "looked")
