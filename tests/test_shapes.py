"""Searches of shapes equal comparisons of all pairs, for every size of block, and look at few."""

import numpy as np
import pytest

from wattloom.operators import shapes as sh


def plain_dtw(a, b, band):
    cost = {(0, 0): 0.0}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            if abs(i - j) <= band:
                cost[i, j] = abs(x - y) + min(cost.get(k, np.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return cost[len(a), len(b)]


@pytest.mark.parametrize("n", [1, 2, 5, 12])
@pytest.mark.parametrize("band", [1, 3, 20])
def test_warping_and_its_bound(n, band):
    rng = np.random.default_rng(n * band)
    a, b = rng.random((25, n)), rng.random((25, n))
    full = np.array([[plain_dtw(x, y, band) for y in b] for x in a])
    assert np.allclose(sh.dtw(a, b, band)[0], np.diag(full)) and (sh.warping(band).bound(a, b) <= full + 1e-9).all()
    limit = rng.random(25) * n / 2
    got, whole = sh.dtw(a, b, band, limit)
    assert all(np.isclose(g, w) if w <= x else g > x or np.isinf(g) for g, w, x in zip(got, np.diag(full), limit)) and not (np.isfinite(got) & ~whole).any()
    at = np.arange(25)
    best, other, looked = sh.search(sh.warping(band), a, at, b, at + 100, np.full(25, np.inf))
    assert np.allclose(best, full.min(1)) and (other - 100 == full.argmin(1)).all() and (looked <= 25).all()


@pytest.mark.parametrize("block", [4, 16, 512])
def test_nearest_event_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    rng = np.random.default_rng(7)
    shapes = {k: [np.round(np.clip(np.linspace(0, 1, 12) ** p + rng.normal(0, 0.05, 12), 0, 1), 3) for p in rng.choice([0.3, 1, 4], n)] for k, n in (("a", 45), ("b", 2), ("c", 1))}
    shapes["a"][7] = shapes["a"][3]  # a tie at 0
    shapes["a"][30] = shapes["a"][3]
    d = spark.createDataFrame([(k, 10 * i, x.tolist()) for k, xs in shapes.items() for i, x in enumerate(xs)], "k string, at long, shape array<double>")
    got = {(r["k"], r["at_a"]): (r["at_b"], r["dtw"]) for r in sh.nearest_dtw(d, "shape", ["k"], "at").collect()}
    want = {}
    for k, xs in shapes.items():
        for i, x in enumerate(xs):
            others = [(plain_dtw(x, y, 3), 10 * j) for j, y in enumerate(xs) if j != i]
            if others:
                want[k, 10 * i] = min(others)
    assert set(got) == set(want)
    for k, (distance, other) in want.items():
        assert got[k][1] == pytest.approx(distance, abs=1e-12)
        assert got[k][0] == other or plain_dtw(shapes[k[0]][k[1] // 10], shapes[k[0]][got[k][0] // 10], 3) == pytest.approx(distance, abs=1e-12)


@pytest.mark.parametrize("size, block", [(20, 16), (20, 512), (200, 16), (4, 8)])
def test_discords_are_those_of_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    rng = np.random.default_rng(size)
    x = np.sin(np.arange(700) / 9) + rng.normal(0, 0.2, 700)
    x[300:330] = 1.0  # constant parts
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    rows = sh.discords(d, "x", size, 2, ["k"], "t").collect()
    s = np.lib.stride_tricks.sliding_window_view(x, size)[::2]
    u = (s - s.mean(1, keepdims=True)) / (s.std(1, keepdims=True) + 1e-9)
    full = np.array([np.sqrt(((v - u) ** 2).sum(1)) for v in u])
    at = 2 * np.arange(len(u))
    full[np.abs(at[:, None] - at) <= size] = np.inf
    want = {int(t): v for t, v in zip(at, full.min(1)) if np.isfinite(v)}
    assert {r["at"]: pytest.approx(r["distance"], abs=1e-9) for r in rows} == want
    if size == 20:
        assert sum(r["looked"] for r in rows) < 0.2 * len(u) ** 2


def test_no_shapes(spark):
    assert sh.nearest_dtw(spark.createDataFrame([], "k string, at long, shape array<double>"), "shape", ["k"], "at").collect() == []
