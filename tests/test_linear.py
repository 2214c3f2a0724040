"""Linear fits from moments: MLlib's coefficients, sums and differences of groups, hand-worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import intervals as iv
from wattloom.operators import linear as ln
from wattloom.operators import models as ml

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(50, 9, 900), rng.normal(0, 1, 900)
    c = 0.5 * a + rng.normal(0, 2, 900)
    y = 3 * a - 7 * b + 0.2 * c + rng.normal(0, 5, 900) + 11
    out = [("abc"[i % 3], i // 3, float(a[i]), float(b[i]), float(c[i]), float(y[i]), 1.0 + i % 4) for i in range(900)]
    return spark.createDataFrame(out, "k string, t long, a double, b double, c double, y double, w double").cache()


@pytest.mark.parametrize("kind", ["ols", "ridge", "lasso", "elastic"])
@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("base", [None, "a"])
def test_coefficients_are_mllibs(rows, kind, weight, base):
    fit = ln.Fit.of("m", X, "y", base, kind)
    got = ln.solve(ln.moments(rows, [*X, "y"], [], weight), [*X, "y"], [fit]).first()
    want = ml.fit_point(rows, X, "y", kind, base, weight).stages[-1]
    coef = np.array(got["coef"][:3]) - np.array([1.0 if base == c else 0.0 for c in X])  # the base is added again
    close = 1e-6 if kind in ("ols", "ridge") else 2e-3
    assert np.allclose(coef, want.coefficients.toArray(), atol=close) and abs(got["intercept"] - want.intercept) < close * 100
    assert got["coef"][3] == 0


def test_roles_are_those_of_rolling_origin(rows):
    d = ln.roles(rows, 5, ["k"], "t")
    long = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("r", F.substr("roles", F.col("fold") + 1, F.lit(1)))
    got = long.where("r <> '-'").select("k", "t", "fold", "r")
    names = {"TRAIN": "T", "CAL": "C", "TEST": "E"}
    want = {(r["k"], r["t"], r["fold"], names[r["role"]]) for r in iv.rolling_origin(rows, 5, ["k"], "t").collect()}
    assert {tuple(r) for r in got.collect()} == want


def test_groups_add_up_and_are_taken_away(rows):
    names = [*X, "y"]
    d = ln.roles(rows, 5, ["k"], "t")
    own = ln.of_folds(ln.moments(d, names, ["k", "roles"]), 5, "TC", ["k"], 4)
    others = ln.without(ln.added(own, ["fold"], 4), own, ["fold"])
    fits = [ln.Fit.of("y", X, "y", None, "ridge"), ln.Fit.of("part", ["b"], "y")]
    got = {(r["k"], r["fold"], r["model"]): r for r in ln.solve(others, names, fits).collect()}
    assert len(got) == 3 * 5 * 2
    rolled = iv.rolling_origin(rows, 5, ["k"], "t").where("role <> 'TEST' and fold = 2 and k <> 'b'")
    for name, features, kind in (("y", X, "ridge"), ("part", ["b"], "ols")):
        want = ml.fit_point(rolled, features, "y", kind).stages[-1]
        r = got["b", 2, name]
        assert np.allclose([r["coef"][X.index(c)] for c in features], want.coefficients.toArray(), atol=1e-6) and abs(r["intercept"] - want.intercept) < 1e-4


def test_hand_worked_and_degenerate_fits(spark):
    d = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0)], "a double, b double, y double")
    r = ln.solve(ln.moments(d, ["a", "b", "y"], []), ["a", "b", "y"], [ln.Fit.of("m", ["a", "b"], "y")]).first()
    assert np.allclose(r["coef"], [2.0, 0.0, 0.0]) and abs(r["intercept"]) < 1e-9  # b never changes: no part in it
    p = ln.predict(d.withColumn("k", F.lit(1)), spark.createDataFrame([(1, "m", 1.0, [2.0, 0.0, 0.0])], "k int, model string, intercept double, coef array<double>"), ["a", "b"], ["k"])
    assert [x["pred"] for x in p.orderBy("a").collect()] == [3.0, 5.0, 7.0]
    none = ln.solve(ln.moments(d.where("a > 9").withColumn("g", F.lit(1)), ["a", "b", "y"], ["g"]), ["a", "b", "y"], [ln.Fit.of("m", ["a"], "y")])
    assert none.collect() == []
