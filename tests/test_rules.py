"""Rules worked out by hand, brute-force comparisons and model properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import diagnosis, features, intervals, policy, shapes
from wattloom.operators import models as ml
from wattloom.plans import halo, ranks
from wattloom.queries.base import K, S, demand, scored

NTZ = "ts timestamp_ntz"


def test_load_zones_of_all_months_and_hours(spark):
    rows = [(dt.datetime(2021, m, 10, h),) for m in range(1, 13) for h in range(24)]
    got = {(r["ts"].month, r["ts"].hour): r["z"] for r in spark.createDataFrame(rows, NTZ).withColumn("z", features.load_zone("ts")).collect()}
    for (m, h), zone in got.items():
        peak = (10, 11, 12, 17, 18, 19, 20, 21, 22) if m in (11, 12, 1, 2) else (11, 12, 13, 14, 15, 16, 17)
        assert zone == ("peak" if h in peak else "light" if h < 9 or h == 23 else "mid")


def test_days_that_remain_of_a_free_run(spark):
    """Thursday to Wednesday with a holiday on Monday: the run is Saturday to Monday."""
    days = spark.createDataFrame([(dt.date(2024, 1, 4) + dt.timedelta(d), int(d == 4)) for d in range(7)], "day date, hol int")
    rows = features.work_calendar(days, "day", "hol").orderBy("day").collect()
    assert [r["off_run"] for r in rows] == [0, 0, 3, 2, 1, 0, 0]
    assert [r["days_to_off"] for r in rows] == [2, 1, 0, 0, 0, -1, -1]
    assert [r["days_since_off"] for r in rows] == [-1, -1, 0, 0, 0, 1, 2]
    bridge = spark.createDataFrame([(dt.date(2024, 1, 4) + dt.timedelta(d), int(d == 0)) for d in range(4)], "day date, hol int")
    assert [r["is_bridge"] for r in features.work_calendar(bridge, "day", "hol").orderBy("day").collect()] == [0, 1, 0, 0]


def test_solar_noon_follows_the_equation_of_time(spark):
    t = spark.createDataFrame([(dt.datetime(2021, 11, 3, 12) + dt.timedelta(minutes=m),) for m in range(-60, 61)], NTZ)
    rows = t.select("ts", features.solar("ts", 37.5, 135.0, 9)["solar_elevation"].alias("e")).collect()
    best = max(rows, key=lambda r: r["e"])["ts"]
    assert best in (dt.datetime(2021, 11, 3, 11, 43), dt.datetime(2021, 11, 3, 11, 44))  # 16.4 minutes early


def test_weather_derivations_by_hand(spark):
    d = spark.createDataFrame([("a", i, 10.0 + i, 5.0, 1000.0 + 2 * i) for i in range(8)], "k string, t long, temp double, dew double, p double")
    r = features.weather_derived(d, "temp", ["k"], "t", "dew", "p").orderBy("t").collect()
    assert r[7]["dew_spread"] == 12.0 and r[7]["pressure_diff3h"] == 6.0 and r[2]["pressure_diff3h"] is None
    assert r[0]["heat_proxy"] == pytest.approx(10 + 0.33 * 6.11 * np.exp(17.27 * 5 / 242.3) - 4)
    assert r[4]["temp_roll24h"] is None and r[5]["temp_roll24h"] == 12.5


def test_margins_and_history_are_null_until_known(spark):
    d = spark.createDataFrame([("a", i, float(i % 7), 5.0, int(i % 7 == 6), dt.date(2024, 1, 1)) for i in range(120)], "k string, t long, x double, thr double, peak int, day date")
    d = features.margin_features(d, "x", "thr", ["k"], "t", F.col("day"))
    d = features.steps_since_peak(features.peak_history(d, "peak", [96], ["k"], "t"), "peak", ["k"], "t")
    r = d.orderBy("t").collect()
    assert r[95]["margin_lag96"] is None and r[96]["margin_lag96"] == -5.0 and r[3]["margin_ratio"] == 0.6
    assert r[95]["peaks_96"] is None and r[96]["peaks_96"] == 13
    assert [x["since_peak"] for x in r[:9]] == [None] * 7 + [0, 1] and r[94]["margin_max96"] is None and r[95]["margin_max96"] == 1.0
    assert r[5]["day_max_margin"] == 0.0 and r[8]["day_max_margin"] == 1.0


def test_a_flicker_marks_two_rows(spark):
    on = [1] * 4 + [1, 1, 0, 1, 1, 1, 1, 1, 1]
    d = spark.createDataFrame([("a", i, v, 0.0) for i, v in enumerate(on)], "k string, t long, op int, ramp double")
    r = intervals.rule_regime(d, "op", "ramp", F.lit(5.0), ["k"], "t").orderBy("t").collect()
    assert [i for i, x in enumerate(r) if x["regime"] == "TRANSITION"] == [0, 1, 2, 3, 6, 10]
    idle = d.withColumn("op", F.lit(0)).withColumn("ramp", F.when(F.col("t") == 8, -5.0).otherwise(0.0))
    assert [x["regime"] for x in intervals.rule_regime(idle, "op", "ramp", F.lit(5.0), ["k"], "t").orderBy("t").collect()][4:] == ["LOW_LOAD"] * 4 + ["TRANSITION"] + ["LOW_LOAD"] * 4


def test_tiers_of_every_band(spark):
    want = {("OOD", 1): "HUMAN_REVIEW", ("OOD", 0): "HUMAN_REVIEW", ("LOW", 1): "WARN_ONLY", ("LOW", 0): "WARN_ONLY", ("MEDIUM", 1): "ADVISE", ("MEDIUM", 0): "MONITOR", ("HIGH", 1): "AUTO", ("HIGH", 0): "AUTO_NORMAL"}
    d = spark.createDataFrame(list(want), "band string, risk int")
    assert {(r["band"], r["risk"]): r["t"] for r in d.withColumn("t", policy.tier(F.col("band"), F.col("risk") == 1)).collect()} == want


def test_seven_advisory_levels(spark):
    # ood, early, confirmed, unsure
    want = {(1, 1, 1, 1): "HUMAN_REVIEW", (0, 1, 1, 0): "WARN_CONFIRMED", (0, 1, 1, 1): "WARN_LOW_CONFIDENCE", (0, 1, 0, 1): "ADVISORY_UNCERTAIN", (0, 1, 0, 0): "EARLY_WATCH", (0, 0, 0, 1): "MONITOR_LOW_CONFIDENCE", (0, 0, 1, 0): "NORMAL_MONITORING"}
    d = spark.createDataFrame(list(want), "ood int, early int, confirm int, unsure int").withColumn("alert", F.col("early") * F.col("confirm"))
    got = {tuple(r)[:4]: r["l"] for r in d.withColumn("l", diagnosis.advisory_fine(F.col("ood") == 1, F.col("confirm") == 1)).collect()}
    assert got == want and tuple(want.values()) == diagnosis.FINE_LEVELS


def runs(flags):
    at = [i for i, v in enumerate(flags) if v]
    out = []
    for i in at:
        if out and i - out[-1][1] <= 2:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


def test_event_sweep_against_masks(spark, sf):
    """Every policy by masks over the rows, as the rule is written."""
    from wattloom.queries.alerts import QS, levelled

    d = levelled(spark, sf)
    got = {(r["series_id"], r["kind"], r["early"], r["confirm"], r["gate"]): r for r in policy.event_sweep(d, "peak", "early_level", "confirm_level", "unsure", 4, len(QS), K, S).collect()}
    frames = {k: g.sort_values("step").reset_index(drop=True) for k, g in d.toPandas().groupby("series_id")}
    assert len(got) == len(frames) * (2 * 13 + 13 * 13 * 3)
    for (series, kind, i, j, gate), r in list(got.items())[::23]:
        q = frames[series]
        early, conf = q.early_level >= (i or 0), q.confirm_level >= (j or 0)
        alert = {"single_early": early, "single_confirm": conf}.get(kind, early & (conf | (q.unsure == 0)) if gate == "confirm_only_if_unsure" else early & conf).to_numpy()
        k = 1 if kind == "single_confirm" else 4
        leads, ev = [], runs(q.peak == 1)
        for s, _ in ev:
            hit = np.flatnonzero(alert[max(0, s - k) : s])
            if len(hit):
                leads.append(min(60, (s - max(0, s - k) - hit[0]) * 15))
        assert (r["n_events"], r["detected"], r["missed"]) == (len(ev), len(leads), len(ev) - len(leads))
        assert r["lead"] == (pytest.approx(np.mean(leads)) if leads else None)


def test_rolling_quantiles_equal_plain_windows(spark, sf):
    d = demand(spark, sf).select("series_id", "step", "kw")
    fast = halo.trailing_quantiles(d, "kw", {"a": (96, 0.95, 48), "b": (300, 0.9, 100)}, K, S)
    plain = features.trailing_quantile(features.trailing_quantile(d, "kw", 96, 0.95, 48, K, S, "c"), "kw", 300, 0.9, 100, K, S, "d")
    m = fast.join(plain.drop("kw"), ["series_id", "step"]).toPandas()
    assert len(m) == d.count()
    for x, y in (("a", "c"), ("b", "d")):
        assert (m[x].isna() == m[y].isna()).all() and np.nanmax(abs(m[x] - m[y])) < 1e-9


def test_row_numbers_over_ranges(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(int(v), i) for i, v in enumerate(rng.integers(0, 500, 900))], "x long, id long")
    out, n = ranks.numbered(d, ["x", "id"])
    assert n == 900 and [r["row_number"] for r in out.orderBy("x", "id").collect()] == list(range(1, 901))
    out, n = ranks.numbered(d, ["x", "id"], "upto", "x")
    got = [r["upto"] for r in out.orderBy("x", "id").collect()]
    assert got == np.cumsum(sorted(r[0] for r in d.select("x").collect())).tolist() and n == got[-1]
    assert ranks.numbered(d.limit(0), ["x"])[1] == 0


def test_warping_distance_and_nearest_shapes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 12))

    def brute(a, b, band):
        D = np.full((13, 13), np.inf)
        D[0, 0] = 0
        for i in range(1, 13):
            for j in range(max(1, i - band), min(12, i + band) + 1):
                D[i, j] = abs(a[i - 1] - b[j - 1]) + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
        return D[12, 12]

    want = np.array([[brute(a, b, 3) if i != j else np.inf for j, b in enumerate(x)] for i, a in enumerate(x)])
    d = spark.createDataFrame([("k", i, [float(v) for v in a]) for i, a in enumerate(x)], "k string, at long, shape array<double>")
    for size in (512, 4):
        shapes.BLOCK = size
        got = {r["at_a"]: (r["at_b"], r["dtw"]) for r in shapes.nearest_dtw(d, "shape", ["k"], "at").collect()}
        assert {i: b for i, (b, _) in got.items()} == {i: int(want[i].argmin()) for i in range(9)}
        assert all(got[i][1] == pytest.approx(want[i].min()) for i in range(9))
    shapes.BLOCK = 512


def test_discords_find_the_odd_part(spark):
    wave = np.sin(np.arange(200) / 3)
    wave[100:110] += np.linspace(0, 3, 10)
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(wave)], "k string, t long, x double")
    got = {r["at"]: r["distance"] for r in shapes.discords(d, "x", 20, 2, ["k"], "t").collect()}
    S_ = np.lib.stride_tricks.sliding_window_view(wave, 20)[::2]
    S_ = (S_ - S_.mean(1, keepdims=True)) / (S_.std(1, keepdims=True) + 1e-9)
    D = np.sqrt(((S_[:, None] - S_[None]) ** 2).sum(2))
    for i in range(len(D)):
        D[i, max(0, i - 10) : i + 11] = np.inf
    assert got == {2 * i: pytest.approx(D[i].min(), abs=1e-5) for i in range(len(D))} and 80 <= max(got, key=got.get) <= 110


def test_state_models_fall_back(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(float(x), float(2 * x if s else -x), s) for x, s in zip(rng.normal(size=400), [i % 2 for i in range(400)])], "x double, y double, s int")
    few = ml.state_models(d, d, ["x"], "y", "s", least=10**6).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    own = ml.state_models(d, d, ["x"], "y", "s", least=10).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert own < 0.8 * few
    new = d.withColumn("s", F.lit(7))
    assert ml.state_models(d, new, ["x"], "y", "s", least=10).where("pred is null").count() == 0


def test_gate_asks_for_all_three(spark):
    rows = [("good", 10.0, 1, 8.0, 9.0, 5.0, 5.0), ("wide", 10.0, 1, 8.0, 9.0, 5.0, 6.0), ("same", 10.0, 1, 9.0, 9.0, 5.0, 5.0)]
    d = spark.createDataFrame(rows, "g string, y double, peak int, pred_core double, pred_public double, width_core double, width_public double")
    assert {r["g"]: r["mode"] for r in ml.mode_gate(d, "y", "peak", ["g"]).collect()} == {"good": "PUBLIC", "wide": "CORE", "same": "CORE"}


def test_scoring_of_a_stream_equals_the_batch(spark, sf):
    from wattloom.queries.models import bundle, scored_rows
    from wattloom.queries import QUERIES

    batch = QUERIES["m33_batch_scoring"](spark, sf).toPandas().sort_values(["series_id", "step"]).reset_index(drop=True)
    stream = QUERIES["w6_stream_scoring"](spark, sf).toPandas().sort_values(["series_id", "step"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(batch, stream, rtol=1e-9)
    assert set(batch.advisory_level) <= set(diagnosis.LEVELS) and set(batch.reliability_h4) <= {"HIGH", "MEDIUM", "LOW", "OOD"}
    assert (batch.interval_low_h4 <= batch.interval_high_h4).all() and (abs(batch.risk_h4.dropna()) <= 3).all()
    early = batch.early == 1
    assert (batch.alert[~early] == 0).all()


def test_leaves_components_and_mixtures(spark, sf):
    from wattloom.queries import QUERIES

    leaves = QUERIES["m28_rule_leaves"](spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert leaves.n.sum() == n and leaves.n.min() >= 50 and (leaves.n * leaves.lift).sum() / n == pytest.approx(1)
    pcs = QUERIES["m34_components"](spark, sf).toPandas()
    assert pcs.pc1.var() >= pcs.pc2.var() and abs(np.corrcoef(pcs.pc1, pcs.pc2)[0, 1]) < 1e-6
    regimes = QUERIES["m26_mixture_regimes"](spark, sf).toPandas().set_index("regime").mean_kw
    assert regimes["LOW"] == regimes.min() and len(regimes) <= 3


def test_new_classifiers_give_probabilities(spark, sf):
    from wattloom.queries.models import X, parts

    train, cal, test = parts(spark, sf)
    p = ml.stack(train, cal.drop("p"), test.drop("p"), X, "label", ["logistic", "nb"])
    assert p.count() == test.count() and p.where("p < 0 or p > 1 or p is null").count() == 0
    (v,) = ml.vote(train, [test.drop("p")], X, "label", ["logistic", "dt"])
    assert v.where("p < 0 or p > 1 or p is null").count() == 0


def test_distances_of_one_class(spark, sf):
    from wattloom.queries import QUERIES

    rows = QUERIES["m31_one_class"](spark, sf).collect()
    normal = min(rows, key=lambda r: r["label"])
    assert normal["outside"] <= 0.05


def test_a_timer_is_a_cut_of_its_score(spark, sf):
    d = scored(spark, sf).select("series_id", S, "p", "label")
    z = policy.timer_settings(d, "p", [1], [(2, 3)], K, S).where("smooth = 1")
    k = d.withColumn("flag", (F.col("p") >= 0.3).cast("int")).withColumn("timer", policy.k_of_m("flag", 2, 3, K, S))
    j = k.join(z.select("series_id", S, "z"), ["series_id", S])
    assert j.where("timer <> coalesce(cast(z >= 0.3 as int), 0)").count() == 0
