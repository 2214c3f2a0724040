"""Edge cases and properties of operators on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import bursts, clean, diagnosis, events, features, intervals, metrics, policy, stats
from wattloom.plans import halo
from wattloom.queries.base import demand, scored

K, S = ["k"], "step"


def frame(spark, rows, schema="k string, step long, flag int, x double"):
    return spark.createDataFrame(rows, schema)


def flags(spark, values, key="a"):
    return frame(spark, [(key, i, v, float(v)) for i, v in enumerate(values)])


def test_runs_join_over_one_missing_step(spark):
    r = events.runs(flags(spark, [1, 0, 1, 1, 0, 0, 1]), "flag", K, S).orderBy("first").collect()
    assert [(x["first"], x["last"], x["n"]) for x in r] == [(0, 3, 3), (6, 6, 1)]
    r = events.strict_runs(flags(spark, [1, 0, 1, 1, 0, 0, 1]), "flag", K, S).orderBy("first").collect()
    assert [(x["first"], x["last"]) for x in r] == [(0, 0), (2, 3), (6, 6)]


def test_empty_frames(spark):
    empty = flags(spark, [])
    assert events.runs(empty, "flag", K, S).count() == 0
    assert features.lags(empty, "x", [1], K, S).count() == 0
    assert metrics.roc_auc(empty, "flag", "x", K).count() == 0
    assert events.local_peaks(empty, "x", 1.0, 4, K, S).count() == 0


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 0, 1.0), (0, 1, 2.0), (0, 0, 0.0)], "g int, y int, s double")
    assert metrics.roc_auc(df, "y", "s", ["g"]).first()["auc"] == pytest.approx(3.5 / 4)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "g int, y int, s double")
    assert metrics.roc_auc(df, "y", "s", ["g"]).first()["auc"] is None


def test_local_peaks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 300).astype(float)
    got = {(r["step"], r["prominence"]) for r in events.local_peaks(frame(spark, [("a", i, 0, float(v)) for i, v in enumerate(x)]), "x", 10.0, 400, K, S).collect()}
    want = set()
    i = 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            a = i - 1
            while a >= 0 and x[a] <= x[i]:
                a -= 1
            b = j + 1
            while b < len(x) and x[b] <= x[i]:
                b += 1
            prominence = x[i] - max(x[a + 1 : i].min(), x[j + 1 : b].min())
            if prominence >= 10:
                want.add((i, prominence))
        i = j + 1
    assert got == want


def test_halo_equals_plain_window(spark, sf):
    d = demand(spark, sf)
    plain = features.trailing_quantile(d, "kw", 96, 0.95, 48, ["series_id"], S)
    chunked = halo.with_halo(d, ["series_id"], S, 200, 96, lambda x, k: features.trailing_quantile(x, "kw", 96, 0.95, 48, k, S))
    a = {(r["series_id"], r["step"]): r["thr"] for r in plain.collect()}
    b = {(r["series_id"], r["step"]): r["thr"] for r in chunked.collect()}
    assert a == b


def test_running_sum_in_chunks(spark, sf):
    d = halo.running(demand(spark, sf), ["series_id"], S, 100, F.col("qty"), "total").toPandas().sort_values(["series_id", "step"])
    assert (d.total == d.groupby("series_id").qty.cumsum()).all()


def test_trailing_threshold_excludes_the_present(spark, sf):
    p = features.trailing_quantile(demand(spark, sf), "kw", 672, 0.95, 96, ["series_id"], S).toPandas()
    one = p[p.series_id == p.series_id.iloc[0]].sort_values("step").reset_index(drop=True)
    for i in (100, 700, 1500, 2000):
        past = one.kw[max(0, i - 672) : i]
        want = past.quantile(0.95) if len(past) >= 96 else np.nan
        assert one.thr[i] == pytest.approx(want)


def test_folds_are_ordered(spark, sf):
    d = intervals.rolling_origin(scored(spark, sf).drop("fold"), 3, ["series_id"], S)
    for r in d.groupBy("series_id", "fold").agg(*[F.max(F.when(F.col("role") == a, F.col("step"))).alias(f"hi_{a}") for a in ("TRAIN", "CAL")], *[F.min(F.when(F.col("role") == a, F.col("step"))).alias(f"lo_{a}") for a in ("CAL", "TEST")]).collect():
        assert r["hi_TRAIN"] < r["lo_CAL"] <= r["hi_CAL"] < r["lo_TEST"]


def test_conformal_level_is_interpolated(spark):
    rows = [("a", i, 0, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])]
    d = frame(spark, rows).withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0)})
    q = intervals.conformity(d, "x", "lo", "hi", 0.2, K).first()["q"]
    assert q == pytest.approx(np.quantile([3, 1, 4, 1, 5, 9, 2, 6], min(1, 0.8 * (1 + 1 / 8))))


def test_mahalanobis_of_a_constant_column(spark):
    d = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, b double")
    out, cut = intervals.mahalanobis(d, d, ["a", "b"])
    assert cut > 0 and out.agg(F.avg("maha")).first()[0] == pytest.approx(1.0)


def test_bootstrap_repeats(spark, sf):
    d = scored(spark, sf).withColumn("day", F.to_date("ts15"))
    run = lambda: stats.block_bootstrap(d, F.col("y"), F.col("kw"), ["day"], ["series_id"], 100, 5).orderBy("series_id").collect()
    first = run()
    assert first == run()
    assert all(r["low"] <= r["difference"] <= r["high"] for r in first)


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20000).select(stats.poisson_weight(1, F.lit(3), "id").alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.06)


def test_normal_tail(spark):
    from wattloom.functions.special import normal_tail

    r = spark.range(1).select(normal_tail(F.lit(1.959964)).alias("p")).first()["p"]
    assert r == pytest.approx(0.025, abs=1e-6)


def test_spectrum_finds_the_frequency(spark):
    rows = [("a", i, 1, float(np.sin(2 * np.pi * 3 * i / 16))) for i in range(64)]
    d = frame(spark, rows).withColumn("seg", F.lit(1)).withColumnRenamed("k", "series")
    r = bursts.spectrum(d, "x", 16, ["series"], S, S).first()
    assert r["dominant"] == 3 and r["low_share"] > 0.95


def test_coupling_lag(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=80)
    d = spark.createDataFrame([("a", i, float(x[i]), float(x[i + 2])) for i in range(78)], "k string, step long, a double, b double").withColumn("seg", F.lit(1))
    assert bursts.coupling(d, "a", "b", 4, K, S, S).first()["lag"] == 2


def test_unsure_advisories(spark, sf):
    from wattloom.queries.alerts import diagnosed, ood

    levels = {r["l"] for r in diagnosed(spark, sf).select(diagnosis.advisory(ood()).alias("l")).distinct().collect()}
    assert levels <= set(diagnosis.LEVELS)
    with pytest.raises(ValueError):
        diagnosis.contract(scored(spark, sf), ["absent"])


def test_pair_sweep_against_masks(spark, sf):
    from wattloom.queries.alerts import levelled

    d = levelled(spark, sf)
    got = {(r["series_id"], r["early"], r["confirm"], r["gate"]): (r["tp"], r["fp"], r["advisories"]) for r in policy.pair_sweep(d, "early_level", "confirm_level", "unsure", "future", 7, ["series_id"]).collect()}
    p = d.toPandas()
    for (s, e, c, gate), value in list(got.items())[::17]:
        q = p[p.series_id == s]
        early, conf, unsure = q.early_level >= e, q.confirm_level >= c, q.unsure == 1
        alert = early & (conf | ~unsure) if gate == "confirm_only_if_unsure" else early & conf
        adv = early & ~conf & unsure if gate != "none" else early & False
        assert value == (int((alert & (q.future == 1)).sum()), int((alert & (q.future == 0)).sum()), int(adv.sum()))


def test_files_round_trip(spark, tmp_path):
    from wattloom.sources import files

    head = "date,hour,kw_15,kw_30,kw_45,kw_60,kw_mean,production,temp,wind,humidity,rain,tariff,dow,day,month,headcount,labour_factor"
    (tmp_path / "m.csv").write_text("﻿" + head + "\n20210101,0,1,2,3,4,2.5,0,1,1,1,0,1,5,1,1,3,1\n", encoding="utf-8")
    r = files.read_meter(spark, str(tmp_path / "m.csv")).first()
    assert r["date"] == dt.datetime(2021, 1, 1) and r["kw_60"] == 4.0
    for site in ("one", "two"):
        (tmp_path / f"{site}.csv").write_text("ts,kw\n2021-01-01 00:00:00,1\n")
    sites = files.read_sites(spark, str(tmp_path / "[ot]*.csv"), "ts timestamp, kw double")
    assert {r["site"] for r in sites.collect()} == {"one", "two"}
    files.save_table(spark.range(3), str(tmp_path / "out"))
    assert files.optional(spark, str(tmp_path / "out")).count() == 3 and files.optional(spark, str(tmp_path / "none")) is None


def test_group_kfold_keeps_groups_whole(spark):
    d = spark.createDataFrame([(i // 3, i % 2) for i in range(90)], "g int, y int")
    f = intervals.group_kfold(d, "g", "y", 5)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert f.select("fold").distinct().count() == 5


def test_fill_limits(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, None, 2.0, None])], "k string, step long, x double")
    got = [r["x"] for r in clean.ffill(d, ["x"], K, S, 2).orderBy("step").collect()]
    assert got == [None, 1.0, 1.0, 1.0, None, 2.0, 2.0]
    assert [r["x"] for r in clean.bfill(d, ["x"], K, S).orderBy("step").collect()] == [1.0, 1.0, 2.0, 2.0, 2.0, 2.0, None]


def test_models_beat_their_baselines(spark, sf):
    from wattloom.queries.models import m8, parts, X
    from wattloom.operators import models as ml

    train, cal, test = parts(spark, "/root/testdata/sf0.01")
    p = ml.predict_point(ml.fit_point(train.unionByName(cal), X, "y", "ridge", base="kw"), test, base="kw")
    r = p.agg(F.avg(F.abs(F.col("y") - F.col("pred"))), F.avg(F.abs(F.col("y") - F.col("kw")))).first()
    assert r[0] < r[1]
    c = m8(spark, sf)
    assert c.select("fold").distinct().count() == 5
    assert 0.8 <= c.agg(F.sum(F.col("coverage") * F.col("n")) / F.sum("n")).first()[0] <= 1.0


def test_stateful_streams(spark, tmp_path):
    from wattloom.streaming import streams as ss

    t, minutes = dt.datetime(2024, 1, 1), lambda n: dt.timedelta(minutes=n)
    rows = [("a", t, 1, 0), ("a", t + minutes(50), 0, 1), ("a", t + minutes(120), 1, 0), ("a", t + minutes(540), 0, 0), ("b", t + minutes(600), 0, 0)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "series_id string, ts timestamp, early int, confirm int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, ts timestamp, early int, confirm int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ss.run_now(ss.stateful(stream, ss.SequentialAlert(), "series_id string, target timestamp, state string"))
    got = {(r["target"].hour, r["state"]) for r in out.where("series_id = 'a'").collect()}
    assert (1, "watch") in got and (1, "confirmed") in got and (3, "expired") in got
    timers = ss.run_now(ss.stateful(stream.withColumn("flag", F.col("early")), ss.DelayTimer(1, 2), "series_id string, ts timestamp, timer int"))
    assert timers.where("series_id = 'a'").agg(F.sum("timer")).first()[0] >= 2
