"""A deployed bundle: fitted models, cuts and thresholds, and the scoring of rows with it.

A bundle is models and small tables, saved in a folder. The same `score` serves a batch and,
through foreachBatch, a stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import diagnosis as dg, intervals as iv, models as ml, policy as pl

Names = Sequence[str]
TABLES = ("conformal", "widths", "thresholds", "ramps", "distance")


def fit_bundle(history: DataFrame, cal: DataFrame, features: Names, horizons: Sequence[int], qs: Sequence[float], keys: Names, step: str, kind: str = "ridge") -> tuple[dict, dict]:
    """Models of every horizon (targets y_h<h>) and the tables that scoring needs; everything
    comes from history and its calibration tail."""
    models, tables = {}, {}
    conformal = widths = thresholds = None
    for h in horizons:
        y = f"y_h{h}"
        models[f"point_{h}"] = ml.fit_point(history, features, y, kind, base="kw")
        models[f"leaf_{h}"], tables[f"leaves_{h}"] = ml.fit_quantiles(history, features, y, [0.05, 0.95])
        c = ml.predict_quantiles(models[f"leaf_{h}"], tables[f"leaves_{h}"], cal, [*keys, step], ["lo", "hi"])
        q = iv.conformity(c, y, "lo", "hi", 0.1, keys).withColumn("h", F.lit(h))
        w = iv.width_cuts(c.join(q, list(keys)).withColumn("width", F.col("hi") - F.col("lo") + 2 * F.col("q")), "width", keys).withColumn("h", F.lit(h))
        t = pl.cal_thresholds(ml.predict_point(models[f"point_{h}"], cal, base="kw"), "pred", qs, keys).withColumn("h", F.lit(h))
        conformal, widths, thresholds = (b if a is None else a.unionByName(b) for a, b in ((conformal, q), (widths, w), (thresholds, t)))
    spark = history.sparkSession
    mean, inverse = iv.mahalanobis_fit(history, features)
    cut = history.agg(F.percentile(iv.mahalanobis_of(features, mean, inverse), F.lit(0.99))).first()[0]
    distance = spark.createDataFrame([(mean, [float(x) for x in inverse.ravel()], cut)], "mean array<double>, inverse array<double>, cut double")
    ramps = history.groupBy(*keys).agg(F.percentile(F.abs("ramp4"), F.lit(0.9)).alias("ramp_cut"))
    return models, tables | {"conformal": conformal, "widths": widths, "thresholds": thresholds, "ramps": ramps, "distance": distance}


def load(spark: SparkSession, path: str, horizons: Sequence[int]) -> tuple[dict, dict]:
    names = [f"{k}_{h}" for h in horizons for k in ("point", "leaf")]
    return ml.load_bundle(spark, path, names, [*TABLES, *[f"leaves_{h}" for h in horizons]])


def score(rows: DataFrame, bundle: tuple[dict, dict], features: Names, early_q: float, confirm_q: float, gate: str, keys: Names, step: str, early_h: int = 4, confirm_h: int = 1) -> DataFrame:
    """Operator fields of decision rows: forecasts, intervals, bands and risk of every horizon,
    early and confirmed risk, regime, flags and the advisory level."""
    models, tables = bundle
    d = rows
    far = tables["distance"].first()
    d = d.withColumn("_maha", iv.mahalanobis_of(features, list(far["mean"]), np.array(far["inverse"]).reshape(len(features), -1)))
    for h in sorted(int(n.removeprefix("point_")) for n in models if n.startswith("point_")):
        d = ml.predict_point(models[f"point_{h}"], d, base="kw", name=f"forecast_h{h}")
        d = ml.predict_quantiles(models[f"leaf_{h}"], tables[f"leaves_{h}"], d, [*keys, step], [f"_lo{h}", f"_hi{h}"])
        own = lambda t, *c: tables[t].where(F.col("h") == h).select(*keys, *c)  # noqa: B023, E731
        d = d.join(own("conformal", F.col("q").alias("_q")), list(keys), "left").join(own("widths", "c50", "c80"), list(keys), "left")
        lo, hi = F.col(f"_lo{h}") - F.col("_q"), F.col(f"_hi{h}") + F.col("_q")
        band = F.when(F.col("_maha") > far["cut"], "OOD").when(hi - lo <= F.col("c50"), "HIGH").when(hi - lo <= F.col("c80"), "MEDIUM").otherwise("LOW")
        d = d.withColumns({f"interval_low_h{h}": lo, f"interval_high_h{h}": hi, f"reliability_h{h}": band, "_w": hi - lo})
        d = d.withColumn(f"risk_h{h}", iv.risk_score(f"forecast_h{h}", "thr", "_w")).drop("_q", "c50", "c80", "_w", f"_lo{h}", f"_hi{h}")
    at = lambda h, q, name: tables["thresholds"].where((F.col("h") == h) & (F.round("q", 6) == round(q, 6))).select(*keys, F.col("threshold").alias(name))
    d = d.join(at(early_h, early_q, "_te"), list(keys), "left").join(at(confirm_h, confirm_q, "_tc"), list(keys), "left").join(tables["ramps"], list(keys), "left")
    early, raw = F.col(f"forecast_h{early_h}") >= F.col("_te"), F.col(f"forecast_h{confirm_h}") >= F.col("_tc")
    unsure = F.col(f"reliability_h{early_h}").isin("LOW", "OOD")
    confirmed = early & (raw | ~unsure) if gate == "confirm_only_if_unsure" else early & raw
    switched = ~F.col("is_operating").eqNullSafe(F.col("is_operating_lag4"))
    steep = F.coalesce(F.abs("ramp4") >= F.col("ramp_cut"), F.lit(False))
    regime = F.when(switched | steep, "TRANSITION").when(F.col("is_operating") == 0, "LOW_LOAD").otherwise("STABLE")
    d = dg.flags(d.drop("alert"), early, confirmed, unsure, regime == "TRANSITION", steep, F.col("is_operating") == 0)
    ood = F.col(f"reliability_h{early_h}") == "OOD"
    out = d.withColumns({"regime": regime, "advisory_level": dg.advisory(ood)})
    return out.drop("_te", "_tc", "_maha", "ramp_cut")
