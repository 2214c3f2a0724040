"""Bursts of samples: segments, sampling geometry, shape, coupling and spectrum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import safe_corr

Keys = Sequence[str]


def segment(df: DataFrame, keys: Keys, t: str, gap: str, tie: str) -> DataFrame:
    """seg counts from 1 and grows where the time since the row before is over the gap."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("seg", F.sum("_new").over(w)).drop("_new")


def seconds(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def geometry(df: DataFrame, keys: Keys, t: str, tie: str) -> DataFrame:
    """Median sampling step, samples and length of bursts, dead time, duty cycle."""
    w = Window.partitionBy(*keys, "seg").orderBy(t, tie)
    d = df.withColumn("_dt", seconds(F.lag(t).over(w), F.col(t)))
    step = d.groupBy(*keys).agg(F.percentile("_dt", F.lit(0.5)).alias("median_step"))
    b = df.groupBy(*keys, "seg").agg(F.count("*").alias("n"), seconds(F.min(t), F.max(t)).alias("len"), F.min(t).alias("_a"), F.max(t).alias("_b"))
    g = b.groupBy(*keys).agg(F.count("*").alias("bursts"), F.avg("n").alias("samples"), F.sum("len").alias("on_s"), seconds(F.min("_a"), F.max("_b")).alias("span_s"))
    return g.join(step, list(keys)).select(*keys, "bursts", "samples", "median_step", "on_s", (F.col("span_s") - F.col("on_s")).alias("dead_s"), (F.col("on_s") / F.nullif(F.col("span_s"), F.lit(0.0))).alias("duty"))


def shape(df: DataFrame, x: str, keys: Keys, t: str, tie: str) -> DataFrame:
    """Amplitude and shape features per burst, in one aggregation. A burst's mean is summed in
    time order, so that a sample beside the mean is on the same side in every run."""
    w = Window.partitionBy(*keys, "seg").orderBy(t, tie)
    centred = F.col(x) - F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumns({"_c": centred, "_i": F.row_number().over(w)})
    d = d.withColumn("_flip", (F.signum("_c") * F.signum(F.lag("_c").over(w)) < 0).cast("int"))
    peak, rms, mean_abs = F.max(F.abs(x)), F.sqrt(F.avg(F.col(x) * F.col(x))), F.avg(F.abs(x))
    part = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return d.groupBy(*keys, "seg").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), rms.alias("rms"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), (F.max(x) - F.min(x)).alias("p2p"), peak.alias("peak"),
        part(peak, rms).alias("crest"), part(peak, mean_abs).alias("impulse"), part(rms, mean_abs).alias("shape"), part(peak, F.avg(F.sqrt(F.abs(x))) ** 2).alias("clearance"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("crossings"), F.sum(F.col(x) * F.col(x)).alias("energy"),
    )


def autocorrelation(df: DataFrame, x: str, ks: Sequence[int], keys: Keys, t: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys, "seg").orderBy(t, tie)
    d = df.withColumns({f"_l{k}": F.lag(x, k).over(w) for k in ks})
    return d.groupBy(*keys, "seg").agg(*[safe_corr(x, f"_l{k}").alias(f"ac{k}") for k in ks])


def coupling(df: DataFrame, a: str, b: str, lags: int, keys: Keys, t: str, tie: str) -> DataFrame:
    """Correlation of two channels and the shift of b with the largest cross product. All
    shifts are lag columns of one window, so rows are not multiplied."""
    w = Window.partitionBy(*keys, "seg").orderBy(t, tie)
    whole = Window.partitionBy(*keys, "seg")
    d = df.withColumns({"_a": F.col(a) - F.avg(a).over(whole), "_b": F.col(b) - F.avg(b).over(whole)})
    shift = lambda k: F.lag("_b", k).over(w) if k >= 0 else F.lead("_b", -k).over(w)
    d = d.withColumns({f"_s{k}": shift(k) for k in range(-lags, lags + 1)})
    products = [F.struct(F.round(F.abs(F.coalesce(F.sum(F.col("_a") * F.col(f"_s{k}")), F.lit(0.0))), 6).alias("v"), F.lit(-abs(k)).alias("near"), F.lit(k).alias("k")) for k in range(-lags, lags + 1)]
    return d.groupBy(*keys, "seg").agg(safe_corr(a, b).alias("corr"), F.array_max(F.array(*products))["k"].alias("lag"), F.count("*").alias("n"))


def spectrum(df: DataFrame, x: str, size: int, keys: Keys, t: str, tie: str) -> DataFrame:
    """Welch spectrum features per burst: Hann windows of `size` samples at half overlap,
    transformed by a join with a fixed table of sines (size x size/2 rows), then dominant
    bin, centroid, entropy and the share of the lower half. Bursts shorter than a window
    give no row."""
    spark = df.sparkSession
    half = size // 2
    w = Window.partitionBy(*keys, "seg").orderBy(t, tie)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "seg")))
    # a sample stands in the window that begins in its half block and in the one before
    d = d.withColumn("win", F.explode(F.array((F.col("_i") / half).cast("int"), (F.col("_i") / half).cast("int") - 1)))
    d = d.where((F.col("win") >= 0) & (F.col("win") * half + size <= F.col("_n"))).withColumn("pos", (F.col("_i") - F.col("win") * half).cast("int"))
    mean = F.avg(x).over(Window.partitionBy(*keys, "seg", "win"))
    d = d.withColumn("_v", F.col(x) - mean)
    rows = [(n, k, math.cos(2 * math.pi * k * n / size) * h, math.sin(2 * math.pi * k * n / size) * h) for n in range(size) for h in [0.5 - 0.5 * math.cos(2 * math.pi * n / size)] for k in range(1, half + 1)]
    waves = F.broadcast(spark.createDataFrame(rows, "pos int, k int, wave_c double, wave_s double"))
    f = d.join(waves, "pos").groupBy(*keys, "seg", "win", "k").agg(F.sum(F.col("_v") * F.col("wave_c")).alias("re"), F.sum(F.col("_v") * F.col("wave_s")).alias("im"))
    p = f.groupBy(*keys, "seg", "k").agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("p"))
    share = F.col("p") / F.nullif(F.sum("p").over(Window.partitionBy(*keys, "seg")), F.lit(0.0))
    p = p.withColumn("q", share)
    return p.groupBy(*keys, "seg").agg(
        F.max_by("k", F.struct(F.round("p", 6), -F.col("k"))).alias("dominant"), F.sum(F.col("k") * F.col("q")).alias("centroid"), (-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log("q")))).alias("entropy"), F.sum(F.when(F.col("k") <= half // 2, F.col("q")).otherwise(0.0)).alias("low_share")
    )
