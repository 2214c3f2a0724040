"""Leak-free features of series. Windows are keyed by series and ordered by time.

Frames count rows; `min_periods` counts non-null values and is the frame's size unless
given. A frame ends at the current row, or before it with shift=1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.plans import expanding, stitch
from wattloom.plans.halo import trailing_quantiles

Keys = Sequence[str]


def over(keys: Keys, t: str):
    return Window.partitionBy(*keys).orderBy(t)


def lags(df: DataFrame, x: str, ks: Sequence[int], keys: Keys, t: str) -> DataFrame:
    w = over(keys, t)
    return df.withColumns({f"{x}_lag{k}": F.lag(x, k).over(w) for k in ks})


def targets(df: DataFrame, x: str, hs: Sequence[int], keys: Keys, t: str) -> DataFrame:
    """Direct multi-horizon targets."""
    w = over(keys, t)
    return df.withColumns({f"y_h{h}": F.lead(x, h).over(w) for h in hs})


def framed(aggregate, x: str | Column, n: int, keys: Keys, t: str, min_periods: int | None = None, shift: int = 0) -> Column:
    """aggregate over the n rows up to the current one, or `shift` rows before."""
    w = over(keys, t).rowsBetween(-n + 1 - shift, -shift)
    value = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(value).over(w) >= (n if min_periods is None else min_periods), aggregate(value).over(w))


def rolling(df: DataFrame, x: str, ns: Sequence[int], keys: Keys, t: str, min_periods: int | None = None, shift: int = 0) -> DataFrame:
    """Rolling mean, sample deviation and maximum."""
    kinds = {"roll": F.avg, "std": F.stddev_samp, "max": F.max}
    return df.withColumns({f"{x}_{k}{n}": framed(f, x, n, keys, t, min_periods, shift) for n in ns for k, f in kinds.items()})


def ramps(df: DataFrame, x: str, ks: Sequence[int], keys: Keys, t: str) -> DataFrame:
    w = over(keys, t)
    return df.withColumns({f"{x}_ramp{k}": F.col(x) - F.lag(x, k).over(w) for k in ks})


def production_state(df: DataFrame, qty: str, keys: Keys, t: str) -> DataFrame:
    w = over(keys, t)
    df = df.withColumn("is_operating", (F.col(qty) > 0).cast("int"))
    return df.withColumns({"is_operating_lag4": F.lag("is_operating", 4).over(w), "prod_diff": F.col(qty) - F.lag(qty, 1).over(w)})


def cyclic(slot: Column, period: int, pairs: int, name: str) -> dict[str, Column]:
    """Fourier pairs of a cyclic position."""
    out = {}
    for k in range(1, pairs + 1):
        angle = F.lit(2 * k) * F.pi() * slot / period
        out[f"{name}_sin{k}"], out[f"{name}_cos{k}"] = F.sin(angle), F.cos(angle)
    return out


def run_length(df: DataFrame, flag: str, keys: Keys, t: str) -> DataFrame:
    """off_run_len and on_run_len: rows since the flag changed, this row included."""
    df = stitch.run_length(df, flag, keys, t, "_n")
    return df.withColumns({"off_run_len": F.when(F.col(flag) == 0, F.col("_n")).otherwise(0), "on_run_len": F.when(F.col(flag) != 0, F.col("_n")).otherwise(0)}).drop("_n")


def restart_flags(df: DataFrame, x: str, daily_mean: str) -> DataFrame:
    """Recent restart, and the level against the day's mean."""
    return df.withColumns({
        "restart_recent": ((F.col("on_run_len") > 0) & (F.col("on_run_len") <= 8)).cast("int"),
        "vs_day": F.col(x) - F.col(daily_mean),
        "ratio_day": F.col(x) / F.greatest(daily_mean, F.lit(1.0)),
    })


def quantile(q: float):
    return lambda x: F.percentile(x, F.lit(q))


def trailing_quantile(df: DataFrame, x: str, n: int, q: float, min_rows: int, keys: Keys, t: str, name: str = "thr") -> DataFrame:
    """Linear-interpolation quantile of the n rows before the current one, as a plain window
    of n values a frame: the exact form for short series. See plans.halo.trailing_quantiles."""
    return df.withColumn(name, framed(quantile(q), x, n, keys, t, min_rows, 1))


def threshold_grid(df: DataFrame, x: str, windows: Sequence[int], qs: Sequence[float], min_rows: int, keys: Keys, t: str) -> DataFrame:
    """Prevalence, onsets, warm-up loss and drift of trailing-threshold rules, long by rule;
    t is a dense step. All rules come from one pass over chunks of the series."""
    rules = {f"w{n}_q{int(q * 100)}": (n, q, min_rows) for n in windows for q in qs}
    wide = trailing_quantiles(df, x, rules, keys, t)
    long = wide.unpivot([*keys, t, x], list(rules), "rule", "thr").withColumn("peak", (F.col(x) >= F.col("thr")).cast("int"))
    w = Window.partitionBy(*keys, "rule").orderBy(t)
    long = long.withColumn("onset", ((F.col("peak") == 1) & (F.coalesce(F.lag("peak").over(w), F.lit(0)) == 0)).cast("int"))
    return long.groupBy(*keys, "rule").agg(
        F.avg("peak").alias("prevalence"), F.sum("onset").alias("events"), F.count_if(F.col("thr").isNull()).alias("warm_up"), (F.max("thr") - F.min("thr")).alias("drift")
    )


def expanding_quantile(df: DataFrame, x: str, q: float, min_rows: int, keys: Keys, t: str) -> DataFrame:
    """Quantile of all the past of a series; see plans.expanding. t is a dense step."""
    return expanding.expanding_quantile(df, x, q, min_rows, keys, t)


def month_to_date_max(df: DataFrame, x: str, keys: Keys, t: str) -> DataFrame:
    """Largest earlier value of the calendar month."""
    w = Window.partitionBy(*keys, F.date_trunc("month", t)).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("thr_month", F.max(x).over(w))


def margin_features(df: DataFrame, x: str, thr: str, keys: Keys, t: str, day: Column) -> DataFrame:
    """Margin over the threshold: plain ratio, lags, ramp, rolling extremes, the day's best."""
    w = over(keys, t)
    df = df.withColumns({"margin": F.col(x) - F.col(thr), "margin_ratio": F.try_divide(F.col(x), F.col(thr)), "_day": day})
    cols = {f"margin_lag{k}": F.lag("margin", k).over(w) for k in (1, 2, 4, 8, 96)}
    cols |= {"margin_ramp4": F.col("margin") - F.lag("margin", 4).over(w), "margin_max4": framed(F.max, "margin", 4, keys, t), "margin_max96": framed(F.max, "margin", 96, keys, t), "margin_roll96": framed(F.avg, "margin", 96, keys, t)}
    cols["day_max_margin"] = F.max(x).over(over([*keys, "_day"], t).rowsBetween(Window.unboundedPreceding, 0)) - F.col(thr)
    return df.withColumns(cols).drop("_day")


def peak_history(df: DataFrame, peak: str, ks: Sequence[int], keys: Keys, t: str) -> DataFrame:
    """Peaks among the k rows before; null until there are k."""
    return df.withColumns({f"peaks_{k}": framed(F.sum, peak, k, keys, t, shift=1) for k in ks})


def steps_since_peak(df: DataFrame, peak: str, keys: Keys, t: str, cap: int = 400) -> DataFrame:
    """Rows between the last earlier peak and the current row, at most cap; null before the
    first peak."""
    d = stitch.rows_since(df, peak, keys, t, "_rows_since")
    return d.withColumn("since_peak", F.least("_rows_since", F.when(F.col("_rows_since").isNotNull(), cap))).drop("_rows_since")


def day_so_far(df: DataFrame, x: str, qty: str, keys: Keys, t: str) -> DataFrame:
    w = Window.partitionBy(*keys, F.to_date(t)).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"day_max": F.max(x).over(w), "day_qty": F.sum(qty).over(w)})


def slot_rate(df: DataFrame, label: str, slot: str, train: Column, keys: Keys, prior: float = 50.0) -> DataFrame:
    """Smoothed rate of a label per slot, from TRAIN rows alone; the overall rate where a
    slot was never seen. The joined table has a row per key and slot."""
    part = df.where(train)
    total = part.groupBy(*keys).agg(F.avg(label).alias("p0"))
    by_slot = part.groupBy(*keys, slot).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    joined = df.join(total, list(keys), "left").join(by_slot, [*keys, slot], "left")
    rate = (F.col("s") + prior * F.col("p0")) / (F.col("n") + prior)
    return joined.withColumn("slot_rate", F.coalesce(rate, "p0")).drop("s", "n", "p0")


def work_calendar(days: DataFrame, day: str, holiday: str, keys: Keys = ()) -> DataFrame:
    """Work-day features of a table with one row per day: workday, bridge day, days to the
    next and since the last non-workday (-1 if there is none), and off_run, the days that
    remain of the run of non-work days, this one included."""
    w = Window.partitionBy(*keys).orderBy(day)
    off = (F.col(holiday) == 1) | (F.weekday(day) >= 5)
    d = days.withColumn("is_workday", (~off).cast("int"))
    near = (F.lag("is_workday").over(w) == 0) & (F.lead("is_workday").over(w) == 0)
    free = F.when(F.col("is_workday") == 0, F.col(day))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(free, ignorenulls=True).over(ahead)
    prev = F.last(free, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"is_bridge": F.coalesce(((F.col("is_workday") == 1) & near).cast("int"), F.lit(0)), "days_to_off": F.coalesce(F.datediff(nxt, day), F.lit(-1)), "days_since_off": F.coalesce(F.datediff(day, prev), F.lit(-1)), "_rn": F.row_number().over(w)})
    stop = F.first(F.when(F.col("is_workday") == 1, F.col("_rn")), ignorenulls=True).over(ahead)
    end = F.coalesce(stop, F.count("*").over(Window.partitionBy(*keys)) + 1)
    return d.withColumn("off_run", F.when(F.col("is_workday") == 0, end - F.col("_rn")).otherwise(0)).drop("_rn")


def solar(t: str, latitude: float, longitude: float, zone_hours: float) -> dict[str, Column]:
    """Solar elevation in degrees, daylight flag and day length in hours, with the equation
    of time."""
    year = F.radians(F.lit(360 / 365) * (F.dayofyear(t) - 81))
    tilt = F.radians(F.lit(23.44)) * F.sin(year)
    lat = F.radians(F.lit(latitude))
    minutes = 9.87 * F.sin(2 * year) - 7.53 * F.cos(year) - 1.5 * F.sin(year)
    true = (F.hour(t) + F.minute(t) / 60) * 60 + F.lit(4 * (longitude - 15 * zone_hours)) + minutes
    angle = F.radians(true / 4 - 180)
    elevation = F.degrees(F.asin(F.sin(lat) * F.sin(tilt) + F.cos(lat) * F.cos(tilt) * F.cos(angle)))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(lat) * F.tan(tilt)))
    return {"solar_elevation": elevation, "is_daylight": (elevation > 0).cast("int"), "day_length_h": F.degrees(F.acos(cosine)) * 2 / 15}


def season(t: str) -> Column:
    m = F.month(t)
    return F.when(m.isin(6, 7, 8), "summer").when(m.isin(11, 12, 1, 2), "winter").otherwise("spring_fall")


# Peak hours of the tariff outside winter and in winter.
PEAK_HOURS, WINTER_PEAK_HOURS = (11, 12, 13, 14, 15, 16, 17), (10, 11, 12, 17, 18, 19, 20, 21, 22)


def load_zone(t: str) -> Column:
    """Tariff zone by season and hour."""
    h = F.hour(t)
    peak = F.when(season(t) == "winter", h.isin(*WINTER_PEAK_HOURS)).otherwise(h.isin(*PEAK_HOURS))
    return F.when(peak, "peak").when((h >= 23) | (h < 9), "light").otherwise("mid")


def weather_derived(df: DataFrame, temp: str, keys: Keys, t: str, dew: str | None = None, pressure: str | None = None) -> DataFrame:
    """Differences and the day's mean of the temperature; with a dew point its spread and the
    apparent temperature (from the vapour pressure), with a pressure its 3-hour change."""
    w = over(keys, t)
    cols = {"temp_diff1h": F.col(temp) - F.lag(temp, 1).over(w), "temp_diff3h": F.col(temp) - F.lag(temp, 3).over(w), "temp_roll24h": framed(F.avg, temp, 24, keys, t, 6)}
    if dew:
        vapour = 6.11 * F.exp(17.27 * F.col(dew) / (237.3 + F.col(dew)))
        cols |= {"dew_spread": F.col(temp) - F.col(dew), "heat_proxy": F.col(temp) + 0.33 * vapour - 4.0}
    if pressure:
        cols["pressure_diff3h"] = F.col(pressure) - F.lag(pressure, 3).over(w)
    return df.withColumns(cols)


def previous_day(df: DataFrame, x: str, keys: Keys, t: str) -> DataFrame:
    """The day before's maximum and minimum."""
    day = df.groupBy(*keys, F.date_add(F.to_date(t), 1).alias("_day")).agg(F.max(x).alias("prev_max"), F.min(x).alias("prev_min"))
    return df.withColumn("_day", F.to_date(t)).join(day, [*keys, "_day"], "left").drop("_day")


def robust_scale(df: DataFrame, x: str, train: Column, keys: Keys) -> DataFrame:
    """(x - median) / IQR of each key's TRAIN rows; the deviation where the IQR is zero."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.where(train).groupBy(*keys).agg(q.alias("_q"), F.stddev_samp(x).alias("_s"))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    scale = F.when(iqr > 0, iqr).otherwise(F.coalesce(F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0)))
    return df.join(s, list(keys)).withColumn(f"{x}_scaled", (F.col(x) - F.col("_q")[1]) / scale).drop("_q", "_s")


def change_point(df: DataFrame, x: str, short: int, long: int, train: Column, keys: Keys, t: str, q: float = 0.9) -> DataFrame:
    """|mean of the last `short` rows - mean of the `long` rows before them| and whether it
    is over its TRAIN quantile."""
    recent = framed(F.avg, x, short, keys, t)
    prior = framed(F.avg, x, long, keys, t, shift=short)
    d = df.withColumn("cp_stat", F.abs(recent - prior))
    cut = d.where(train).groupBy(*keys).agg(F.percentile("cp_stat", F.lit(q)).alias("cp_cut"))
    return d.join(cut, list(keys), "left").withColumn("cp_flag", F.coalesce((F.col("cp_stat") > F.col("cp_cut")).cast("int"), F.lit(0)))


def centred_mean(df: DataFrame, x: str, n: int, keys: Keys, t: str) -> DataFrame:
    half = n // 2
    return df.withColumn(f"{x}_centred", F.avg(x).over(over(keys, t).rowsBetween(-half, half)))


def rolling_corr(df: DataFrame, a: str, b: str, n: int, keys: Keys, t: str) -> DataFrame:
    w = over(keys, t).rowsBetween(-n + 1, 0)
    spread = F.nullif(F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w), F.lit(0.0))
    return df.withColumn("roll_corr", F.when(F.count(a).over(w) >= n, F.covar_pop(a, b).over(w) / spread))


def onset_slopes(df: DataFrame, x: str, onset: str, ks: Sequence[int], keys: Keys, t: str) -> DataFrame:
    """Levels and slopes before each onset."""
    w = over(keys, t)
    cols = {f"before{k}": F.lag(x, k).over(w) for k in ks}
    cols |= {f"slope{k}": (F.lag(x, 1).over(w) - F.lag(x, k).over(w)) / (k - 1) for k in ks if k > 1}
    return df.withColumns(cols).where(F.col(onset) == 1)


def aligned_windows(df: DataFrame, x: str, onset: str, back: int, size: int, keys: Keys, step: str) -> DataFrame:
    """Min-max normalised windows around onsets, as arrays in step order; windows that run
    over an end of the series are dropped. A join on step copies at most `size` rows an
    onset."""
    starts = df.where(F.col(onset) == 1).select(*keys, F.col(step).alias("at"))
    want = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(step, F.col("at") - back + F.col("k"))
    rows = want.join(df.select(*keys, step, x), [*keys, step])
    shape = rows.groupBy(*keys, "at").agg(F.sort_array(F.collect_list(F.struct("k", x))).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return shape.where(F.size("s") == size).select(*keys, "at", F.transform("s", lambda p: F.coalesce((p[x] - F.col("lo")) / span, F.lit(0.0))).alias("shape"))
