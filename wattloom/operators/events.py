"""Event algebra on flagged series: runs of flags (gaps and islands), onsets, recall, lead.

`step` is the row's integer place on the series' grid. Runs are found in chunks of steps and
stitched at their borders (plans.stitch), frames reach a few rows over a chunk's border
(plans.halo): no window holds a whole series. Events are matched with alerts by frames,
never by comparing all events with all alerts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.plans.halo import with_frames
from wattloom.plans.stitch import run_ids

Keys = Sequence[str]


def runs(df: DataFrame, flag: str, keys: Keys, step: str, gap: int = 2, **extra: Column) -> DataFrame:
    """One row per run: event_id, first and last step, n flagged rows, and aggregates."""
    more = [c.alias(n) for n, c in extra.items()]
    return run_ids(df, flag, keys, step, gap).groupBy(*keys, "event_id").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("n"), *more)


def strict_runs(df: DataFrame, flag: str, keys: Keys, step: str, **extra: Column) -> DataFrame:
    """Runs of consecutive flags alone."""
    return runs(df, flag, keys, step, 1, **extra)


def onsets(df: DataFrame, flag: str, keys: Keys, step: str) -> DataFrame:
    """onset = 1 where the flag rises from 0."""
    before = lambda w: F.coalesce(F.lag(flag).over(w), F.lit(0))
    return with_frames(df, keys, step, 1, 0, lambda w: {"onset": ((F.col(flag) == 1) & (before(w) == 0)).cast("int")})


def future_any(df: DataFrame, flag: str, k: int, keys: Keys, step: str, name: str = "future") -> DataFrame:
    """Whether the flag is set in (step, step + k]."""
    return with_frames(df, keys, step, 0, k, lambda w: {name: F.coalesce(F.max(flag).over(w.rowsBetween(1, k)), F.lit(0))})


def anatomy(df: DataFrame, flag: str, x: str, keys: Keys, step: str, pad: int = 8) -> DataFrame:
    """Per run: duration, peak and its step, baseline (mean of the pad rows before), area
    over the baseline, rise in level and steps, mean after, rebound."""
    d = with_frames(df, keys, step, pad, pad, lambda w: {"_pre": F.avg(x).over(w.rowsBetween(-pad, -1)), "_post": F.avg(x).over(w.rowsBetween(1, pad)), "_low": F.min(x).over(w.rowsBetween(1, pad))})
    e = runs(d, flag, keys, step, 2, peak=F.max(x), peak_step=F.max_by(step, F.struct(F.col(x), -F.col(step))), baseline=F.min_by("_pre", step), post=F.max_by("_post", step), low_after=F.max_by("_low", step), total=F.sum(x))
    return e.select(
        *keys,
        "event_id",
        (F.col("last") - F.col("first") + 1).alias("duration"),
        "peak",
        "peak_step",
        "baseline",
        (F.col("total") - F.col("n") * F.coalesce("baseline", F.lit(0.0))).alias("area"),
        (F.col("peak") - F.col("baseline")).alias("rise"),
        (F.col("peak_step") - F.col("first")).alias("rise_steps"),
        "post",
        (F.col("post") - F.col("low_after")).alias("rebound"),
    )


def exceedance(df: DataFrame, flag: str, x: str, thr: str, keys: Keys, step: str) -> DataFrame:
    """Size of the largest exceedance per run."""
    return runs(df.withColumn("_over", F.col(x) - F.col(thr)), flag, keys, step, 2, size=F.max("_over"))


def event_recall(df: DataFrame, flag: str, alert: str, k: int, keys: Keys, step: str, include_onset: bool = False, minutes: int = 15) -> DataFrame:
    """Per event whether an alert came in the k rows before its onset (or at it), and the
    lead of the first one, at most k steps. The look-back is a frame on the dense grid."""
    frame = lambda w: w.rowsBetween(-k, 0 if include_onset else -1)
    d = with_frames(df, keys, step, k, 0, lambda w: {"_first": F.min(F.when(F.col(alert) == 1, F.col(step))).over(frame(w))})
    e = runs(d, flag, keys, step, 2, first_alert=F.min_by("_first", step))
    lead = F.when(F.col("first_alert").isNotNull(), F.least(F.col("first") - F.col("first_alert"), F.lit(k)) * minutes)
    return e.select(*keys, "event_id", "first", "last", F.col("first_alert").isNotNull().cast("int").alias("detected"), lead.alias("lead_min"))


def covered_events(df: DataFrame, flag: str, alert: str, keys: Keys, step: str, before: int = 0) -> DataFrame:
    """Per event whether an alert stands inside it or up to `before` steps ahead, and the
    first such alert's distance to the onset."""
    near = lambda w: {"_near": F.min(F.when(F.col(alert) == 1, F.col(step))).over(w.rowsBetween(-before, 0))}
    e = runs(with_frames(df, keys, step, before, 0, near), flag, keys, step, 2, first_alert=F.min("_near"))
    return e.select(*keys, "event_id", "first", "last", F.col("first_alert").isNotNull().cast("int").alias("detected"), (F.col("first") - F.col("first_alert")).alias("lead_steps"))


def alert_load(df: DataFrame, alert: str, keys: Keys, step: str, per_day: int = 96, minutes_per_alert: float = 5.0) -> DataFrame:
    """Alert runs and steps per day, and checking minutes per day."""
    days = df.groupBy(*keys).agg((F.count("*") / per_day).alias("days"), F.sum(alert).alias("steps"))
    n = runs(df, alert, keys, step).groupBy(*keys).agg(F.count("*").alias("runs"))
    return days.join(n, list(keys), "left").select(
        *keys,
        (F.coalesce("runs", F.lit(0)) / F.col("days")).alias("runs_per_day"),
        (F.col("steps") / F.col("days")).alias("steps_per_day"),
        (F.coalesce("runs", F.lit(0)) * minutes_per_alert / F.col("days")).alias("check_minutes_per_day"),
    )


def local_peaks(df: DataFrame, x: str, prominence: float, look: int, keys: Keys, step: str) -> DataFrame:
    """Rows higher than both neighbours (the first row of a plateau stands for it) whose
    prominence, within `look` rows to each side, is at least the given one.

    The higher base of both sides is subtracted; a side ends before its first row that is
    higher than the peak."""
    w = Window.partitionBy(*keys).orderBy(step)
    # equal neighbours are one point: only rows where the value changes are compared
    d = df.withColumn("_prev", F.lag(x).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(x)))
    d = d.withColumns({"_next": F.lead(x).over(w), "_left": F.reverse(F.collect_list(x).over(w.rowsBetween(-look, -1))), "_right": F.collect_list(x).over(w.rowsBetween(1, look))})
    peak = d.where((F.col(x) > F.col("_prev")) & (F.col(x) > F.col("_next")))

    def base(side: str) -> Column:
        higher = F.array_position(F.transform(side, lambda v: v > F.col(x)), True)
        part = F.when(higher > 0, F.slice(side, 1, (higher - 1).cast("int"))).otherwise(F.col(side))
        return F.coalesce(F.array_min(part), F.col(x))

    out = peak.withColumn("prominence", F.col(x) - F.greatest(base("_left"), base("_right")))
    return out.where(F.col("prominence") >= prominence).select(*keys, step, x, "prominence")


def peak_definitions(df: DataFrame, x: str, keys: Keys, step: str, day: Column, trailing: str) -> DataFrame:
    """Flags of several definitions of a peak: over the series' p95 or p99, over a trailing
    threshold, a local maximum, the day's maximum."""
    cut = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.95), F.lit(0.99))).alias("_q"))
    w = Window.partitionBy(*keys).orderBy(step)
    by_day = Window.partitionBy(*keys, "_day")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    d = df.withColumn("_day", day).join(cut, list(keys))
    return d.withColumns({
        "p95": flag(F.col(x) >= F.col("_q")[0]),
        "p99": flag(F.col(x) >= F.col("_q")[1]),
        "trailing": flag(F.col(x) >= F.col(trailing)),
        "local_max": flag((F.col(x) > F.lag(x).over(w)) & (F.col(x) > F.lead(x).over(w))),
        "day_max": flag((F.col(x) == F.max(x).over(by_day)) & (F.col(x) > 0)),
    }).drop("_q", "_day")


def missed_taxonomy(df: DataFrame, flag: str, alert: str, margin: str, mae: str, keys: Keys, step: str, ways: Keys = ()) -> DataFrame:
    """Each event as caught, forecast_miss (best margin under -2 MAE), rule_blocked (at
    least -1 MAE) or undetermined, and by which other ways (0/1 columns: a lower threshold, a
    probability, another stage) it would have been caught. mae is a column of the series."""
    e = runs(df, flag, keys, step, 2, caught=F.max(alert), best=F.max(margin), _mae=F.max(mae), **{w: F.max(w) for w in ways})
    kind = F.when(F.col("caught") == 1, "caught").when(F.col("best") < -2 * F.col("_mae"), "forecast_miss").when(F.col("best") >= -F.col("_mae"), "rule_blocked").otherwise("undetermined")
    return e.withColumn("kind", kind).drop("_mae")


def false_alarms(df: DataFrame, alert: str, label: str, margin: str, near: float, keys: Keys, step: str) -> DataFrame:
    """Alert runs without any label, and whether they came near one."""
    e = runs(df, alert, keys, step, 2, any_label=F.max(label), best=F.max(margin))
    return e.where("any_label = 0").withColumn("near_miss", (F.col("best") >= -near).cast("int")).drop("any_label")
