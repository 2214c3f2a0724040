"""Runs and running values of long series, by chunk summaries and a stitch of their borders.

A series is cut in chunks of steps. Inside a chunk rows are worked through alone; what a
chunk hands to the next is a small associative summary (sums, extremes, its first and last
row), and the summaries of all chunks before one are combined in two levels: chunks inside
a group of FAN chunks, then groups. So no window holds a series: the longest is a chunk's
rows, FAN chunks, or the groups of one series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a chunk, and chunks of a group.
STEPS, FAN = 4096, 4096
#: Groups that a series has at most.
TOP = 1 << 31
CHUNK, GROUP = "_chunk", "_group"

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}
Keys = Sequence[str]


def chunked(df: DataFrame, keys: Keys, step: str, steps: int = STEPS) -> DataFrame:
    """df with its chunk, dealt by series and chunk: summaries and rows share that shuffle."""
    return df.withColumn(CHUNK, F.floor(F.col(step) / steps).cast("long")).repartition(*keys, CHUNK)


def before(chunks: DataFrame, keys: Keys, values: Mapping[str, str], fan: int = FAN) -> DataFrame:
    """chunks (a row per series and chunk) with each value replaced by its combination over
    the series' earlier chunks: null, or 0 for sums, where there are none. values: the kind
    (sum, max, min) of each column."""
    kinds = {c: _COMBINE[k] for c, k in values.items()}
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    d = chunks.withColumn(GROUP, F.floor(F.col(CHUNK) / fan))
    groups = d.groupBy(*keys, GROUP).agg(*[f(c).alias(c) for c, f in kinds.items()])
    # a series has one group for every steps * fan steps: no further level is needed below TOP of them
    top = past(Window.partitionBy(*keys, F.floor(F.col(GROUP) / TOP)).orderBy(GROUP))
    groups = groups.select(*keys, GROUP, *[f(c).over(top).alias(f"_g_{c}") for c, f in kinds.items()])
    inside = past(Window.partitionBy(*keys, GROUP).orderBy(CHUNK))
    d = d.withColumns({c: f(c).over(inside) for c, f in kinds.items()}).join(groups, [*keys, GROUP])
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    return d.withColumns({c: both[k](F.col(c), F.col(f"_g_{c}")) for c, k in values.items()}).drop(GROUP, *[f"_g_{c}" for c in values])


def run_ids(df: DataFrame, flag: str, keys: Keys, step: str, gap: int = 2, steps: int = STEPS, fan: int = FAN) -> DataFrame:
    """The flagged rows with the number of their run in the series; flags at most `gap` steps
    apart are one run.

    A chunk's summary is its first and last flagged step and the runs that begin inside it
    after the first; whether its first flag begins a run follows from the last flag before."""
    d = chunked(df.where(F.col(flag) == 1), keys, step, steps)
    w = Window.partitionBy(*keys, CHUNK).orderBy(step)
    d = d.withColumn("_before", F.lag(step).over(w)).withColumn("_new", (F.col(step) - F.col("_before") > gap).cast("long"))
    summary = d.groupBy(*keys, CHUNK).agg(F.min(step).alias("_first"), F.max(step).alias("_last"), F.coalesce(F.sum("_new"), F.lit(0)).alias("_inner"))
    seen = before(summary.select(*keys, CHUNK, F.col("_first"), F.col("_last"), F.col("_inner")), keys, {"_last": "max"}, fan)
    begins = F.coalesce((F.col("_first") - F.col("_last") > gap).cast("long"), F.lit(1))
    seen = seen.withColumns({"_begins": begins, "_runs": F.col("_inner") + begins}).select(*keys, CHUNK, "_begins", "_runs")
    seen = before(seen, keys, {"_runs": "sum"}, fan)
    inner = F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return d.join(seen, [*keys, CHUNK]).withColumn("event_id", F.col("_runs") + F.col("_begins") + inner).drop("_before", "_new", "_begins", "_runs", CHUNK)


def run_length(df: DataFrame, state: str, keys: Keys, step: str, name: str, steps: int = STEPS, fan: int = FAN) -> DataFrame:
    """df with the rows since the state changed, this row included. A null state is a state.

    A chunk's summary is its number of rows, its first and last state, and where its last
    change stands; the change at its first row follows from the last state before."""
    d = chunked(df, keys, step, steps)
    w = Window.partitionBy(*keys, CHUNK).orderBy(step)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_rn": F.row_number().over(w), "_state": F.struct(F.col(state).alias("s"))})
    d = d.withColumn("_from", F.when((F.col("_rn") > 1) & ~F.lag("_state").over(w).eqNullSafe(F.col("_state")), F.col("_rn")))
    d = d.withColumn("_from", F.max("_from").over(so_far))  # of the run, if it begins in the chunk after the first row
    summary = d.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"), F.min_by("_state", step).alias("_head"), F.max(F.struct(F.col(step).alias("at"), F.col("_state").alias("state"))).alias("_tail"), F.max("_from").alias("_turn"))
    seen = before(summary.withColumn("_rows", F.col("_n")), keys, {"_tail": "max", "_rows": "sum"}, fan)
    changed = F.col("_tail").isNull() | ~F.col("_tail.state").eqNullSafe(F.col("_head"))
    start = F.when(F.col("_turn").isNotNull(), F.col("_rows") + F.col("_turn")).when(changed, F.col("_rows") + 1)
    own = F.when(changed, F.col("_rows") + 1)  # where the chunk's first run begins, if in it
    seen = before(seen.select(*keys, CHUNK, "_rows", own.alias("_own"), start.alias("_start")), keys, {"_start": "max"}, fan)
    begin = F.coalesce(F.col("_rows") + F.col("_from"), F.col("_own"), F.col("_start"))
    return d.join(seen, [*keys, CHUNK]).withColumn(name, F.col("_rows") + F.col("_rn") - begin + 1).drop("_rn", "_state", "_from", "_rows", "_own", "_start", CHUNK)


def rows_since(df: DataFrame, flag: str, keys: Keys, step: str, name: str, steps: int = STEPS, fan: int = FAN) -> DataFrame:
    """df with the rows between the last earlier flagged row and this one; null before the first."""
    d = chunked(df, keys, step, steps)
    w = Window.partitionBy(*keys, CHUNK).orderBy(step)
    d = d.withColumn("_rn", F.row_number().over(w))
    flagged = F.when(F.col(flag) == 1, F.col("_rn"))
    summary = d.groupBy(*keys, CHUNK).agg(F.count("*").alias("_rows"), F.max(flagged).alias("_in"))
    seen = before(summary, keys, {"_rows": "sum"}, fan).withColumn("_last", F.col("_rows") + F.col("_in"))
    seen = before(seen.select(*keys, CHUNK, "_rows", "_last"), keys, {"_last": "max"}, fan)
    d = d.withColumn("_in", F.max(flagged).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(seen, [*keys, CHUNK])
    last = F.coalesce(F.col("_rows") + F.col("_in"), F.col("_last"))
    return d.withColumn(name, F.col("_rows") + F.col("_rn") - last - 1).drop("_rn", "_in", "_rows", "_last", CHUNK)
