"""Data-quality audits: repeated days and rows, structure, grids, leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform
from wattloom.plans.quantiles import quantiles
from wattloom.plans.ranks import numbered

Keys = Sequence[str]


def day_signatures(df: DataFrame, x: str, keys: Keys, t: str) -> DataFrame:
    """One row per series and day with its ordered values, their hash, and how many days of
    the series have the same values. A day's array is bounded by the grid."""
    day = df.groupBy(*keys, F.to_date(t).alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct(t, x))), lambda p: p[x]).alias("values"))
    same = Window.partitionBy(*keys, "values")
    return day.withColumns({"signature": F.xxhash64("values"), "n_same": F.count("*").over(same), "first_day": F.min("day").over(same)})


def duplicate_audit(signatures: DataFrame, keys: Keys, clean_from: str) -> DataFrame:
    """Days, repeated days, distinct profiles, and repeats across the clean boundary."""
    clean = F.col("day") >= F.to_date(F.lit(clean_from))
    groups = signatures.groupBy(*keys, "values").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"), F.count_if(clean).alias("c"))
    return groups.groupBy(*keys).agg(
        F.sum("n").alias("days"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.count("*").alias("profiles"), F.count_if((F.col("c") > 0) & (F.col("c") < F.col("n"))).alias("across"), F.max(F.datediff("b", "a")).alias("longest_span")
    )


def groups_across(df: DataFrame, group: str, role: str, by: Keys) -> DataFrame:
    """Groups with rows in both TRAIN and TEST, per fold."""
    has = lambda r: F.max((F.col(role) == r).cast("int"))
    g = df.groupBy(*by, group).agg(has("TRAIN").alias("a"), has("TEST").alias("b"), F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("crossing"), F.count("*").alias("groups"), F.sum(F.when((F.col("a") == 1) & (F.col("b") == 1), F.col("n")).otherwise(0)).alias("rows_crossing"))


def pair_forensics(df: DataFrame, features: Keys, label: str, order: str) -> DataFrame:
    """Groups of rows with equal features by size: groups, label conflicts, and groups whose
    rows stand next to each other. Grouping is on the features themselves."""
    g = df.groupBy(*features).agg(F.count("*").alias("size"), F.countDistinct(label).alias("labels"), (F.max(order) - F.min(order)).alias("span"))
    return g.groupBy("size").agg(F.count("*").alias("groups"), F.count_if(F.col("labels") > 1).alias("conflicts"), F.count_if(F.col("span") == F.col("size") - 1).alias("consecutive"))


def structure(df: DataFrame, columns: Keys, by: Keys = ()) -> DataFrame:
    """Per column: rows, nulls, distinct values, range, most frequent value's share. Values
    are counted per column first, so that the second step sees distinct values."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "column", "value")
    v = long.groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    return v.groupBy(*by, "column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(known).alias("distinct"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        (F.max(F.when(known, F.col("n"))) / F.sum("n")).alias("top_share"),
        (F.count_if(known) <= 1).cast("int").alias("constant"),
    )


def monotone(df: DataFrame, t: str, keys: Keys, order: str) -> DataFrame:
    """Steps back and repeats of a time column in row order."""
    d = df.withColumn("_p", F.lag(t).over(Window.partitionBy(*keys).orderBy(order)))
    return d.groupBy(*keys).agg(F.count_if(F.col(t) < F.col("_p")).alias("back"), F.count_if(F.col(t) == F.col("_p")).alias("repeats"), F.count("*").alias("n"))


def label_granularity(rows: DataFrame, results: DataFrame, day: str) -> DataFrame:
    """Days with rows, days with results, days of rows without a result, rows a day."""
    a = rows.groupBy(day).agg(F.count("*").alias("n"))
    missing = a.join(results.select(day).distinct(), day, "left_anti").agg(F.count("*").alias("days_without_result"))
    left = a.agg(F.count("*").alias("days"), F.avg("n").alias("rows_a_day"))
    return left.crossJoin(results.agg(F.countDistinct(day).alias("result_days"))).crossJoin(missing)


def run_structure(df: DataFrame, flag: str, order: Keys) -> DataFrame:
    """Rate of a flag by quarter of the row order; the first n % 4 quarters have a row more."""
    d, n = numbered(df.select(*order, flag), order)
    size, more = divmod(n, 4)
    rn = F.col("row_number")
    quarter = F.when(rn <= more * (size + 1), F.ceil(rn / (size + 1))).otherwise(more + F.ceil((rn - more * (size + 1)) / max(size, 1)))
    return d.groupBy(quarter.cast("int").alias("quarter")).agg(F.count("*").alias("n"), F.avg(flag).alias("rate"))


def order_auc(df: DataFrame, label: str, order: str) -> DataFrame:
    """AUC of the row order for a label, between the first and the last positive row: how far
    time alone tells the label. Rows of equal order share their rank."""
    v = df.groupBy(order).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    span = F.broadcast(v.where("_pos > 0").agg(F.min(order).alias("_a"), F.max(order).alias("_b")))
    d, _ = numbered(v.crossJoin(span).where(F.col(order).between(F.col("_a"), F.col("_b"))).drop("_a", "_b"), [order], "_upto", "_n")
    n, pos = F.sum("_n").cast("double"), F.sum("_pos").cast("double")
    ranks = F.sum(F.col("_pos") * (F.col("_upto") - (F.col("_n") - 1) / 2))
    return d.agg(F.sum("_n").alias("n"), ((ranks - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("auc"))


def equal_bins(df: DataFrame, x: str, y: str, split: str, bins: int, by: Keys = ()) -> DataFrame:
    """Rows in bins between quantiles of x; per bin the mean of y where split is below and
    above its bin median. Groups are few."""
    edges = F.broadcast(quantiles(df, x, [i / bins for i in range(1, bins)], by, "_e"))
    d = df.join(edges, list(by), "left") if by else df.crossJoin(edges)
    d = d.withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(x))))
    cut = F.broadcast(quantiles(d, split, [0.5], [*by, "bin"], "_m"))
    d = d.join(cut, [*by, "bin"], "left")
    low = F.col(split) <= F.col("_m")[0]
    return d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(F.when(low, F.col(y))).alias("y_low"), F.avg(F.when(~low, F.col(y))).alias("y_high"))


def quality_flags(df: DataFrame, x: str, by: Keys, saturated: float) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(x) == 0).alias("zeros"), F.count_if(F.col(x) >= saturated).alias("saturated"), F.count_if(F.col(x).isNull()).alias("missing"))


def grid_fingerprint(df: DataFrame, x: str, step: float, by: Keys) -> DataFrame:
    """How far values stand from a grid, their decimals, share of unique values and least
    step between neighbours."""
    v = df.groupBy(*by, x).agg(F.count("*").alias("n"))
    d = v.withColumn("_next", F.lead(x).over(Window.partitionBy(*by).orderBy(x)))
    off = F.abs(F.col(x) / step - F.round(F.col(x) / step))
    decimals = F.length(F.rtrim(F.split_part(F.format_string("%.6f", F.col(x)), F.lit("."), F.lit(2)), F.lit("0")))
    return d.groupBy(*by).agg((F.sum(off * F.col("n")) / F.sum("n")).alias("off_grid"), F.max(decimals).alias("decimals"), (F.count("*") / F.sum("n")).alias("unique_share"), F.min(F.col("_next") - F.col(x)).alias("least_step"))


def top_k(df: DataFrame, k: int, keys: Keys, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def arg_min(df: DataFrame, keys: Keys, *order: str | Column) -> DataFrame:
    """The least row of each group, as an aggregate: no sort of groups."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def budget(df: DataFrame, label: str, score: str, share: float, by: Keys, tie: str) -> DataFrame:
    """Recall and precision of alerting on the best `share` of rows."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score), tie)), "_n": F.count("*").over(w)})
    hit = F.col("_r") <= F.round(share * F.col("_n"))
    return d.groupBy(*by).agg((F.sum(F.when(hit, F.col(label)).otherwise(0)) / F.nullif(F.sum(label), F.lit(0))).alias("recall"), F.avg(F.when(hit, F.col(label))).alias("precision"), F.count_if(hit).alias("alerts"))


def stratified(df: DataFrame, strata: Keys, per: int, least: int, keys: Keys, seed: int = 0) -> DataFrame:
    """`per` rows of each stratum by hashed order, topped up to `least` rows in all from the
    others in that order: the hash of the first key, then the keys."""
    d = df.withColumn("_u", uniform(F.lit(seed), keys[0]))
    d = d.withColumn("_first", (F.row_number().over(Window.partitionBy(*strata).orderBy("_u", *keys)) <= per).cast("int"))
    # the top-up needs at most `least` rows: the smallest of each task, then of all
    some = d.where("_first = 0").orderBy("_u", *keys).limit(least)
    rest = some.withColumn("_place", F.row_number().over(Window.partitionBy("_first").orderBy("_u", *keys)))
    have = F.broadcast(d.where("_first = 1").agg(F.count("*").alias("_have")))
    top = rest.crossJoin(have).where(F.col("_place") <= least - F.col("_have")).drop("_place", "_have")
    return d.where("_first = 1").unionByName(top).drop("_u", "_first")


def profiles(df: DataFrame, state: Keys, x: str, ramp: str, peak: str, hour: Column, by: Keys = ()) -> DataFrame:
    """Share, level, deviation, ramp, modal hour and peak rate of each state."""
    h = df.withColumn("_h", hour).groupBy(*by, *state, "_h").agg(F.count("*").alias("_c")).groupBy(*by, *state).agg(F.max_by("_h", F.struct("_c", -F.col("_h"))).alias("modal_hour"))
    p = df.groupBy(*by, *state).agg(F.count("*").alias("n"), F.avg(x).alias("level"), F.stddev_samp(x).alias("deviation"), F.avg(F.abs(ramp)).alias("ramp"), F.avg(peak).alias("peak_rate"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return p.withColumn("share", share).join(h, [*by, *state])


def leakage(df: DataFrame, x: str, parts: Keys, by: Keys, tolerance: float = 0.5) -> DataFrame:
    """Share of rows where a column equals the mean of later targets."""
    mean = sum((F.col(c) for c in parts[1:]), F.col(parts[0])) / len(parts)
    return df.groupBy(*by).agg(F.avg((F.abs(F.col(x) - mean) <= tolerance).cast("int")).alias("equal_share"), F.countDistinct(x).alias("distinct"))


def crosstab_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs and each pair's share of its row."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return c.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def vs_base(df: DataFrame, variant: str, base: str, value: str, by: Keys) -> DataFrame:
    """Each variant's value against the base variant's."""
    b = F.max(F.when(F.col(variant) == base, F.col(value))).over(Window.partitionBy(*by))
    return df.withColumns({"base": b, "ratio": F.col(value) / F.nullif(b, F.lit(0.0))})
