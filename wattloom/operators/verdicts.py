"""Decisions over metric tables: retention, marginal value, scenarios, adoption rules.

Metric tables have a row per variant, level or policy; windows run over those rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]

# Information levels, each holding the ones before it, and the production columns
# that are known for certain when a forecast is made.
LEVELS = {
    "L0_power": ["kw", "kw_lag1", "kw_lag2", "kw_lag3", "kw_lag4", "kw_lag8", "kw_lag96", "kw_roll4", "kw_roll96", "kw_diff1", "kw_ramp4", "kw_std4", "kw_std96", "kw_max96"],
    "L1_calendar": ["slot", "hour", "dow", "day", "month", "is_weekend", "season"],
    "L2_weather": ["temp", "humidity", "wind", "rain"],
    "L3_production": ["qty", "prod_lag4", "prod_diff", "is_operating"],
}
STRICT = ["prod_lag4", "prod_diff", "is_operating_lag4"]


def level_columns(level: str, strict: bool = False) -> list[str]:
    """Columns of a level and all before it; strict has the certain production columns."""
    out: list[str] = []
    for name, columns in LEVELS.items():
        out += STRICT if strict and name == "L3_production" else columns
        if name == level:
            return out
    raise KeyError(level)


def catalogue(df: DataFrame) -> DataFrame:
    """One row per catalogued feature: its level, whether it is known ahead, whether it rests on
    an assumption (the production plan), whether df has it, and the share of rows with a value."""
    rows = [(c, level, level == "L1_calendar", level == "L3_production" and c not in STRICT) for level, columns in LEVELS.items() for c in columns]
    rows += [(c, "L3s_strict", False, False) for c in STRICT if c not in LEVELS["L3_production"]]
    table = df.sparkSession.createDataFrame(rows, "feature string, level string, known_ahead boolean, assumption_dependent boolean")
    have = [c for c, *_ in rows if c in df.columns]
    filled = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in have]).unpivot([], have, "feature", "filled")
    return table.join(F.broadcast(filled), "feature", "left").withColumn("present", F.col("filled").isNotNull())


def retention(df: DataFrame, level: str, error: str, by: Keys, shares: Sequence[float] = (0.9, 0.95, 0.98)) -> DataFrame:
    """Share of the best level's gain over the first level that each level keeps, and which
    of the shares it reaches."""
    w = Window.partitionBy(*by)
    first = F.first(error).over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = (first - F.col(error)) / F.nullif(first - F.min(error).over(w), F.lit(0.0))
    out = df.withColumn("kept", kept)
    return out.withColumns({f"over_{int(s * 100)}": (F.col("kept") >= s).cast("int") for s in shares})


def marginal(df: DataFrame, level: str, error: str, by: Keys) -> DataFrame:
    """Gain of each level over the one before it."""
    before = F.lag(error).over(Window.partitionBy(*by).orderBy(level))
    return df.withColumns({"gain": before - F.col(error), "gain_share": (before - F.col(error)) / F.nullif(before, F.lit(0.0))})


def scenarios(curve: DataFrame, scenario: DataFrame, by: Keys, order: Keys) -> DataFrame:
    """Money scenarios (name, miss_cost, alarm_cost) as cost ratios, each with the cheapest
    row of the nearest evaluated ratio. scenario is a small table."""
    goal = scenario.select("name", (F.col("miss_cost") / F.col("alarm_cost")).alias("implied"))
    rows = F.struct(*[c for c in curve.columns if c not in by])
    rank = F.struct(F.round(F.abs(F.col("ratio") - F.col("implied")), 9), F.round("cost", 12), *order)
    best = curve.crossJoin(F.broadcast(goal)).groupBy(*by, "name", "implied").agg(F.min_by(rows, rank).alias("_b"))
    return best.select(*by, "name", "implied", "_b.*")


def adopt(df: DataFrame, conditions: dict[str, Column], by: Keys) -> DataFrame:
    """adopt = 1 only if every condition holds on every row of the group, and the names of
    those that fail."""
    each = [F.coalesce(F.min(c.cast("int")), F.lit(0)).alias(n) for n, c in conditions.items()]
    d = df.groupBy(*by).agg(*each)
    failed = F.concat_ws(",", *[F.when(F.col(n) == 0, F.lit(n)) for n in conditions])
    return d.select(*by, F.least(*[F.col(n) for n in conditions], F.lit(1)).alias("adopt"), failed.alias("failed"))


def hard_conditions(df: DataFrame, error: str, conditions: dict[str, Column], by: Keys, fold: str, lift: float = 1.2, support: float = 0.02) -> DataFrame:
    """Error under each condition and each pair of conditions against all rows, and in how
    many folds it is over `lift` with enough support. One pass: a row is exploded to the
    conditions that it meets."""
    names = list(conditions)
    single = [F.when(conditions[n], F.lit(n)) for n in names]
    pairs = [F.when(conditions[a] & conditions[b], F.lit(f"{a}&{b}")) for i, a in enumerate(names) for b in names[i + 1 :]]
    tags = F.array_compact(F.array(*single, *pairs, F.lit("ALL")))
    g = df.withColumn("condition", F.explode(tags)).groupBy(*by, fold, "condition").agg(F.count("*").alias("n"), F.sum(error).alias("s"))
    w = Window.partitionBy(*by, fold)
    every = lambda c: F.max(F.when(F.col("condition") == "ALL", F.col(c))).over(w)
    ratio = (F.col("s") / F.col("n")) / F.nullif(every("s") / every("n"), F.lit(0.0))
    hard = (ratio >= lift) & (F.col("n") >= support * every("n"))
    g = g.withColumns({"_ratio": ratio, "_hard": hard.cast("int")})
    return g.where("condition <> 'ALL'").groupBy(*by, "condition").agg(F.sum("n").alias("n"), F.avg("_ratio").alias("ratio"), F.sum("_hard").alias("folds_hard"), F.count("*").alias("folds"))


def stress_map(df: DataFrame, error: str, conditions: dict[str, Column], by: Keys) -> DataFrame:
    """Rows, share, MAE, its ratio to all rows and p95 under each named condition."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()], F.lit("ALL")))
    g = df.withColumn("condition", F.explode(met)).groupBy(*by, "condition").agg(F.count("*").alias("n"), F.avg(error).alias("mae"), F.percentile(error, F.lit(0.95)).alias("err_p95"))
    every = lambda c: F.max(F.when(F.col("condition") == "ALL", F.col(c))).over(Window.partitionBy(*by))
    return g.withColumns({"share": F.col("n") / every("n"), "ratio": F.col("mae") / F.nullif(every("mae"), F.lit(0.0))})


def regime_structure(profiles: DataFrame, whole: DataFrame, by: Keys) -> DataFrame:
    """Whether the states of each definition show the three structures: a low one (low load,
    not the steepest, few peaks), a stable one (load over the median, ramp at most the states'
    median) and a transition (the steepest, with errors over the states' median and a ramp over
    the median). profiles: definition, state, level, ramp, peak_rate, mae; whole: med_level,
    med_ramp."""
    w = Window.partitionBy(*by, "definition")
    d = profiles.join(whole, list(by)).withColumns({"_top": F.max("ramp").over(w), "_mr": F.percentile("ramp", F.lit(0.5)).over(w), "_me": F.percentile("mae", F.lit(0.5)).over(w)})
    low = (F.col("level") < F.col("med_level")) & (F.col("ramp") < F.col("_top")) & (F.col("peak_rate") < 0.05)
    stable = (F.col("level") >= F.col("med_level")) & (F.col("ramp") <= F.col("_mr"))
    steep = (F.col("ramp") == F.col("_top")) & (F.col("mae") > F.col("_me")) & (F.col("ramp") > F.col("med_ramp"))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    out = d.groupBy(*by, "definition").agg(F.count("*").alias("states"), any_(low).alias("low"), any_(stable).alias("stable"), any_(steep).alias("transition"))
    return out.withColumn("three", F.least("low", "stable", "transition"))


def recommend(df: DataFrame, honest: Column, by: Keys, least_auc: float = 0.85, least_lift: float = 3.0) -> DataFrame:
    """Peak definitions by their figures (prevalence, auc, lift, gap between windows): eligible
    if honest, of 2 to 15 % prevalence and screenable, and of these the one of least gap."""
    fit = honest & F.col("prevalence").between(0.02, 0.15) & (F.col("auc") >= least_auc) & (F.col("lift") >= least_lift)
    d = df.withColumn("eligible", F.coalesce(fit, F.lit(False)).cast("int"))
    first = F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(F.desc("eligible"), F.round("gap", 9), by[-1])) == 1
    return d.withColumn("recommended", ((F.col("eligible") == 1) & first).cast("int"))
