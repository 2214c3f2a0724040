"""Operator advisories from alerts, reliability and explanation flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("HUMAN_REVIEW", "CONFIRMED_WARNING", "LOW_CONFIDENCE_WARNING", "INFORMATION_GAP", "EARLY_WATCH", "NORMAL")


def flags(df: DataFrame, early: Column, confirm: Column, unsure: Column, transition: Column, ramp_high: Column, idle: Column) -> DataFrame:
    """explained, gap, alert, early and unsure as 0/1 columns."""
    explained = transition | ramp_high | idle | (early & ~confirm)
    named = {"early": early, "alert": early & confirm, "unsure": unsure, "explained": explained, "gap": unsure & ~explained}
    return df.withColumns({k: F.coalesce(c, F.lit(False)).cast("int") for k, c in named.items()})


def advisory(ood: Column) -> Column:
    """The first rule that holds, in the order of LEVELS."""
    on = lambda c: F.col(c) == 1
    return F.when(ood, LEVELS[0]).when(on("alert") & ~on("unsure"), LEVELS[1]).when(on("alert"), LEVELS[2]).when(on("gap"), LEVELS[3]).when(on("early"), LEVELS[4]).otherwise(LEVELS[5])


FINE_LEVELS = ("HUMAN_REVIEW", "WARN_CONFIRMED", "WARN_LOW_CONFIDENCE", "ADVISORY_UNCERTAIN", "EARLY_WATCH", "MONITOR_LOW_CONFIDENCE", "NORMAL_MONITORING")


def advisory_fine(ood: Column, confirm: Column) -> Column:
    """The first rule that holds, in the order of FINE_LEVELS; an early row that is unsure and
    not confirmed is an uncertain advisory."""
    on = lambda c: F.col(c) == 1
    rules = (ood, on("alert") & ~on("unsure"), on("alert"), on("early") & ~confirm & on("unsure"), on("early"), on("unsure"))
    out = F.when(rules[0], FINE_LEVELS[0])
    for rule, level in zip(rules[1:], FINE_LEVELS[1:]):
        out = out.when(rule, level)
    return out.otherwise(FINE_LEVELS[-1])


def reasons(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Texts of all rules that hold, in order, joined by ` / `."""
    return F.coalesce(F.nullif(F.concat_ws(" / ", *[F.when(c, F.lit(t)) for c, t in rules]), F.lit("")), F.lit(otherwise))


def information_type(ood: Column, transition: Column, idle: Column) -> Column:
    on = lambda c: F.col(c) == 1
    return F.when(on("gap") | ood, "equipment state or process stage").when(transition, "setup and changeover log").when(on("unsure") & idle, "equipment state").when(on("unsure"), "product and lot").otherwise("none")


def routing(df: DataFrame, error: str, covered: str, peak: str, by: Sequence[str] = ()) -> DataFrame:
    """The 2 x 2 table of reliable / uncertain and explained / unexplained."""
    cell = F.concat_ws("_", F.when(F.col("unsure") == 1, "uncertain").otherwise("reliable"), F.when(F.col("explained") == 1, "explained").otherwise("unexplained"))
    return df.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(error).alias("mae"), F.avg(covered).alias("coverage"), F.avg(peak).alias("prevalence"))


def flag_validation(df: DataFrame, names: Sequence[str], error: str, covered: str, peak: str, by: Sequence[str], high: float = 0.8) -> DataFrame:
    """Per flag: rows, share, error, coverage and peaks inside against outside it, and how well
    it tells large errors (over their quantile `high` in the group): AUC, AP and AP over the
    share of large errors. A flag has two scores, so both follow from four counts."""
    cut = df.groupBy(*by).agg(F.percentile(error, F.lit(high)).alias("_cut"))
    d = df.join(cut, list(by)).withColumn("_high", (F.col(error) >= F.col("_cut")).cast("int"))
    long = d.unpivot([*by, error, covered, peak, "_high"], list(names), "flag", "on")
    inside = lambda c, v: F.avg(F.when(F.col("on") == v, F.col(c)))
    n, flagged = F.count("*"), F.sum("on")
    positives, hits = F.sum("_high"), F.sum(F.col("on") * F.col("_high"))
    g = long.groupBy(*by, "flag").agg(
        flagged.alias("n"), F.avg("on").alias("share"), inside(error, 1).alias("mae_in"), inside(error, 0).alias("mae_out"), inside(covered, 1).alias("coverage_in"), inside(covered, 0).alias("coverage_out"),
        inside(peak, 1).alias("peaks_in"), n.alias("_n"), positives.alias("_p"), hits.alias("_tp"),
    )
    part = lambda a, b: a / F.nullif(b, F.lit(0))
    recall, false = part(F.col("_tp"), F.col("_p")), part(F.col("n") - F.col("_tp"), F.col("_n") - F.col("_p"))
    rate = F.col("_p") / F.col("_n")
    ap = recall * F.coalesce(part(F.col("_tp"), F.col("n")), F.lit(0.0)) + (1 - recall) * rate
    g = g.withColumns({"mae_ratio": F.col("mae_in") / F.nullif("mae_out", F.lit(0.0)), "auc": 0.5 + (recall - false) / 2, "ap": ap})
    return g.withColumn("lift", F.col("ap") / F.nullif(rate, F.lit(0.0))).drop("_n", "_p", "_tp")


def forbidden(df: DataFrame, column: str, phrases: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows whose text has a phrase that operators must not read."""
    return df.groupBy(*by).agg(F.count_if(F.col(column).rlike("(?i)" + "|".join(phrases))).alias("n_forbidden"), F.count("*").alias("n"))


def contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the given columns in order; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns)
