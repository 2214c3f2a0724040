"""Forecast, classification and calibration metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform

Keys = Sequence[str]


def forecast_metrics(df: DataFrame, y: str, pred: str, naive: str, peak: str, by: Keys) -> DataFrame:
    """MAE, RMSE, normalised MAE, improvement over the naive forecast, MAE on peaks, and
    error quantiles."""
    e = df.withColumns({"_e": F.abs(F.col(y) - F.col(pred)), "_n": F.abs(F.col(y) - F.col(naive))})
    return e.groupBy(*by).agg(
        F.count("_e").alias("n"),
        F.avg("_e").alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (F.avg("_e") / F.nullif(F.avg(y), F.lit(0.0))).alias("nmae"),
        (1 - F.avg("_e") / F.nullif(F.avg("_n"), F.lit(0.0))).alias("gain"),
        F.avg(F.when(F.col(peak) == 1, F.col("_e"))).alias("mae_peak"),
        F.percentile("_e", F.lit(0.9)).alias("e90"),
        F.percentile("_e", F.lit(0.99)).alias("e99"),
        F.max("_e").alias("e_max"),
    )


def scale_free(df: DataFrame, y: str, pred: str, seasonal: str, by: Keys) -> DataFrame:
    """MAPE, sMAPE, MASE against a seasonal naive forecast, R squared."""
    e = F.abs(F.col(y) - F.col(pred))
    total = F.abs(F.col(y)) + F.abs(F.col(pred))
    return df.groupBy(*by).agg(
        (100 * F.avg(F.when(F.col(y) != 0, e / F.abs(y)))).alias("mape"),
        (200 * F.avg(F.when(total > 0, e / total))).alias("smape"),
        (F.avg(e) / F.nullif(F.avg(F.abs(F.col(y) - F.col(seasonal))), F.lit(0.0))).alias("mase"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall, spec = part(tp, tp + fp), part(tp, tp + fn), part(tn, tn + fp)
    d = lambda c: c.cast("double")
    mcc = part(d(tp) * tn - d(fp) * fn, F.sqrt(d(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return {"precision": precision, "recall": recall, "specificity": spec, "balanced": (recall + spec) / 2, "f1": part(2.0 * tp, 2 * tp + fp + fn), "mcc": mcc, "accuracy": part(tp + tn, tp + fp + fn + tn)}


def class_metrics(df: DataFrame, label: str, alert: str, by: Keys) -> DataFrame:
    one = lambda a, b: F.count_if((F.col(label) == a) & (F.col(alert) == b))
    d = df.groupBy(*by).agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    return d.withColumns(_rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def score_counts(df: DataFrame, label: str, score: str, by: Keys) -> DataFrame:
    """Positives and rows of each distinct score: all that ranking metrics need, and
    pre-aggregated, so that windows run over distinct scores rather than rows."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("rows"))


def cumulative(df: DataFrame, label: str, score: str, by: Keys) -> DataFrame:
    """Per distinct score, from the highest: tp and fp of the cut `score >= it`, and the
    totals. These are also the points of the precision-recall curve."""
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    c = score_counts(df, label, score, by)
    c = c.withColumns({"tp": F.sum("pos").over(w), "n_cut": F.sum("rows").over(w), "n_pos": F.sum("pos").over(whole), "n_all": F.sum("rows").over(whole)})
    return c.withColumn("fp", F.col("n_cut") - F.col("tp"))


def roc_auc(df: DataFrame, label: str, score: str, by: Keys) -> DataFrame:
    """Exact AUC with ties counted half."""
    c = cumulative(df, label, score, by)
    neg = F.col("rows") - F.col("pos")
    good = F.sum(neg.cast("double") * (F.col("tp") - F.col("pos") / 2))
    return c.groupBy(*by).agg((good / F.nullif(F.max("n_pos").cast("double") * (F.max("n_all") - F.max("n_pos")), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Keys) -> DataFrame:
    c = cumulative(df, label, score, by)
    return c.groupBy(*by).agg(F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * (F.col("tp") / F.col("n_cut"))).alias("ap"))


def screening_power(df: DataFrame, label: str, score: str, error: str, by: Keys) -> DataFrame:
    """How well a score screens for a label: rows, positives, prevalence, AUC, AP, AP over the
    prevalence, and the mean of the error column. Rows without a label do not count."""
    d = df.where(F.col(label).isNotNull())
    counts = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("n_peak"), F.avg(label).alias("prevalence"), F.avg(error).alias("mae"))
    c = cumulative(d, label, score, by)
    neg = (F.col("rows") - F.col("pos")).cast("double")
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.max("n_pos").cast("double") * (F.max("n_all") - F.max("n_pos")), F.lit(0.0))
    ap = F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * (F.col("tp") / F.col("n_cut")))
    both = counts.join(c.groupBy(*by).agg(auc.alias("auc"), ap.alias("ap")), list(by))
    return both.withColumn("ap_lift", F.col("ap") / F.nullif(F.col("prevalence"), F.lit(0.0)))


def best_f1_cut(df: DataFrame, label: str, score: str, by: Keys, largest: bool = False) -> DataFrame:
    """The cut of the best F1; of equals the smallest, or the largest, threshold."""
    c = cumulative(df, label, score, by)
    f1 = F.round(2.0 * F.col("tp") / (F.col("n_cut") + F.col("n_pos")), 12)
    order = F.struct(f1, F.col(score) if largest else -F.col(score))
    best = c.where("n_pos > 0").groupBy(*by).agg(F.max_by(F.struct(F.col(score).alias("cut"), f1.alias("f1"), "tp", "fp"), order).alias("b"))
    return best.select(*by, "b.*")


def probability_scores(df: DataFrame, label: str, p: str, by: Keys, eps: float = 1e-6) -> DataFrame:
    """Brier score and log loss."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg(-F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))


def reliability_curve(df: DataFrame, label: str, p: str, by: Keys, bins: int = 10) -> DataFrame:
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))


def ece(df: DataFrame, label: str, p: str, by: Keys, bins: int = 10) -> DataFrame:
    """Expected calibration error."""
    c = reliability_curve(df, label, p, by, bins)
    return c.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def group_r2(df: DataFrame, y: str, state: str, by: Keys) -> DataFrame:
    """Share of the variance that the state's mean explains, and the spread of state means.
    States are aggregated first: the second step sees a row per state."""
    s = df.groupBy(*by, state).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    n, total = F.sum("n"), F.sum("s")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - total * total / n
    return s.where("n > 0").groupBy(*by).agg((between / F.nullif(F.sum("q") - total * total / n, F.lit(0.0))).alias("r2"), (F.max(F.col("s") / F.col("n")) - F.min(F.col("s") / F.col("n"))).alias("spread"))


def by_condition(df: DataFrame, label: str, alert: str, conditions: dict[str, Column], by: Keys) -> DataFrame:
    """Confusion counts under each named condition with shares of all misses and false
    alarms; a row counts under every condition that it meets, in one pass."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()], F.lit("ALL")))
    d = class_metrics(df.withColumn("condition", F.explode(met)), label, alert, [*by, "condition"])
    every = Window.partitionBy(*by)
    all_of = lambda c: F.max(F.when(F.col("condition") == "ALL", F.col(c))).over(every)
    return d.withColumns({"share_fn": F.col("fn") / F.nullif(all_of("fn"), F.lit(0)), "share_fp": F.col("fp") / F.nullif(all_of("fp"), F.lit(0))})


def error_cells(df: DataFrame, label: str, score: str, by: Keys, **profile: Column) -> DataFrame:
    """Profiles of TP, FN, FP, TN at the cut whose alert rate equals the prevalence."""
    prevalence = df.groupBy(*by).agg(F.avg(label).alias("_p"))
    ranked = df.join(prevalence, list(by)).withColumn("_r", F.percent_rank().over(Window.partitionBy(*by).orderBy(score)))
    hit = (F.col("_r") >= 1 - F.col("_p")).cast("int")
    cell = F.when((F.col(label) == 1) & (hit == 1), "TP").when(F.col(label) == 1, "FN").when(hit == 1, "FP").otherwise("TN")
    return ranked.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in profile.items()])


def rank_normalised(df: DataFrame, score: str, by: Keys) -> DataFrame:
    """Scores as average-rank shares in (0, 1]. Ranks come from counts of distinct scores."""
    c = df.groupBy(*by, score).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(score)
    upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*by))
    c = c.withColumn("rank_share", (upto - (F.col("_n") - 1) / 2) / total)
    return df.join(c.drop("_n"), [*by, score])


def oracle_f1(df: DataFrame, y: str, e: str, label: str, keys: Keys, t: str, replicas: int) -> DataFrame:
    """What F1 an unbiased forecast with the same errors could reach: residuals are dealt anew
    over the rows of a key in hashed order, the best F1 is taken of every replica, and averaged.
    With the bias of all rows and of positive ones."""
    n = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(t)))
    r = n.select(*keys, t, y, label, F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("_r"))
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(uniform(F.lit("oracle"), "_r", t), t)))
    v = r.join(n.select(*keys, "_i", F.col(e).alias("_e")), [*keys, "_i"]).withColumn("_v", F.round(F.col(y) + F.col("_e"), 9))
    f1 = best_f1_cut(v, label, "_v", [*keys, "_r"]).groupBy(*keys).agg(F.avg("f1").alias("oracle_f1"))
    return df.groupBy(*keys).agg(F.avg(e).alias("bias_all"), F.avg(F.when(F.col(label) == 1, F.col(e))).alias("bias_peak")).join(f1, list(keys))
