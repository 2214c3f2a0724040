"""Folds, conformal intervals, bands, distances and regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform

Keys = Sequence[str]


def rolling_origin(df: DataFrame, n: int, keys: Keys, t: str, cal: float = 0.2) -> DataFrame:
    """Every row once for each fold in which it has a role: expanding train of which the
    last `cal` share is CAL, then a test block of rows // (n + 1)."""
    rows = Window.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(rows.orderBy(t)) - 1, "_n": F.count("*").over(rows)})
    size = F.floor(F.col("_n") / (n + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.col("_n") - size * (n - F.col("fold"))
    role = F.when(F.col("_i") >= start + size, None).when(F.col("_i") >= start, "TEST").when(F.col("_i") >= F.floor(start * (1 - cal)), "CAL").otherwise("TRAIN")
    return d.withColumn("role", role).where("role is not null").drop("_i", "_n")


def chrono_split(keys: Keys, t: str, shares: dict[str, float]) -> Column:
    """Role by place in time: shares add up to 1, in order."""
    w = Window.partitionBy(*keys)
    place = (F.row_number().over(w.orderBy(t)) - 1) / F.count("*").over(w)
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        cond = place < round(upto, 9)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(list(shares)[-1])


def group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Whole groups in one fold, groups of each class dealt in turn by hashed order."""
    g = df.groupBy(group).agg(F.max(label).alias("_class"))
    w = Window.partitionBy("_class").orderBy(uniform(F.lit(seed), group), group)
    return df.join(g.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k))).drop("_class"), group)


def last_days(df: DataFrame, t: str, keys: Keys, test: int = 14, lock: int = 14) -> DataFrame:
    """SEL / TEST / LOCK: the last days are locked, the ones before them test."""
    left = F.datediff(F.max(t).over(Window.partitionBy(*keys)), F.col(t))
    return df.withColumn("part", F.when(left < lock, "LOCK").when(left < lock + test, "TEST").otherwise("SEL"))


def conformity(cal: DataFrame, y: str, lo: str, hi: str, alpha: float, by: Keys) -> DataFrame:
    """(by, n, q): the conformal correction: the quantile at min(1, (1-a)(1+1/n)) of
    max(lo - y, y - hi), by linear interpolation on the sorted errors."""
    e = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    w = Window.partitionBy(*by).orderBy("_e")
    d = cal.withColumn("_e", e).where("_e is not null").withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    at = F.least(F.lit(1.0), (1 - alpha) * (1 + 1 / F.col("_n"))) * (F.col("_n") - 1)
    share = F.greatest(F.lit(0.0), 1 - F.abs(at - F.col("_i")))
    return d.where(share > 0).groupBy(*by).agg(F.max("_n").alias("n"), F.sum(F.col("_e") * share).alias("q"))


def conformal(cal: DataFrame, test: DataFrame, y: str, lo: str, hi: str, alpha: float, by: Keys, group: str | None = None, min_group: int = 50) -> DataFrame:
    """test with int_lo, int_hi; per group where it has min_group calibration rows, else
    the correction of all. Both corrections are small tables."""
    whole = conformity(cal, y, lo, hi, alpha, by).select(*by, F.col("q").alias("_q"))
    out = test.join(whole, list(by), "left")
    q = F.col("_q")
    if group:
        own = conformity(cal, y, lo, hi, alpha, [*by, group]).where(F.col("n") >= min_group).select(*by, group, F.col("q").alias("_g"))
        out = out.join(own, [*by, group], "left")
        q = F.coalesce("_g", "_q")
    out = out.withColumns({"int_lo": F.col(lo) - q, "int_hi": F.col(hi) + q})
    return out.drop("_q", "_g")


def bands(df: DataFrame, width: str, cuts: DataFrame, by: Keys, ood: Column) -> DataFrame:
    """HIGH / MEDIUM / LOW by cuts (by, c50, c80) of the interval width, OOD first."""
    b = F.when(ood, "OOD").when(F.col(width) <= F.col("c50"), "HIGH").when(F.col(width) <= F.col("c80"), "MEDIUM").otherwise("LOW")
    return df.join(cuts, list(by)).withColumn("band", b).drop("c50", "c80")


def width_cuts(cal: DataFrame, width: str, by: Keys) -> DataFrame:
    q = F.percentile(width, F.array(F.lit(0.5), F.lit(0.8)))
    return cal.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("c50"), F.col("_q")[1].alias("c80"))


def mahalanobis_fit(train: DataFrame, columns: Keys):
    """Mean and pseudo-inverse of the population covariance: only these p x p numbers come to
    the driver."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = train.agg(*[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    p = len(columns)
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[p:]):
        cov[i, j] = cov[j, i] = v or 0.0
    return [float(m or 0.0) for m in row[:p]], np.linalg.pinv(cov)


def mahalanobis_of(columns: Keys, mean: Sequence[float], inverse) -> Column:
    """Squared distance from the mean as one expression."""
    diff = [F.col(c) - F.lit(m) for c, m in zip(columns, mean)]
    terms = [diff[i] * diff[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(columns)) for j in range(i, len(columns))]
    return sum(terms[1:], terms[0])


def mahalanobis(train: DataFrame, df: DataFrame, columns: Keys, q: float = 0.99, name: str = "maha") -> tuple[DataFrame, float]:
    """df with its squared distance from TRAIN, and the TRAIN quantile."""
    distance = mahalanobis_of(columns, *mahalanobis_fit(train, columns))
    return df.withColumn(name, distance), train.agg(F.percentile(distance, F.lit(q))).first()[0]


def risk_score(pred: str, thr: str, width: str, cap: float = 3.0) -> Column:
    """Margin over the threshold in interval widths, within +-cap."""
    r = (F.col(pred) - F.col(thr)) / F.nullif(F.col(width), F.lit(0.0))
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), r))


def rule_regime(df: DataFrame, operating: str, ramp: str, ramp_cut: Column, keys: Keys, t: str) -> DataFrame:
    """TRANSITION if the state differs from that of 4 rows ago (or nothing is known of it) or
    the ramp is high; else LOW_LOAD while idle, or STABLE."""
    before = F.lag(operating, 4).over(Window.partitionBy(*keys).orderBy(t))
    switched = ~F.col(operating).eqNullSafe(before)
    r = F.when(switched | F.coalesce(F.abs(ramp) >= ramp_cut, F.lit(False)), "TRANSITION").when(F.col(operating) == 0, "LOW_LOAD").otherwise("STABLE")
    return df.withColumn("regime", r)


def coverage(df: DataFrame, y: str, by: Keys, operating: str, peak: str) -> DataFrame:
    """Coverage overall, operating, idle and at peaks, and the mean width, per group with a
    totals row (group null) beside each."""
    hit = ((F.col(y) >= F.col("int_lo")) & (F.col(y) <= F.col("int_hi"))).cast("int")
    return df.rollup(*by).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("coverage"),
        F.avg(F.when(F.col(operating) == 1, hit)).alias("coverage_operating"),
        F.avg(F.when(F.col(operating) == 0, hit)).alias("coverage_idle"),
        F.avg(F.when(F.col(peak) == 1, hit)).alias("coverage_peak"),
        F.avg(F.col("int_hi") - F.col("int_lo")).alias("width"),
    )


def one_sided(cal: DataFrame, test: DataFrame, y: str, upper: str, level: float, by: Keys) -> DataFrame:
    """test with upper_q: the upper forecast plus the conformal correction of y - upper."""
    q = _upper_quantile(cal, y, upper, level, by)
    return test.join(q, list(by), "left").withColumn("upper_q", F.col(upper) + F.col("_q")).drop("_q")


def _upper_quantile(cal: DataFrame, y: str, upper: str, level: float, by: Keys) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("_e")
    d = cal.withColumn("_e", F.col(y) - F.col(upper)).where("_e is not null").withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    at = F.least(F.lit(1.0), level * (1 + 1 / F.col("_n"))) * (F.col("_n") - 1)
    share = F.greatest(F.lit(0.0), 1 - F.abs(at - F.col("_i")))
    return d.where(share > 0).groupBy(*by).agg(F.sum(F.col("_e") * share).alias("_q"))


def grouping_menu(cal: DataFrame, test: DataFrame, y: str, lo: str, hi: str, alpha: float, groups: dict[str, str], fixed: str, by: Keys, min_group: int = 50, min_fixed: int = 30) -> DataFrame:
    """Per grouping (name to a column of group labels): coverage, width, the worst gap of its
    own groups, and the worst gap on one fixed partition, so that groupings can be compared."""
    tag = lambda d: d.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("grouping"), F.col(c).cast("string").alias("group")) for n, c in groups.items()])))
    d = conformal(tag(cal), tag(test), y, lo, hi, alpha, [*by, "grouping"], "group", min_group)
    hit = ((F.col(y) >= F.col("int_lo")) & (F.col(y) <= F.col("int_hi"))).cast("int")
    d = d.withColumn("_hit", hit)
    gap = lambda d: F.abs(d - (1 - alpha))
    own = d.groupBy(*by, "grouping", "group").agg(F.avg("_hit").alias("_c")).groupBy(*by, "grouping").agg(F.max(gap(F.col("_c"))).alias("worst_gap"), F.count("*").alias("groups"))
    part = d.groupBy(*by, "grouping", fixed).agg(F.avg("_hit").alias("_c"), F.count("*").alias("_n")).where(F.col("_n") >= min_fixed)
    part = part.groupBy(*by, "grouping").agg(F.max(gap(F.col("_c"))).alias("fixed_gap"))
    out = d.groupBy(*by, "grouping").agg(F.count("*").alias("n"), F.avg("_hit").alias("coverage"), F.avg(F.col("int_hi") - F.col("int_lo")).alias("width"))
    return out.join(own, [*by, "grouping"]).join(part, [*by, "grouping"], "left")
