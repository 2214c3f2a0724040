"""Linear fits of every kind from one pass over the rows.

A fit needs no more than the sums of products of its columns, with one more column of ones:
the moments. They are summed once per group of rows (site, part of the folds), and groups
are added, or taken away from a total, to form any training set: of a fold, of a horizon,
of all sites but one. A set of features is a part of the same matrix, and a residual target
(y - base) a combination of its columns. Solving is a small matrix per model, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import ship

Names = Sequence[str]


@dataclass(frozen=True)
class Fit:
    """A model: its features, its target as a combination of columns, and its penalty as MLlib
    defines it (features of unit variance, `share` of it on absolute values)."""

    name: str
    features: tuple[str, ...]
    target: tuple[tuple[str, float], ...]
    penalty: float = 0.0
    share: float = 0.0

    @staticmethod
    def of(name: str, features: Names, y: str, base: str | None = None, kind: str = "ols") -> Fit:
        penalty, share = {"ols": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (0.1, 1.0), "elastic": (0.1, 0.5)}[kind]
        return Fit(name, tuple(features), ((y, 1.0), (base, -1.0)) if base else ((y, 1.0),), penalty, share)


def roles(df: DataFrame, n: int, keys: Names, t: str, cal: float = 0.2, name: str = "roles") -> DataFrame:
    """df with a letter per rolling-origin fold: T train, C calibration (its last `cal`), E
    test, - none. The folds are those of intervals.rolling_origin; each row stands once."""
    rows = Window.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(rows.orderBy(t)) - 1, "_n": F.count("*").over(rows)})
    size = F.floor(F.col("_n") / (n + 1))

    def letter(fold: int) -> Column:
        start = F.col("_n") - size * (n - fold)
        return F.when(F.col("_i") >= start + size, "-").when(F.col("_i") >= start, "E").when(F.col("_i") >= F.floor(start * (1 - cal)), "C").otherwise("T")

    return d.withColumn(name, F.concat(*[letter(f) for f in range(n)])).drop("_i", "_n")


def moments(df: DataFrame, names: Names, by: Names, weight: str | None = None) -> DataFrame:
    """(by..., m): the upper triangle of the sums of products of 1 and the columns."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.groupBy(*by).agg(F.array(*sums).alias("m"))


def added(grams: DataFrame, by: Names, columns: int) -> DataFrame:
    """Moments of `columns` columns added up over what is not in by."""
    size = (columns + 1) * (columns + 2) // 2
    return grams.groupBy(*by).agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))


def of_folds(grams: DataFrame, folds: int, letters: str, by: Names, columns: int) -> DataFrame:
    """(fold, by..., m) of the training set that letters name, from moments by roles."""
    each = grams.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each = each.where(F.instr(F.lit(letters), F.substr("roles", F.col("fold") + 1, F.lit(1))) > 0)
    return added(each, ["fold", *by], columns)


def without(whole: DataFrame, own: DataFrame, on: Names) -> DataFrame:
    """own's groups with the moments of all others: the whole less their own."""
    return own.withColumnRenamed("m", "_own").join(whole, list(on)).withColumn("m", F.zip_with("m", "_own", lambda a, b: a - b)).drop("_own")


def _descend(r: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent on a correlation matrix."""
    x = np.zeros(len(b))
    for _ in range(100_000):
        most = 0.0
        for j in range(len(b)):
            g = b[j] - r[j] @ x + r[j, j] * x[j]
            new = np.sign(g) * max(abs(g) - l1, 0.0) / (r[j, j] + l2)
            most = max(most, abs(new - x[j]))
            x[j] = new
        if most < 1e-13:
            break
    return x


def solve_one(matrix: np.ndarray, names: Names, fit: Fit) -> tuple[float, np.ndarray]:
    """Intercept and a coefficient per name (0 for what the fit does not use) of the forecast of
    the target's first column: what was taken from it is added again."""
    at = {c: i + 1 for i, c in enumerate(names)}
    use = [at[c] for c in fit.features]
    pick = np.zeros((len(names) + 1, len(use) + 2))
    pick[0, 0] = 1.0
    for k, i in enumerate(use):
        pick[i, k + 1] = 1.0
    for c, times in fit.target:
        pick[at[c], -1] += times
    a = pick.T @ matrix @ pick
    out = np.zeros(len(names))
    if not a[0, 0] > 0:
        return float("nan"), out
    a = a / a[0, 0]
    mean = a[0, 1:]
    c = a[1:, 1:] - np.outer(mean, mean)
    s = np.sqrt(np.maximum(np.diag(c), 0.0))
    live = np.flatnonzero(s[:-1] > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])))
    if s[-1] > 0 and len(live):
        r = c[np.ix_(live, live)] / np.outer(s[live], s[live])
        b = c[live, -1] / (s[live] * s[-1])
        penalty = fit.penalty / s[-1]
        if fit.penalty and fit.share:
            x = _descend(r, b, penalty * fit.share, penalty * (1 - fit.share))
        else:
            x = np.linalg.lstsq(r + penalty * np.eye(len(live)), b, rcond=None)[0]
        out[np.array(use)[live] - 1] = x * s[-1] / s[live]
    intercept = float(mean[-1] - out[np.array(use) - 1] @ mean[:-1])
    for c, times in fit.target[1:]:
        out[at[c] - 1] -= times
    return intercept, out


def solve(grams: DataFrame, names: Names, fits: Sequence[Fit]) -> DataFrame:
    """(groups..., model, intercept, coef) of every group of grams and fit; coef has an entry
    per name."""
    ship(grams.sparkSession)
    by = [c for c in grams.columns if c != "m"]
    size, upper = len(names) + 1, np.triu_indices(len(names) + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            keys = frame[by].itertuples(index=False, name=None) if by else [()] * len(frame)
            for key, m in zip(keys, frame["m"]):
                matrix = np.zeros((size, size))
                matrix[upper] = m
                matrix = matrix + np.triu(matrix, 1).T
                for fit in fits:
                    intercept, coef = solve_one(matrix, names, fit)
                    rows.append((*key, fit.name, intercept, coef.tolist()))
            yield pd.DataFrame(rows, columns=[*by, "model", "intercept", "coef"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema.fields if f.name != "m")
    return grams.mapInPandas(run, f"{kinds + ', ' if kinds else ''}model string, intercept double, coef array<double>")


def value(names: Names) -> Column:
    """The forecast of a row that has a model's intercept and coef; names are the first of those
    that the model was solved for, with all that it uses."""
    out = F.col("intercept")
    for i, c in enumerate(names):
        out = out + F.when(F.col("coef")[i] != 0, F.col("coef")[i] * F.col(c)).otherwise(0.0)
    return out


def predict(df: DataFrame, models: DataFrame, names: Names, on: Names, name: str = "pred") -> DataFrame:
    """df joined with its models on the given columns: a row for each."""
    return df.join(models, list(on)).withColumn(name, value(names)).drop("intercept", "coef")


def gram_sql(rows: str, by: Names, x: Names, y: str, penalty: float = 0.0, model: str = "model") -> str:
    """CTEs that end in `model` (by..., intercept, b1...): the same fit of the table `rows` in SQL,
    by Gauss-Jordan elimination of the correlation matrix."""
    z, p, keys = ["1.0", *x, y], len(x), ", ".join(by)
    pairs = [(i, j) for i in range(p + 2) for j in range(p + 2)]
    lists = ", ".join(f"unnest([{', '.join(map(str, v))}]) {n}" for n, v in (("i", [i for i, _ in pairs]), ("j", [j for _, j in pairs]), ("v", [f"sum(({z[i]}) * ({z[j]}))::double" for i, j in pairs])))
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in by)
    parts = [
        f"{model}_s as (select {keys}, {lists} from {rows} group by {keys})",
        f"{model}_m as (select a.{', a.'.join(by)}, a.i, a.j, a.v / n.v v from {model}_s a join {model}_s n on {on('a', 'n')} and n.i = 0 and n.j = 0)",
        f"{model}_c as (select a.{', a.'.join(by)}, a.i, a.j, a.v - b.v * c.v v from {model}_m a join {model}_m b on {on('a', 'b')} and b.i = 0 and b.j = a.i join {model}_m c on {on('a', 'c')} and c.i = 0 and c.j = a.j where a.i > 0 and a.j > 0)",
        f"{model}_d as (select {keys}, i, sqrt(v) s from {model}_c where i = j)",
        f"{model}_0 as (select a.{', a.'.join(by)}, a.i, a.j, a.v / (b.s * c.s) + case when a.i = a.j then {penalty} / t.s else 0 end v from {model}_c a join {model}_d b on {on('a', 'b')} and b.i = a.i join {model}_d c on {on('a', 'c')} and c.i = a.j join {model}_d t on {on('a', 't')} and t.i = {p + 1} where a.i <= {p})",
    ]
    for k in range(1, p + 1):
        last = f"{model}_{k - 1}"
        parts.append(f"{model}_{k} as (select a.{', a.'.join(by)}, a.i, a.j, case when a.i = {k} then a.v / p.v else a.v - c.v * r.v / p.v end v from {last} a join {last} p on {on('a', 'p')} and p.i = {k} and p.j = {k} join {last} r on {on('a', 'r')} and r.i = {k} and r.j = a.j join {last} c on {on('a', 'c')} and c.i = a.i and c.j = {k})")
    parts.append(f"{model}_b as (select a.{', a.'.join(by)}, a.i, a.v * t.s / b.s v, m.v mean, y.v ymean from {model}_{p} a join {model}_d b on {on('a', 'b')} and b.i = a.i join {model}_d t on {on('a', 't')} and t.i = {p + 1} join {model}_m m on {on('a', 'm')} and m.i = 0 and m.j = a.i join {model}_m y on {on('a', 'y')} and y.i = 0 and y.j = {p + 1} where a.j = {p + 1})")
    parts.append(f"{model} as (select {keys}, max(ymean) - sum(v * mean) intercept, " + ", ".join(f"sum(v) filter (where i = {k}) b{k}" for k in range(1, p + 1)) + f" from {model}_b group by {keys})")
    return ",\n".join(parts)


def value_sql(x: Names, model: str = "model") -> str:
    return f"{model}.intercept + " + " + ".join(f"{model}.b{k} * ({c})" for k, c in enumerate(x, 1))
