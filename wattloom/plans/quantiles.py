"""Exact quantiles of a column without one task that holds its distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.plans.ranks import numbered


def quantiles(df: DataFrame, x: str, qs: Sequence[float], by: Sequence[str] = (), name: str = "_q") -> DataFrame:
    """(by..., name): an array with the interpolated quantiles of x for each of qs, as
    F.percentile gives them; nulls are left out. Without by one row, of nulls if x has no
    value; with by no row for groups without a value.

    Values are counted, and ranges of (by, x) get the running count up to each value; only
    the values at the wanted places are aggregated. Groups are few (bins, columns): their
    sizes go to the tasks."""
    v = df.select(*by, F.col(x).cast("double").alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    d, _ = numbered(v, [*by, "_x"], "_upto", "_n")
    sizes = F.broadcast(d.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_total")))
    d = d.join(sizes, list(by)) if by else d.crossJoin(sizes)
    last = F.col("_upto") - F.col("_before") - 1  # place of the value's last row in its group, from 0
    at = lambda place: F.max(F.when((last >= place) & (last - F.col("_n") < place), F.col("_x")))
    out = []
    for q in qs:
        place = (F.col("_total") - 1) * F.lit(float(q))
        out += [at(F.floor(place)), at(F.ceil(place)), F.max(place)]
    got = d.groupBy(*by).agg(F.array(*out).alias("_v"))

    def between(k: int):
        lo, hi, place = (F.col("_v")[3 * k + i] for i in range(3))
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    return got.select(*by, F.array(*[between(k) for k in range(len(qs))]).alias(name))
