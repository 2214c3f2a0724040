"""Row numbers of a whole table without one task: ranges, their sizes, then rows in each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import cut


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number", weight: str | None = None) -> tuple[DataFrame, int]:
    """df with the place of each row in the order, from 1, and the number of rows; with a
    weight column, the running sum of weights up to the row, and their sum.

    Rows are dealt to ranges of the order; the sizes of the ranges (one number each) give
    every range its first number, and rows are numbered inside their range. Rows with equal
    order columns take any order."""
    d = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in d.groupBy("_range").agg((F.sum(weight) if weight else F.count("*")).alias("n")).collect()}  # a row per partition
    before, total = [0] * (max(sizes, default=-1) + 2), 0
    for i in range(len(before)):
        before[i] = total
        total += sizes.get(i, 0)
    first = F.get(F.array(*[F.lit(b) for b in before]), F.col("_range"))
    inside = Window.partitionBy("_range").orderBy(*order)
    place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(inside)
    return d.withColumn(name, first + place).drop("_range"), total
