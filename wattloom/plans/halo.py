"""Halo chunks: bounded frames on long series without one task per series.

A series is cut in chunks of steps; each chunk also gets the last rows of the one before,
as many as the longest frame needs. Windows are keyed by (series, chunk), and the rows
that were only lent are dropped. Running values that need all the past use two passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"


def with_halo(df: DataFrame, keys: Sequence[str], step: str, chunk: int, halo: int, build: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """build(rows, keys + chunk) on chunks of `chunk` steps with `halo` steps lent before.

    Steps are a dense integer grid, halo is at most chunk: a row goes to its own chunk and
    perhaps to the next."""
    if halo > chunk:
        raise ValueError("the halo is longer than a chunk")
    own = F.floor(F.col(step) / chunk).cast("long")
    lent = F.col(step) % chunk >= chunk - halo
    rows = df.withColumn("_own", own).withColumn(CHUNK, F.explode(F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))))
    return build(rows, [*keys, CHUNK]).where(F.col("_own") == F.col(CHUNK)).drop("_own", CHUNK)


def with_frames(df: DataFrame, keys: Sequence[str], step: str, back: int, ahead: int, columns: Callable[[WindowSpec], dict[str, Column]], chunk: int = 4096) -> DataFrame:
    """df with columns(w), where w is ordered by step and frames of it reach at most `back` rows
    before and `ahead` rows after the current one, on series with a row for every step. Each
    chunk is lent the rows that stand so near its borders."""
    size = max(chunk, back, ahead)
    own, place = F.floor(F.col(step) / size).cast("long"), F.col(step) % size
    near = F.filter(F.array(own, F.when(place >= size - back, own + 1), F.when(place < ahead, own - 1)), lambda c: c.isNotNull())
    rows = df.withColumn("_own", own).withColumn(CHUNK, F.explode(near))
    w = Window.partitionBy(*keys, CHUNK).orderBy(step)
    return rows.withColumns(columns(w)).where(F.col("_own") == F.col(CHUNK)).drop("_own", CHUNK)


def trailing_quantiles(df: DataFrame, x: str, rules: dict[str, tuple[int, float, int]], keys: Sequence[str], step: str) -> DataFrame:
    """df with a column per rule (n, q, least): the quantile, by linear interpolation, of the n
    rows before the current one, null where fewer than `least` of them have a value.

    Chunks are as long as the longest frame, so a task holds two of them; inside it every
    rule is one rolling pass that keeps its frame sorted."""
    longest = max(n for n, _, _ in rules.values())
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in rules]])
    widened = T.StructType([*schema.fields, T.StructField("_own", T.LongType()), T.StructField(CHUNK, T.LongType())])

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(step)
        return rows.assign(**{c: rows[x].rolling(n, min_periods=least).quantile(q).shift(1) for c, (n, q, least) in rules.items()})[widened.names]

    return with_halo(df, keys, step, longest, longest, lambda d, by: d.groupBy(*by).applyInPandas(roll, widened))


def running(df: DataFrame, keys: Sequence[str], step: str, chunk: int, value: Column, name: str) -> DataFrame:
    """Running sum of value up to each row: sums per chunk, their prefix, then the rows of
    each chunk alone."""
    d = df.withColumns({"_v": value, CHUNK: F.floor(F.col(step) / chunk)})
    total = d.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.withColumn("_before", before).drop("_t")
    inside = F.sum("_v").over(Window.partitionBy(*keys, CHUNK).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return d.join(total, [*keys, CHUNK]).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_v", "_before", CHUNK)
