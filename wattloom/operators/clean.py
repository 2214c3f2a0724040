"""Cleaning, reshaping and splitting of keyed time tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform

Keys = Sequence[str]


def repair_hour(df: DataFrame, keys: Keys = (), day: str = "date", hour: str = "hour", order: str = "row_id") -> DataFrame:
    """Days with any hour over 23 are flagged; hours are rebuilt from row order in the day."""
    by = Window.partitionBy(*keys, day)
    return df.withColumns({"hour_corrupt": F.max((F.col(hour) > 23).cast("int")).over(by) == 1, hour: (F.row_number().over(by.orderBy(order)) - 1).cast("long")})


def to_long(df: DataFrame, t: str, columns: dict[str, int], value: str = "kw") -> DataFrame:
    """One row per reading: columns maps a reading's column to its minutes after t."""
    ids = [c for c in df.columns if c not in columns]
    long = df.unpivot(ids, list(columns), "reading", value)
    minutes = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return long.withColumn("minutes", F.element_at(minutes, F.col("reading"))).withColumn("ts15", F.expr(f"{t} + make_dt_interval(0, 0, minutes)"))


def slot_of_day(t: str, minutes: int = 15) -> Column:
    """Index of the reading in its day."""
    return ((F.hour(t) * 60 + F.minute(t)) / minutes).cast("int")


def resample(df: DataFrame, keys: Keys, t: str, every: str, **aggregates: Column) -> DataFrame:
    """Regular bins; bins without rows are absent."""
    out = df.groupBy(*keys, F.window(t, every).alias("bin")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(*keys, F.col("bin.start").alias(t), *aggregates)


def dense_grid(df: DataFrame, keys: Keys, t: str, every: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every key on every step of the span of t, with the row's values or nulls.

    The span is one row for all keys (or given), and each key's steps come from a sequence."""
    span = df.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    steps = F.expr(f"sequence({start or '_a'}, {end or '_b'}, interval {every})")
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(steps).alias(t))
    return grid.join(df, [*keys, t], "left")


def ffill(df: DataFrame, columns: Keys, keys: Keys, t: str, limit: int | None = None) -> DataFrame:
    """Last value, at most `limit` rows old."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def bfill(df: DataFrame, columns: Keys, keys: Keys, t: str) -> DataFrame:
    """Next value."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def complete_rows(df: DataFrame, columns: Keys) -> DataFrame:
    """Rows with none of the columns null: the common rows of several feature sets."""
    return df.dropna(subset=list(columns))


def finite(column: str, value: float = 0.0) -> Column:
    """NaN, infinities and nulls replaced."""
    c = F.col(column)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(value)).otherwise(c)


def window_tags(df: DataFrame, clean: Column) -> DataFrame:
    """Every row once for the window `all` and, if clean, once for `clean`."""
    return df.withColumn("window", F.explode(F.when(clean, F.array(F.lit("all"), F.lit("clean"))).otherwise(F.array(F.lit("all")))))


def local_hour(t: str, hours: int = 9) -> Column:
    """The hour of local time of a UTC time."""
    return F.date_trunc("hour", F.expr(f"{t} + interval '{hours}' hour")).cast("timestamp_ntz")


def ordinal(column: str, order: Keys) -> Column:
    """Place of a label in order, null if absent."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)).cast("int") - 1


def requantise(column: str, step: float) -> Column:
    return F.round(F.col(column) / step) * step


def first_per_group(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """The first row of each group; order must tell all its rows apart, or any of the first is taken."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def hashed_split(keys: Keys, share: float, seed: int = 0) -> Column:
    """True for about `share` of the rows, at random but repeatably: no sort, no shuffle."""
    return uniform(F.lit(seed), *keys) < share


def packed_weather(df: DataFrame) -> DataFrame:
    """Comma-packed station fields to numbers: tenths are scaled, sentinels become null."""
    part = lambda c, i: F.try_element_at(F.split(c, ","), F.lit(i))
    number = lambda c, i, bad: F.when(part(c, i).isin(bad), None).otherwise(part(c, i).try_cast("double"))
    return df.select(
        "*",
        (number("TMP", 1, ["+9999"]) / 10).alias("ext_temp"),
        (number("DEW", 1, ["+9999"]) / 10).alias("ext_dewpoint"),
        (number("SLP", 1, ["99999"]) / 10).alias("ext_pressure"),
        (number("WND", 4, ["9999"]) / 10).alias("ext_wind"),
        number("VIS", 1, ["999999"]).alias("ext_visibility"),
        number("CIG", 1, ["99999"]).alias("ext_ceiling"),
    )


def dictionary(df: DataFrame, meaning: dict[str, tuple[str, str]]) -> DataFrame:
    """A data dictionary: column, meaning, unit, and as evidence its rows, filled rows and
    distinct values. One pass counts, columns become rows after it."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("meaning"), F.lit(u).alias("unit"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.countDistinct(c).alias("distinct")) for c, (m, u) in meaning.items()]
    return df.agg(F.array(*parts).alias("_d")).select(F.inline("_d"))
