"""Registry and fixtures: the meter tables that queries derive from `events` and others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import clean
from wattloom.operators.features import over
from wattloom.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """The columns of spec (name:kind): f a double rounded to 6 places (after 1e-9 is added,
    so that halves fall alike in both engines), i a long, others as they are."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        c = F.col(name)
        out.append(((F.round(c.cast("double") + 1e-9, 6) + F.lit(0.0)) if kind == "f" else c.cast("long") if kind == "i" else c).alias(name))
    return df.select(*out)


def register(name: str, spec: str, sql: str | None = None):
    """Register a query; sql is wrapped so that both sides have spec's columns."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: shaped(f(spark, sf), spec)
        if sql is not None:
            cols = []
            for item in spec.split():
                c, _, kind = item.partition(":")
                cols.append(f'round("{c}"::double + 1e-9, 6) + 0.0 as "{c}"' if kind == "f" else f'"{c}"::bigint as "{c}"' if kind == "i" else f'"{c}"')
            ORACLE[name] = f"select {', '.join(cols)} from ({sql})"
        return f

    return add


def demand(spark: SparkSession, sf: str) -> DataFrame:
    """15-minute demand per event type on a dense grid: series_id, step, ts15, kw, qty,
    is_operating."""
    e = table(spark, sf, "events").withColumnRenamed("event_type", "series_id")
    # bins are few beside events: computed once, then read for the keys, the span and the join
    b = cut(clean.resample(e.withColumnRenamed("ts", "ts15"), ["series_id"], "ts15", "15 minutes", kw=F.round(F.sum("value"), 2), qty=F.count("*")))
    d = clean.dense_grid(b, ["series_id"], "ts15", "15 minutes")
    # the grid starts on the first bin of all series, which is on the quarter hour
    first = F.broadcast(b.agg(F.min("ts15").alias("_first")))
    d = d.crossJoin(first).withColumn("step", (F.timestamp_diff("MINUTE", "_first", "ts15") / 15).cast("long"))
    return d.select("series_id", "step", "ts15", F.coalesce("kw", F.lit(0.0)).alias("kw"), F.coalesce("qty", F.lit(0)).alias("qty"), (F.coalesce("qty", F.lit(0)) > 0).cast("int").alias("is_operating"))


DEMAND = """
with b as (select event_type series_id, time_bucket(interval '15 minutes', ts) ts15, round(sum(value), 2) v, count(*) n from events group by 1, 2),
span as (select min(ts15) a, max(ts15) z from b),
grid as (select unnest(generate_series(a, z, interval '15 minutes')) ts15 from span),
demand as (
  select s.series_id, (row_number() over (partition by s.series_id order by g.ts15) - 1)::bigint step, g.ts15,
         coalesce(v, 0.0) kw, coalesce(n, 0)::bigint qty, case when coalesce(n, 0) > 0 then 1 else 0 end is_operating
  from (select distinct event_type series_id from events) s cross join grid g
  left join b on b.series_id = s.series_id and b.ts15 = g.ts15)
"""

K, S = ["series_id"], "step"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """demand with a threshold (the series' p95), peak flag, a score (mean of 4), the value
    an hour ahead (y), a day before (seasonal), label, alert, probability, fold, hour; computed
    once, as thresholds and rules read it again."""
    d = demand(spark, sf)
    thr = d.groupBy("series_id").agg(F.percentile("kw", F.lit(0.95)).alias("thr"))
    w = over(K, S)
    d = d.join(thr, "series_id").withColumns({"score": F.round(F.avg("kw").over(w.rowsBetween(-3, 0)), 6), "y": F.lead("kw", 4).over(w), "seasonal": F.lag("kw", 96).over(w), "ramp4": F.col("kw") - F.lag("kw", 4).over(w)})
    d = d.where("y is not null and seasonal is not null")
    d = d.withColumns({
        "peak": (F.col("kw") >= F.col("thr")).cast("int"),
        "label": (F.col("y") >= F.col("thr")).cast("int"),
        "alert": (F.col("score") >= F.col("thr") * 0.7).cast("int"),
        "p": F.round(F.least(F.lit(1.0), F.col("score") / (2 * F.greatest("thr", F.lit(1.0)))), 6),
        "fold": F.floor(F.col("step") / 720),
        "hour": F.hour("ts15"),
    })
    return cut(d)


SCORED = (
    DEMAND
    + """,
thr as (select series_id, quantile_cont(kw, 0.95) thr from demand group by 1),
raw as (
  select d.*, thr, round(avg(kw) over (partition by d.series_id order by step rows between 3 preceding and current row), 6) score,
         lead(kw, 4) over (partition by d.series_id order by step) y, lag(kw, 96) over (partition by d.series_id order by step) seasonal,
         kw - lag(kw, 4) over (partition by d.series_id order by step) ramp4
  from demand d join thr on thr.series_id = d.series_id),
scored as (
  select *, case when kw >= thr then 1 else 0 end peak, case when y >= thr then 1 else 0 end "label",
         case when score >= thr * 0.7 then 1 else 0 end alert, round(least(1.0, score / (2 * greatest(thr, 1.0))), 6) p,
         step // 720 fold, hour(ts15) "hour"
  from raw where y is not null and seasonal is not null)
"""
)


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as shots: id, four features and a label (returned)."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("machine"),
    )


SHOTS = """
with shots as (select l_orderkey * 10 + l_linenumber id, l_quantity a, l_extendedprice b, l_discount c, l_tax d,
  case when l_returnflag = 'R' then 1 else 0 end "label", l_shipdate::date "day", l_suppkey machine from lineitem)
"""


def u_sql(*parts: str) -> str:
    """The twin of functions.special.uniform."""
    text = ", ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::ubigint / 4294967296.0)"
