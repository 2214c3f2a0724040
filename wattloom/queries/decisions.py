"""Decisions over metric tables of the naive scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import verdicts as vd
from wattloom.queries.alerts import COSTS, costs
from wattloom.queries.base import K, SCORED, register, scored

LEVEL = """, lv as (select series_id, 1 "level", avg(abs(y - seasonal)) mae from scored group by 1 union all select series_id, 2, avg(abs(y - kw)) from scored group by 1 union all select series_id, 3, avg(abs(y - score)) from scored group by 1 union all select series_id, 4, avg(abs(y - (score + seasonal) / 2)) from scored group by 1)
"""


def levels(spark, sf):
    d = scored(spark, sf)
    err = lambda e: F.avg(F.abs(F.col("y") - e))
    wide = d.groupBy("series_id").agg(err(F.col("seasonal")).alias("a"), err(F.col("kw")).alias("b"), err(F.col("score")).alias("c"), err((F.col("score") + F.col("seasonal")) / 2).alias("d"))
    parts = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("mae")) for i, c in enumerate("abcd", 1)])
    return wide.select("series_id", F.inline(parts))


@register("v15_retention", "series_id level:i kept:f", SCORED + LEVEL + """select series_id, "level", (f - mae) / nullif(f - m, 0) kept from (select *, first_value(mae) over (partition by series_id order by "level" rows between unbounded preceding and unbounded following) f, min(mae) over (partition by series_id) m from lv)""")
def v15(spark, sf):
    return vd.retention(levels(spark, sf), "level", "mae", K)


@register("v16_marginal_value", "series_id level:i gain:f gain_share:f", SCORED + LEVEL + """select series_id, "level", p - mae gain, (p - mae) / nullif(p, 0) gain_share from (select *, lag(mae) over (partition by series_id order by "level") p from lv)""")
def v16(spark, sf):
    return vd.marginal(levels(spark, sf), "level", "mae", K)


@register("p20_cost_scenarios", "series_id name implied:f ratio:f kind early:i confirm:i gate cost:f", SCORED + COSTS + """, sc_ as (select * from (values ('small', 40.0, 10.0), ('large', 900.0, 20.0)) v("name", miss, alarm)), k_ as (select cost.*, "name", miss / alarm implied, row_number() over (partition by series_id, "name" order by round(abs(ratio - miss / alarm), 9), round(cost, 12), place) rk from cost, sc_) select * from k_ where rk = 1""")
def p20(spark, sf):
    s = spark.createDataFrame([("small", 40.0, 10.0), ("large", 900.0, 20.0)], "name string, miss_cost double, alarm_cost double")
    return vd.scenarios(costs(spark, sf), s, K, ["place"])


@register("x14_adoption_rules", "series_id adopt:i failed", SCORED + """, m_ as (select series_id, fold, avg(abs(y - score)) a, avg(abs(y - kw)) b, avg(abs(y - score)) filter (where peak = 1) pa, avg(abs(y - kw)) filter (where peak = 1) pb from scored group by 1, 2),
g_ as (select series_id, coalesce(min((a <= b)::int), 0) c1, coalesce(min((pa <= pb * 1.02)::int), 0) c2 from m_ group by 1) select series_id, least(c1, c2) adopt, concat_ws(',', case when c1 = 0 then 'better' end, case when c2 = 0 then 'peaks_kept' end) failed from g_""")
def x14(spark, sf):
    peak = lambda c: F.avg(F.when(F.col("peak") == 1, F.abs(F.col("y") - F.col(c))))
    m = scored(spark, sf).groupBy("series_id", "fold").agg(F.avg(F.abs(F.col("y") - F.col("score"))).alias("a"), F.avg(F.abs(F.col("y") - F.col("kw"))).alias("b"), peak("score").alias("pa"), peak("kw").alias("pb"))
    return vd.adopt(m, {"better": F.col("a") <= F.col("b"), "peaks_kept": F.col("pa") <= F.col("pb") * 1.02}, K)


@register("r14_hard_conditions", "series_id condition n:i ratio:f folds_hard:i folds:i", SCORED + """, t_ as (select *, abs(y - score) e, unnest(list_filter([case when "hour" < 6 then 'night' end, case when is_operating = 0 then 'idle' end, case when abs(ramp4) > 100 then 'ramp' end, case when "hour" < 6 and is_operating = 0 then 'night&idle' end, case when "hour" < 6 and abs(ramp4) > 100 then 'night&ramp' end, case when is_operating = 0 and abs(ramp4) > 100 then 'idle&ramp' end, 'ALL'], lambda x: x is not null)) condition from scored where ramp4 is not null),
g_ as (select series_id, fold, condition, count(*) n, sum(e) s from t_ group by 1, 2, 3), h_ as (select *, max(s) filter (where condition = 'ALL') over (partition by series_id, fold) sa, max(n) filter (where condition = 'ALL') over (partition by series_id, fold) na from g_)
select series_id, condition, sum(n) n, avg((s / n) / nullif(sa / na, 0)) ratio, sum(((s / n) / nullif(sa / na, 0) >= 1.2 and n >= 0.02 * na)::int) folds_hard, count(*) folds from h_ where condition <> 'ALL' group by 1, 2""")
def r14(spark, sf):
    from wattloom.queries.alerts import conditions

    d = scored(spark, sf).where("ramp4 is not null").withColumn("e", F.abs(F.col("y") - F.col("score")))
    return vd.hard_conditions(d, "e", conditions(), K, "fold")
