"""Audits, statistics and bursts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.operators import audit as au, bursts as bu, metrics as mt, stats as st
from wattloom.operators.features import over
from wattloom.plans.quantiles import quantiles
from wattloom.queries.base import DEMAND, K, S, SCORED, SHOTS, demand, register, scored, shots, table, u_sql
from wattloom.queries.meter import SLOT, W


def weight_sql(*parts: str) -> str:
    """The twin of stats.poisson_weight: parts are the seed, the replica and the block."""
    return f"len(list_filter([{', '.join(map(repr, st.poisson_steps()))}], lambda x: x <= {u_sql(*parts)}))"


def boot_sql(seed: str, block: str, replicas: int) -> str:
    """The twin of stats.block_bootstrap over d_ (series_id, block, d, n)."""
    return f""", r_ as (select *, {weight_sql(seed, "r", block)} w from d_, range(1, {replicas + 1}) t(r)), e_ as (select series_id, r, sum(w * d) / nullif(sum(w * n), 0) m from r_ group by 1, 2), p_ as (select series_id, sum(d) / sum(n) difference from d_ group by 1)
select p_.series_id, any_value(difference) difference, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high, avg((m < 0)::int) below_zero from e_ join p_ on p_.series_id = e_.series_id group by 1"""


# ---- aggregation and audits
@register("a1_daily_rollup", "series_id day peak:f mean:f energy:f qty:i active:i", DEMAND + 'select series_id, ts15::date "day", max(kw) peak, avg(kw) mean, sum(kw) / 4 energy, sum(qty) qty, count(distinct case when is_operating = 1 then hour(ts15) end) active from demand group by 1, 2')
def a1(spark, sf):
    d = demand(spark, sf)
    return d.groupBy("series_id", F.to_date("ts15").alias("day")).agg(F.max("kw").alias("peak"), F.avg("kw").alias("mean"), (F.sum("kw") / 4).alias("energy"), F.sum("qty").alias("qty"), F.countDistinct(F.when(F.col("is_operating") == 1, F.hour("ts15"))).alias("active"))


SIGN = DEMAND + """, sv as (select series_id, ts15, floor(case when day(ts15) in (5, 9, 20) then least(kw, 100) * 0 else kw end / 100) v from demand),
sg as (select series_id, ts15::date "day", list(v order by ts15) vs from sv group by 1, 2)
"""


def signatures(spark, sf):
    d = demand(spark, sf).withColumn("v", F.floor(F.when(F.dayofmonth("ts15").isin(5, 9, 20), F.lit(0.0)).otherwise(F.col("kw")) / 100))
    return au.day_signatures(d, "v", K, "ts15")


@register("a2_day_signatures", "series_id day n_same:i first_day", SIGN + 'select series_id, "day", count(*) over (partition by series_id, vs) n_same, min("day") over (partition by series_id, vs) first_day from sg')
def a2(spark, sf):
    return signatures(spark, sf)


@register("a3_duplicate_audit", "series_id days:i repeated:i profiles:i across:i longest_span:i", SIGN + """, g as (select series_id, vs, count(*) n, min("day") a, max("day") b, count(*) filter (where "day" >= date '2024-01-16') c from sg group by 1, 2)
select series_id, sum(n) "days", sum(case when n > 1 then n else 0 end) repeated, count(*) profiles, count(*) filter (where c > 0 and c < n) across, max(b - a) longest_span from g group by 1""")
def a3(spark, sf):
    return au.duplicate_audit(signatures(spark, sf), K, "2024-01-16")


@register("a4_groups_across_folds", "series_id crossing:i groups:i rows_crossing:i", SIGN + """, r as (select *, case when "day" < date '2024-01-21' then 'TRAIN' else 'TEST' end role from sg), g as (select series_id, vs, max((role = 'TRAIN')::int) a, max((role = 'TEST')::int) b, count(*) n from r group by 1, 2)
select series_id, count(*) filter (where a = 1 and b = 1) crossing, count(*) groups, sum(case when a = 1 and b = 1 then n else 0 end) rows_crossing from g group by 1""")
def a4(spark, sf):
    r = signatures(spark, sf).withColumn("role", F.when(F.col("day") < F.to_date(F.lit("2024-01-21")), "TRAIN").otherwise("TEST"))
    return au.groups_across(r, "values", "role", K)


PAIRS = SHOTS + """, pairs as (select * from shots union all select id + 1, a, b, c, d, case when id % 50 = 1 then 1 - "label" else "label" end, "day", machine from shots where id % 10 = 1)"""


def pairs(spark, sf):
    s = shots(spark, sf)
    copy = s.where("id % 10 = 1").withColumn("label", F.when(F.col("id") % 50 == 1, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("id", F.col("id") + 1)
    return s.unionByName(copy)


@register("a5_pair_forensics", "size:i groups:i conflicts:i consecutive:i", PAIRS + """, g as (select a, b, c, d, count(*) n, count(distinct "label") l, max(id) - min(id) sp from pairs group by 1, 2, 3, 4) select n size, count(*) groups, count(*) filter (where l > 1) conflicts, count(*) filter (where sp = n - 1) consecutive from g group by 1""")
def a5(spark, sf):
    return au.pair_forensics(pairs(spark, sf), ["a", "b", "c", "d"], "label", "id")


@register("a6_structure", "column rows:i nulls:i distinct:i low:f high:f top_share:f constant:i", SHOTS + ", u as (" + " union all ".join(f"select '{c}' \"column\", {c}::double v from shots" for c in ("a", "b", "c", "d", '"label"')).replace("'\"label\"'", "'label'") + """), k as (select "column", v, count(*) n from u group by 1, 2) select "column", sum(n) "rows", 0 nulls, count(*) "distinct", min(v) low, max(v) high, max(n) / sum(n) top_share, case when count(*) <= 1 then 1 else 0 end "constant" from k group by 1""")
def a6(spark, sf):
    return au.structure(shots(spark, sf), ["a", "b", "c", "d", "label"])


@register("a6_monotone", "user_id:i back:i repeats:i n:i", "select user_id, count(*) filter (where ts < p) back, count(*) filter (where ts = p) repeats, count(*) n from (select user_id, ts, lag(ts) over (partition by user_id order by event_id) p from events) group by 1")
def a6_monotone(spark, sf):
    return au.monotone(table(spark, sf, "events"), "ts", ["user_id"], "event_id")


@register("a7_block_identity", "machine:i days:i distinct_blocks:i", SHOTS + ', g as (select machine, "day", list(a order by id) v from shots group by 1, 2) select machine, count(*) "days", count(distinct v) distinct_blocks from g group by 1')
def a7(spark, sf):
    g = shots(spark, sf).groupBy("machine", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "a"))), lambda p: p["a"]).alias("v"))
    return g.groupBy("machine").agg(F.count("*").alias("days"), F.countDistinct("v").alias("distinct_blocks"))


@register("a8_label_granularity", "days:i rows_a_day:f result_days:i days_without_result:i", SHOTS + """, r as (select "day", count(*) n from shots group by 1), o as (select distinct o_orderdate::date "day" from orders)
select count(*) "days", avg(n) rows_a_day, (select count(*) from o) result_days, count(*) filter (where "day" not in (select "day" from o)) days_without_result from r""")
def a8(spark, sf):
    return au.label_granularity(shots(spark, sf), table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@register("a9_daily_process", "day n:i mean:f dev:f urgent:i other:i", SHOTS + """, p as (select "day", count(*) n, avg(a) mean, stddev_samp(a) dev from shots group by 1), o as (select o_orderdate::date "day", count(*) filter (where o_orderpriority = '1-URGENT') urgent, count(*) filter (where o_orderpriority <> '1-URGENT') other from orders group by 1)
select p."day", n, mean, dev, coalesce(urgent, 0) urgent, coalesce(other, 0) other from p left join o on o."day" = p."day" """)
def a9(spark, sf):
    p = shots(spark, sf).groupBy("day").agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.stddev_samp("a").alias("dev"))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("kind"))
    o = o.groupBy("day").pivot("kind", ["urgent", "other"]).count()
    return p.join(o, "day", "left").fillna(0, ["urgent", "other"])


@register("a10_quarter_rates", "quarter:i n:i rate:f", SHOTS + """select "quarter", count(*) n, avg("label") rate from (select ntile(4) over (order by id, b, "label") "quarter", "label" from shots) group by 1""")
def a10(spark, sf):
    return au.run_structure(shots(spark, sf), "label", ["id", "b", "label"])


@register("a11_heat_map", "hour:i d1:f d2:f d3:f d4:f d5:f d6:f d7:f", DEMAND + 'select hour(ts15) "hour", ' + ", ".join(f"avg(kw) filter (where isodow(ts15) = {k}) d{k}" for k in range(1, 8)) + " from demand group by 1")
def a11(spark, sf):
    d = demand(spark, sf).select(F.hour("ts15").alias("hour"), F.format_string("d%d", F.weekday("ts15") + 1).alias("dow"), "kw")
    return d.groupBy("hour").pivot("dow", [f"d{k}" for k in range(1, 8)]).avg("kw")


@register("a12_equal_bins", "bin:i n:i lo:f hi:f y_low:f y_high:f", SHOTS + """, e as (select quantile_cont(b, [0.2, 0.4, 0.6, 0.8]) q from shots), g as (select s.*, len(list_filter(q, lambda x: x < b)) bin from shots s, e), m as (select bin, quantile_cont(a, 0.5) md from g group by 1)
select g.bin, count(*) n, min(b) lo, max(b) hi, avg("label") filter (where a <= md) y_low, avg("label") filter (where a > md) y_high from g join m on m.bin = g.bin group by 1""")
def a12(spark, sf):
    return au.equal_bins(shots(spark, sf), "b", "label", "a", 5)


@register("a13_crosstab", "l_returnflag l_linestatus n:i row_share:f", "select l_returnflag, l_linestatus, count(*) n, count(*) / sum(count(*)) over (partition by l_returnflag) row_share from lineitem group by 1, 2")
def a13(spark, sf):
    return au.crosstab_rows(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("a14_quality_flags", "series_id n:i zeros:i saturated:i missing:i", DEMAND + "select series_id, count(*) n, count(*) filter (where kw = 0) zeros, count(*) filter (where kw >= 600) saturated, count(*) filter (where kw is null) missing from demand group by 1")
def a14(spark, sf):
    return au.quality_flags(demand(spark, sf), "kw", K, 600)


@register("a15_two_regimes", "kurt:f split:f agree:f", SHOTS + ', m as (select quantile_cont(a, 0.5) ma, quantile_cont(b, 0.5) mb from shots) select kurtosis_pop(a) kurt, max(ma) split, avg(((a > ma) = (b > mb))::int) agree from shots, m')
def a15(spark, sf):
    s = shots(spark, sf)
    both = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("x")) for c in ("a", "b")])))
    median = lambda c: F.max(F.when(F.col("of") == c, F.col("_q")[0])).alias(f"m{c}")
    m = quantiles(both, "x", [0.5], ["of"]).agg(median("a"), median("b"))
    return s.crossJoin(F.broadcast(m)).agg(F.kurtosis("a").alias("kurt"), F.max("ma").alias("split"), F.avg(((F.col("a") > F.col("ma")) == (F.col("b") > F.col("mb"))).cast("int")).alias("agree"))


@register("a16_grid_fingerprint", "event_type off_grid:f decimals:i unique_share:f least_step:f", """with v as (select event_type, value, count(*) n from events group by 1, 2), l as (select *, lead(value) over (partition by event_type order by value) nx from v)
select event_type, sum(abs(value / 0.5 - round(value / 0.5)) * n) / sum(n) off_grid, max(length(rtrim(split_part(printf('%.6f', value), '.', 2), '0'))) decimals, count(*) / sum(n) unique_share, min(nx - value) least_step from l group by 1""")
def a16(spark, sf):
    return au.grid_fingerprint(table(spark, sf, "events"), "value", 0.5, ["event_type"])


@register("a17_top_k", "series_id step:i kw:f rank:i", DEMAND + "select * from (select series_id, step, kw, row_number() over (partition by series_id order by kw desc, step) rank from demand) where rank <= 5")
def a17(spark, sf):
    return au.top_k(demand(spark, sf), 5, K, F.desc("kw"), F.asc("step"))


@register("a18_arg_min", "series_id step:i kw:f", DEMAND + "select series_id, step, kw from (select *, row_number() over (partition by series_id order by kw desc, step) r from demand) where r = 1")
def a18(spark, sf):
    return au.arg_min(demand(spark, sf), K, -F.col("kw"), "step")


@register("a19_nearest", "series_id step:i kw:f", DEMAND + "select series_id, step, kw from (select *, row_number() over (partition by series_id order by round(abs(kw - 250), 9), step) r from demand) where r = 1")
def a19(spark, sf):
    return au.arg_min(demand(spark, sf), K, F.round(F.abs(F.col("kw") - 250), 9), "step")


@register("a20_alert_budget", "series_id recall:f precision:f alerts:i", SCORED + """, r as (select *, row_number() over (partition by series_id order by score desc, step) rk, count(*) over (partition by series_id) n from scored)
select series_id, sum("label") filter (where rk <= round(0.1 * n)) / nullif(sum("label"), 0) recall, avg("label") filter (where rk <= round(0.1 * n)) "precision", count(*) filter (where rk <= round(0.1 * n)) alerts from r group by 1""")
def a20(spark, sf):
    return au.budget(scored(spark, sf), "label", "score", 0.1, K, S)


@register("a21_stratified_sample", "id:i label:i machine:i b:f", SHOTS + f""", u_ as (select *, {u_sql("0", "id")} u from shots), f_ as (select *, row_number() over (partition by "label", machine order by u, id, b) rn from u_),
r_ as (select *, row_number() over (order by u, id, b) pl from f_ where rn > 2) select id, "label", machine, b from f_ where rn <= 2 union all select id, "label", machine, b from r_ where pl <= 50 - (select count(*) from f_ where rn <= 2)""")
def a21(spark, sf):
    return au.stratified(shots(spark, sf), ["label", "machine"], 2, 50, ["id", "b"])


@register("a22_set_operations", "kind n:i", """with a as (select l_shipdate::date d from lineitem), o as (select o_orderdate::date d from orders)
select 'union' kind, count(*) n from (select d from a union select d from o) union all select 'intersect', count(*) from (select d from a intersect select d from o) union all select 'except', count(*) from (select d from o except select d from a)""")
def a22(spark, sf):
    a = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    count = lambda x, k: x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(a.union(o).distinct(), "union").unionByName(count(a.intersect(o), "intersect")).unionByName(count(o.subtract(a), "except"))


@register("a23_fold_then_overall", "series_id mean:f worst:f", SCORED + "select series_id, avg(m) mean, max(m) worst from (select series_id, fold, avg(abs(y - score)) m from scored group by 1, 2) group by 1")
def a23(spark, sf):
    m = scored(spark, sf).groupBy("series_id", "fold").agg(F.avg(F.abs(F.col("y") - F.col("score"))).alias("m"))
    return m.groupBy("series_id").agg(F.avg("m").alias("mean"), F.max("m").alias("worst"))


@register("a24_vs_base", "series_id variant mae:f ratio:f", SCORED + """, u as (select series_id, 'naive' variant, avg(abs(y - kw)) mae from scored group by 1 union all select series_id, 'mean4', avg(abs(y - score)) from scored group by 1 union all select series_id, 'seasonal', avg(abs(y - seasonal)) from scored group by 1)
select series_id, variant, mae, mae / nullif(max(mae) filter (where variant = 'naive') over (partition by series_id), 0) ratio from u""")
def a24(spark, sf):
    d = scored(spark, sf)
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    wide = d.groupBy("series_id").agg(err("kw").alias("naive"), err("score").alias("mean4"), err("seasonal").alias("seasonal"))
    long = wide.unpivot(["series_id"], ["naive", "mean4", "seasonal"], "variant", "mae")
    return au.vs_base(long, "variant", "naive", "mae", K)


@register("a25_totals", "l_returnflag l_linestatus n:i qty:f", "select l_returnflag, l_linestatus, count(*) n, sum(l_quantity) qty from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a25(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@register("a26_state_profiles", "series_id is_operating:i n:i share:f level:f deviation:f ramp:f peak_rate:f modal_hour:i", SCORED + """, h as (select series_id, is_operating, "hour", count(*) c from scored group by 1, 2, 3), m as (select series_id, is_operating, "hour" modal_hour, row_number() over (partition by series_id, is_operating order by c desc, "hour") rk from h),
p as (select series_id, is_operating, count(*) n, avg(kw) level, stddev_samp(kw) deviation, avg(abs(ramp4)) ramp, avg(peak) peak_rate from scored group by 1, 2)
select p.*, n / sum(n) over (partition by p.series_id) share, modal_hour from p join m on m.series_id = p.series_id and m.is_operating = p.is_operating and rk = 1""")
def a26(spark, sf):
    return au.profiles(scored(spark, sf), ["is_operating"], "kw", "ramp4", "peak", F.col("hour"), K)


@register("a27_leakage", "series_id equal_share:f distinct:i", DEMAND + f"""select series_id, avg((abs(m - (a + b + c + d) / 4) <= 0.5)::int) equal_share, count(distinct m) "distinct" from (select series_id, round(avg(kw) over ({W} rows between 1 following and 4 following), 4) m, lead(kw, 1) over ({W}) a, lead(kw, 2) over ({W}) b, lead(kw, 3) over ({W}) c, lead(kw, 4) over ({W}) d from demand) group by 1""")
def a27(spark, sf):
    w = over(K, S)
    d = demand(spark, sf).withColumn("m", F.round(F.avg("kw").over(w.rowsBetween(1, 4)), 4))
    d = d.withColumns({c: F.lead("kw", k).over(w) for k, c in enumerate("abcd", 1)})
    return au.leakage(d, "m", ["a", "b", "c", "d"], K)


@register("a28_feature_relation", "window r_score:f r_seasonal:f", SCORED + """, t as (select *, unnest(case when ts15 >= timestamp '2024-01-16' then ['all', 'clean'] else ['all'] end) "window" from scored) select "window", corr(y, score) r_score, corr(y, seasonal) r_seasonal from t group by 1""")
def a28(spark, sf):
    from wattloom.operators.clean import window_tags

    d = window_tags(scored(spark, sf), F.col("ts15") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return d.groupBy("window").agg(F.corr("y", "score").alias("r_score"), F.corr("y", "seasonal").alias("r_seasonal"))


@register("s11_inventory", "name bytes:i md5")
def s11(spark, sf):
    from wattloom.sources.files import inventory

    return inventory(spark, f"{sf}/*.parquet")


# ---- statistics
@register("x1_rank_sum", "machine:i auc:f delta:f z:f", SHOTS + """, r as (select *, rank() over (partition by machine order by a) + (count(*) over (partition by machine, a) - 1) / 2.0 r from shots), t as (select machine, sum(n * n * n - n) ties from (select machine, a, count(*)::double n from shots group by 1, 2) group by 1),
g as (select machine, sum("label")::double n1, count(*)::double n, sum(r) filter (where "label" = 1) w from r group by 1), u as (select g.*, ties, n - n1 n0, w - n1 * (n1 + 1) / 2 u from g join t on t.machine = g.machine)
select machine, u / nullif(n1 * n0, 0) auc, 2 * u / nullif(n1 * n0, 0) - 1 delta, (u - n1 * n0 / 2) / nullif(sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) z from u""")
def x1(spark, sf):
    return st.rank_sum(shots(spark, sf), "a", "label", ["machine"])


@register("x2_ks", "machine:i ks:f", SHOTS + """, v as (select machine, b, sum("label") p, sum(1 - "label") q from shots group by 1, 2) select machine, max(g) ks from (select machine, abs(sum(p) over (partition by machine order by b) / sum(p) over (partition by machine) - sum(q) over (partition by machine order by b) / sum(q) over (partition by machine)) g from v) group by 1""")
def x2(spark, sf):
    return st.ks_two_sample(shots(spark, sf), "b", "label", ["machine"])


@register("x3_spearman", "machine:i rho:f r:f n:i", SHOTS + """, k as (select machine, a, b, rank() over (partition by machine order by a) + (count(*) over (partition by machine, a) - 1) / 2.0 ra, rank() over (partition by machine order by b) + (count(*) over (partition by machine, b) - 1) / 2.0 rb from shots) select machine, corr(ra, rb) rho, corr(a, b) r, count(*) n from k group by 1""")
def x3(spark, sf):
    return st.spearman(shots(spark, sf), "a", "b", ["machine"])


@register("x9_adjusted_rand", "ari:f", """with c as (select l_returnflag x, l_linestatus y, count(*)::double n from lineitem group by 1, 2), a as (select sum(n * (n - 1) / 2) v from (select sum(n) n from c group by x)), b as (select sum(n * (n - 1) / 2) v from (select sum(n) n from c group by y)), t as (select sum(n * (n - 1) / 2) ij, sum(n) n from c)
select (ij - a.v * b.v / (n * (n - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (n * (n - 1) / 2)) ari from a, b, t""")
def x9(spark, sf):
    return st.adjusted_rand(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("x4_paired_bootstrap", "series_id difference:f low:f high:f below_zero:f", SCORED + ", d_ as (select series_id, floor(" + u_sql("'block'", "step") + " * 64)::bigint bl, sum(abs(y - score) - abs(y - kw)) d, count(*) n from scored group by 1, 2)" + boot_sql("1", "bl", 200))
def x4(spark, sf):
    d = scored(spark, sf).withColumn("bl", st.hashed_block("step", 64))
    return st.block_bootstrap(d, F.abs(F.col("y") - F.col("score")), F.abs(F.col("y") - F.col("kw")), ["bl"], K, 200, 1)


@register("x5_day_block_bootstrap", "series_id difference:f low:f high:f below_zero:f", SCORED + ", d_ as (select series_id, ts15::date bl, sum(abs(y - score) - abs(y - seasonal)) d, count(*) n from scored group by 1, 2)" + boot_sql("1", "bl", 500))
def x5(spark, sf):
    d = scored(spark, sf).withColumn("day", F.to_date("ts15"))
    return st.block_bootstrap(d, F.abs(F.col("y") - F.col("score")), F.abs(F.col("y") - F.col("seasonal")), ["day"], K, 500, 1)


COND = """unnest(list_filter([case when "hour" < 6 then 'night' end, case when is_operating = 0 then 'idle' end, case when abs(ramp4) > 100 then 'ramp' end, 'ALL'], lambda x: x is not null)) condition"""


@register("x7_rate_bootstrap", "series_id condition fn_rate:f fn_low:f fn_high:f fp_rate:f fp_low:f fp_high:f", SCORED + f""", l_ as (select *, {COND} from scored), d_ as (select series_id, condition, ts15::date bl, count(*) filter (where "label" = 1 and alert = 1) tp, count(*) filter (where "label" = 1 and alert = 0) fn, count(*) filter (where "label" = 0 and alert = 1) fp, count(*) filter (where "label" = 0 and alert = 0) tn from l_ group by 1, 2, 3),
r_ as (select *, {weight_sql("3", "r", "bl")} w from d_, range(1, 301) t(r)), e_ as (select series_id, condition, r, sum(w * fn) / nullif(sum(w * (fn + tp)), 0) a, sum(w * fp) / nullif(sum(w * (fp + tn)), 0) b from r_ group by 1, 2, 3)
select series_id, condition, avg(a) fn_rate, quantile_cont(a, 0.025) fn_low, quantile_cont(a, 0.975) fn_high, avg(b) fp_rate, quantile_cont(b, 0.025) fp_low, quantile_cont(b, 0.975) fp_high from e_ group by 1, 2""")
def x7(spark, sf):
    conds = {"night": F.col("hour") < 6, "idle": F.col("is_operating") == 0, "ramp": F.abs("ramp4") > 100}
    return st.rate_bootstrap(scored(spark, sf).withColumn("day", F.to_date("ts15")), "label", "alert", conds, ["day"], K, 300, 3)


@register("x15_group_bootstrap", "series_id difference:f low:f high:f below_zero:f", SCORED + f""", d_ as (select series_id, is_operating g, floor({u_sql("'block'", "step")} * 64)::bigint bl, sum(abs(y - score)) s, count(*) n from scored group by 1, 2, 3),
r_ as (select *, {weight_sql("5", "r", "g", "bl")} w from d_, range(1, 201) t(r)), e_ as (select series_id, r, sum(w * s) filter (where g = 1) / nullif(sum(w * n) filter (where g = 1), 0) - sum(w * s) filter (where g = 0) / nullif(sum(w * n) filter (where g = 0), 0) m from r_ group by 1, 2),
p_ as (select series_id, sum(s) filter (where g = 1) / nullif(sum(n) filter (where g = 1), 0) - sum(s) filter (where g = 0) / nullif(sum(n) filter (where g = 0), 0) difference from d_ group by 1)
select p_.series_id, any_value(difference) difference, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high, avg((m < 0)::int) below_zero from e_ join p_ on p_.series_id = e_.series_id where m is not null group by 1""")
def x15(spark, sf):
    d = scored(spark, sf).withColumn("err", F.abs(F.col("y") - F.col("score")))
    return st.group_bootstrap(d, "err", F.col("is_operating") == 1, "step", K, 200, seed=5)


FORMS = [*"abcd", *(f"{x}*{y}" for i, x in enumerate("abcd") for y in "abcd"[i + 1 :])]
PERM = SHOTS + ", l_ as (" + " union all ".join(f"select '{f}' form, {f if len(f) == 1 else f'round({f}, 9)'}::double v, \"label\" y, floor({u_sql(chr(39) + 'block' + chr(39), 'id')} * 256)::bigint bl from shots" for f in FORMS) + """),
k_ as (select *, rank() over (partition by form order by v) + (count(*) over (partition by form, v) - 1) / 2.0 rk from l_),
b_ as (select form, bl, count(*)::double n, sum(y)::double pos, sum(rk) r, sum(y * rk) rp from k_ group by 1, 2),
s_ as (select form, abs((sum(rp) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) - 0.5) g, sum(pos) / sum(n) rate from b_ group by 1),
o_ as (select max(p.g - greatest(a.g, b.g)) max_gain from s_ p join s_ a on a.form = split_part(p.form, '*', 1) join s_ b on b.form = split_part(p.form, '*', 2) where p.form like '%*%'),
"""


@register("x8_permutation", "max_gain:f null_p95:f null_max:f exceeds:i", PERM + f"""d_ as (select r, ['{"', '".join(f for f in FORMS if len(f) > 1)}'][floor({u_sql("'pair'", "0", "r")} * 6)::int + 1] form from range(1, 201) t(r)),
j_ as (select d_.r rep, b_.*, ({u_sql("'label'", "0", "d_.r", "bl")} < rate)::int "on" from d_ join b_ on b_.form = d_.form join s_ on s_.form = d_.form),
e_ as (select rep, abs((sum("on" * r) - sum("on" * n) * (sum("on" * n) + 1) / 2) / nullif(sum("on" * n) * (sum(n) - sum("on" * n)), 0) - 0.5) g from j_ group by 1)
select any_value(max_gain) max_gain, quantile_cont(g, 0.95) null_p95, max(g) null_max, (any_value(max_gain) > quantile_cont(g, 0.95))::int exceeds from e_, o_""")
def x8(spark, sf):
    return st.permutation_null(shots(spark, sf), "label", ["a", "b", "c", "d"], "id", 200)


@register("x11_confound_auc", "n:i auc:f", SHOTS + """, m as (select * from shots where id between (select min(id) from shots where "label" = 1) and (select max(id) from shots where "label" = 1)), r as (select *, rank() over (order by id) + (count(*) over (partition by id) - 1) / 2.0 r from m) select count(*) n, (sum(r) filter (where "label" = 1) - sum("label") * (sum("label") + 1) / 2.0) / (sum("label") * (count(*) - sum("label"))) auc from r""")
def x11(spark, sf):
    return au.order_auc(shots(spark, sf), "label", "id")


@register("j12_pair_forms", "form auc:f", SHOTS + ", u as (" + " union all ".join(f"select '{x}{o}{y}' form, round({x} {o} {y}, 9) v, \"label\" lb from shots" for i, x in enumerate("acd") for y in "acd"[i + 1 :] for o in "+-*") + ") , r as (select form, lb, rank() over (partition by form order by v) + (count(*) over (partition by form, v) - 1) / 2.0 r from u) select form, (sum(r) filter (where lb = 1) - sum(lb) * (sum(lb) + 1) / 2.0) / (sum(lb) * (count(*) - sum(lb))) auc from r group by 1")
def j12(spark, sf):
    return st.pairwise_auc(shots(spark, sf), "id", ["a", "c", "d"], "label")


@register("j13_flag_overlap", "series_id pair jaccard:f", SCORED + """, f as (select series_id, peak, alert, "label" lb from scored) select series_id, 'peak|alert' pair, sum(peak * alert) / nullif(sum(greatest(peak, alert)), 0) jaccard from f group by 1 union all select series_id, 'peak|label', sum(peak * lb) / nullif(sum(greatest(peak, lb)), 0) from f group by 1 union all select series_id, 'alert|label', sum(alert * lb) / nullif(sum(greatest(alert, lb)), 0) from f group by 1""")
def j13(spark, sf):
    return st.jaccard(scored(spark, sf), ["peak", "alert", "label"], K)


# ---- bursts: events of a user, a new burst after six hours
BURST = """
with e as (select user_id, event_id, ts, value x, json_extract_string(props, '$.k')::double z, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '6 hours' then 0 else 1 end nw from events),
b as (select *, sum(nw) over (partition by user_id order by ts, event_id) seg from e)
"""
U = ["user_id"]


def bursts(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("z"))
    return bu.segment(e, U, "ts", "6 hours", "event_id")


@register("f29_segments", "user_id:i seg:i n:i", BURST + "select user_id, seg, count(*) n from b group by 1, 2")
def f29(spark, sf):
    return bursts(spark, sf).groupBy("user_id", "seg").agg(F.count("*").alias("n"))


@register("f30_geometry", "user_id:i bursts:i samples:f median_step:f on_s:f dead_s:f duty:f", BURST + """, d as (select *, date_diff('microsecond', lag(ts) over (partition by user_id, seg order by ts, event_id), ts) / 1e6 dt from b), m as (select user_id, quantile_cont(dt, 0.5) ms from d group by 1),
g as (select user_id, seg, count(*) n, date_diff('microsecond', min(ts), max(ts)) / 1e6 ln, min(ts) a, max(ts) z from b group by 1, 2), h as (select user_id, count(*) bursts, avg(n) samples, sum(ln) on_s, date_diff('microsecond', min(a), max(z)) / 1e6 sp from g group by 1)
select h.user_id, bursts, samples, ms median_step, on_s, sp - on_s dead_s, on_s / nullif(sp, 0) duty from h join m on m.user_id = h.user_id""")
def f30(spark, sf):
    return bu.geometry(bursts(spark, sf), U, "ts", "event_id")


@register("f31_shape", "user_id:i seg:i n:i mean:f std:f rms:f p2p:f peak:f crest:f impulse:f shape:f clearance:f crossings:i", BURST + """, c as (select *, x - avg(x) over (partition by user_id, seg) cx from b), k as (select *, case when sign(cx) * sign(lag(cx) over (partition by user_id, seg order by ts, event_id)) < 0 then 1 else 0 end fl from c)
select user_id, seg, count(*) n, avg(x) mean, stddev_pop(x) std, sqrt(avg(x * x)) rms, max(x) - min(x) p2p, max(abs(x)) peak, max(abs(x)) / nullif(sqrt(avg(x * x)), 0) crest, max(abs(x)) / nullif(avg(abs(x)), 0) impulse, sqrt(avg(x * x)) / nullif(avg(abs(x)), 0) shape, max(abs(x)) / nullif(pow(avg(sqrt(abs(x))), 2), 0) clearance, sum(fl) crossings from k group by 1, 2""")
def f31(spark, sf):
    return bu.shape(bursts(spark, sf), "x", U, "ts", "event_id")


@register("f32_autocorrelation", "user_id:i n:i mean_ac1:f", BURST + """, l as (select *, lag(x) over (partition by user_id, seg order by ts, event_id) l1 from b), a as (select user_id, seg, count(l1) n, corr(x, l1) r from l group by 1, 2 having count(l1) >= 4) select user_id, count(*) n, avg(r) mean_ac1 from a group by 1""")
def f32(spark, sf):
    b = bursts(spark, sf)
    long = b.groupBy("user_id", "seg").agg(F.count("*").alias("c")).where("c >= 5")
    a = bu.autocorrelation(b, "x", [1, 2], U, "ts", "event_id").join(long, ["user_id", "seg"])
    return a.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("ac1").alias("mean_ac1"))


@register("f33_coupling", "user_id:i seg:i corr:f lag:i n:i")
def f33(spark, sf):
    return bu.coupling(bursts(spark, sf), "x", "z", 3, U, "ts", "event_id")


@register("f34_spectrum", "user_id:i seg:i dominant:i centroid:f entropy:f low_share:f")
def f34(spark, sf):
    return bu.spectrum(bursts(spark, sf), "x", 8, U, "ts", "event_id")
