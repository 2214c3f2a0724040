"""Scans, cleaning, features, joins and events of meter series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.operators import clean, events as ev, features as ft
from wattloom.plans import halo
from wattloom.queries.base import DEMAND, K, S, SCORED, SHOTS, demand, register, scored, shots, table, u_sql

W = "partition by series_id order by step"
BASE = "series_id step:i"


def framed(agg: str, n: int, shift: int = 0, least: int | None = None, x: str = "kw") -> str:
    rows = f"over ({W} rows between {n - 1 + shift} preceding and {f'{shift} preceding' if shift else 'current row'})"
    return f"case when count({x}) {rows} >= {n if least is None else least} then {agg} {rows} end"


# ---- cleaning
HOURS = """
with h as (select event_type series_id, date_trunc('day', ts) "date", hour(ts) hh, count(*) n from events group by 1, 2, 3),
r as (select *, (row_number() over (partition by series_id order by "date", hh)) row_id, case when day("date") in (3, 5) then hh + 90 else hh end "hour" from h)
"""


def raw_hours(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), F.hour("ts").alias("hh"))
    h = e.groupBy("series_id", "date", "hh").agg(F.count("*").alias("n"))
    h = h.withColumn("row_id", F.row_number().over(Window.partitionBy("series_id").orderBy("date", "hh")))
    return h.withColumn("hour", F.when(F.dayofmonth("date").isin(3, 5), F.col("hh") + 90).otherwise(F.col("hh")))


@register("t1_repair_hour", "series_id row_id:i hour_corrupt hour:i", HOURS + """select series_id, row_id, max(case when "hour" > 23 then 1 else 0 end) over (partition by series_id, "date") = 1 hour_corrupt,
 row_number() over (partition by series_id, "date" order by row_id) - 1 "hour" from r""")
def t1(spark, sf):
    return clean.repair_hour(raw_hours(spark, sf), K)


@register("t2_wide_to_long", "series_id ts15 kw:f", DEMAND + """select series_id, date_trunc('hour', ts15) + to_minutes(minute(ts15) + 15) ts15, kw from demand""")
def t2(spark, sf):
    d = demand(spark, sf).withColumn("ts", F.date_trunc("hour", "ts15").cast("timestamp_ntz")).withColumn("q", F.minute("ts15"))
    wide = d.groupBy("series_id", "ts").pivot("q", [0, 15, 30, 45]).agg(F.first("kw"))
    return clean.to_long(wide, "ts", {"0": 15, "15": 30, "30": 45, "45": 60}).where("kw is not null")


@register("t3_slot_of_day", BASE + " slot:i", DEMAND + "select series_id, step, (hour(ts15) * 60 + minute(ts15)) // 15 slot from demand")
def t3(spark, sf):
    return demand(spark, sf).withColumn("slot", clean.slot_of_day("ts15"))


@register("t4_resample", "user_id:i ts mean:f n:i", "select user_id, time_bucket(interval '1 hour', ts) ts, avg(value) mean, count(*) n from events group by 1, 2")
def t4(spark, sf):
    return clean.resample(table(spark, sf, "events"), ["user_id"], "ts", "1 hour", mean=F.avg("value"), n=F.count("*"))


@register("t5_dense_grid", BASE + " ts15 kw:f qty:i", DEMAND + "select * from demand")
def t5(spark, sf):
    return demand(spark, sf)


WEATHER = """
with w as (select event_type series_id, date_trunc('hour', ts) ts, avg(json_extract_string(props, '$.k')::double) temp from events group by 1, 2),
g as (select s.series_id, t.ts from (select distinct series_id from w) s, (select unnest(generate_series(min(ts), max(ts), interval '1 hour')) ts from w) t),
weather as (select g.series_id, g.ts, round(temp, 6) temp from g left join w on w.series_id = g.series_id and w.ts = g.ts)
"""


def weather(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    w = e.groupBy("series_id", "ts").agg(F.round(F.avg("k"), 6).alias("temp"))
    return clean.dense_grid(w, K, "ts", "1 hour")


@register("t6_ffill_limit", "series_id ts temp:f", WEATHER + "select series_id, ts, last_value(temp ignore nulls) over (partition by series_id order by ts rows between 6 preceding and current row) temp from weather")
def t6(spark, sf):
    return clean.ffill(weather(spark, sf), ["temp"], K, "ts", 6)


@register("t7_bfill", "series_id ts temp:f", WEATHER + "select series_id, ts, first_value(temp ignore nulls) over (partition by series_id order by ts rows between current row and unbounded following) temp from weather")
def t7(spark, sf):
    return clean.bfill(weather(spark, sf), ["temp"], K, "ts")


@register("t8_complete_rows", "series_id n:i", DEMAND + f"select series_id, count(*) n from (select series_id, lag(kw, 96) over ({W}) a, lead(kw, 4) over ({W}) b from demand) where a is not null and b is not null group by 1")
def t8(spark, sf):
    d = ft.targets(ft.lags(demand(spark, sf), "kw", [96], K, S), "kw", [4], K, S)
    return clean.complete_rows(d, ["kw_lag96", "y_h4"]).groupBy("series_id").agg(F.count("*").alias("n"))


@register("t9_replace_missing", BASE + " lag:f ratio:f", DEMAND + f"select series_id, step, coalesce(lag(kw, 1) over ({W}), -1) lag, case when lag(kw, 1) over ({W}) is null or lag(kw, 1) over ({W}) = 0 then 0.0 else kw / lag(kw, 1) over ({W}) end ratio from demand")
def t9(spark, sf):
    d = ft.lags(demand(spark, sf), "kw", [1], K, S)
    d = d.withColumn("ratio", F.try_divide("kw", "kw_lag1"))
    return d.select(*K, S, F.coalesce("kw_lag1", F.lit(-1.0)).alias("lag"), clean.finite("ratio").alias("ratio"))


@register("t10_window_tags", "series_id window n:i mean:f", DEMAND + """select series_id, "window", count(*) n, avg(kw) mean from (select *, unnest(case when ts15 >= timestamp '2024-01-16' then ['all', 'clean'] else ['all'] end) "window" from demand) group by 1, 2""")
def t10(spark, sf):
    d = clean.window_tags(demand(spark, sf), F.col("ts15") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return d.groupBy("series_id", "window").agg(F.count("*").alias("n"), F.avg("kw").alias("mean"))


@register("t11_local_hour", "event_id:i local", "select event_id, date_trunc('hour', ts + interval 9 hours) local from events")
def t11(spark, sf):
    return table(spark, sf, "events").withColumn("local", clean.local_hour("ts"))


def season_sql(t: str) -> str:
    return f"case when month({t}) in (6, 7, 8) then 'summer' when month({t}) in (11, 12, 1, 2) then 'winter' else 'spring_fall' end"


def zone_sql(t: str) -> str:
    return f"case when hour({t}) < 9 or hour({t}) = 23 then 'light' when month({t}) in (11, 12, 1, 2) and (hour({t}) between 10 and 12 or hour({t}) between 17 and 22) then 'peak' when month({t}) not in (11, 12, 1, 2) and hour({t}) between 11 and 17 then 'peak' else 'mid' end"


@register("t12_ordinal", "zone code:i n:i", DEMAND + """select zone, list_position(['light', 'mid', 'peak'], zone) - 1 code, count(*) n from (select """ + zone_sql("ts15") + """ zone from demand) group by 1, 2""")
def t12(spark, sf):
    d = demand(spark, sf).withColumn("zone", ft.load_zone("ts15"))
    return d.groupBy("zone", clean.ordinal("zone", ["light", "mid", "peak"]).alias("code")).agg(F.count("*").alias("n"))


@register("t13_requantise", "event_id:i q:f", "select event_id, round(value / 0.5) * 0.5 q from events")
def t13(spark, sf):
    return table(spark, sf, "events").withColumn("q", clean.requantise("value", 0.5))


@register("t14_first_per_group", "l_orderkey:i l_linenumber:i l_quantity:f", "select l_orderkey, min(l_linenumber) l_linenumber, arg_min(l_quantity, l_linenumber) l_quantity from lineitem group by 1")
def t14(spark, sf):
    # lines of one number: the first in the file, as a scan of it in order takes them
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return clean.first_per_group(li, ["l_orderkey"], ["l_linenumber", "file", "row"])


@register("t17_hashed_split", "part n:i", SHOTS + f"select case when {u_sql('7', 'id')} < 0.8 then 'train' else 'test' end part, count(*) n from shots group by 1")
def t17(spark, sf):
    return shots(spark, sf).groupBy(F.when(clean.hashed_split(["id"], 0.8, 7), "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"))


@register("s5_packed_weather", "event_id:i ext_temp:f ext_wind:f", """select event_id, case when user_id % 7 = 0 then null else round(value * 10)::bigint / 10.0 end ext_temp, case when user_id % 11 = 0 then null else user_id / 10.0 end ext_wind from events""")
def s5(spark, sf):
    e = table(spark, sf, "events")
    tmp = F.when(F.col("user_id") % 7 == 0, F.lit("+9999")).otherwise(F.round(F.col("value") * 10).cast("long").cast("string"))
    wnd = F.when(F.col("user_id") % 11 == 0, F.lit("9999")).otherwise(F.col("user_id").cast("string"))
    packed = e.select("event_id", F.concat(tmp, F.lit(",1")).alias("TMP"), F.lit("+0100,1").alias("DEW"), F.lit("10132,1").alias("SLP"), F.concat(F.lit("090,1,N,"), wnd, F.lit(",1")).alias("WND"), F.lit("010000,1,N,1").alias("VIS"), F.lit("99999,9,9,N").alias("CIG"))
    # an array index over the end is null: WND's speed is its fourth part
    return clean.packed_weather(packed)


# ---- features
@register("f1_lags", BASE + " kw_lag1:f kw_lag2:f kw_lag3:f kw_lag4:f kw_lag8:f kw_lag96:f", DEMAND + "select series_id, step, " + ", ".join(f"lag(kw, {k}) over ({W}) kw_lag{k}" for k in (1, 2, 3, 4, 8, 96)) + " from demand")
def f1(spark, sf):
    return ft.lags(demand(spark, sf), "kw", [1, 2, 3, 4, 8, 96], K, S)


@register("f2_rolling", BASE + " " + " ".join(f"kw_{k}{n}:f" for n in (4, 96) for k in ("roll", "std", "max")), DEMAND + "select series_id, step, " + ", ".join(f"{framed(f, n)} kw_{k}{n}" for n in (4, 96) for k, f in (("roll", "avg(kw)"), ("std", "stddev_samp(kw)"), ("max", "max(kw)"))) + " from demand")
def f2(spark, sf):
    return ft.rolling(demand(spark, sf), "kw", [4, 96], K, S)


@register("f3_ramps", BASE + " kw_ramp1:f kw_ramp4:f", DEMAND + f"select series_id, step, kw - lag(kw, 1) over ({W}) kw_ramp1, kw - lag(kw, 4) over ({W}) kw_ramp4 from demand")
def f3(spark, sf):
    return ft.ramps(demand(spark, sf), "kw", [1, 4], K, S)


@register("f4_production_state", BASE + " is_operating:i is_operating_lag4:i prod_diff:i", DEMAND + f"select series_id, step, is_operating, lag(is_operating, 4) over ({W}) is_operating_lag4, qty - lag(qty) over ({W}) prod_diff from demand")
def f4(spark, sf):
    return ft.production_state(demand(spark, sf), "qty", K, S)


@register("f5_targets", BASE + " y_h1:f y_h2:f y_h3:f y_h4:f", DEMAND + "select series_id, step, " + ", ".join(f"lead(kw, {h}) over ({W}) y_h{h}" for h in (1, 2, 3, 4)) + " from demand")
def f5(spark, sf):
    return ft.targets(demand(spark, sf), "kw", [1, 2, 3, 4], K, S)


SLOT = "((hour(ts15) * 60 + minute(ts15)) // 15)"


@register("f6_cyclic", BASE + " tod_sin1:f tod_cos1:f tod_sin2:f tod_cos2:f tod_sin3:f tod_cos3:f dow_sin1:f dow_cos1:f", DEMAND + "select series_id, step, " + ", ".join(f"{f}(2 * {k} * pi() * {SLOT} / 96) tod_{f}{k}" for k in (1, 2, 3) for f in ("sin", "cos")) + ", sin(2 * pi() * isodow(ts15) / 7) dow_sin1, cos(2 * pi() * isodow(ts15) / 7) dow_cos1 from demand")
def f6(spark, sf):
    d = demand(spark, sf)
    return d.withColumns(ft.cyclic(clean.slot_of_day("ts15"), 96, 3, "tod") | ft.cyclic(F.weekday("ts15") + 1, 7, 1, "dow"))


RUNLEN = f"""
, ch as (select *, case when is_operating <> lag(is_operating) over ({W}) then 1 when lag(is_operating) over ({W}) is null then 1 else 0 end c from demand),
rn as (select *, sum(c) over ({W}) r from ch),
len as (select *, row_number() over (partition by series_id, r order by step) n from rn)
"""


@register("f7_run_length", BASE + " off_run_len:i on_run_len:i", DEMAND + RUNLEN + "select series_id, step, case when is_operating = 0 then n else 0 end off_run_len, case when is_operating <> 0 then n else 0 end on_run_len from len")
def f7(spark, sf):
    return ft.run_length(demand(spark, sf), "is_operating", K, S)


@register("f8_restart", BASE + " restart_recent:i vs_day:f ratio_day:f", DEMAND + RUNLEN + f""", z as (select *, {framed("avg(kw)", 96)} m from len)
select series_id, step, case when is_operating <> 0 and n <= 8 then 1 else 0 end restart_recent, kw - m vs_day, kw / (case when m is null or m < 1 then 1.0 else m end) ratio_day from z""")
def f8(spark, sf):
    d = ft.rolling(ft.run_length(demand(spark, sf), "is_operating", K, S), "kw", [96], K, S)
    return ft.restart_flags(d, "kw", "kw_roll96")


def trailing(n: int, q: float, least: int) -> str:
    return framed(f"quantile_cont(kw, {q})", n, 1, least)


#: The published threshold: p95 of the 30 days before, once 7 days are there.
MONTH, WEEK = 2880, 672
WINDOWS, LEVELS = (1344, 2880, 5760, 8640), (0.9, 0.95, 0.97)


def trailing_p95(d):
    return halo.trailing_quantiles(d, "kw", {"thr": (MONTH, 0.95, WEEK)}, K, S)


@register("f9_trailing_p95", BASE + " thr:f", DEMAND + f"select series_id, step, {trailing(MONTH, 0.95, WEEK)} thr from demand")
def f9(spark, sf):
    return trailing_p95(demand(spark, sf))


@register("f10_threshold_grid", "series_id rule prevalence:f events:i warm_up:i drift:f", DEMAND + ", g as (" + " union all ".join(f"select series_id, step, kw, 'w{n}_q{int(q * 100)}' rule, {trailing(n, q, WEEK)} thr from demand" for n in WINDOWS for q in LEVELS) + """),
f as (select *, case when thr is null then null when kw >= thr then 1 else 0 end peak from g),
o as (select *, case when peak = 1 and coalesce(lag(peak) over (partition by series_id, rule order by step), 0) = 0 then 1 else 0 end onset from f)
select series_id, rule, avg(peak) prevalence, sum(onset) events, count(*) filter (where thr is null) warm_up, max(thr) - min(thr) drift from o group by 1, 2""")
def f10(spark, sf):
    return ft.threshold_grid(demand(spark, sf).select("series_id", "step", "kw"), "kw", WINDOWS, LEVELS, WEEK, K, S)


@register("f11_expanding_p95", BASE + " thr_expanding:f", DEMAND + f"select series_id, step, case when count(kw) over ({W} rows between unbounded preceding and 1 preceding) >= 96 then quantile_cont(kw, 0.95) over ({W} rows between unbounded preceding and 1 preceding) end thr_expanding from demand")
def f11(spark, sf):
    return ft.expanding_quantile(demand(spark, sf), "kw", 0.95, 96, K, S)


@register("f12_month_max", BASE + " thr_month:f", DEMAND + "select series_id, step, max(kw) over (partition by series_id, date_trunc('month', ts15) order by ts15 rows between unbounded preceding and 1 preceding) thr_month from demand")
def f12(spark, sf):
    return ft.month_to_date_max(demand(spark, sf), "kw", K, "ts15")


@register("f13_margins", BASE + " margin:f margin_ratio:f margin_lag1:f margin_lag2:f margin_lag4:f margin_lag8:f margin_lag96:f margin_ramp4:f margin_max4:f margin_max96:f margin_roll96:f day_max_margin:f", SCORED + f""", m as (select series_id, step, ts15, kw, thr, kw - thr margin, kw / nullif(thr, 0) margin_ratio from scored)
select series_id, step, margin, margin_ratio, {', '.join(f'lag(margin, {k}) over ({W}) margin_lag{k}' for k in (1, 2, 4, 8, 96))}, margin - lag(margin, 4) over ({W}) margin_ramp4, {framed("max(margin)", 4, x="margin")} margin_max4, {framed("max(margin)", 96, x="margin")} margin_max96, {framed("avg(margin)", 96, x="margin")} margin_roll96,
 max(kw) over (partition by series_id, ts15::date order by step) - thr day_max_margin from m""")
def f13(spark, sf):
    return ft.margin_features(scored(spark, sf), "kw", "thr", K, S, F.to_date("ts15"))


@register("f14_peak_history", BASE + " peaks_96:i peaks_672:i", SCORED + "select series_id, step, " + ", ".join(f"{framed('sum(peak)', k, 1, x='peak')} peaks_{k}" for k in (96, 672)) + " from scored")
def f14(spark, sf):
    return ft.peak_history(scored(spark, sf), "peak", [96, 672], K, S)


@register("f15_since_peak", BASE + " since_peak:i", SCORED + f""", r as (select *, row_number() over ({W}) rn from scored),
l as (select *, last_value(case when peak = 1 then rn end ignore nulls) over ({W} rows between unbounded preceding and 1 preceding) pk from r)
select series_id, step, case when pk is not null then least(rn - pk - 1, 400) end since_peak from l""")
def f15(spark, sf):
    return ft.steps_since_peak(scored(spark, sf), "peak", K, S)


@register("f16_day_so_far", BASE + " day_max:f day_qty:i", DEMAND + "select series_id, step, max(kw) over w day_max, sum(qty) over w day_qty from demand window w as (partition by series_id, ts15::date order by ts15)")
def f16(spark, sf):
    return ft.day_so_far(demand(spark, sf), "kw", "qty", K, "ts15")


@register("f17_slot_rate", BASE + " slot_rate:f", SCORED + f""", t_ as (select * from scored where step < 1700), p_ as (select series_id, avg("label") p0 from t_ group by 1),
b_ as (select series_id, {SLOT} slot, sum("label") s, count(*) n from t_ group by 1, 2)
select s.series_id, s.step, coalesce((b_.s + 50 * p0) / (b_.n + 50), p0) slot_rate from scored s left join p_ on p_.series_id = s.series_id left join b_ on b_.series_id = s.series_id and b_.slot = {SLOT}""")
def f17(spark, sf):
    d = scored(spark, sf).withColumn("slot", clean.slot_of_day("ts15"))
    return ft.slot_rate(d, "label", "slot", F.col("step") < 1700, K)


@register("f19_work_calendar", "day is_workday:i is_bridge:i days_to_off:i days_since_off:i off_run:i", """
with d as (select distinct l_shipdate::date "day" from lineitem), h as (select "day", case when dayofmonth("day") in (1, 15, 17) then 1 else 0 end hol from d),
w as (select *, case when hol = 1 or isodow("day") >= 6 then 0 else 1 end is_workday, row_number() over (order by "day") i from h),
o as (select *, lag(is_workday) over (order by "day") pv, lead(is_workday) over (order by "day") nx,
 min(case when is_workday = 0 then "day" end) over (order by "day" rows between current row and unbounded following) nf, max(case when is_workday = 0 then "day" end) over (order by "day" rows between unbounded preceding and current row) pf,
 coalesce(min(case when is_workday = 1 then i end) over (order by "day" rows between current row and unbounded following), (select count(*) + 1 from w)) bk from w)
select "day", is_workday, case when is_workday = 1 and pv = 0 and nx = 0 then 1 else 0 end is_bridge, coalesce(nf - "day", -1) days_to_off, coalesce("day" - pf, -1) days_since_off, case when is_workday = 0 then bk - i else 0 end off_run from o""")
def f19(spark, sf):
    days = shots(spark, sf).select("day").distinct().withColumn("hol", F.dayofmonth("day").isin(1, 15, 17).cast("int"))
    return ft.work_calendar(days, "day", "hol")


SOLAR = """, s as (select *, radians(360 / 365.0 * (dayofyear(ts15) - 81)) yr, radians(37.5) lat from demand),
z as (select *, radians(23.44) * sin(yr) tilt, radians(((hour(ts15) + minute(ts15) / 60.0) * 60 + 4 * (127.0 - 135) + 9.87 * sin(2 * yr) - 7.53 * cos(yr) - 1.5 * sin(yr)) / 4 - 180) ang from s),
sun as (select *, degrees(asin(sin(lat) * sin(tilt) + cos(lat) * cos(tilt) * cos(ang))) el from z)
"""


@register("f20_solar", BASE + " solar_elevation:f is_daylight:i day_length_h:f", DEMAND + SOLAR + "select series_id, step, el solar_elevation, case when el > 0 then 1 else 0 end is_daylight, degrees(acos(greatest(-1.0, least(1.0, -tan(lat) * tan(tilt))))) * 2 / 15 day_length_h from sun")
def f20(spark, sf):
    return demand(spark, sf).withColumns(ft.solar("ts15", 37.5, 127.0, 9))


@register("f21_season_zone", "season zone n:i", f"with l as (select l_shipdate + to_hours((l_orderkey % 24)::int) t from lineitem) select {season_sql('t')} season, {zone_sql('t')} zone, count(*) n from l group by 1, 2")
def f21(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_orderkey") % 24)).alias("t"))
    return l.groupBy(ft.season("t").alias("season"), ft.load_zone("t").alias("zone")).agg(F.count("*").alias("n"))


WH = "partition by series_id order by ts"


@register("f22_weather", "series_id ts temp_diff1h:f temp_diff3h:f temp_roll24h:f dew_spread:f heat_proxy:f pressure_diff3h:f", WEATHER + f", x as (select *, temp / 4 dew, 1000 + temp / 2 pressure from weather) select series_id, ts, temp - lag(temp, 1) over ({WH}) temp_diff1h, temp - lag(temp, 3) over ({WH}) temp_diff3h, case when count(temp) over ({WH} rows between 23 preceding and current row) >= 6 then avg(temp) over ({WH} rows between 23 preceding and current row) end temp_roll24h, temp - dew dew_spread, temp + 0.33 * (6.11 * exp(17.27 * dew / (237.3 + dew))) - 4.0 heat_proxy, pressure - lag(pressure, 3) over ({WH}) pressure_diff3h from x")
def f22(spark, sf):
    d = weather(spark, sf).withColumns({"dew": F.col("temp") / 4, "pressure": 1000 + F.col("temp") / 2})
    return ft.weather_derived(d, "temp", K, "ts", "dew", "pressure")


@register("f23_previous_day", BASE + " prev_max:f prev_min:f", DEMAND + """, g as (select series_id, ts15::date + 1 dd, max(kw) a, min(kw) b from demand group by 1, 2)
select d.series_id, d.step, a prev_max, b prev_min from demand d left join g on g.series_id = d.series_id and g.dd = d.ts15::date""")
def f23(spark, sf):
    return ft.previous_day(demand(spark, sf), "kw", K, "ts15")


@register("f24_robust_scale", BASE + " kw_scaled:f", DEMAND + """, q as (select series_id, quantile_cont(kw, 0.25) a, quantile_cont(kw, 0.5) m, quantile_cont(kw, 0.75) b, stddev_samp(kw) s from demand where step < 1700 group by 1)
select d.series_id, step, (kw - m) / (case when b - a > 0 then b - a else coalesce(nullif(s, 0), 1) end) kw_scaled from demand d join q on q.series_id = d.series_id""")
def f24(spark, sf):
    return ft.robust_scale(demand(spark, sf), "kw", F.col("step") < 1700, K)


@register("f25_change_point", BASE + " cp_flag:i cp_stat:f", DEMAND + f""", c as (select series_id, step, abs({framed("avg(kw)", 4)} - {framed("avg(kw)", 16, 4)}) cp_stat from demand), q as (select series_id, quantile_cont(round(cp_stat, 6), 0.9) cut from c where step < 1700 group by 1)
select c.series_id, step, case when round(cp_stat, 6) > cut then 1 else 0 end cp_flag, cp_stat from c join q on q.series_id = c.series_id""")
def f25(spark, sf):
    return ft.change_point(demand(spark, sf), "kw", 4, 16, F.col("step") < 1700, K, S)


@register("f26_centred_mean", BASE + " kw_centred:f", DEMAND + f"select series_id, step, avg(kw) over ({W} rows between 25 preceding and 25 following) kw_centred from demand")
def f26(spark, sf):
    return ft.centred_mean(demand(spark, sf), "kw", 51, K, S)


@register("f27_rolling_corr", "series_id day mean_corr:f low:i", DEMAND + f""", c as (select series_id, ts15::date "day", case when count(kw) over ({W} rows between 99 preceding and current row) >= 100 then round(covar_pop(kw, qty) over ({W} rows between 99 preceding and current row) / nullif(stddev_pop(kw) over ({W} rows between 99 preceding and current row) * stddev_pop(qty) over ({W} rows between 99 preceding and current row), 0), 9) end r from demand)
select series_id, "day", avg(r) mean_corr, count(*) filter (where r < 0.5) low from c group by 1, 2""")
def f27(spark, sf):
    d = ft.rolling_corr(demand(spark, sf), "kw", "qty", 100, K, S).withColumn("r", F.round("roll_corr", 9))
    return d.groupBy("series_id", F.to_date("ts15").alias("day")).agg(F.avg("r").alias("mean_corr"), F.count_if(F.col("r") < 0.5).alias("low"))


@register("f28_ratios", "id:i vi:f vit:f i2t:f", SHOTS + "select id, a * c vi, a * c * d vit, a * a * d i2t from shots")
def f28(spark, sf):
    return shots(spark, sf).select("id", (F.col("a") * F.col("c")).alias("vi"), (F.col("a") * F.col("c") * F.col("d")).alias("vit"), (F.col("a") * F.col("a") * F.col("d")).alias("i2t"))


@register("f37_onset_slopes", BASE + " before1:f before4:f before8:f slope4:f slope8:f", SCORED + f""", o as (select *, case when peak = 1 and coalesce(lag(peak) over ({W}), 0) = 0 then 1 else 0 end onset, lag(kw, 1) over ({W}) b1, lag(kw, 4) over ({W}) b4, lag(kw, 8) over ({W}) b8 from scored)
select series_id, step, b1 before1, b4 before4, b8 before8, (b1 - b4) / 3 slope4, (b1 - b8) / 7 slope8 from o where onset = 1""")
def f37(spark, sf):
    return ft.onset_slopes(ev.onsets(scored(spark, sf), "peak", K, S), "kw", "onset", [1, 4, 8], K, S)


@register("f38_shifted_rolling", BASE + " kw_roll4:f kw_std4:f kw_max4:f", DEMAND + f"select series_id, step, {framed('avg(kw)', 4, 1)} kw_roll4, {framed('stddev_samp(kw)', 4, 1)} kw_std4, {framed('max(kw)', 4, 1)} kw_max4 from demand")
def f38(spark, sf):
    return ft.rolling(demand(spark, sf), "kw", [4], K, S, shift=1)


@register("f36_aligned_windows", "series_id at:i n:i top:f", SCORED + f""", o as (select *, case when peak = 1 and coalesce(lag(peak) over ({W}), 0) = 0 then 1 else 0 end onset from scored),
j as (select a.series_id, a.step "at", b.step - a.step + 4 k, b.kw from o a join scored b on b.series_id = a.series_id and b.step between a.step - 4 and a.step + 7 where a.onset = 1),
g as (select series_id, "at", count(*) n, min(kw) lo, max(kw) hi, sum(kw) s from j group by 1, 2)
select series_id, "at", n, round(coalesce((s - n * lo) / nullif(hi - lo, 0), 0), 5) top from g where n = 12""")
def f36(spark, sf):
    a = ft.aligned_windows(ev.onsets(scored(spark, sf), "peak", K, S), "kw", "onset", 4, 12, K, S)
    return a.select("series_id", "at", F.size("shape").alias("n"), F.round(F.aggregate("shape", F.lit(0.0), lambda s, x: s + x), 5).alias("top"))


# ---- joins
@register("j1_calendar_join", "series_id is_workday:i mean:f", DEMAND + ", c as (select distinct ts15::date dd, case when isodow(ts15) >= 6 then 0 else 1 end w from demand) select series_id, w is_workday, avg(kw) mean from demand d left join c on c.dd = d.ts15::date group by 1, 2")
def j1(spark, sf):
    d = demand(spark, sf).withColumn("day", F.to_date("ts15"))
    cal = ft.work_calendar(d.select("day").distinct().withColumn("hol", F.lit(0)), "day", "hol")
    return d.join(cal, "day", "left").groupBy("series_id", "is_workday").agg(F.avg("kw").alias("mean"))


@register("j2_asof_floor", BASE + " temp:f", DEMAND + WEATHER.replace("with w", ", w", 1) + "select d.series_id, d.step, temp from demand d left join weather x on x.series_id = d.series_id and x.ts = date_trunc('hour', d.ts15)")
def j2(spark, sf):
    d = demand(spark, sf).withColumn("ts", F.date_trunc("hour", "ts15").cast("timestamp_ntz"))
    return d.join(weather(spark, sf), ["series_id", "ts"], "left")


@register("j8_semi_anti", "kind n:i", "select 'semi' kind, count(*) n from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') union all select 'anti', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def j8(spark, sf):
    o, r = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda how: o.join(r, "o_orderkey", f"left_{how}").agg(F.count("*").alias("n")).select(F.lit(how).alias("kind"), "n")
    return count("semi").union(count("anti"))


@register("j7_station_match", "series_id station:i r:f bias:f rank:i", WEATHER + """, s as (select user_id % 10 station, date_trunc('hour', ts) ts, avg(value) v from events group by 1, 2),
m as (select series_id, station, round(corr(temp, v), 9) r, avg(temp - v) bias from weather w join s on s.ts = w.ts group by 1, 2),
k as (select *, row_number() over (partition by series_id order by r desc, station) rank from m) select * from k where rank <= 3""")
def j7(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("v"))
    m = weather(spark, sf).join(s, "ts").groupBy("series_id", "station").agg(F.round(F.corr("temp", "v"), 9).alias("r"), F.avg(F.col("temp") - F.col("v")).alias("bias"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("r"), "station"))).where("rank <= 3")


@register("j14_leave_one_out", "target n:i mean:f", DEMAND + "select t.series_id target, count(*) n, avg(kw) mean from (select distinct series_id from demand) t join demand d on d.series_id <> t.series_id group by 1")
def j14(spark, sf):
    # a row counts for every target but its own: totals less the target's part, no join of rows
    g = demand(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("kw").alias("s"))
    all_ = Window.partitionBy(F.lit(1))
    return g.select(F.col("series_id").alias("target"), (F.sum("n").over(all_) - F.col("n")).alias("n"), ((F.sum("s").over(all_) - F.col("s")) / (F.sum("n").over(all_) - F.col("n"))).alias("mean"))


# ---- events
def runs_sql(src: str, flag: str, gap: int, aggs: str = "") -> str:
    return f""", f_ as (select * from {src} where {flag} = 1), n_ as (select *, case when step - lag(step) over ({W}) <= {gap} then 0 else 1 end nw from f_), i_ as (select *, sum(nw) over ({W}) event_id from n_),
runs as (select series_id, event_id, min(step) "first", max(step) "last", count(*) n {aggs} from i_ group by 1, 2)
"""


@register("e1_runs_gap2", "series_id event_id:i first:i last:i n:i kw_max:f", SCORED + runs_sql("scored", "peak", 2, ", max(kw) kw_max") + "select * from runs")
def e1(spark, sf):
    return ev.runs(scored(spark, sf), "peak", K, S, 2, kw_max=F.max("kw"))


@register("e2_strict_runs", "series_id event_id:i first:i last:i n:i", SCORED + runs_sql("scored", "peak", 1) + "select * from runs")
def e2(spark, sf):
    return ev.strict_runs(scored(spark, sf), "peak", K, S)


ANAT = f""", p_ as (select *, avg(kw) over ({W} rows between 8 preceding and 1 preceding) pre, avg(kw) over ({W} rows between 1 following and 8 following) post, min(kw) over ({W} rows between 1 following and 8 following) low from scored)"""


@register("e3_anatomy", "series_id event_id:i duration:i peak:f peak_step:i baseline:f area:f rise:f rise_steps:i post:f rebound:f", SCORED + ANAT + runs_sql("p_", "peak", 2, ", max(kw) top, arg_max(step, kw) top_step0, arg_min(pre, step) base, arg_max(post, step) post1, arg_max(low, step) low1, sum(kw) total") + """, k_ as (select i_.series_id, i_.event_id, min(step) top_step from i_ join runs r on r.series_id = i_.series_id and r.event_id = i_.event_id and i_.kw = r.top group by 1, 2)
select r.series_id, r.event_id, "last" - "first" + 1 duration, top peak, top_step peak_step, base baseline, total - n * coalesce(base, 0) area, top - base rise, top_step - "first" rise_steps, post1 post, post1 - low1 rebound from runs r join k_ on k_.series_id = r.series_id and k_.event_id = r.event_id""")
def e3(spark, sf):
    return ev.anatomy(scored(spark, sf), "peak", "kw", K, S)


@register("e4_future_any", BASE + " future:i", SCORED + f"select series_id, step, coalesce(max(peak) over ({W} rows between 1 following and 4 following), 0) future from scored")
def e4(spark, sf):
    return ev.future_any(scored(spark, sf), "peak", 4, K, S)


@register("e5_event_recall", "series_id event_id:i detected:i lead_min:i", SCORED + f", a_ as (select *, min(case when alert = 1 then step end) over ({W} rows between 4 preceding and 1 preceding) fa from scored)" + runs_sql("a_", "peak", 2, ", arg_min(coalesce(fa, -1), step) fa1") + """select series_id, event_id, case when fa1 >= 0 then 1 else 0 end detected, case when fa1 >= 0 then least("first" - fa1, 4) * 15 end lead_min from runs""")
def e5(spark, sf):
    return ev.event_recall(scored(spark, sf), "peak", "alert", 4, K, S)


@register("e6_covered_events", "series_id event_id:i detected:i lead_steps:i", SCORED + f", a_ as (select *, min(case when alert = 1 then step end) over ({W} rows between 0 preceding and current row) fa from scored)" + runs_sql("a_", "peak", 2, ", min(fa) fa1") + """select series_id, event_id, case when fa1 is not null then 1 else 0 end detected, "first" - fa1 lead_steps from runs""")
def e6(spark, sf):
    return ev.covered_events(scored(spark, sf), "peak", "alert", K, S)


@register("e7_covered_tolerance", "series_id event_id:i detected:i lead_steps:i", SCORED + f", a_ as (select *, min(case when alert = 1 then step end) over ({W} rows between 4 preceding and current row) fa from scored)" + runs_sql("a_", "peak", 2, ", min(fa) fa1") + """select series_id, event_id, case when fa1 is not null then 1 else 0 end detected, "first" - fa1 lead_steps from runs""")
def e7(spark, sf):
    return ev.covered_events(scored(spark, sf), "peak", "alert", K, S, 4)


@register("e8_alert_load", "series_id runs_per_day:f steps_per_day:f check_minutes_per_day:f", SCORED + runs_sql("scored", "alert", 2) + ", d_ as (select series_id, count(*) / 96.0 dd, sum(alert) s from scored group by 1), r_ as (select series_id, count(*) r from runs group by 1) select d_.series_id, coalesce(r, 0) / dd runs_per_day, s / dd steps_per_day, coalesce(r, 0) * 5.0 / dd check_minutes_per_day from d_ left join r_ on r_.series_id = d_.series_id")
def e8(spark, sf):
    return ev.alert_load(scored(spark, sf), "alert", K, S)


@register("e9_exceedance", "series_id mean:f median:f p90:f", SCORED + runs_sql("scored", "peak", 2, ", max(kw - thr) size") + "select series_id, avg(size) mean, quantile_cont(size, 0.5) median, quantile_cont(size, 0.9) p90 from runs group by 1")
def e9(spark, sf):
    e = ev.exceedance(scored(spark, sf), "peak", "kw", "thr", K, S)
    return e.groupBy("series_id").agg(F.avg("size").alias("mean"), F.percentile("size", F.lit(0.5)).alias("median"), F.percentile("size", F.lit(0.9)).alias("p90"))


@register("e10_local_peaks", BASE + " kw:f prominence:f")
def e10(spark, sf):
    return ev.local_peaks(demand(spark, sf), "kw", 30.0, 96, K, S)


@register("e11_peak_definitions", "series_id p95:i p99:i local_max:i day_max:i", SCORED + f""", q_ as (select series_id, quantile_cont(kw, 0.95) a, quantile_cont(kw, 0.99) b from scored group by 1),
l_ as (select s.*, a, b, lag(kw) over ({W.replace('series_id', 's.series_id', 1)}) pv, lead(kw) over ({W.replace('series_id', 's.series_id', 1)}) nx, max(kw) over (partition by s.series_id, ts15::date) dm from scored s join q_ on q_.series_id = s.series_id)
select series_id, count(*) filter (where kw >= a) p95, count(*) filter (where kw >= b) p99, count(*) filter (where kw > pv and kw > nx) local_max, count(*) filter (where kw = dm and kw > 0) day_max from l_ group by 1""")
def e11(spark, sf):
    d = ev.peak_definitions(scored(spark, sf), "kw", K, S, F.to_date("ts15"), "thr")
    return d.groupBy("series_id").agg(*[F.sum(c).alias(c) for c in ("p95", "p99", "local_max", "day_max")])


@register("e12_missed_taxonomy", "series_id kind lower:i probable:i n:i", SCORED + f", a_ as (select *, max(alert) over ({W} rows between 4 preceding and current row) ca, max((score >= 0.5 * thr)::int) over ({W} rows between 4 preceding and current row) lo, max((p >= 0.4)::int) over ({W} rows between 4 preceding and current row) pb, score - thr margin, avg(abs(y - score)) over (partition by series_id) mae from scored)" + runs_sql("a_", "peak", 2, ", max(ca) caught, max(margin) best, max(lo) lower, max(pb) probable, max(mae) mae") + """select series_id, case when caught = 1 then 'caught' when best < -2 * mae then 'forecast_miss' when best >= -mae then 'rule_blocked' else 'undetermined' end kind, lower, probable, count(*) n from runs group by 1, 2, 3, 4""")
def e12(spark, sf):
    recent = lambda c: F.max(c).over(ft.over(K, S).rowsBetween(-4, 0))
    d = scored(spark, sf)
    mae = d.groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"))
    d = d.join(mae, "series_id").withColumns({"margin": F.col("score") - F.col("thr"), "near": recent("alert"), "lower": recent((F.col("score") >= 0.5 * F.col("thr")).cast("int")), "probable": recent((F.col("p") >= 0.4).cast("int"))})
    return ev.missed_taxonomy(d, "peak", "near", "margin", "mae", K, S, ["lower", "probable"]).groupBy("series_id", "kind", "lower", "probable").agg(F.count("*").alias("n"))


@register("e13_false_alarms", "series_id n:i near:i", SCORED + ", a_ as (select *, kw - thr margin from scored)" + runs_sql("a_", "alert", 2, ', max("label") lb, max(margin) best') + "select series_id, count(*) n, count(*) filter (where best >= -50) near from runs where lb = 0 group by 1")
def e13(spark, sf):
    d = scored(spark, sf).withColumn("margin", F.col("kw") - F.col("thr"))
    e = ev.false_alarms(d, "alert", "label", "margin", 50.0, K, S)
    return e.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("near_miss").alias("near"))


@register("e14_onsets", "series_id n:i", SCORED + f"select series_id, count(*) n from (select series_id, peak, coalesce(lag(peak) over ({W}), 0) pv from scored) where peak = 1 and pv = 0 group by 1")
def e14(spark, sf):
    return ev.onsets(scored(spark, sf), "peak", K, S).where("onset = 1").groupBy("series_id").agg(F.count("*").alias("n"))


@register("flagship_peak_events", "series_id events:i events_per_day:f peak_kw:f", DEMAND + f", t_ as (select *, {trailing(MONTH, 0.95, WEEK)} thr from demand), x_ as (select *, case when kw >= thr then 1 else 0 end peak from t_)" + runs_sql("x_", "peak", 2, ", max(kw) kw_max") + ", d_ as (select series_id, count(*) / 96.0 dd from demand group by 1) select r.series_id, count(*) events, count(*) / max(dd) events_per_day, max(kw_max) peak_kw from runs r join d_ on d_.series_id = r.series_id group by 1")
def flagship(spark, sf):
    d = demand(spark, sf)
    days = d.groupBy("series_id").agg((F.count("*") / 96).alias("days"))
    d = trailing_p95(d).withColumn("peak", F.coalesce((F.col("kw") >= F.col("thr")).cast("int"), F.lit(0)))
    e = ev.runs(d, "peak", K, S, 2, kw_max=F.max("kw")).groupBy("series_id").agg(F.count("*").alias("events"), F.max("kw_max").alias("peak_kw"))
    return e.join(days, "series_id").withColumn("events_per_day", F.col("events") / F.col("days"))
