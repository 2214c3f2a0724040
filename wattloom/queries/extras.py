"""Files, catalogues, small joins, folds, searches of shapes, and stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions.special import uniform
from wattloom.operators import clean, diagnosis as dg, features as ft, intervals as iv, joins as jn, ledger as lg, policy as pl, shapes as sh, stats as st, verdicts as vd
from wattloom.queries.alerts import CAL, DIAG, LEDGER, SEQ, day_book, diagnosed, ood, sequential, thresholds
from wattloom.queries.audits import signatures, SIGN, weight_sql
from wattloom.queries.base import DEMAND, K, S, SCORED, SHOTS, demand, register, scored, shots, table, u_sql
from wattloom.queries.meter import SLOT, SOLAR, W, zone_sql
from wattloom.session import cut, scratch
from wattloom.sources import files
from wattloom.streaming import streams as ss


# ---- sources and sinks: derived tables written as the files that readers meet
@register("s1_meter_csv", "series_id date hour:i kw_15:f kw_60:f", DEMAND + """, h as (select series_id, date_trunc('day', ts15) "date", hour(ts15) "hour", max(case when minute(ts15) = 0 then kw end) kw_15, max(case when minute(ts15) = 45 then kw end) kw_60 from demand group by 1, 2, 3) select * from h""")
def s1(spark, sf):
    d = demand(spark, sf).withColumns({"date": F.date_format("ts15", "yyyyMMdd"), "hour": F.hour("ts15"), "q": F.minute("ts15")})
    wide = d.groupBy("series_id", "date", "hour").pivot("q", [0, 15, 30, 45]).agg(F.first("kw"))
    out = wide.select("date", "hour", *[F.col(f"`{m - 15}`").alias(f"kw_{m}") for m in (15, 30, 45, 60)], *[F.lit(None).cast("double").alias(c) for c in ("kw_mean", "production", "temp", "wind", "humidity", "rain", "tariff")], *[F.lit(None).cast("long").alias(c) for c in ("dow", "day", "month")], F.lit(None).cast("double").alias("headcount"), F.lit(None).cast("double").alias("labour_factor"), "series_id")
    path = scratch(spark, "meter-csv")
    out.write.partitionBy("series_id").option("header", True).csv(path)
    return files.read_meter(spark, path)


@register("s2_shot_csv", "idx:i a:f label:i", SHOTS + 'select id idx, a, "label" from shots')
def s2(spark, sf):
    path = scratch(spark, "shots-csv")
    shots(spark, sf).select(F.col("id").alias("first column"), "a", "label").write.option("header", True).csv(path)
    return files.read_shots(spark, path)


@register("s3_labelled_union", "source n:i total:f", "select case when l_returnflag = 'R' then 'returned' else 'kept' end source, count(*) n, sum(l_quantity) total from lineitem group by 1")
def s3(spark, sf):
    li, path = table(spark, sf, "lineitem"), scratch(spark, "labelled-csv")
    for label, rows in (("returned", li.where("l_returnflag = 'R'")), ("kept", li.where("l_returnflag <> 'R'"))):
        rows.select("l_orderkey", "l_quantity").write.option("header", True).csv(f"{path}/{label}")
    u = files.read_labelled(spark, {k: f"{path}/{k}" for k in ("returned", "kept")})
    return u.groupBy("source").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@register("s4_site_scan", "site n:i kw:f", DEMAND + "select series_id site, count(*) n, sum(kw) kw from demand group by 1")
def s4(spark, sf):
    path = scratch(spark, "sites-csv")
    demand(spark, sf).select(F.col("series_id").alias("site"), "ts15", "kw").write.partitionBy("site").option("header", True).csv(path)
    return files.read_sites(spark, path, "ts15 timestamp, kw double").groupBy("site").agg(F.count("*").alias("n"), F.sum("kw").alias("kw"))


@register("s6_result_sink", "series_id day n:i", DEMAND + 'select series_id, ts15::date "day", count(*) n from demand group by 1, 2')
def s6(spark, sf):
    """Also S7 and S8: the table is read back, and taken as an optional source."""
    path = scratch(spark, "result")
    files.save_table(demand(spark, sf).groupBy("series_id", F.to_date("ts15").alias("day")).agg(F.count("*").alias("n")), path)
    assert files.optional(spark, path + "-absent") is None
    return files.optional(spark, path)


# ---- catalogues
@register("t15_feature_catalogue", "feature level known_ahead assumption_dependent present filled:f")
def t15(spark, sf):
    return vd.catalogue(wide_features(spark, sf))


def wide_features(spark, sf):
    d = ft.rolling(ft.lags(ft.production_state(demand(spark, sf), "qty", K, S), "kw", [1, 2, 3, 4, 8, 96], K, S), "kw", [4, 96], K, S)
    return d.withColumns({"slot": clean.slot_of_day("ts15"), "hour": F.hour("ts15"), "dow": F.weekday("ts15") + 1, "day": F.dayofmonth("ts15"), "month": F.month("ts15"), "kw_diff1": F.col("kw") - F.col("kw_lag1"), "kw_ramp4": F.col("kw") - F.col("kw_lag4"), "prod_lag4": F.lag("qty", 4).over(ft.over(K, S))}).withColumn("is_weekend", (F.col("dow") >= 6).cast("int"))


@register("t16_information_levels", "level columns:i complete:i", DEMAND + f", c_ as (select lag(kw, 96) over ({W}) a, lag(qty, 4) over ({W}) b from demand) select unnest(['L0_power', 'L1_calendar', 'L3s_strict']) level, unnest([14, 20, 3]) columns, unnest([count(a), count(a), count(b)]) complete from c_")
def t16(spark, sf):
    d = cut(wide_features(spark, sf))
    sets = {"L0_power": vd.level_columns("L0_power"), "L1_calendar": [c for c in vd.level_columns("L1_calendar") if c != "season"], "L3s_strict": vd.STRICT}
    out = None
    for name, columns in sets.items():
        part = clean.complete_rows(d, columns).agg(F.count("*").alias("complete")).select(F.lit(name).alias("level"), F.lit(len(columns)).alias("columns"), "complete")
        out = part if out is None else out.unionByName(part)
    return out


#: Meanings of the columns that the data dictionary describes.
MEANING = {"event_id": ("row number", ""), "ts": ("time of the reading", "timestamp"), "user_id": ("meter", ""), "event_type": ("series", ""), "value": ("energy of the reading", "kWh"), "props": ("further fields", "JSON")}


@register("t18_dictionary", "column meaning unit rows:i filled:i distinct:i", "select c \"column\", m meaning, un unit, n \"rows\", f filled, d \"distinct\" from (values " + ", ".join(f"('{c}', '{m}', '{u}', (select count(*) from events), (select count({c}) from events), (select count(distinct {c}) from events))" for c, (m, u) in MEANING.items()) + ") v(c, m, un, n, f, d)")
def t18(spark, sf):
    return clean.dictionary(table(spark, sf, "events"), MEANING)


# ---- features and joins that others build on
@register("f35_dwell", "series_id state:i dwell:i n:i", DEMAND + f", c_ as (select *, case when is_operating is distinct from lag(is_operating) over ({W}) then 1 else 0 end ch from demand), r_ as (select *, sum(ch) over ({W}) r from c_), d_ as (select series_id, is_operating state, row_number() over (partition by series_id, r order by step) dwell from r_) select series_id, state, least(dwell, 10) dwell, count(*) n from d_ group by 1, 2, 3")
def f35(spark, sf):
    d = ft.run_length(demand(spark, sf), "is_operating", K, S)
    return d.groupBy("series_id", F.col("is_operating").alias("state"), F.least(F.greatest("on_run_len", "off_run_len"), F.lit(10)).alias("dwell")).agg(F.count("*").alias("n"))


@register("j3_solar_tariff_join", "series_id zone is_daylight:i n:i mean:f", DEMAND + SOLAR + f", k_ as (select distinct ts15, {zone_sql('ts15')} zone, (el > 0)::int is_daylight from sun) select d.series_id, zone, is_daylight, count(*) n, avg(kw) mean from demand d left join k_ on k_.ts15 = d.ts15 group by 1, 2, 3")
def j3(spark, sf):
    d = demand(spark, sf)
    sun = d.select("ts15").distinct().withColumns(ft.solar("ts15", 37.5, 127.0, 9)).withColumn("zone", ft.load_zone("ts15"))
    return d.join(sun, "ts15", "left").groupBy("series_id", "zone", "is_daylight").agg(F.count("*").alias("n"), F.avg("kw").alias("mean"))


@register("j5_threshold_lookup", "series_id step:i passed:i", SCORED + CAL + "select s.series_id, step, count(*) filter (where score >= th) passed from scored s join thr_ on thr_.series_id = s.series_id group by 1, 2")
def j5(spark, sf):
    d = scored(spark, sf)
    return pl.with_level(d, "score", thresholds(d, "score"), K, "passed")


@register("j6_profile_map", "series_id group_size:i n:i mean:f", SIGN + ', mp as (select series_id, "day", count(*) over (partition by series_id, vs) group_size from sg) select d.series_id, group_size, count(*) n, avg(kw) mean from demand d join mp on mp.series_id = d.series_id and mp."day" = d.ts15::date group by 1, 2')
def j6(spark, sf):
    m = signatures(spark, sf).select("series_id", "day", F.col("n_same").alias("group_size"))
    d = demand(spark, sf).withColumn("day", F.to_date("ts15")).join(m, ["series_id", "day"])
    return d.groupBy("series_id", "group_size").agg(F.count("*").alias("n"), F.avg("kw").alias("mean"))


@register("j9_decision_context", "series_id state n:i ramp:f idle:i", SCORED + SEQ + "select st.series_id, state, count(*) n, avg(abs(ramp4)) ramp, sum((is_operating = 0)::int) idle from st left join scored s on s.series_id = st.series_id and s.step = st.step - 4 group by 1, 2")
def j9(spark, sf):
    d = scored(spark, sf).select("series_id", (F.col(S) + 4).alias(S), "ramp4", "is_operating")
    j = sequential(spark, sf).join(d, ["series_id", S], "left")
    return j.groupBy("series_id", "state").agg(F.count("*").alias("n"), F.avg(F.abs("ramp4")).alias("ramp"), F.sum((F.col("is_operating") == 0).cast("int")).alias("idle"))


@register("j10_model_pairs", "series_id n:i wins:i gain:f", SCORED + "select a.series_id, count(*) n, count(*) filter (where abs(a.y - a.score) < abs(b.y - b.seasonal)) wins, avg(abs(b.y - b.seasonal) - abs(a.y - a.score)) gain from scored a join scored b on b.series_id = a.series_id and b.step = a.step group by 1")
def j10(spark, sf):
    d = scored(spark, sf)
    long = d.select("series_id", S, "y", F.inline(F.array(F.struct(F.lit("score").alias("model"), F.col("score").alias("pred")), F.struct(F.lit("seasonal").alias("model"), F.col("seasonal").alias("pred")))))
    return jn.paired_models(long, "model", "score", "seasonal", "y", "pred", K, S).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("err_a") < F.col("err_b")).alias("wins"), F.avg(F.col("err_b") - F.col("err_a")).alias("gain"))


# ---- folds
@register("m2_cal_tail", "series_id fold:i train:i cal:i first_cal:i", SCORED + """, r_ as (select *, row_number() over (partition by series_id order by step) - 1 i, count(*) over (partition by series_id) n from scored),
f_ as (select r_.*, k, n - (n // 6) * (5 - k) st from r_, range(5) t(k)) select series_id, k fold, count(*) filter (where i < floor(st * 0.8)) train, count(*) filter (where i >= floor(st * 0.8)) cal, min(step) filter (where i >= floor(st * 0.8)) first_cal from f_ where i < st group by 1, 2""")
def m2(spark, sf):
    d = iv.rolling_origin(scored(spark, sf).drop("fold"), 5, K, S).where("role <> 'TEST'")
    return d.groupBy("series_id", "fold").agg(F.count_if(F.col("role") == "TRAIN").alias("train"), F.count_if(F.col("role") == "CAL").alias("cal"), F.min(F.when(F.col("role") == "CAL", F.col(S))).alias("first_cal"))


@register("m4_group_kfold", "fold:i label:i groups:i n:i", SHOTS + f""", g_ as (select machine, max("label") cl, count(*) n from shots group by 1), f_ as (select *, (row_number() over (partition by cl order by {u_sql("0", "machine")}, machine) - 1) % 5 fold from g_) select fold, cl "label", count(*) groups, sum(n) n from f_ group by 1, 2""")
def m4(spark, sf):
    f = iv.group_kfold(shots(spark, sf), "machine", "label", 5)
    g = f.groupBy("machine", "fold").agg(F.max("label").alias("label"), F.count("*").alias("n"))
    return g.groupBy("fold", "label").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


# ---- policy cost by day blocks
@register("x6_cost_bootstrap", "series_id part difference:f low:f high:f below_zero:f", LEDGER + f""", ch as (select a.series_id, a.place pa, b.place pb from gk a join gk b on b.series_id = a.series_id and b.ratio = a.ratio where a.ratio = 10 and a.rk = 1 and b.rk = 1 and a."scope" = 'escalation_only' and b."scope" = 'single_only'),
dy as (select gd.series_id, part, bl, coalesce(sum(fp) filter (where place = pa), 0) fa, coalesce(sum(missed) filter (where place = pa), 0) ma, coalesce(sum(fp) filter (where place = pb), 0) fb, coalesce(sum(missed) filter (where place = pb), 0) mb, max(n_events) ev from gd join ch on ch.series_id = gd.series_id where part <> 'SEL' and place in (pa, pb) group by 1, 2, 3),
r_ as (select *, {weight_sql("9", "r", "bl")} w from dy, range(1, 301) t(r)), e_ as (select series_id, part, r, (sum(w * fa) + 10 * sum(w * ma)) / nullif(10.0 * sum(w * ev), 0) - (sum(w * fb) + 10 * sum(w * mb)) / nullif(10.0 * sum(w * ev), 0) m from r_ group by 1, 2, 3)
select series_id, part, avg(m) difference, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high, avg((m < 0)::int) below_zero from e_ where m is not null group by 1, 2""")
def x6(spark, sf):
    """Whether the escalation chosen on SEL costs less than the single policy chosen there, by
    resampled days of TEST and of LOCK; an event counts on the day of its onset."""
    book = day_book(spark, sf)
    picks = lg.select_then_apply(cut(lg.costs(book, [10], K)), K)
    one = lambda scope, name: picks.where(F.col("scope") == scope).select("series_id", F.col("place").alias(name)).distinct()
    chosen = one("escalation_only", "place_a").join(one("single_only", "place_b"), "series_id")
    return st.cost_bootstrap(lg.paired_days(book.where("part <> 'SEL'"), chosen, K, "day"), ["series_id", "part"], ["day"], 10, 300, 9)


# ---- searches of shapes
@register("x12_dtw_pairs", "series_id at_a:i at_b:i dtw:f warped:i")
def x12(spark, sf):
    from wattloom.operators import events as ev

    shapes = ft.aligned_windows(ev.onsets(scored(spark, sf), "peak", K, S), "kw", "onset", 4, 12, K, S)
    return sh.nearest_dtw(shapes, "shape", K, "at", band=3)


@register("x13_discords", "series_id at:i distance:f looked:i")
def x13(spark, sf):
    return sh.discords(demand(spark, sf), "kw", 20, 2, K, S)


# ---- output contract and phrases
@register("d8_forbidden_phrases", "series_id n_forbidden:i n:i", DIAG + "select series_id, sum((case when uns and rmp then 'wide interval / shut down now' when uns then 'wide interval' else 'routine' end ilike '%shut down%')::int) n_forbidden, count(*) n from g_ group by 1")
def d8(spark, sf):
    text = F.when((F.col("unsure") == 1) & (F.abs("ramp4") >= F.col("rc")), "wide interval / shut down now").when(F.col("unsure") == 1, "wide interval").otherwise("routine")
    return dg.forbidden(diagnosed(spark, sf).withColumn("reason", text), "reason", ["shut down", "stop the line"], K)


@register("d9_contract", "series_id step:i early:i alert:i unsure:i explained:i gap:i level", DIAG + "select series_id, step, erl::int early, alr::int alert, uns::int unsure, xpl::int explained, gap::int gap, case when ood then 'HUMAN_REVIEW' when alr and not uns then 'CONFIRMED_WARNING' when alr then 'LOW_CONFIDENCE_WARNING' when gap then 'INFORMATION_GAP' when erl then 'EARLY_WATCH' else 'NORMAL' end level from g_")
def d9(spark, sf):
    d = diagnosed(spark, sf).withColumn("level", dg.advisory(ood()))
    return dg.contract(d, ["series_id", S, "early", "alert", "unsure", "explained", "gap", "level"])


# ---- stateful streams over the demand fixture, written as a table and read as a stream
def stream_of(spark, sf, *columns):
    path = scratch(spark, "rows")
    d = scored(spark, sf).withColumn("ts", F.col("ts15").cast("timestamp")).select("series_id", "ts", *columns)
    d.write.parquet(path)
    return spark.readStream.schema(d.schema).parquet(path)


#: Rows that the watermark has passed when all files are read.
PASSED = "(select max(ts15) - interval 30 minutes from scored)"


@register("w4_sequential_stream", "series_id state n:i", SCORED + f""", seen as (
  select series_id, ts15, ts15 + interval 1 hour target, alert, max(case when peak = 1 then ts15 end) over (partition by series_id order by step rows between 3 following and 3 following) c3,
    max(case when peak = 1 then ts15 end) over (partition by series_id order by step rows between 4 following and 4 following) c4 from scored),
hit as (select *, coalesce(c3, c4) came from seen where alert = 1),
states as (
  select series_id, 'watch' state from hit where ts15 <= {PASSED} union all select series_id, 'confirmed' from hit where came <= {PASSED}
  union all select series_id, 'rejected' from hit where came is null and target <= {PASSED})
select series_id, state, count(*) n from states group by 1, 2""")
def w4(spark, sf):
    rows = stream_of(spark, sf, F.col("alert").alias("early"), F.col("peak").alias("confirm"))
    return ss.run_now(ss.stateful(rows, ss.SequentialAlert(), "series_id string, target timestamp, state string")).groupBy("series_id", "state").agg(F.count("*").alias("n"))


@register("w5_delay_stream", "series_id n:i timer:i", SCORED + f"select series_id, count(*) n, sum(t) timer from (select series_id, ts15, case when sum(alert) over ({W} rows between 3 preceding and current row) >= 2 then 1 else 0 end t from scored) where ts15 <= {PASSED} group by 1")
def w5(spark, sf):
    rows = stream_of(spark, sf, F.col("alert").alias("flag"))
    out = ss.run_now(ss.stateful(rows, ss.DelayTimer(2, 4), "series_id string, ts timestamp, timer int"))
    return out.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("timer").alias("timer"))


@register("w7_stream_join", "series_id n:i early:f confirm:f", SCORED + "select a.series_id, count(*) n, sum(a.kw) early, sum(b.kw) confirm from scored a join scored b on b.series_id = a.series_id and b.ts15 = a.ts15 + interval 45 minutes group by 1")
def w7(spark, sf):
    one, two = (stream_of(spark, sf, "kw").withColumnRenamed("ts", "ts15") for _ in range(2))
    j = ss.run_now(ss.target_join(one, two))
    return j.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("early_kw").alias("early"), F.sum("confirm_kw").alias("confirm"))
