"""Metrics, policies, intervals and operator diagnosis on naive scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.operators import audit as au, clean, diagnosis as dg, events as ev, intervals as iv, ledger as lg, metrics as mt, policy as pl
from wattloom.operators.features import over
from wattloom.queries.base import K, S, SCORED, register, scored
from wattloom.queries.meter import W, runs_sql
from wattloom.session import cut

BY = ["series_id", "fold"]
#: The published threshold grid and cost ratios.
QS = [0.50, 0.54, 0.58, 0.62, 0.66, 0.70, 0.74, 0.78, 0.82, 0.86, 0.90, 0.94, 0.98]
RATIOS = [1, 2, 5, 10, 20, 50, 100]
NQ = len(QS) + 1


# ---- metrics
@register("v1_forecast_metrics", "series_id fold:i n:i mae:f rmse:f nmae:f gain:f mae_peak:f e90:f e99:f e_max:f", SCORED + """, e_ as (select *, abs(y - score) e, abs(y - kw) en from scored)
select series_id, fold, count(e) n, avg(e) mae, sqrt(avg(e * e)) rmse, avg(e) / nullif(avg(y), 0) nmae, 1 - avg(e) / nullif(avg(en), 0) gain, avg(e) filter (where peak = 1) mae_peak, quantile_cont(e, 0.9) e90, quantile_cont(e, 0.99) e99, max(e) e_max from e_ group by 1, 2""")
def v1(spark, sf):
    return mt.forecast_metrics(scored(spark, sf), "y", "score", "kw", "peak", BY)


@register("v2_scale_free", "series_id mape:f smape:f mase:f r2:f", SCORED + """select series_id, 100 * avg(abs(y - score) / abs(y)) filter (where y <> 0) mape, 200 * avg(abs(y - score) / (abs(y) + abs(score))) filter (where abs(y) + abs(score) > 0) smape,
 avg(abs(y - score)) / nullif(avg(abs(y - seasonal)), 0) mase, 1 - sum((y - score) * (y - score)) / nullif(var_pop(y) * count(y), 0) r2 from scored group by 1""")
def v2(spark, sf):
    return mt.scale_free(scored(spark, sf), "y", "score", "seasonal", K)


CONF = """, c_ as (select series_id, fold, count(*) filter (where "label" = 1 and alert = 1) tp, count(*) filter (where "label" = 0 and alert = 1) fp, count(*) filter (where "label" = 1 and alert = 0) fn, count(*) filter (where "label" = 0 and alert = 0) tn from scored group by 1, 2)"""


@register("v3_confusion", "series_id fold:i tp:i fp:i fn:i tn:i precision:f recall:f specificity:f balanced:f f1:f mcc:f accuracy:f", SCORED + CONF + """, r_ as (select *, coalesce(tp / nullif(tp + fp, 0), 0) "precision", coalesce(tp / nullif(tp + fn, 0), 0) recall, coalesce(tn / nullif(tn + fp, 0), 0) specificity from c_)
select *, (recall + specificity) / 2 balanced, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) mcc, (tp + tn) / (tp + fp + fn + tn) accuracy from r_""")
def v3(spark, sf):
    return mt.class_metrics(scored(spark, sf), "label", "alert", BY)


@register("v4_roc_auc", "series_id fold:i auc:f", SCORED + """, n_ as (select series_id, fold, sum("label") np, count(*) - sum("label") nq from scored group by 1, 2),
r_ as (select *, rank() over (partition by series_id, fold order by score) + (count(*) over (partition by series_id, fold, score) - 1) / 2.0 r from scored)
select r_.series_id, r_.fold, (sum(r) filter (where "label" = 1) - max(np) * (max(np) + 1) / 2.0) / nullif(max(np) * max(nq), 0) auc from r_ join n_ on n_.series_id = r_.series_id and n_.fold = r_.fold group by 1, 2""")
def v4(spark, sf):
    return mt.roc_auc(scored(spark, sf), "label", "score", BY)


CUM = """, s_ as (select series_id, score, sum("label") pos, count(*) nr from scored group by 1, 2),
u_ as (select *, sum(pos) over (partition by series_id order by score desc) tp, sum(nr) over (partition by series_id order by score desc) n, sum(pos) over (partition by series_id) p from s_)
"""


@register("v5_average_precision", "series_id ap:f", SCORED + CUM + "select series_id, sum(pos / nullif(p, 0) * (tp / n)) ap from u_ group by 1")
def v5(spark, sf):
    return mt.average_precision(scored(spark, sf), "label", "score", K)


@register("v6_probability_scores", "series_id fold:i brier:f log_loss:f", SCORED + """select series_id, fold, avg((p - "label") * (p - "label")) brier, avg(-case when "label" = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end) log_loss from scored group by 1, 2""")
def v6(spark, sf):
    return mt.probability_scores(scored(spark, sf), "label", "p", BY)


@register("v7_reliability_curve", "series_id bin:i n:i mean_p:f rate:f", SCORED + """select series_id, least(floor(p * 10), 9) bin, count(*) n, avg(p) mean_p, avg("label") rate from scored group by 1, 2""")
def v7(spark, sf):
    return mt.reliability_curve(scored(spark, sf), "label", "p", K)


@register("v7_ece", "series_id ece:f", SCORED + """, b_ as (select series_id, least(floor(p * 10), 9) bin, count(*) n, avg(p) m, avg("label") r from scored group by 1, 2) select series_id, sum(n * abs(m - r)) / sum(n) ece from b_ group by 1""")
def v7_ece(spark, sf):
    return mt.ece(scored(spark, sf), "label", "p", K)


for _name, _sign in (("v8_best_f1_smallest", ""), ("v8_best_f1_largest", " desc")):

    @register(_name, "series_id cut:f f1:f tp:i fp:i", SCORED + CUM + f", f_ as (select *, round(2.0 * tp / (n + p), 12) f1 from u_ where p > 0), k_ as (select *, row_number() over (partition by series_id order by f1 desc, score{_sign}) rk from f_) select series_id, score cut, f1, tp, n - tp fp from k_ where rk = 1")
    def v8(spark, sf, largest=bool(_sign)):
        return mt.best_f1_cut(scored(spark, sf), "label", "score", K, largest)


@register("v9_window_labels", "series_id exact:i within30:i within60:i", SCORED + f""", l_ as (select series_id, peak, lead(peak, 4) over ({W}) a, greatest(lead(peak, 1) over ({W}), lead(peak, 2) over ({W})) b, greatest(lead(peak, 1) over ({W}), lead(peak, 2) over ({W}), lead(peak, 3) over ({W}), lead(peak, 4) over ({W})) c from scored) select series_id, sum(a) exact, sum(b) within30, sum(c) within60 from l_ group by 1""")
def v9(spark, sf):
    d, w = scored(spark, sf), over(K, S)
    ahead = lambda k: F.lead("peak", k).over(w)
    d = d.withColumns({"a": ahead(4), "b": F.greatest(ahead(1), ahead(2)), "c": F.greatest(*[ahead(k) for k in (1, 2, 3, 4)])})
    return d.groupBy("series_id").agg(F.sum("a").alias("exact"), F.sum("b").alias("within30"), F.sum("c").alias("within60"))


H_SQL = " union all ".join(f"select {h} horizon, ts15, score, lead(peak, {h}) over ({W}) lb, abs(lead(kw, {h}) over ({W}) - score) err from scored" for h in (1, 2, 3, 4))


@register("v10_horizon_power", "window horizon:i n:i n_peak:i prevalence:f auc:f ap:f ap_lift:f mae:f", SCORED + f", h0_ as ({H_SQL}), h_ as (select 'all' \"window\", * from h0_ where lb is not null union all select 'clean', * from h0_ where lb is not null and ts15 >= timestamp '2024-01-16')" + """,
s_ as (select "window", horizon, score, sum(lb) pos, count(*) nr from h_ group by 1, 2, 3), u_ as (select *, sum(pos) over (partition by "window", horizon order by score desc) tp, sum(nr) over (partition by "window", horizon order by score desc) n, sum(pos) over (partition by "window", horizon) p, sum(nr) over (partition by "window", horizon) t from s_),
a_ as (select "window", horizon, sum(pos / p * (tp / n)) ap, sum((nr - pos) * (tp - pos / 2.0)) / (max(p) * (max(t) - max(p))) auc from u_ group by 1, 2),
c_ as (select "window", horizon, count(*) n, sum(lb) n_peak, avg(lb) prevalence, avg(err) mae from h_ group by 1, 2)
select c_.*, auc, ap, ap / prevalence ap_lift from c_ join a_ on a_."window" = c_."window" and a_.horizon = c_.horizon""")
def v10(spark, sf):
    d, w, hs = scored(spark, sf), over(K, S), (1, 2, 3, 4)
    d = d.withColumns({f"lb{h}": F.lead("peak", h).over(w) for h in hs} | {f"ahead{h}": F.lead("kw", h).over(w) for h in hs})
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"lb{h}").alias("lb"), F.abs(F.col(f"ahead{h}") - F.col("score")).alias("err")) for h in hs])
    long = clean.window_tags(d.select("ts15", "score", F.inline(each)), F.col("ts15") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    return mt.screening_power(long, "lb", "score", "err", ["window", "horizon"])


@register("v12_error_by_hour", "series_id hour:i mae:f n:i", SCORED + """select series_id, "hour", avg(abs(y - score)) mae, count(*) n from scored group by 1, 2""")
def v12(spark, sf):
    return scored(spark, sf).groupBy("series_id", "hour").agg(F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"), F.count("*").alias("n"))


@register("v13_state_r2", "series_id r2:f spread:f", SCORED + """, g_ as (select series_id, "hour", count(y) n, sum(y) s, sum(y * y) q from scored group by 1, 2) select series_id, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / nullif(sum(q) - sum(s) * sum(s) / sum(n), 0) r2, max(s / n) - min(s / n) spread from g_ group by 1""")
def v13(spark, sf):
    return mt.group_r2(scored(spark, sf), "y", "hour", K)


def conditions():
    return {"night": F.col("hour") < 6, "idle": F.col("is_operating") == 0, "ramp": F.abs("ramp4") > 100}


@register("v17_by_condition", "series_id condition tp:i fp:i fn:i tn:i share_fn:f share_fp:f", SCORED + """, l_ as (select *, unnest(list_filter([case when "hour" < 6 then 'night' end, case when is_operating = 0 then 'idle' end, case when abs(ramp4) > 100 then 'ramp' end, 'ALL'], lambda x: x is not null)) condition from scored),
c_ as (select series_id, condition, count(*) filter (where "label" = 1 and alert = 1) tp, count(*) filter (where "label" = 0 and alert = 1) fp, count(*) filter (where "label" = 1 and alert = 0) fn, count(*) filter (where "label" = 0 and alert = 0) tn from l_ group by 1, 2)
select *, fn / nullif(max(fn) filter (where condition = 'ALL') over (partition by series_id), 0) share_fn, fp / nullif(max(fp) filter (where condition = 'ALL') over (partition by series_id), 0) share_fp from c_""")
def v17(spark, sf):
    return mt.by_condition(scored(spark, sf), "label", "alert", conditions(), K)


@register("v18_pr_curve", "series_id score:f recall:f precision:f", SCORED + CUM + 'select series_id, score, tp / nullif(p, 0) recall, tp / n "precision" from u_')
def v18(spark, sf):
    c = mt.cumulative(scored(spark, sf), "label", "score", K)
    return c.select("series_id", "score", F.try_divide("tp", "n_pos").alias("recall"), (F.col("tp") / F.col("n_cut")).alias("precision"))


@register("v19_error_cells", "series_id cell n:i mean_kw:f", SCORED + """, r_ as (select *, percent_rank() over (partition by series_id order by score) r, avg("label") over (partition by series_id) pv from scored)
select series_id, case when "label" = 1 and r >= 1 - pv then 'TP' when "label" = 1 then 'FN' when r >= 1 - pv then 'FP' else 'TN' end cell, count(*) n, avg(kw) mean_kw from r_ group by 1, 2""")
def v19(spark, sf):
    return mt.error_cells(scored(spark, sf), "label", "score", K, mean_kw=F.avg("kw"))


@register("v21_rank_normalised", "series_id step:i rank_share:f", SCORED + "select series_id, step, (rank() over (partition by series_id order by score) + (count(*) over (partition by series_id, score) - 1) / 2.0) / count(*) over (partition by series_id) rank_share from scored")
def v21(spark, sf):
    return mt.rank_normalised(scored(spark, sf), "score", K)


# ---- policies: thresholds from CAL (fold 1), applied to all folds
CAL = f""", cal as (select * from scored where fold = 1),
thr_ as (select series_id, unnest(range(1, {NQ})) lv, unnest({QS}) q, unnest(quantile_cont(score, {QS})) th from cal group by 1),
thk_ as (select series_id, unnest(range(1, {NQ})) lv, unnest(quantile_cont(kw, {QS})) th from cal group by 1),
fut_ as (select *, coalesce(max(peak) over (partition by series_id order by step rows between 1 following and 4 following), 0) future, coalesce(lead(peak) over (partition by series_id order by step), 0) future1, case when abs(ramp4) > 100 then 1 else 0 end unsure from scored)
"""


def thresholds(d, pred):
    return pl.cal_thresholds(d.where("fold = 1"), pred, QS, K)


def levelled(spark, sf):
    """scored with future, unsure, and the early and confirm levels."""
    d = scored(spark, sf)
    early, confirm = thresholds(d, "score"), thresholds(d, "kw")
    d = ev.future_any(ev.future_any(d, "peak", 4, K, S), "peak", 1, K, S, "future1").withColumn("unsure", (F.abs("ramp4") > 100).cast("int"))
    return pl.with_level(pl.with_level(d, "score", early, K, "early_level"), "kw", confirm, K, "confirm_level")


LEVELS = CAL + """, lev as (select f.*, (select count(*) from thr_ t where t.series_id = f.series_id and t.th <= f.score) early_level, (select count(*) from thk_ t where t.series_id = f.series_id and t.th <= f.kw) confirm_level from fut_ f)
"""


@register("p1_cal_thresholds", "series_id level:i q:f threshold:f", SCORED + CAL + "select series_id, lv level, q, th threshold from thr_")
def p1(spark, sf):
    return thresholds(scored(spark, sf), "score")


@register("p2_single_alert", "series_id n:i alerts:i", SCORED + CAL + "select s.series_id, count(*) n, count(*) filter (where score >= th) alerts from scored s join thr_ t on t.series_id = s.series_id and t.q = 0.9 group by 1")
def p2(spark, sf):
    d = scored(spark, sf)
    t = thresholds(d, "score").where("q = 0.9").select("series_id", "threshold")
    return d.join(t, "series_id").groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("alerts"))


@register("p5_single_sweep", "series_id early:i tp:i fp:i", SCORED + LEVELS + f"select series_id, i early, sum(case when early_level >= i then future else 0 end) tp, sum(case when early_level >= i then 1 - future else 0 end) fp from lev, range(1, {NQ}) r(i) group by 1, 2")
def p5(spark, sf):
    return pl.single_sweep(levelled(spark, sf), "early_level", "future", len(QS), K)


PAIRS = LEVELS + f""", pr as (select series_id, i "early", j "confirm", g gate,
 case when g = 'confirm_only_if_unsure' then (confirm_level >= j or unsure = 0) else confirm_level >= j end al,
 g <> 'none' and confirm_level < j and unsure = 1 ad, future, confirm_level < j rj
 from lev, range(1, {NQ}) a(i), range(1, {NQ}) b(j), (values ('none'), ('advisory_if_unsure'), ('confirm_only_if_unsure')) c(g) where early_level >= i),
curve as (select series_id, "early", "confirm", gate, count(*) filter (where rj) / count(*) rejection, count(*) filter (where al and future = 1) tp, count(*) filter (where al and future = 0) fp, count(*) filter (where ad) advisories from pr group by 1, 2, 3, 4)
"""


@register("p3_pair_sweep", "series_id early:i confirm:i gate rejection:f tp:i fp:i advisories:i", SCORED + PAIRS + "select * from curve")
def p3(spark, sf):
    return pl.pair_sweep(levelled(spark, sf), "early_level", "confirm_level", "unsure", "future", len(QS), K)


@register("p4_composite", "series_id any:i two:i long_only:i escalate:i", SCORED + """, c_ as (select series_id, (kw >= thr)::int a, (score >= thr * 0.8)::int b, alert c from scored) select series_id, sum((a + b + c >= 1)::int) "any", sum((a + b + c >= 2)::int) two, sum(c) long_only, sum((a = 1 and c = 1)::int) escalate from c_ group by 1""")
def p4(spark, sf):
    d = scored(spark, sf)
    rules = pl.composite({"a": F.col("kw") >= F.col("thr"), "b": F.col("score") >= F.col("thr") * 0.8, "c": F.col("alert") == 1})
    return d.groupBy("series_id").agg(*[F.sum(c).alias(n) for n, c in rules.items()])


COSTS = PAIRS + runs_sql("lev", "peak", 2) + f""", lk as (select r.series_id, r.event_id, r."first" - l.step a, early_level e, confirm_level c, unsure u from runs r left join lev l on l.series_id = r.series_id and l.step between r."first" - 4 and r."first" - 1),
pol as (select 'single_early' kind, i "early", null::bigint "confirm", 'none' gate from range(1, {NQ}) a(i) union all select 'single_confirm', null, j, 'none' from range(1, {NQ}) b(j) union all select 'escalate', i, j, g from range(1, {NQ}) a(i), range(1, {NQ}) b(j), (values ('none'), ('advisory_if_unsure'), ('confirm_only_if_unsure')) c(g)),
ec as (select series_id, event_id, kind, "early", "confirm", gate, max(case when (kind = 'single_early' and e >= "early") or (kind = 'single_confirm' and c >= "confirm" and a <= 1) or (kind = 'escalate' and e >= "early" and (c >= "confirm" or (gate = 'confirm_only_if_unsure' and u = 0))) then a end) a from lk, pol group by all),
es as (select series_id, kind, "early", "confirm", gate, count(*) n_events, count(a) detected, count(*) - count(a) missed, avg(case when a is not null then least(a, 4) * 15 end) "lead", avg(case when a is not null then (least(a, 4) * 15 >= 30)::int end) lead_share from ec group by 1, 2, 3, 4, 5),
st_ as (select 'escalate' kind, * from curve union all select 'single_early', series_id, i, null, 'none', 0, sum(case when early_level >= i then future else 0 end), sum(case when early_level >= i then 1 - future else 0 end), 0 from lev, range(1, {NQ}) r(i) group by series_id, i
 union all select 'single_confirm', series_id, null, i, 'none', 0, sum(case when confirm_level >= i then future1 else 0 end), sum(case when confirm_level >= i then 1 - future1 else 0 end), 0 from lev, range(1, {NQ}) r(i) group by series_id, i),
dd_ as (select series_id, count(*) / 96.0 nd from lev group by 1),
pc as (select s.*, n_events, detected, missed, "lead", lead_share, fp / nd false_a_day, advisories / nd advisories_a_day,
 case s.kind when 'single_confirm' then 0 when 'single_early' then 1 else 2 end * 100000 + coalesce(s."early", 0) * 1000 + coalesce(s."confirm", 0) * 10 + case s.gate when 'none' then 0 when 'advisory_if_unsure' then 1 else 2 end place
 from st_ s join es e on e.series_id = s.series_id and e.kind = s.kind and e."early" is not distinct from s."early" and e."confirm" is not distinct from s."confirm" and e.gate = s.gate join dd_ on dd_.series_id = s.series_id),
cost as (select pc.*, ratio::double ratio, (fp + ratio * missed) / nullif(ratio * n_events, 0) cost from pc, (select unnest({RATIOS}) ratio))
"""


def curve(spark, sf):
    """Every policy with its steps, events, leads and loads a day."""
    d = levelled(spark, sf)
    pairs = pl.pair_sweep(d, "early_level", "confirm_level", "unsure", "future", len(QS), K)
    single = lambda level, future, kind: pl.single_sweep(d, level, future, len(QS), K).select(
        "series_id", (F.col("early") if kind == "single_early" else F.lit(None).cast("int")).alias("early"), (F.col("early") if kind == "single_confirm" else F.lit(None).cast("int")).alias("confirm"),
        F.lit("none").alias("gate"), F.lit(0.0).alias("rejection"), "tp", "fp", F.lit(0).cast("long").alias("advisories"), F.lit(kind).alias("kind"),
    )
    singles = single("early_level", "future", "single_early").unionByName(single("confirm_level", "future1", "single_confirm"))
    events = pl.event_sweep(d, "peak", "early_level", "confirm_level", "unsure", 4, len(QS), K, S)
    days = d.groupBy("series_id").agg((F.count("*") / 96).alias("days"))
    c = pl.policy_curve(pairs, singles, events, days, K)
    order = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1
    place = order("kind", ["single_confirm", "single_early", "escalate"]) * 100000 + F.coalesce("early", F.lit(0)) * 1000 + F.coalesce("confirm", F.lit(0)) * 10 + order("gate", list(pl.GATES))
    return c.withColumn("place", place)


def costs(spark, sf):
    return pl.cost_curve(cut(curve(spark, sf)), RATIOS)


@register("p5_event_sweep", "series_id kind early:i confirm:i gate n_events:i detected:i missed:i lead:f lead_share:f tp:i fp:i false_a_day:f advisories_a_day:f", SCORED + COSTS + "select * from pc")
def p5_events(spark, sf):
    return curve(spark, sf)


@register("p6_cost_curve", "series_id kind early:i confirm:i gate ratio:f cost:f", SCORED + COSTS + "select * from cost")
def p6(spark, sf):
    return costs(spark, sf)


@register("p7_best_points", "series_id ratio:f scope kind early:i confirm:i gate cost:f lead:f missed:i", SCORED + COSTS + """, sc as (select *, unnest(list_filter(['all', case when kind = 'escalate' then 'escalation_only' else 'single_only' end, case when "lead" >= 30 then 'lead_constrained' end], lambda x: x is not null)) "scope" from cost),
k_ as (select *, row_number() over (partition by series_id, ratio, "scope" order by round(cost, 12), place) rk from sc) select * from k_ where rk = 1""")
def p7(spark, sf):
    scopes = {"all": F.lit(True), "single_only": F.col("kind") != "escalate", "escalation_only": F.col("kind") == "escalate", "lead_constrained": F.col("lead") >= 30}
    return pl.best_points(costs(spark, sf), scopes, ["series_id", "ratio"], ["place"])


@register("p8_verdict", "series_id ratio:f single:f escalation:f escalation_wins:i", SCORED + COSTS + """, v_ as (select series_id, ratio, min(cost) filter (where kind <> 'escalate') single, min(cost) filter (where kind = 'escalate') escalation from cost group by 1, 2) select *, case when round(escalation, 12) < round(single, 12) then 1 else 0 end escalation_wins from v_""")
def p8(spark, sf):
    best = lambda c: F.min(F.when(c, F.col("cost")))
    v = costs(spark, sf).groupBy("series_id", "ratio").agg(best(F.col("kind") != "escalate").alias("single"), best(F.col("kind") == "escalate").alias("escalation"))
    return v.withColumn("escalation_wins", F.coalesce((F.round("escalation", 12) < F.round("single", 12)).cast("int"), F.lit(0)))


@register("p9_pareto", "series_id cost:f lead:f", SCORED + COSTS + """, d_ as (select distinct series_id, round(cost, 9) cost, round("lead", 9) "lead" from cost where ratio = 10 and "lead" is not null and detected > 0), b_ as (select *, max("lead") over (partition by series_id order by cost, "lead" desc rows between unbounded preceding and 1 preceding) best from d_) select * from b_ where best is null or "lead" > best""")
def p9(spark, sf):
    d = costs(spark, sf).where("ratio = 10 and lead is not null and detected > 0")
    return pl.pareto(d.select("series_id", F.round("cost", 9).alias("cost"), F.round("lead", 9).alias("lead")).distinct(), K, "cost", "lead")


SEQ = CAL + """, a_ as (select series_id, step + 4 t, score s60 from scored), b_ as (select series_id, step + 1 t, kw k15 from scored),
tt as (select a_.series_id, a_.t step, s60, k15 from a_ join b_ on b_.series_id = a_.series_id and b_.t = a_.t),
st as (select tt.*, case when s60 >= e.th and k15 >= c.th then 'confirmed' when s60 >= e.th then 'rejected' when k15 >= c.th then 'late' else 'quiet' end state from tt join thr_ e on e.series_id = tt.series_id and e.lv = 4 join thk_ c on c.series_id = tt.series_id and c.lv = 5)
"""


def sequential(spark, sf):
    d = scored(spark, sf)
    t = pl.target_time(d, {"h60": 4, "h15": 1}, ["score", "kw"], K, S)
    e = thresholds(d, "score").where("level = 4").select("series_id", F.col("threshold").alias("e"))
    c = thresholds(d, "kw").where("level = 5").select("series_id", F.col("threshold").alias("c"))
    return t.join(e, "series_id").join(c, "series_id").withColumn("state", pl.sequential_state(F.col("score_h60") >= F.col("e"), F.col("kw_h15") >= F.col("c")))


@register("j4_target_time", "series_id step:i score_h60:f kw_h15:f", SCORED + SEQ + "select series_id, step, s60 score_h60, k15 kw_h15 from tt")
def j4(spark, sf):
    return pl.target_time(scored(spark, sf), {"h60": 4, "h15": 1}, ["score", "kw"], K, S)


@register("p10_sequential_states", "series_id state n:i", SCORED + SEQ + "select series_id, state, count(*) n from st group by 1, 2")
def p10(spark, sf):
    return sequential(spark, sf).groupBy("series_id", "state").agg(F.count("*").alias("n"))


PLACE = """case kind when 'single_confirm' then 0 when 'single_early' then 1 else 2 end * 100000 + coalesce("early", 0) * 1000 + coalesce("confirm", 0) * 10 + case gate when 'none' then 0 when 'advisory_if_unsure' then 1 else 2 end"""
LEDGER = SCORED + COSTS + f""", gp as (select series_id, ts15::date bl, i "early", j "confirm", g gate, future, case when g = 'confirm_only_if_unsure' then (confirm_level >= j or unsure = 0) else confirm_level >= j end al
 from lev, range(1, {NQ}) a(i), range(1, {NQ}) b(j), (values ('none'), ('advisory_if_unsure'), ('confirm_only_if_unsure')) c(g) where early_level >= i),
ga as (
 select series_id, bl, 'escalate' kind, "early", "confirm", gate, count(*) filter (where al and future = 0) fp, count(*) filter (where al) alerts, 0 n_events, 0 missed, 0.0 lead_sum from gp group by 1, 2, 3, 4, 5, 6
 union all select series_id, ts15::date, 'single_early', i, null, 'none', sum(case when early_level >= i then 1 - future else 0 end), sum((early_level >= i)::int), 0, 0, 0.0 from lev, range(1, {NQ}) r(i) group by series_id, ts15::date, i
 union all select series_id, ts15::date, 'single_confirm', null, i, 'none', sum(case when confirm_level >= i then 1 - future1 else 0 end), sum((confirm_level >= i)::int), 0, 0, 0.0 from lev, range(1, {NQ}) r(i) group by series_id, ts15::date, i
 union all select ec.series_id, f.ts15::date, kind, "early", "confirm", gate, 0, 0, count(*), count(*) - count(a), coalesce(sum(case when a is not null then least(a, 4) * 15 end), 0) from ec join runs r on r.series_id = ec.series_id and r.event_id = ec.event_id join lev f on f.series_id = r.series_id and f.step = r."first" group by 1, 2, 3, 4, 5, 6),
gl as (select series_id, bl, kind, "early", "confirm", gate, {PLACE} place, sum(fp) fp, sum(alerts) alerts, sum(n_events) n_events, sum(missed) missed, sum(lead_sum) lead_sum from ga group by all),
gd as (select gl.*, case when date_diff('day', bl, mx) < 7 then 'LOCK' when date_diff('day', bl, mx) < 14 then 'TEST' else 'SEL' end part from gl join (select series_id, max(ts15)::date mx from lev group by 1) m on m.series_id = gl.series_id),
gt as (select series_id, part, kind, "early", "confirm", gate, place, sum(fp) fp, sum(alerts) alerts, sum(n_events) n_events, sum(missed) missed, sum(lead_sum) / nullif(sum(n_events) - sum(missed), 0) "lead" from gd group by 1, 2, 3, 4, 5, 6, 7),
gc as (select gt.*, ratio::double ratio, (fp + ratio * missed) / nullif(ratio * n_events, 0) cost from gt, (select unnest({RATIOS}) ratio)),
gs as (select *, unnest(list_filter(['all', case when kind = 'escalate' then 'escalation_only' else 'single_only' end, case when "lead" >= 30 then 'lead_constrained' end], lambda x: x is not null)) "scope" from gc where part = 'SEL' and cost is not null),
gk as (select *, row_number() over (partition by series_id, ratio, "scope" order by round(cost, 12), place) rk from gs),
gh as (select *, row_number() over (partition by series_id, ratio order by round(cost, 12), place) rk from gc where part = 'TEST' and cost is not null)
"""


def day_book(spark, sf):
    """The ledger of all policies of p5, a row per series, day and policy, with its part."""
    d = levelled(spark, sf).withColumn("day", F.to_date("ts15"))
    book = lg.ledger(d, "peak", "early_level", "confirm_level", "unsure", "future", "future1", 4, len(QS), K, S, "day")
    return cut(lg.parts_of(book, d.groupBy("series_id").agg(F.max("day").alias("_last")), K, "day", 7, 7))


@register("p11_select_then_apply", "series_id ratio:f scope part kind early:i confirm:i gate cost:f cost_on_sel:f fp:i alerts:i n_events:i missed:i lead:f", LEDGER + """
select c.series_id, c.ratio, k."scope", c.part, c.kind, c."early", c."confirm", c.gate, c.cost, k.cost cost_on_sel, c.fp, c.alerts, c.n_events, c.missed, c."lead" from gc c join gk k on k.series_id = c.series_id and k.ratio = c.ratio and k.place = c.place and k.rk = 1 where c.part <> 'SEL'
union all select series_id, ratio, 'post_hoc', part, kind, "early", "confirm", gate, cost, null, fp, alerts, n_events, missed, "lead" from gh where rk = 1""")
def p11(spark, sf):
    return lg.select_then_apply(cut(lg.costs(day_book(spark, sf), RATIOS, K)), K)


@register("p12_capacity", "series_id kind gate n:i", SCORED + COSTS + "select series_id, kind, gate, count(*) n from pc where advisories_a_day <= 12 group by 1, 2, 3")
def p12(spark, sf):
    return curve(spark, sf).where("advisories_a_day <= 12").groupBy("series_id", "kind", "gate").agg(F.count("*").alias("n"))


@register("p13_k_of_m", "series_id step:i timer:i", SCORED + f"select series_id, step, case when sum(alert) over ({W} rows between 3 preceding and current row) >= 2 then 1 else 0 end timer from scored")
def p13(spark, sf):
    return scored(spark, sf).withColumn("timer", pl.k_of_m("alert", 2, 4, K, S))


@register("p14_smooth", "series_id step:i smooth:f", SCORED + f"select series_id, step, avg(p) over ({W} rows between 2 preceding and current row) smooth from scored")
def p14(spark, sf):
    return scored(spark, sf).withColumn("smooth", pl.smooth("p", 3, K, S))


RATE_GRID = [round(0.02 + 0.005 * i, 3) for i in range(46)]
#: TEST folds of three, each with the CAL tail of its past.
ROLES = """, o_ as (select *, row_number() over (partition by series_id order by step) - 1 i0, count(*) over (partition by series_id) n0 from scored),
f_ as (select o_.* exclude (fold), k fold, n0 - (n0 // 4) * (3 - k) st, n0 // 4 sz from o_, range(3) t(k)),
ro as (select *, case when i0 >= st + sz then null when i0 >= st then 'TEST' when i0 >= floor(st * 0.8) then 'CAL' else 'TRAIN' end role from f_)
"""
BEST = """, cc{x} as (select {by}, p, sum("label") pos, count(*) nr from ro where role = 'CAL' group by all), cu{x} as (select *, sum(pos) over (partition by {by} order by p desc) tp, sum(nr) over (partition by {by} order by p desc) n, sum(pos) over (partition by {by}) pp from cc{x}),
bc{x} as (select {by}, arg_max(p, (round(2.0 * tp / (n + pp), 12), p)) ct from cu{x} where pp > 0 group by all),
rq{x} as (select {by}, unnest({qs}) q, unnest(quantile_cont(p, {qs})) th from ro where role = 'CAL' group by {by}),
rf{x} as (select {q}.* , round(coalesce(2.0 * sum(case when p >= th then "label" else 0 end) / nullif(sum(case when p >= th then 1 else 0 end) + sum("label"), 0), 0), 12) f1 from rq{x} {q} join ro r on {on} where role = 'CAL' group by all),
br{x} as (select {by}, arg_max(q, (f1, -q)) q from rf{x} group by {by})
"""


def folds3(spark, sf):
    return cut(iv.rolling_origin(scored(spark, sf).drop("fold"), 3, K, S))


RQS = sorted(round(1 - r, 9) for r in RATE_GRID)


@register("p16_op_rules", "series_id rule tp:i fp:i fn:i", SCORED + ROLES + BEST.format(x="a", by="series_id, fold", qs=RQS, q="rq", on="r.series_id = rq.series_id and r.fold = rq.fold") + BEST.format(x="b", by="series_id", qs=RQS, q="rq", on="r.series_id = rq.series_id") + f""", tq as (select series_id, fold, unnest({RQS}) q, unnest(quantile_cont(p, {RQS})) th from ro where role = 'TEST' group by series_id, fold),
al as (select t.series_id, "label", coalesce((p >= a.ct)::int, 0) r1, coalesce((p >= ta.th)::int, 0) r2, coalesce((p >= b.ct)::int, 0) r3, coalesce((p >= tb.th)::int, 0) r4 from ro t left join bca a on a.series_id = t.series_id and a.fold = t.fold left join bcb b on b.series_id = t.series_id
 left join bra qa on qa.series_id = t.series_id and qa.fold = t.fold left join tq ta on ta.series_id = t.series_id and ta.fold = t.fold and ta.q = qa.q left join brb qb on qb.series_id = t.series_id left join tq tb on tb.series_id = t.series_id and tb.fold = t.fold and tb.q = qb.q where role = 'TEST'),
lo as (select series_id, "label", rule, a from al unpivot (a for rule in (r1, r2, r3, r4)))
select series_id, rule, count(*) filter (where a = 1 and "label" = 1) tp, count(*) filter (where a = 1 and "label" = 0) fp, count(*) filter (where a = 0 and "label" = 1) fn from lo group by 1, 2""".replace("{q}", "rq"))
def p16(spark, sf):
    d = pl.op_rules(folds3(spark, sf), "p", "label", RATE_GRID, K, "fold")
    long = d.select("series_id", "label", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("a")) for r in ("r1", "r2", "r3", "r4")])))
    return mt.class_metrics(long, "label", "a", ["series_id", "rule"])


TIMERS = [(1, 1), (2, 2), (2, 3), (3, 3), (2, 4), (3, 4)]
TIMERS_WIDE = [*TIMERS, (4, 4), (3, 5), (4, 5)]


def settings_sql(src: str, p: str, smooths, timers, by: str) -> str:
    """Every row once per (smooth, k, m) with the k-th largest of the last m smoothed values."""
    w = f"partition by {by} order by step"
    one = lambda s, k, m: f"select *, {s} sm, {k} k, {m} m, (list_reverse_sort(list(ps{s}) over ({w} rows between {m - 1} preceding and current row)))[{k}] z from s_"
    return f", s_ as (select *, {', '.join(f'avg({p}) over ({w} rows between {s - 1} preceding and current row) ps{s}' for s in smooths)} from {src}), z_ as (" + " union all ".join(one(s, k, m) for s in smooths for k, m in timers) + ")"


@register("p15_joint_choice", "series_id smooth:i k:i m:i f1:f", SCORED + settings_sql("(select * from scored where fold = 1)", "p", [1, 2, 3, 4], TIMERS_WIDE, "series_id") + """, c_ as (select series_id, sm, k, m, round(z, 9) z, sum("label") pos, count(*) nr from z_ where z is not null group by all), u_ as (select *, sum(pos) over w tp, sum(nr) over w n, sum(pos) over (partition by series_id, sm, k, m) pp from c_ window w as (partition by series_id, sm, k, m order by z desc)),
f_ as (select series_id, sm "smooth", k, m, max(round(2.0 * tp / (n + pp), 12)) f1 from u_ where pp > 0 group by all) select * from f_ qualify row_number() over (partition by series_id order by f1 desc, "smooth", m, k) = 1""")
def p15(spark, sf):
    d = scored(spark, sf).where("fold = 1").select("series_id", S, "p", "label")
    z = pl.timer_settings(d, "p", [1, 2, 3, 4], TIMERS_WIDE, K, S).withColumn("z", F.round("z", 9))
    best = mt.best_f1_cut(z, "label", "z", ["series_id", "smooth", "k", "m"], True)
    return au.arg_min(best, K, -F.col("f1"), "smooth", "m", "k")


@register("p22_rate_transfer", "series_id fold:i k:i m:i residual_lead:i rate:f cal_f1:f alerts:i hits:i", SCORED + ROLES + settings_sql("(select * from ro where role <> 'TRAIN')", "p", [1], TIMERS, "series_id, fold, role") + f""", zz as (select series_id, fold, role, step, k, m, "label", round(z, 9) z from z_ where z is not null), rq as (select series_id, fold, k, m, unnest({RQS}) q, unnest(quantile_cont(z, {RQS})) th from zz where role = 'CAL' group by series_id, fold, k, m),
rf as (select rq.*, round(coalesce(2.0 * sum(case when z >= th then "label" else 0 end) / nullif(sum(case when z >= th then 1 else 0 end) + sum("label"), 0), 0), 12) f1 from rq join zz on zz.series_id = rq.series_id and zz.fold = rq.fold and zz.k = rq.k and zz.m = rq.m and role = 'CAL' group by all),
bs as (select series_id, fold, k, m, round(1 - arg_max(q, (f1, -q)), 9) rate, max(f1) cal_f1 from rf group by all), pk as (select * from bs qualify row_number() over (partition by series_id, fold order by cal_f1 desc, m, k) = 1),
tq as (select series_id, fold, k, m, unnest({RQS}) q, unnest(quantile_cont(z, {RQS})) th from zz where role = 'TEST' group by series_id, fold, k, m)
select pk.series_id, pk.fold, pk.k, pk.m, 60 - (pk.m - 1) * 15 residual_lead, rate, cal_f1, count(*) filter (where z >= th) alerts, count(*) filter (where z >= th and "label" = 1) hits from pk join zz on zz.series_id = pk.series_id and zz.fold = pk.fold and zz.k = pk.k and zz.m = pk.m and role = 'TEST' join tq on tq.series_id = pk.series_id and tq.fold = pk.fold and tq.k = pk.k and tq.m = pk.m and tq.q = round(1 - rate, 9) group by all""")
def p22(spark, sf):
    keys = ["series_id", "fold", "k", "m"]
    d = folds3(spark, sf).where("role <> 'TRAIN'").select("series_id", "fold", "role", S, "p", "label")
    z = cut(pl.timer_settings(d, "p", [1], TIMERS, ["series_id", "fold", "role"], S).withColumn("z", F.round("z", 9)).where("z is not null"))
    cal, test = z.where("role = 'CAL'"), z.where("role = 'TEST'")
    pick = cut(au.arg_min(pl.rate_choice(cal, "z", "label", RATE_GRID, keys), ["series_id", "fold"], -F.col("f1"), "m", "k"))
    t = test.join(pick.select(*keys, "rate", F.col("f1").alias("cal_f1")), keys)
    t = pl.rate_alerts(t, "z", pick, RATE_GRID, keys, "on")
    return t.groupBy(*keys, "rate", "cal_f1").agg(F.sum("on").alias("alerts"), F.sum(F.col("on") * F.col("label")).alias("hits")).withColumn("residual_lead", 60 - (F.col("m") - 1) * 15)


@register("p17_pooled_alert", "n:i tp:i fp:i cut:f", SCORED + """, s_ as (select p, sum("label") pos, count(*) nr from scored where fold = 1 group by 1), u_ as (select *, sum(pos) over (order by p desc) tp, sum(nr) over (order by p desc) n, sum(pos) over () pp from s_), k_ as (select p cut from u_ order by round(2.0 * tp / (n + pp), 12) desc, p desc limit 1)
select count(*) n, count(*) filter (where p >= cut and "label" = 1) tp, count(*) filter (where p >= cut and "label" = 0) fp, max(cut) cut from scored, k_ where fold > 1""")
def p17(spark, sf):
    d = scored(spark, sf).withColumn("all", F.lit(0))
    best = mt.best_f1_cut(d.where("fold = 1"), "label", "p", ["all"], True).select("all", "cut")
    hit = F.col("p") >= F.col("cut")
    return d.where("fold > 1").join(F.broadcast(best), "all").agg(F.count("*").alias("n"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.max("cut").alias("cut"))


@register("p18_matched_budget", "series_id kind gate goal:f early:i confirm:i alerts_a_day:f precision:f event_recall:f lead:f lead_share:f", SCORED + COSTS + """, b_ as (select pc.*, (tp + fp) / nd alerts_a_day from pc join dd_ on dd_.series_id = pc.series_id),
k_ as (select *, row_number() over (partition by series_id, kind, gate, goal order by round(abs(alerts_a_day - goal), 12), place) rk from b_, (values (5.0), (10.0), (20.0)) g(goal))
select series_id, kind, gate, goal, "early", "confirm", alerts_a_day, tp / nullif(tp + fp, 0) "precision", detected / nullif(n_events, 0) event_recall, "lead", lead_share from k_ where rk = 1""")
def p18(spark, sf):
    """Every kind of policy at the cut whose alert steps a day are nearest to 5, 10 and 20."""
    c = curve(spark, sf)
    days = scored(spark, sf).groupBy("series_id").agg((F.count("*") / 96).alias("days"))
    c = c.join(days, "series_id").withColumn("alerts_a_day", (F.col("tp") + F.col("fp")) / F.col("days"))
    best = pl.matched_budget(c, "alerts_a_day", [5, 10, 20], ["series_id", "kind", "gate"], ["place"])
    part = lambda a, b: a / F.nullif(b, F.lit(0))
    return best.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "event_recall": part(F.col("detected"), F.col("n_events"))})


# ---- intervals: CAL fold 1, test fold 2 and 3
INT = SCORED + """, i_ as (select *, score * 0.5 lo, score * 1.5 + 10 hi, case when kw < t1 then 0 when kw < t2 then 1 else 2 end grp from scored join (select series_id sid, quantile_cont(kw, 1 / 3.0) t1, quantile_cont(kw, 2 / 3.0) t2 from scored where fold = 0 group by 1) on sid = series_id), e_ as (select *, greatest(lo - y, y - hi) e from i_ where fold = 1),
n_ as (select series_id, count(*) n, list(e order by e) es from e_ group by 1), q_ as (select series_id, n, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) h, es from n_), c_ as (select series_id, es[floor(h)::int + 1] + (h - floor(h)) * (coalesce(es[floor(h)::int + 2], es[floor(h)::int + 1]) - es[floor(h)::int + 1]) q from q_),
gn_ as (select series_id, grp, count(*) n, list(e order by e) es from e_ group by 1, 2 having count(*) >= 50), gq_ as (select series_id, grp, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) h, es from gn_), gc_ as (select series_id, grp, es[floor(h)::int + 1] + (h - floor(h)) * (coalesce(es[floor(h)::int + 2], es[floor(h)::int + 1]) - es[floor(h)::int + 1]) q from gq_)
"""


def naive_interval(spark, sf):
    d = scored(spark, sf)
    t = d.where("fold = 0").groupBy("series_id").agg(F.percentile("kw", F.array(F.lit(1 / 3.0), F.lit(2 / 3.0))).alias("t"))
    group = F.when(F.col("kw") < F.col("t")[0], 0).when(F.col("kw") < F.col("t")[1], 1).otherwise(2)
    return d.join(t, "series_id").withColumns({"lo": F.col("score") * 0.5, "hi": F.col("score") * 1.5 + 10, "grp": group}).drop("t")


@register("r1_conformal", "series_id step:i int_lo:f int_hi:f", INT + "select i_.series_id, step, lo - q int_lo, hi + q int_hi from i_ join c_ on c_.series_id = i_.series_id where fold > 1")
def r1(spark, sf):
    d = naive_interval(spark, sf)
    return iv.conformal(d.where("fold = 1"), d.where("fold > 1"), "y", "lo", "hi", 0.1, K)


@register("r2_group_conformal", "series_id step:i int_lo:f int_hi:f", INT + "select i_.series_id, step, lo - coalesce(gc_.q, c_.q) int_lo, hi + coalesce(gc_.q, c_.q) int_hi from i_ join c_ on c_.series_id = i_.series_id left join gc_ on gc_.series_id = i_.series_id and gc_.grp = i_.grp where fold > 1")
def r2(spark, sf):
    d = naive_interval(spark, sf)
    return iv.conformal(d.where("fold = 1"), d.where("fold > 1"), "y", "lo", "hi", 0.1, K, "grp")


@register("r5_bands", "series_id band n:i mae:f", INT + """, w_ as (select series_id, quantile_cont(hi - lo, 0.5) a, quantile_cont(hi - lo, 0.8) b from i_ where fold = 1 group by 1)
select i_.series_id, case when abs(ramp4) > 400 then 'OOD' when hi - lo <= a then 'HIGH' when hi - lo <= b then 'MEDIUM' else 'LOW' end band, count(*) n, avg(abs(y - score)) mae from i_ join w_ on w_.series_id = i_.series_id where fold > 1 group by 1, 2""")
def r5(spark, sf):
    d = naive_interval(spark, sf).withColumn("width", F.col("hi") - F.col("lo"))
    b = iv.bands(d.where("fold > 1"), "width", iv.width_cuts(d.where("fold = 1"), "width", K), K, F.abs("ramp4") > 400)
    return b.groupBy("series_id", "band").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"))


@register("r8_coverage_rollup", "series_id n:i coverage:f coverage_operating:f coverage_idle:f coverage_peak:f width:f", INT + """, f_ as (select i_.*, case when y >= lo - q and y <= hi + q then 1 else 0 end hit, hi - lo + 2 * q wd from i_ join c_ on c_.series_id = i_.series_id where fold > 1)
select series_id, count(*) n, avg(hit) coverage, avg(hit) filter (where is_operating = 1) coverage_operating, avg(hit) filter (where is_operating = 0) coverage_idle, avg(hit) filter (where peak = 1) coverage_peak, avg(wd) width from f_ group by rollup (series_id)""")
def r8(spark, sf):
    d = naive_interval(spark, sf)
    c = iv.conformal(d.where("fold = 1"), d.where("fold > 1"), "y", "lo", "hi", 0.1, K)
    return iv.coverage(c, "y", K, "is_operating", "peak")


@register("r9_risk_score", "series_id step:i risk:f", INT + "select series_id, step, greatest(-3, least(3, (score - thr) / nullif(hi - lo, 0))) risk from i_")
def r9(spark, sf):
    return naive_interval(spark, sf).withColumn("width", F.col("hi") - F.col("lo")).withColumn("risk", iv.risk_score("score", "thr", "width"))


REGIME = f""", rc_ as (select series_id, quantile_cont(abs(ramp4), 0.9) rc, quantile_cont(score, 0.5) m1, quantile_cont(score, 0.8) m2, quantile_cont(abs(ramp4), 0.5) r1 from scored where fold <= 1 group by 1),
rg_ as (select s.*, rc, m1, m2, r1, case when is_operating is distinct from lag(is_operating, 4) over (partition by s.series_id order by step) or abs(ramp4) >= rc then 'TRANSITION' when is_operating = 0 then 'LOW_LOAD' else 'STABLE' end regime from scored s join rc_ on rc_.series_id = s.series_id)
"""


def regimes(spark, sf):
    d = scored(spark, sf)
    q = lambda c, x: F.percentile(c, F.lit(x))
    c = d.where("fold <= 1").groupBy("series_id").agg(q(F.abs("ramp4"), 0.9).alias("rc"), q("score", 0.5).alias("m1"), q("score", 0.8).alias("m2"), q(F.abs("ramp4"), 0.5).alias("r1"))
    return iv.rule_regime(d.join(c, "series_id"), "is_operating", "ramp4", F.col("rc"), K, S)


@register("r10_rule_regime", "series_id regime n:i", SCORED + REGIME + "select series_id, regime, count(*) n from rg_ group by 1, 2")
def r10(spark, sf):
    return regimes(spark, sf).groupBy("series_id", "regime").agg(F.count("*").alias("n"))


@register("r13_decile_curve", "series_id decile:i n:i mae:f", SCORED + "select series_id, decile, count(*) n, avg(abs(y - score)) mae from (select *, ntile(10) over (partition by series_id order by abs(ramp4), step) decile from scored) group by 1, 2")
def r13(spark, sf):
    d = scored(spark, sf).withColumn("decile", F.ntile(10).over(Window.partitionBy("series_id").orderBy(F.abs("ramp4"), "step")))
    return d.groupBy("series_id", "decile").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"))


# ---- diagnosis
DIAG = INT + """, c9 as (select series_id, quantile_cont(abs(ramp4), 0.9) rc, quantile_cont(score, 0.8) ec, quantile_cont(kw, 0.9) cc from scored where fold = 1 group by 1),
d_ as (select i_.*, score >= ec erl, kw >= cc cnf, hi - lo > 150 uns, abs(ramp4) >= rc rmp, is_operating = 0 idl, abs(ramp4) > 600 ood from i_ join c9 on c9.series_id = i_.series_id where fold > 1),
x_ as (select *, erl and cnf alr, rmp or idl or (erl and not cnf) xpl from d_), g_ as (select *, uns and not xpl gap, case when y >= lo and y <= hi then 1 else 0 end hit, abs(y - score) err from x_)
"""


def diagnosed(spark, sf):
    d = naive_interval(spark, sf)
    c = d.where("fold = 1").groupBy("series_id").agg(F.percentile(F.abs("ramp4"), F.lit(0.9)).alias("rc"), F.percentile("score", F.lit(0.8)).alias("ec"), F.percentile("kw", F.lit(0.9)).alias("cc"))
    d = d.where("fold > 1").join(c, "series_id")
    no = F.lit(False)
    d = dg.flags(d.drop("alert"), F.col("score") >= F.col("ec"), F.col("kw") >= F.col("cc"), F.col("hi") - F.col("lo") > 150, no, F.abs("ramp4") >= F.col("rc"), F.col("is_operating") == 0)
    return d.withColumns({"hit": ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int"), "err": F.abs(F.col("y") - F.col("score"))})


def ood():
    return F.abs("ramp4") > 600


@register("d1_explained_gap", "series_id unsure:i explained:i gap:i", DIAG + "select series_id, sum(uns::int) unsure, sum(xpl::int) explained, sum(gap::int) gap from g_ group by 1")
def d1(spark, sf):
    return diagnosed(spark, sf).groupBy("series_id").agg(*[F.sum(c).alias(c) for c in ("unsure", "explained", "gap")])


@register("d2_advisory", "series_id step:i level", DIAG + "select series_id, step, case when ood then 'HUMAN_REVIEW' when alr and not uns then 'CONFIRMED_WARNING' when alr then 'LOW_CONFIDENCE_WARNING' when gap then 'INFORMATION_GAP' when erl then 'EARLY_WATCH' else 'NORMAL' end level from g_")
def d2(spark, sf):
    return diagnosed(spark, sf).withColumn("level", dg.advisory(ood()))


@register("d3_reasons", "series_id reason n:i", DIAG + """select series_id, coalesce(nullif(concat_ws(' / ', case when ood then 'outside training range' end, case when uns then 'wide interval' end, case when rmp then 'high ramp' end, case when gap then 'cause unknown' end), ''), 'routine') reason, count(*) n from g_ group by 1, 2""")
def d3(spark, sf):
    rules = [(ood(), "outside training range"), (F.col("unsure") == 1, "wide interval"), (F.abs("ramp4") >= F.col("rc"), "high ramp"), (F.col("gap") == 1, "cause unknown")]
    return diagnosed(spark, sf).groupBy("series_id", dg.reasons(rules, "routine").alias("reason")).agg(F.count("*").alias("n"))


@register("d4_information_type", "series_id kind n:i", DIAG + "select series_id, case when gap or ood then 'equipment state or process stage' when uns and idl then 'equipment state' when uns then 'product and lot' else 'none' end kind, count(*) n from g_ group by 1, 2")
def d4(spark, sf):
    d = diagnosed(spark, sf)
    return d.groupBy("series_id", dg.information_type(ood(), F.lit(False), F.col("is_operating") == 0).alias("kind")).agg(F.count("*").alias("n"))


@register("d5_routing", "series_id cell n:i mae:f coverage:f prevalence:f", DIAG + "select series_id, case when uns then 'uncertain' else 'reliable' end || '_' || case when xpl then 'explained' else 'unexplained' end cell, count(*) n, avg(err) mae, avg(hit) coverage, avg(peak) prevalence from g_ group by 1, 2")
def d5(spark, sf):
    return dg.routing(diagnosed(spark, sf), "err", "hit", "peak", K)


@register("d6_flag_validation", "series_id flag n:i share:f mae_in:f mae_out:f mae_ratio:f coverage_in:f coverage_out:f peaks_in:f auc:f ap:f lift:f", DIAG + ", q8_ as (select series_id, quantile_cont(err, 0.8) q8 from g_ group by 1), u_ as (" + " union all ".join(f"""select g_.series_id, '{n}' flag, {c}::int f, err, hit, "label" pk, (err >= q8)::int hi from g_ join q8_ on q8_.series_id = g_.series_id""" for n, c in (("unsure", "uns"), ("explained", "xpl"), ("gap", "gap"))) + """),
dv_ as (select series_id, flag, sum(f) n, avg(f) share, avg(err) filter (where f = 1) mae_in, avg(err) filter (where f = 0) mae_out, avg(hit) filter (where f = 1) coverage_in, avg(hit) filter (where f = 0) coverage_out, avg(pk) filter (where f = 1) peaks_in, count(*) t, sum(hi) p, sum(f * hi) tp from u_ group by 1, 2),
dw_ as (select *, tp / nullif(p, 0) rc, (n - tp) / nullif(t - p, 0) fr, p / t rate from dv_)
select *, mae_in / nullif(mae_out, 0) mae_ratio, 0.5 + (rc - fr) / 2 auc, rc * coalesce(tp / nullif(n, 0), 0) + (1 - rc) * rate ap, (rc * coalesce(tp / nullif(n, 0), 0) + (1 - rc) * rate) / nullif(rate, 0) lift from dw_""")
def d6(spark, sf):
    return dg.flag_validation(diagnosed(spark, sf), ["unsure", "explained", "gap"], "err", "hit", "label", K)


@register("d7_distribution", "level n:i share:f", DIAG + ", l_ as (select case when ood then 'HUMAN_REVIEW' when alr and not uns then 'CONFIRMED_WARNING' when alr then 'LOW_CONFIDENCE_WARNING' when gap then 'INFORMATION_GAP' when erl then 'EARLY_WATCH' else 'NORMAL' end level, count(*) n from g_ group by 1) select level, n, n / sum(n) over () share from l_")
def d7(spark, sf):
    c = diagnosed(spark, sf).groupBy(dg.advisory(ood()).alias("level")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


@register("d10_advisory_fine", "series_id level n:i mae:f coverage:f", DIAG + "select series_id, case when ood then 'HUMAN_REVIEW' when alr and not uns then 'WARN_CONFIRMED' when alr then 'WARN_LOW_CONFIDENCE' when erl and not cnf and uns then 'ADVISORY_UNCERTAIN' when erl then 'EARLY_WATCH' when uns then 'MONITOR_LOW_CONFIDENCE' else 'NORMAL_MONITORING' end level, count(*) n, avg(err) mae, avg(hit) coverage from g_ group by 1, 2")
def d10(spark, sf):
    level = dg.advisory_fine(ood(), F.col("kw") >= F.col("cc"))
    return diagnosed(spark, sf).groupBy("series_id", level.alias("level")).agg(F.count("*").alias("n"), F.avg("err").alias("mae"), F.avg("hit").alias("coverage"))


GATE_QS = [round(0.80 + 0.01 * i, 2) for i in range(20)]


@register("p19_tier_curve", "series_id risk_q:f tier n:i hits:i mae:f", DIAG + f""", b_ as (select series_id, quantile_cont(hi - lo, 0.5) a, quantile_cont(hi - lo, 0.8) b from i_ where fold = 1 group by 1), rq_ as (select series_id, unnest({GATE_QS}) q, unnest(quantile_cont(score, {GATE_QS})) th from g_ group by 1),
t_ as (select g_.*, q, score >= th rk, case when ood then 'OOD' when hi - lo <= a then 'HIGH' when hi - lo <= b then 'MEDIUM' else 'LOW' end bd from g_ join b_ on b_.series_id = g_.series_id join rq_ on rq_.series_id = g_.series_id)
select series_id, q risk_q, case when bd = 'OOD' then 'HUMAN_REVIEW' when bd = 'LOW' then 'WARN_ONLY' when bd = 'MEDIUM' and rk then 'ADVISE' when bd = 'MEDIUM' then 'MONITOR' when rk then 'AUTO' else 'AUTO_NORMAL' end tier, count(*) n, sum("label") hits, avg(err) mae from t_ group by 1, 2, 3""")
def p19(spark, sf):
    d = diagnosed(spark, sf).withColumn("width", F.col("hi") - F.col("lo"))
    cal = naive_interval(spark, sf).where("fold = 1").withColumn("width", F.col("hi") - F.col("lo"))
    d = iv.bands(d, "width", iv.width_cuts(cal, "width", K), K, ood())
    # a row passes the first `level` cuts: rows are counted by (band, level), then met with the cuts
    d = pl.with_level(d, "score", pl.cal_thresholds(d, "score", GATE_QS, K), K, "level")
    h = d.groupBy("series_id", "band", "level").agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.sum("err").alias("err"))
    g = h.select("*", F.posexplode(F.array(*[F.lit(q) for q in GATE_QS])).alias("i", "risk_q"))
    tier = pl.tier(F.col("band"), F.col("level") > F.col("i"))
    return g.groupBy("series_id", "risk_q", tier.alias("tier")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), (F.sum("err") / F.sum("n")).alias("mae"))


# ---- folds
@register("m1_rolling_origin", "series_id fold:i role n:i first:i last:i", SCORED + """, r_ as (select *, row_number() over (partition by series_id order by step) - 1 i, count(*) over (partition by series_id) n from scored),
f_ as (select r_.*, k, n - (n // 6) * (5 - k) st, n // 6 sz from r_, range(5) t(k)), g_ as (select *, case when i >= st + sz then null when i >= st then 'TEST' when i >= floor(st * 0.8) then 'CAL' else 'TRAIN' end role from f_)
select series_id, k fold, role, count(*) n, min(step) "first", max(step) "last" from g_ where role is not null group by 1, 2, 3""")
def m1(spark, sf):
    d = iv.rolling_origin(scored(spark, sf).drop("fold"), 5, K, S)
    return d.groupBy("series_id", "fold", "role").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"))


@register("m3_chrono_split", "series_id role n:i", SCORED + ", r_ as (select *, (row_number() over (partition by series_id order by step) - 1) / count(*) over (partition by series_id) pl from scored) select series_id, case when pl < 0.6 then 'TRAIN' when pl < 0.8 then 'CAL' else 'TEST' end role, count(*) n from r_ group by 1, 2")
def m3(spark, sf):
    return scored(spark, sf).withColumn("role", iv.chrono_split(K, S, {"TRAIN": 0.6, "CAL": 0.2, "TEST": 0.2})).groupBy("series_id", "role").agg(F.count("*").alias("n"))


@register("m5_last_days", "series_id part n:i", SCORED + ", p_ as (select *, date_diff('day', ts15::date, (max(ts15) over (partition by series_id))::date) lf from scored) select series_id, case when lf < 7 then 'LOCK' when lf < 14 then 'TEST' else 'SEL' end part, count(*) n from p_ group by 1, 2")
def m5(spark, sf):
    return iv.last_days(scored(spark, sf), "ts15", K, 7, 7).groupBy("series_id", "part").agg(F.count("*").alias("n"))


@register("m6_relevance_weight", "series_id step:i residual:f weight:f", SCORED + """, q_ as (select series_id, quantile_cont(y, 0.9) a, quantile_cont(y, 0.995) b from scored where fold < 3 group by 1) select s.series_id, step, y - kw residual, 1 + 4 * greatest(0, least(1, (y - a) / greatest(b - a, 1e-6))) weight from scored s join q_ on q_.series_id = s.series_id""")
def m6(spark, sf):
    d = scored(spark, sf)
    q = d.where("fold < 3").groupBy("series_id").agg(F.percentile("y", F.array(F.lit(0.9), F.lit(0.995))).alias("q"))
    share = (F.col("y") - F.col("q")[0]) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-6))
    return d.join(q, "series_id").withColumns({"residual": F.col("y") - F.col("kw"), "weight": 1 + 4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))})


@register("m11_naive_seasonal", "series_id naive_mae:f seasonal_mae:f", SCORED + "select series_id, avg(abs(y - kw)) naive_mae, avg(abs(y - lag4)) seasonal_mae from (select *, lead(seasonal, 4) over (partition by series_id order by step) lag4 from scored) where lag4 is not null group by 1")
def m11(spark, sf):
    d = scored(spark, sf).withColumn("s4", F.lead("seasonal", 4).over(over(K, S))).where("s4 is not null")
    return d.groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("kw"))).alias("naive_mae"), F.avg(F.abs(F.col("y") - F.col("s4"))).alias("seasonal_mae"))
