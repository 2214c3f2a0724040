"""Groupings, operating curves, regimes, stress, ceilings and summaries of naive scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform
from wattloom.operators import audit as au, intervals as iv, metrics as mt, policy as pl, stats as st, verdicts as vd
from wattloom.operators.features import over
from wattloom.plans import halo
from wattloom.queries.alerts import INT, REGIME, naive_interval, regimes
from wattloom.queries.base import K, S, SCORED, register, scored, u_sql
from wattloom.queries.decisions import LEVEL
from wattloom.session import cut

# ---- R3: groupings compared on one partition
MENU = INT + """, mc as (select series_id, quantile_cont(score, 0.5) m1, quantile_cont(score, 0.8) m2, quantile_cont(abs(ramp4), 0.5) r1, quantile_cont(abs(ramp4), 0.9) r2 from scored where fold = 0 group by 1),
mg as (select i_.*, 0 g_global, is_operating g_operating, case when score >= m2 then 2 when score >= m1 then 1 else 0 end g_level, case when abs(ramp4) >= r2 then 2 when abs(ramp4) >= r1 then 1 else 0 end g_ramp, peak g_peak from i_ join mc on mc.series_id = i_.series_id),
ml as (select *, is_operating * 3 + g_level fixed from mg), mu as (""" + " union all ".join(f"select series_id, fold, y, lo, hi, fixed, '{n}' grouping, {c} grp from ml" for n, c in (("global", "g_global"), ("operating", "g_operating"), ("level", "g_level"), ("ramp", "g_ramp"), ("product", "fixed"), ("peak_now", "g_peak"))) + """),
me as (select *, greatest(lo - y, y - hi) e from mu where fold = 1), mh as (select series_id, grouping, grp, count(*) n, quantile_cont(e, 0.0) z, list(e order by e) es from me group by 1, 2, 3), mw as (select series_id, grouping, count(*) n, list(e order by e) es from me group by 1, 2),
mq as (select *, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) h from mh where n >= 50), mx as (select *, least(1.0, 0.9 * (1 + 1.0 / n)) * (n - 1) h from mw),
tq as (select mu.*, coalesce(mq.es[floor(mq.h)::int + 1] + (mq.h - floor(mq.h)) * (coalesce(mq.es[floor(mq.h)::int + 2], mq.es[floor(mq.h)::int + 1]) - mq.es[floor(mq.h)::int + 1]), mx.es[floor(mx.h)::int + 1] + (mx.h - floor(mx.h)) * (coalesce(mx.es[floor(mx.h)::int + 2], mx.es[floor(mx.h)::int + 1]) - mx.es[floor(mx.h)::int + 1])) q
 from mu join mx on mx.series_id = mu.series_id and mx.grouping = mu.grouping left join mq on mq.series_id = mu.series_id and mq.grouping = mu.grouping and mq.grp = mu.grp where fold > 1),
th as (select *, case when y >= lo - q and y <= hi + q then 1 else 0 end hit from tq),
ow as (select series_id, grouping, max(abs(c - 0.9)) worst_gap, count(*) groups from (select series_id, grouping, grp, avg(hit) c from th group by 1, 2, 3) group by 1, 2), fx as (select series_id, grouping, max(abs(c - 0.9)) fixed_gap from (select series_id, grouping, fixed, avg(hit) c, count(*) n from th group by 1, 2, 3) where n >= 30 group by 1, 2)
"""


@register("r3_grouping_menu", "series_id grouping n:i coverage:f width:f worst_gap:f groups:i fixed_gap:f", MENU + "select a.*, worst_gap, groups, fixed_gap from (select series_id, grouping, count(*) n, avg(hit) coverage, avg(hi - lo + 2 * q) width from th group by 1, 2) a join ow on ow.series_id = a.series_id and ow.grouping = a.grouping left join fx on fx.series_id = a.series_id and fx.grouping = a.grouping")
def r3(spark, sf):
    d = naive_interval(spark, sf)
    q = lambda c, *x: F.percentile(c, F.array(*[F.lit(v) for v in x]))
    c = d.where("fold = 0").groupBy("series_id").agg(q("score", 0.5, 0.8).alias("m"), q(F.abs("ramp4"), 0.5, 0.9).alias("r"))
    three = lambda v, e: F.when(v >= e[1], 2).when(v >= e[0], 1).otherwise(0)
    d = d.join(c, "series_id").withColumns({"g_global": F.lit(0), "g_level": three(F.col("score"), F.col("m")), "g_ramp": F.when(F.col("ramp4").isNull(), 0).otherwise(three(F.abs("ramp4"), F.col("r")))}).drop("m", "r")
    d = cut(d.withColumn("fixed", F.col("is_operating") * 3 + F.col("g_level")))
    groups = {"global": "g_global", "operating": "is_operating", "level": "g_level", "ramp": "g_ramp", "product": "fixed", "peak_now": "peak"}
    return iv.grouping_menu(d.where("fold = 1"), d.where("fold > 1"), "y", "lo", "hi", 0.1, groups, "fixed", K)


# ---- R6, R7: one-sided upper forecasts (naive: a share of the score by level)
UPS = [0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95, 0.975, 0.99]
UPPER = SCORED + f""", ul as (select s.*, a, score * (0.5 + a) + 10 up from scored s, (select unnest({UPS}) a)), ue as (select series_id, a, count(*) n, list(y - up order by y - up) es from ul where fold = 1 group by 1, 2), uh as (select *, least(1.0, a * (1 + 1.0 / n)) * (n - 1) h from ue),
uq as (select series_id, a, es[floor(h)::int + 1] + (h - floor(h)) * (coalesce(es[floor(h)::int + 2], es[floor(h)::int + 1]) - es[floor(h)::int + 1]) q from uh), ut as (select ul.*, up + q upq from ul join uq on uq.series_id = ul.series_id and uq.a = ul.a where fold > 1)
"""


def upper(spark, sf, levels):
    """TEST rows once per level with up and the corrected upq."""
    d = scored(spark, sf)
    out = None
    for a in levels:
        u = d.withColumn("up", F.col("score") * (0.5 + a) + 10)
        part = iv.one_sided(u.where("fold = 1"), u.where("fold > 1"), "y", "up", a, K).withColumn("a", F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("upper_q", "upq")


@register("r6_exceedance_score", "series_id method auc:f ap:f", UPPER + """, x_ as (select series_id, 'corrected' method, round(upq - thr, 9) v, "label" y1 from ut where a = 0.95 union all select series_id, 'raw', round(up - thr, 9), "label" from ut where a = 0.95),
k_ as (select *, rank() over (partition by series_id, method order by v) + (count(*) over (partition by series_id, method, v) - 1) / 2.0 rk from x_), u_ as (select series_id, method, (sum(rk) filter (where y1 = 1) - sum(y1) * (sum(y1) + 1) / 2.0) / nullif(sum(y1) * (count(*) - sum(y1)), 0) auc from k_ group by 1, 2),
s_ as (select series_id, method, v, sum(y1) pos, count(*) nr from x_ group by 1, 2, 3), c_ as (select *, sum(pos) over w tp, sum(nr) over w n, sum(pos) over (partition by series_id, method) p from s_ window w as (partition by series_id, method order by v desc)), p_ as (select series_id, method, sum(pos / nullif(p, 0) * (tp / n)) ap from c_ group by 1, 2)
select u_.*, ap from u_ join p_ on p_.series_id = u_.series_id and p_.method = u_.method""")
def r6(spark, sf):
    d = upper(spark, sf, [0.95])
    x = cut(d.select("series_id", "label", F.inline(F.array(F.struct(F.lit("corrected").alias("method"), F.round(F.col("upq") - F.col("thr"), 9).alias("v")), F.struct(F.lit("raw").alias("method"), F.round(F.col("up") - F.col("thr"), 9).alias("v"))))))
    by = ["series_id", "method"]
    return mt.roc_auc(x, "label", "v", by).join(mt.average_precision(x, "label", "v", by), by)


@register("r7_operating_curve", "series_id method a:f tp:i fp:i fn:i tn:i", UPPER + """, x_ as (select series_id, 'corrected' method, a, (upq >= thr)::int al, "label" y1 from ut union all select series_id, 'raw', a, (up >= thr)::int, "label" from ut)
select series_id, method, a, count(*) filter (where al = 1 and y1 = 1) tp, count(*) filter (where al = 1 and y1 = 0) fp, count(*) filter (where al = 0 and y1 = 1) fn, count(*) filter (where al = 0 and y1 = 0) tn from x_ group by 1, 2, 3""")
def r7(spark, sf):
    d = upper(spark, sf, UPS)
    flag = lambda n, c: F.struct(F.lit(n).alias("method"), (F.col(c) >= F.col("thr")).cast("int").alias("al"))
    x = d.select("series_id", "a", "label", F.inline(F.array(flag("corrected", "upq"), flag("raw", "up"))))
    return mt.class_metrics(x, "label", "al", ["series_id", "method", "a"])


# ---- R11, R12, R15
DEFS = SCORED + REGIME + """, rd as (select *, case when score >= m2 then 'high' when score >= m1 then 'mid' else 'low' end by_level, case when abs(ramp4) >= rc then 'steep' when abs(ramp4) >= r1 then 'mid' else 'flat' end by_ramp, abs(y - score) err from rg_ where ramp4 is not null),
du as (select series_id, step, 'rule' definition, regime st, score, ramp4, peak, err from rd union all select series_id, step, 'level', by_level, score, ramp4, peak, err from rd union all select series_id, step, 'ramp', by_ramp, score, ramp4, peak, err from rd)
"""


def definitions(spark, sf):
    d = regimes(spark, sf).where("ramp4 is not null").withColumns({
        "by_level": F.when(F.col("score") >= F.col("m2"), "high").when(F.col("score") >= F.col("m1"), "mid").otherwise("low"),
        "by_ramp": F.when(F.abs("ramp4") >= F.col("rc"), "steep").when(F.abs("ramp4") >= F.col("r1"), "mid").otherwise("flat"),
        "err": F.abs(F.col("y") - F.col("score")),
    })
    return cut(d)


PAIRS3 = [("rule", "regime"), ("level", "by_level"), ("ramp", "by_ramp")]


@register("r11_regime_agreement", "series_id a b ari:f", DEFS + """, pr as (select x.series_id, x.definition a, z.definition b, x.st s, z.st t from du x join du z on z.series_id = x.series_id and z.step = x.step where (x.definition, z.definition) in (('rule', 'level'), ('rule', 'ramp'), ('level', 'ramp'))),
ce as (select series_id, a, b, s, t, count(*)::double n from pr group by all), ij as (select series_id, a, b, sum(n * (n - 1) / 2) x, sum(n) n from ce group by 1, 2, 3), ri as (select series_id, a, b, sum(n * (n - 1) / 2) x from (select series_id, a, b, s, sum(n) n from ce group by 1, 2, 3, 4) group by 1, 2, 3), cj as (select series_id, a, b, sum(n * (n - 1) / 2) x from (select series_id, a, b, t, sum(n) n from ce group by 1, 2, 3, 4) group by 1, 2, 3)
select ij.series_id, ij.a, ij.b, (ij.x - ri.x * cj.x / (n * (n - 1) / 2)) / nullif((ri.x + cj.x) / 2 - ri.x * cj.x / (n * (n - 1) / 2), 0) ari from ij join ri using (series_id, a, b) join cj using (series_id, a, b)""")
def r11(spark, sf):
    d = definitions(spark, sf)
    pairs = [(x, y) for i, x in enumerate(PAIRS3) for y in PAIRS3[i + 1 :]]
    long = d.select("series_id", F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(c).alias("s"), F.col(e).alias("t")) for (x, c), (y, e) in pairs])))
    return st.adjusted_rand(long, "s", "t", ["series_id", "a", "b"])


@register("r11_structure_verdict", "series_id definition states:i low:i stable:i transition:i three:i", DEFS + """, pf as (select series_id, definition, st, avg(score) lv, avg(abs(ramp4)) rp, avg(peak) pk, avg(err) ma from du group by 1, 2, 3), md as (select series_id, quantile_cont(score, 0.5) ms, quantile_cont(abs(ramp4), 0.5) mr from rd group by 1),
w_ as (select pf.*, ms, mr, max(rp) over w tp, quantile_cont(rp, 0.5) over w pr, quantile_cont(ma, 0.5) over w pm from pf join md on md.series_id = pf.series_id window w as (partition by pf.series_id, definition)),
v_ as (select series_id, definition, count(*) states, max((lv < ms and rp < tp and pk < 0.05)::int) low, max((lv >= ms and rp <= pr)::int) stable, max((rp = tp and ma > pm and rp > mr)::int) transition from w_ group by 1, 2) select *, least(low, stable, transition) three from v_""")
def r11_structure(spark, sf):
    d = definitions(spark, sf)
    long = d.select("series_id", "score", "ramp4", "peak", "err", F.inline(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(c).alias("state")) for n, c in PAIRS3])))
    p = long.groupBy("series_id", "definition", "state").agg(F.avg("score").alias("level"), F.avg(F.abs("ramp4")).alias("ramp"), F.avg("peak").alias("peak_rate"), F.avg("err").alias("mae"))
    whole = d.groupBy("series_id").agg(F.percentile("score", F.lit(0.5)).alias("med_level"), F.percentile(F.abs("ramp4"), F.lit(0.5)).alias("med_ramp"))
    return vd.regime_structure(p, whole, K)


@register("r12_disagreement", "series_id decile:i disagreement:f mae:f n:i", SCORED + "select series_id, decile, avg(g) disagreement, avg(abs(y - score)) mae, count(*) n from (select *, abs(score - seasonal) g, ntile(10) over (partition by series_id order by round(abs(score - seasonal), 6), step) decile from scored) group by 1, 2")
def r12(spark, sf):
    d = scored(spark, sf).withColumn("g", F.abs(F.col("score") - F.col("seasonal")))
    d = d.withColumn("decile", F.ntile(10).over(Window.partitionBy("series_id").orderBy(F.round("g", 6), S)))
    return d.groupBy("series_id", "decile").agg(F.avg("g").alias("disagreement"), F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"), F.count("*").alias("n"))


@register("r15_stress_map", "series_id condition n:i share:f mae:f ratio:f err_p95:f", SCORED + """, q_ as (select s.*, quantile_cont(abs(ramp4), 0.9) over (partition by series_id) rq, min(is_operating) over (partition by series_id order by step rows between 3 preceding and current row) mo, abs(y - score) err from scored s),
l_ as (select *, unnest(list_filter(['ALL', case when "label" = 1 then 'peak_only' end, case when abs(ramp4) >= rq then 'high_ramp' end, case when is_operating = 0 then 'idle' end, case when is_operating = 1 and mo = 0 then 'restart_1h' end, case when "hour" between 12 and 17 then 'midday' end, case when isodow(ts15) >= 6 then 'weekend' end], lambda x: x is not null)) condition from q_),
g_ as (select series_id, condition, count(*) n, avg(err) mae, quantile_cont(err, 0.95) err_p95 from l_ group by 1, 2) select *, n / max(n) filter (where condition = 'ALL') over (partition by series_id) share, mae / nullif(max(mae) filter (where condition = 'ALL') over (partition by series_id), 0) ratio from g_""")
def r15(spark, sf):
    d = scored(spark, sf)
    cuts = d.groupBy("series_id").agg(F.percentile(F.abs("ramp4"), F.lit(0.9)).alias("rq"))
    d = d.join(cuts, "series_id").withColumns({"err": F.abs(F.col("y") - F.col("score")), "mo": F.min("is_operating").over(over(K, S).rowsBetween(-3, 0))})
    conds = {"peak_only": F.col("label") == 1, "high_ramp": F.abs("ramp4") >= F.col("rq"), "idle": F.col("is_operating") == 0, "restart_1h": (F.col("is_operating") == 1) & (F.col("mo") == 0), "midday": F.col("hour").between(12, 17), "weekend": F.weekday("ts15") >= 5}
    return vd.stress_map(d, "err", conds, K)


# ---- V11, V14, V20, P21
@register("v11_oracle_f1", "series_id bias_all:f bias_peak:f oracle_f1:f", SCORED + f""", n_ as (select *, y - score e, row_number() over (partition by series_id order by step) i from scored), r_ as (select n_.series_id, r, step, y, "label", row_number() over (partition by n_.series_id, r order by {u_sql("'oracle'", "r", "step")}, step) j from n_, range(10) t(r)),
p_ as (select r_.series_id, r, round(r_.y + n_.e, 9) v, r_."label" from r_ join n_ on n_.series_id = r_.series_id and n_.i = r_.j), s_ as (select series_id, r, v, sum("label") pos, count(*) nr from p_ group by 1, 2, 3), u_ as (select *, sum(pos) over w tp, sum(nr) over w n, sum(pos) over (partition by series_id, r) p from s_ window w as (partition by series_id, r order by v desc)),
f_ as (select series_id, r, max(round(2.0 * tp / (n + p), 12)) f1 from u_ where p > 0 group by 1, 2) select a.series_id, bias_all, bias_peak, oracle_f1 from (select series_id, avg(e) bias_all, avg(e) filter (where "label" = 1) bias_peak from n_ group by 1) a join (select series_id, avg(f1) oracle_f1 from f_ group by 1) b on a.series_id = b.series_id""")
def v11(spark, sf):
    d = scored(spark, sf).withColumn("e", F.col("y") - F.col("score"))
    return mt.oracle_f1(d, "y", "e", "label", K, S, 10)


@register("v14_consolidated", "series_id window core_mae:f core_rmse:f public_mae:f public_rmse:f gain:f naive_mae:f", SCORED + """, w_ as (select *, unnest(case when ts15 >= timestamp '2024-01-16' then ['all', 'clean'] else ['all'] end) "window" from scored), m_ as (select series_id, "window", avg(abs(y - score)) core_mae, sqrt(avg((y - score) * (y - score))) core_rmse, avg(abs(y - (score + seasonal) / 2)) public_mae, sqrt(avg((y - (score + seasonal) / 2) * (y - (score + seasonal) / 2))) public_rmse, avg(abs(y - kw)) naive_mae from w_ group by 1, 2) select *, (core_mae - public_mae) / nullif(core_mae, 0) gain from m_""")
def v14(spark, sf):
    from wattloom.operators import clean

    d = clean.window_tags(scored(spark, sf), F.col("ts15") >= F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("both", (F.col("score") + F.col("seasonal")) / 2)
    by = ["series_id", "window"]
    one = lambda pred, name: mt.forecast_metrics(d, "y", pred, "kw", "peak", by).select(*by, F.col("mae").alias(f"{name}_mae"), F.col("rmse").alias(f"{name}_rmse"))
    naive = d.groupBy(*by).agg(F.avg(F.abs(F.col("y") - F.col("kw"))).alias("naive_mae"))
    return one("score", "core").join(one("both", "public"), by).join(naive, by).withColumn("gain", (F.col("core_mae") - F.col("public_mae")) / F.nullif(F.col("core_mae"), F.lit(0.0)))


@register("v20_reliability_by_level", "series_id level:i n:i low_or_ood:f coverage_peak:f transition_mae:f mae:f", SCORED + REGIME + """, pv as (select *, unnest([1, 2, 3, 4]) "level", unnest([seasonal, kw, score, (score + seasonal) / 2]) pred from rg_), iv_ as (select *, pred * 0.5 lo, pred * 1.5 + 10 hi from pv),
wc as (select series_id, "level", quantile_cont(hi - lo, 0.8) c80 from iv_ where fold = 1 group by 1, 2)
select iv_.series_id, iv_."level", count(*) n, avg((abs(coalesce(ramp4, 0)) > 400 or hi - lo > c80)::int) low_or_ood, avg((y between lo and hi)::int) filter (where peak = 1) coverage_peak, avg(abs(y - pred)) filter (where regime = 'TRANSITION') transition_mae, avg(abs(y - pred)) mae from iv_ join wc on wc.series_id = iv_.series_id and wc."level" = iv_."level" where fold > 1 group by 1, 2""")
def v20(spark, sf):
    preds = [F.col("seasonal"), F.col("kw"), F.col("score"), (F.col("score") + F.col("seasonal")) / 2]
    d = regimes(spark, sf).select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("level"), p.alias("pred")) for i, p in enumerate(preds, 1)])))
    d = cut(d.withColumns({"lo": F.col("pred") * 0.5, "hi": F.col("pred") * 1.5 + 10}).withColumn("width", F.col("hi") - F.col("lo")))
    by = ["series_id", "level"]
    b = iv.bands(d.where("fold > 1"), "width", iv.width_cuts(d.where("fold = 1"), "width", by), by, F.coalesce(F.abs("ramp4") > 400, F.lit(False)))
    err = F.abs(F.col("y") - F.col("pred"))
    return b.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("band").isin("LOW", "OOD").cast("int")).alias("low_or_ood"), F.avg(F.when(F.col("peak") == 1, F.col("y").between(F.col("lo"), F.col("hi")).cast("int"))).alias("coverage_peak"), F.avg(F.when(F.col("regime") == "TRANSITION", err)).alias("transition_mae"), F.avg(err).alias("mae"))


SENSE_QS = [round(0.5 + 0.01 * i, 2) for i in range(50)]
W_ = "partition by series_id order by step"
SENSE = SCORED + f""", tt as (select *, case when count(kw) over ({W_} rows between 672 preceding and 1 preceding) >= 96 then quantile_cont(kw, 0.95) over ({W_} rows between 672 preceding and 1 preceding) end tr, max(kw) over (partition by series_id, date_trunc('month', ts15) order by step rows between unbounded preceding and 1 preceding) mm from scored),
dl as (select series_id, step, score, fold, unnest(['fixed', 'trailing', 'month_max']) definition, unnest([(y >= thr)::int, coalesce(y >= tr, false)::int, coalesce(y >= mm, false)::int]) yl from tt),
"""


def sensitivity(spark, sf):
    d = scored(spark, sf)
    d = halo.trailing_quantiles(d, "kw", {"tr": (672, 0.95, 96)}, K, S)
    mm = F.max("kw").over(Window.partitionBy("series_id", F.date_trunc("month", "ts15")).orderBy(S).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("mm", mm)
    lab = lambda n, c: F.struct(F.lit(n).alias("definition"), F.coalesce((F.col("y") >= F.col(c)).cast("int"), F.lit(0)).alias("yl"))
    return cut(d.select("series_id", S, "score", "fold", F.inline(F.array(lab("fixed", "thr"), lab("trailing", "tr"), lab("month_max", "mm")))))


@register("p21_definition_costs", "series_id definition ratio:f q:f cost:f missed:i", SENSE + f"""sq as (select series_id, unnest(range(1, {len(SENSE_QS) + 1})) i, unnest({SENSE_QS}) q, unnest(quantile_cont(score, {SENSE_QS})) th from scored group by 1), cc as (select d.series_id, definition, q, sum((score >= th)::int * (1 - yl)) fp, sum((score < th)::int * yl) fn, sum(yl) pp from dl d join sq on sq.series_id = d.series_id group by 1, 2, 3),
cr as (select *, ratio::double ratio, (fp + ratio * fn) / (ratio * greatest(pp, 1)) cost from cc, (select unnest([1, 5, 10, 20, 50]) ratio)) select series_id, definition, ratio, q, cost, fn missed from cr qualify row_number() over (partition by series_id, definition, ratio order by round(cost, 12), q) = 1""".replace("select *, ratio::double ratio", "select cc.*, r.ratio::double ratio").replace("from cc, (select unnest([1, 5, 10, 20, 50]) ratio)", "from cc, (select unnest([1, 5, 10, 20, 50]) ratio) r"))
def p21(spark, sf):
    d = sensitivity(spark, sf)
    by = ["series_id", "definition"]
    cuts = pl.cal_thresholds(d.where("definition = 'fixed'"), "score", SENSE_QS, K)
    s = pl.single_sweep(pl.with_level(d, "score", cuts, K, "level"), "level", "yl", len(SENSE_QS), by)
    total = d.groupBy(*by).agg(F.sum("yl").alias("pp"))
    s = s.join(total, by).withColumns({"missed": F.col("pp") - F.col("tp"), "n_events": F.greatest("pp", F.lit(1)), "q": F.get(F.array(*[F.lit(q) for q in SENSE_QS]), F.col("early") - 1)})
    c = pl.cost_curve(s, [1, 5, 10, 20, 50])
    return au.arg_min(c, ["series_id", "definition", "ratio"], F.round("cost", 12), "q")


@register("p21_recommended", "series_id definition prevalence:f auc:f lift:f gap:f eligible:i recommended:i", SENSE + """k_ as (select *, rank() over (partition by series_id, definition order by score) + (count(*) over (partition by series_id, definition, score) - 1) / 2.0 rk from dl), u_ as (select series_id, definition, avg(yl) prevalence, (sum(rk) filter (where yl = 1) - sum(yl) * (sum(yl) + 1) / 2.0) / nullif(sum(yl) * (count(*) - sum(yl)), 0) auc, abs(avg(yl) - avg(yl) filter (where fold >= 2)) gap from k_ group by 1, 2),
s_ as (select series_id, definition, score, sum(yl) pos, count(*) nr from dl group by 1, 2, 3), c_ as (select *, sum(pos) over w tp, sum(nr) over w n, sum(pos) over (partition by series_id, definition) p from s_ window w as (partition by series_id, definition order by score desc)), a_ as (select series_id, definition, sum(pos / nullif(p, 0) * (tp / n)) ap from c_ group by 1, 2),
e_ as (select u_.*, ap / nullif(prevalence, 0) lift, coalesce(u_.definition <> 'fixed' and prevalence between 0.02 and 0.15 and auc >= 0.55 and ap / nullif(prevalence, 0) >= 1.1, false)::int eligible from u_ join a_ on a_.series_id = u_.series_id and a_.definition = u_.definition)
select *, (eligible = 1 and row_number() over (partition by series_id order by eligible desc, round(gap, 9), definition) = 1)::int recommended from e_""")
def p21_recommended(spark, sf):
    d = sensitivity(spark, sf)
    by = ["series_id", "definition"]
    late = F.avg(F.when(F.col("fold") >= 2, F.col("yl")))
    u = d.groupBy(*by).agg(F.avg("yl").alias("prevalence"), F.abs(F.avg("yl") - late).alias("gap"))
    e = u.join(mt.roc_auc(d, "yl", "score", by), by).join(mt.average_precision(d, "yl", "score", by), by).withColumn("lift", F.col("ap") / F.nullif(F.col("prevalence"), F.lit(0.0)))
    return vd.recommend(e, F.col("definition") != "fixed", by, 0.55, 1.1)
