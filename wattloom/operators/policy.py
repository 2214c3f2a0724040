"""Alert policies: thresholds from calibration, sweeps, costs, selection.

A sweep does not evaluate each policy over all rows. Scores are replaced by the number of
thresholds of the grid that they pass, rows are counted per (early level, confirm level,
state), and suffix sums over that small table give every policy's counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.events import runs
from wattloom.plans.halo import with_frames

Keys = Sequence[str]


def cal_thresholds(cal: DataFrame, pred: str, qs: Sequence[float], by: Keys) -> DataFrame:
    """(by, level, q, threshold): quantiles of calibration predictions; level counts from 1."""
    grid = F.percentile(pred, F.array(*[F.lit(q) for q in qs]))
    rows = cal.groupBy(*by).agg(grid.alias("_g")).select(*by, F.posexplode("_g").alias("level", "threshold"))
    names = F.array(*[F.lit(q) for q in qs])
    return rows.select(*by, (F.col("level") + 1).alias("level"), F.get(names, F.col("level")).alias("q"), "threshold")


def with_level(df: DataFrame, score: str, thresholds: DataFrame, by: Keys, name: str) -> DataFrame:
    """The number of thresholds that the score reaches; thresholds is a small table."""
    grid = thresholds.groupBy(*by).agg(F.sort_array(F.collect_list("threshold")).alias("_grid"))
    passed = F.size(F.filter("_grid", lambda x: x <= F.col(score)))
    return df.join(grid, list(by)).withColumn(name, F.when(F.col(score).isNotNull(), passed).otherwise(0)).drop("_grid")


def single_sweep(df: DataFrame, level: str, future: str, qs: int, by: Keys) -> DataFrame:
    """tp and fp of `level >= i` for i = 1..qs."""
    counts = df.groupBy(*by, F.col(level).alias("_l")).agg(F.sum(future).alias("_tp"), F.sum(1 - F.col(future)).alias("_fp"))
    cut = counts.withColumn("early", F.explode(F.sequence(F.lit(1), F.lit(qs))))
    hit = lambda c: F.sum(F.when(F.col("_l") >= F.col("early"), F.col(c)).otherwise(0))
    return cut.groupBy(*by, "early").agg(hit("_tp").alias("tp"), hit("_fp").alias("fp"))


def pair_sweep(df: DataFrame, early: str, confirm: str, unsure: str, future: str, qs: int, by: Keys) -> DataFrame:
    """tp, fp and advisories of every (early, confirm, gate) from one histogram.

    Gates: none (early and confirmed), advisory_if_unsure (the same, unconfirmed unsure
    rows become advisories), confirm_only_if_unsure (sure rows need no confirmation)."""
    h = df.groupBy(*by, F.col(early).alias("_e"), F.col(confirm).alias("_c"), F.col(unsure).alias("_u")).agg(F.sum(future).alias("_t"), F.count("*").alias("_n"))
    grid = F.sequence(F.lit(1), F.lit(qs))
    g = h.withColumn("early", F.explode(grid)).where("_e >= early").withColumn("confirm", F.explode(grid))
    conf = F.col("_c") >= F.col("confirm")
    free = conf | (F.col("_u") == 0)
    part = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    s = g.groupBy(*by, "early", "confirm").agg(
        part(conf, "_t").alias("t0"), part(conf, "_n").alias("n0"), part(free, "_t").alias("t2"), part(free, "_n").alias("n2"), part(~conf & (F.col("_u") == 1), "_n").alias("adv"), F.sum("_n").alias("n_early")
    )
    gate = lambda n, t, k, a: F.struct(F.lit(n).alias("gate"), F.col(t).alias("tp"), (F.col(k) - F.col(t)).alias("fp"), a.alias("advisories"))
    gates = F.array(gate("none", "t0", "n0", F.lit(0).cast("long")), gate("advisory_if_unsure", "t0", "n0", F.col("adv")), gate("confirm_only_if_unsure", "t2", "n2", F.col("adv")))
    return s.select(*by, "early", "confirm", ((F.col("n_early") - F.col("n0")) / F.col("n_early")).alias("rejection"), F.inline(gates))


def composite(flags: dict[str, Column]) -> dict[str, Column]:
    """OR, two of all, the longest alone, escalation (long and short)."""
    values = list(flags.values())
    total = sum((v.cast("int") for v in values[1:]), values[0].cast("int"))
    return {"any": (total >= 1).cast("int"), "two": (total >= 2).cast("int"), "long_only": values[-1].cast("int"), "escalate": (values[-1] & values[0]).cast("int")}


def cost_curve(curve: DataFrame, ratios: Sequence[float], fp: str = "fp", missed: str = "missed", events: str = "n_events") -> DataFrame:
    """Normalised expected cost (fp + r * missed) / (r * events) for every ratio r."""
    r = curve.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    return r.withColumn("cost", (F.col(fp) + F.col("ratio") * F.col(missed)) / F.nullif(F.col("ratio") * F.col(events), F.lit(0.0)))


def best_points(curve: DataFrame, scopes: dict[str, Column], by: Keys, order: Keys) -> DataFrame:
    """Cheapest row per scope; of equals the first in order."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))
    s = curve.withColumn("scope", F.explode(tags))
    rows = F.struct(*[c for c in curve.columns if c not in by])
    return s.groupBy(*by, "scope").agg(F.min_by(rows, F.struct(F.round("cost", 12), *order)).alias("_b")).select(*by, "scope", "_b.*")


def pareto(curve: DataFrame, by: Keys, cost: str = "cost", gain: str = "lead") -> DataFrame:
    """Rows that no cheaper row beats in gain: by rising cost, kept where the gain is over
    every one before."""
    w = Window.partitionBy(*by).orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    d = curve.where(F.col(gain).isNotNull()).withColumn("_best", F.max(gain).over(w))
    return d.where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def k_of_m(flag: str, k: int, m: int, keys: Keys, t: str) -> Column:
    """Delay timer: at least k flags among the last m rows."""
    return (F.sum(flag).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-m + 1, 0)) >= k).cast("int")


def smooth(p: str, m: int, keys: Keys, t: str) -> Column:
    """Moving mean of the last m rows, fewer at the start."""
    return F.avg(p).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-m + 1, 0))


def rate_cut(cal: DataFrame, score: str, rates: Sequence[float], by: Keys) -> DataFrame:
    """Cuts that give each alert rate on the calibration scores."""
    cuts = F.percentile(score, F.array(*[F.lit(1 - r) for r in rates]))
    return cal.groupBy(*by).agg(cuts.alias("_c")).select(*by, F.posexplode("_c").alias("_k", "cut")).select(*by, F.get(F.array(*[F.lit(r) for r in rates]), F.col("_k")).alias("rate"), "cut")


def matched_budget(curve: DataFrame, column: str, goals: Sequence[float], by: Keys, order: Keys) -> DataFrame:
    """The row nearest to each goal; of equals the first in order."""
    g = curve.withColumn("goal", F.explode(F.array(*[F.lit(float(x)) for x in goals])))
    rows = F.struct(*[c for c in curve.columns if c not in by])
    return g.groupBy(*by, "goal").agg(F.min_by(rows, F.struct(F.round(F.abs(F.col(column) - F.col("goal")), 12), *order)).alias("_b")).select(*by, "goal", "_b.*")


def target_time(df: DataFrame, stages: dict[str, int], columns: Keys, keys: Keys, step: str) -> DataFrame:
    """One row per target step with the columns as decided `ahead` steps before: equi joins
    on the shifted step, all on the same partitioning."""
    out = None
    for name, ahead in stages.items():
        part = df.select(*keys, (F.col(step) + ahead).alias(step), *[F.col(c).alias(f"{c}_{name}") for c in columns])
        out = part if out is None else out.join(part, [*keys, step])
    return out


def sequential_state(early: Column, confirm: Column) -> Column:
    """State of a target: confirmed if watched and confirmed, rejected if watched and not."""
    return F.when(early & confirm, "confirmed").when(early, "rejected").when(confirm, "late").otherwise("quiet")


TIERS = ("HUMAN_REVIEW", "WARN_ONLY", "ADVISE", "MONITOR", "AUTO", "AUTO_NORMAL")


def tier(band: Column, risky: Column) -> Column:
    """Confidence tier of a row by band and whether its risk is over the cut: automatic action
    only in the HIGH band, advice in MEDIUM, a warning alone in LOW whatever the risk."""
    return F.when(band == "OOD", TIERS[0]).when(band == "LOW", TIERS[1]).when((band == "MEDIUM") & risky, TIERS[2]).when(band == "MEDIUM", TIERS[3]).when(risky, TIERS[4]).otherwise(TIERS[5])


GATES = ("none", "advisory_if_unsure", "confirm_only_if_unsure")


def event_sweep(df: DataFrame, peak: str, early: str, confirm: str, unsure: str, k: int, qs: int, by: Keys, step: str, minutes: int = 15, least_lead: int = 30, day: str | None = None) -> DataFrame:
    """Events, detected events, mean lead and the share of leads of at least least_lead
    minutes, of every policy: (kind, early, confirm, gate).

    An event is a run of peaks (gap 2). It is detected by an alert in the k steps before its
    first; the lead is that of the first such alert. Each event is the few rows before it as
    (steps ahead, early level, confirm level, unsure); equal ones are counted first, and only
    these patterns meet the grid. Kinds are `single_early` and `single_confirm` (which looks
    one step back only) and `escalate`. With a day column, events are counted by the day of
    their onset."""
    look = F.collect_list(F.struct(F.col(step).alias("t"), F.col(early).alias("e"), F.col(confirm).alias("c"), F.col(unsure).alias("u")))
    seen = with_frames(df, by, step, k, 0, lambda w: {"_look": look.over(w.rowsBetween(-k, -1))})
    ev = runs(seen, peak, by, step, 2, look=F.min_by("_look", step), **({day: F.min_by(day, step)} if day else {}))
    by = [*by, day] if day else by
    ahead = F.sort_array(F.transform("look", lambda r: F.struct((F.col("first") - r["t"]).alias("a"), r["e"].alias("e"), r["c"].alias("c"), r["u"].alias("u"))), asc=False)
    p = ev.select(*by, ahead.alias("p")).groupBy(*by, "p").agg(F.count("*").alias("n"))
    grid = F.sequence(F.lit(1), F.lit(qs))
    g = p.withColumn("i", F.explode(grid))

    def first(rows: DataFrame, kind: str, cond, e, c, gate) -> DataFrame:
        hit = F.get(F.filter("p", cond), F.lit(0))["a"]
        return rows.select(*by, "n", F.lit(kind).alias("kind"), e.alias("early"), c.alias("confirm"), gate.alias("gate"), hit.alias("a"))

    none = F.lit(None).cast("int")
    parts = [first(g, "single_early", lambda r: r["e"] >= F.col("i"), F.col("i"), none, F.lit("none")), first(g, "single_confirm", lambda r: (r["c"] >= F.col("i")) & (r["a"] <= 1), none, F.col("i"), F.lit("none"))]
    pair = g.withColumn("j", F.explode(grid))
    both = pair.withColumn("gate", F.explode(F.array(*[F.lit(x) for x in GATES])))
    parts.append(first(both, "escalate", lambda r: (r["e"] >= F.col("i")) & ((r["c"] >= F.col("j")) | ((F.col("gate") == GATES[2]) & (r["u"] == 0))), F.col("i"), F.col("j"), F.col("gate")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lead = F.when(F.col("a").isNotNull(), F.least(F.col("a"), F.lit(k)) * minutes)
    found = F.sum(F.when(F.col("a").isNotNull(), F.col("n")).otherwise(0))
    return rows.groupBy(*by, "kind", "early", "confirm", "gate").agg(
        F.sum("n").alias("n_events"),
        found.alias("detected"),
        (F.sum("n") - found).alias("missed"),
        (F.sum(lead * F.col("n")) / F.nullif(found, F.lit(0))).alias("lead"),
        (F.sum(F.when(lead >= least_lead, F.col("n")).otherwise(0)) / F.nullif(found, F.lit(0))).alias("lead_share"),
    )


def policy_curve(steps: DataFrame, singles: DataFrame, events: DataFrame, days: DataFrame, by: Keys) -> DataFrame:
    """Step counts of pairs and singles with the events of the same policy, and loads a day.
    All are tables with a row per policy; null levels join as null."""
    every = steps.withColumn("kind", F.lit("escalate")).unionByName(singles)
    on = ["kind", "early", "confirm", "gate"]
    cond = [every[c] == events[c] for c in by] + [every[c].eqNullSafe(events[c]) for c in on]
    joined = every.join(events, cond).select(*[every[c] for c in every.columns], *[events[c] for c in events.columns if c not in (*by, *on)])
    d = joined.join(days, list(by))
    return d.withColumns({"false_a_day": F.col("fp") / F.col("days"), "advisories_a_day": F.col("advisories") / F.col("days")}).drop("days")


def timer_score(p: str, k: int, m: int, keys: Keys, t: str) -> Column:
    """The score whose cut is the timer `k of the last m rows over the cut`: the k-th largest
    of the last m values; null where there are fewer than k."""
    last = F.collect_list(p).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-m + 1, 0))
    return F.get(F.sort_array(last, asc=False), F.lit(k - 1))


def timer_settings(df: DataFrame, p: str, smooths: Sequence[int], timers: Sequence[tuple[int, int]], keys: Keys, t: str) -> DataFrame:
    """Every row once per setting (smooth, k, m) with its score z: smoothing and timer turn a
    cut's alerts into `z >= cut`, so one ranking serves every cut."""
    d = df.withColumns({f"_s{s}": smooth(p, s, keys, t) for s in smooths})
    d = d.withColumns({f"_z{s}_{k}_{m}": timer_score(f"_s{s}", k, m, keys, t) for s in smooths for k, m in timers})
    each = F.array(*[F.struct(F.lit(s).alias("smooth"), F.lit(k).alias("k"), F.lit(m).alias("m"), F.col(f"_z{s}_{k}_{m}").alias("z")) for s in smooths for k, m in timers])
    return d.select(*df.columns, F.inline(each))


def rate_choice(cal: DataFrame, score: str, label: str, rates: Sequence[float], by: Keys) -> DataFrame:
    """(by, rate, f1): the alert rate whose quantile cut has the best F1 on calibration rows;
    of equals the largest rate."""
    qs = sorted(round(1 - r, 9) for r in rates)
    level = with_level(cal, score, cal_thresholds(cal, score, qs, by), by, "_level")
    s = single_sweep(level, "_level", label, len(qs), by).join(cal.groupBy(*by).agg(F.sum(label).alias("_p")), list(by))
    f1 = F.round(F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("_p"), F.lit(0)), F.lit(0.0)), 12)
    best = s.groupBy(*by).agg(F.max_by(F.struct("early", f1.alias("f1")), F.struct(f1, -F.col("early"))).alias("_b"))
    return best.select(*by, F.round(1 - F.get(F.array(*[F.lit(q) for q in qs]), F.col("_b.early") - 1), 9).alias("rate"), "_b.f1")


def rate_alerts(test: DataFrame, score: str, choice: DataFrame, rates: Sequence[float], by: Keys, name: str) -> DataFrame:
    """test with the alerts of a chosen rate, as a quantile of test's own scores per group."""
    qs = sorted(round(1 - r, 9) for r in rates)
    cuts = cal_thresholds(test, score, qs, by).select(*by, F.round(1 - F.col("q"), 9).alias("rate"), "threshold")
    at = cuts.join(choice.select(*by, "rate"), [*by, "rate"]).select(*by, F.col("threshold").alias("_cut"))
    return test.join(at, list(by), "left").withColumn(name, F.coalesce((F.col(score) >= F.col("_cut")).cast("int"), F.lit(0))).drop("_cut")


def op_rules(df: DataFrame, score: str, label: str, rates: Sequence[float], by: Keys, fold: str) -> DataFrame:
    """TEST rows with the alerts of four rules for the operating point, chosen on CAL rows: the
    best F1 cut of each fold (r1), the best alert rate of each fold (r2), the pooled cut (r3),
    the pooled rate applied to each fold's scores (r4)."""
    from wattloom.operators.metrics import best_f1_cut

    cal, test = df.where("role = 'CAL'"), df.where("role = 'TEST'")
    each = [*by, fold]
    cut = lambda keys, name: best_f1_cut(cal, label, score, keys, True).select(*keys, F.col("cut").alias(name))
    d = test.join(cut(each, "_c1"), each, "left").join(cut(by, "_c3"), list(by), "left")
    on = lambda c: F.coalesce((F.col(score) >= F.col(c)).cast("int"), F.lit(0))
    d = d.withColumns({"r1": on("_c1"), "r3": on("_c3")}).drop("_c1", "_c3")
    d = rate_alerts(d, score, rate_choice(cal, score, label, rates, each), rates, each, "r2")
    pooled = rate_choice(cal, score, label, rates, by).join(test.select(*each).distinct(), list(by))
    return rate_alerts(d, score, pooled, rates, each, "r4")
