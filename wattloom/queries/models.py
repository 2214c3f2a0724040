"""Fitted models on the demand fixture: rows-only for the driver, properties in tests.

Linear forecasts run over 5 rolling-origin folds and 4 horizons, trees and classifiers over
the 5 folds at the 60-minute horizon."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform
from wattloom.operators import clean, features as ft, intervals as iv, linear as ln, metrics as mt, models as ml, scoring as sc, stats as st
from wattloom.queries.meter import W, weather
from wattloom.queries.base import K, S, SCORED, register, scored, shots, table
from wattloom.session import cut, scratch

X = ["kw", "score", "seasonal", "ramp4", "hour", "is_operating"]
FOLDS = 5
LINEAR = ("ridge", "lasso", "elastic", "ols")


def rows_of(spark, sf):
    """Decision rows with targets of 4 horizons."""
    d = scored(spark, sf).withColumns({"ramp4": F.coalesce("ramp4", F.lit(0.0)), "is_operating_lag4": F.coalesce(F.lag("is_operating", 4).over(ft.over(K, S)), F.col("is_operating"))})
    d = ft.targets(d, "kw", [1, 2, 3, 4], K, S).dropna(subset=["y_h1", "y_h4"])
    d = d.withColumns({"clean": (F.col("ts15") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int"), "day": F.to_date("ts15")} | ft.cyclic(clean.slot_of_day("ts15"), 96, 2, "tod"))
    return d.drop("fold")


def frame(spark, sf, folds=FOLDS):
    """rows_of once per fold and role, computed once."""
    return cut(iv.rolling_origin(rows_of(spark, sf), folds, K, S))


YS = ["y_h1", "y_h2", "y_h3", "y_h4"]


def by_roles(spark, sf):
    """rows_of, each once, with its role in every fold and what else linear fits use; computed once."""
    d = ft.run_length(rows_of(spark, sf), "is_operating", K, S).withColumn("restart_recent", ((F.col("on_run_len") > 0) & (F.col("on_run_len") <= 8)).cast("int"))
    return cut(ln.roles(d, FOLDS, K, S))


def tests_of(d):
    """Rows with the one fold whose TEST they are in."""
    return d.withColumn("fold", F.instr("roles", "E") - 1).where("fold >= 0")


def fold_models(d, names, fits, by=(), letters="TC", least=0):
    """(fold, by..., model, intercept, coef) of every fit, all from one pass over d."""
    names = [*names, *YS]
    grams = ln.of_folds(ln.moments(d, names, [*by, "roles"]), FOLDS, letters, by, len(names))
    return ln.solve(grams.where(F.col("m")[0] >= least), names, fits)


def at_horizon(p):
    """p with model and horizon from `model|horizon`, and y at that horizon."""
    part = F.split("model", r"\|")
    p = p.withColumns({"horizon": part[1].cast("int"), "model": part[0]})
    return p.withColumn("y", F.element_at(F.array(*YS), F.col("horizon")))


def linear_over(d, names, fits):
    """Forecasts of TEST rows by every fit; folds x fits are few, so models go to the rows."""
    return at_horizon(ln.predict(tests_of(d), F.broadcast(fold_models(d, names, fits)), names, ["fold"]))


def parts(spark, sf):
    """Roles of the last of two folds."""
    d = frame(spark, sf, 2).where("fold = 1")
    return tuple(d.where(F.col("role") == r) for r in ("TRAIN", "CAL", "TEST"))


def errors(p, *by):
    return p.groupBy("series_id", *by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("kw"))).alias("naive_mae"))


def point_over(d, kind, features=X, horizons=(4,), folds=FOLDS):
    """TEST forecasts of every fold and horizon: models see TRAIN and CAL (M20)."""
    out = None
    for h in horizons:
        y = f"y_h{h}"
        each = lambda train, cal, test: ml.predict_point(ml.fit_point(train.unionByName(cal), features, y, kind, base="kw"), test, base="kw")  # noqa: B023, E731
        p = ml.over_folds(d, each, range(folds)).withColumns({"y": F.col(y), "horizon": F.lit(h)})
        out = p if out is None else out.unionByName(p)
    return out


#: Rows with their roles, and the fits of every fold and horizon, in SQL.
ROWS_SQL = SCORED + f""", fr as (select *, coalesce(ramp4, 0) r4, lead(kw, 1) over ({W}) y_h1, lead(kw, 2) over ({W}) y_h2, lead(kw, 3) over ({W}) y_h3, lead(kw, 4) over ({W}) y_h4 from scored),
nm as (select *, row_number() over ({W}) - 1 i_, count(*) over (partition by series_id) n_ from fr where y_h1 is not null and y_h4 is not null),
ro as (
  select nm.*, f.fold_, h.h, [y_h1, y_h2, y_h3, y_h4][h.h] yh,
    case when i_ >= n_ - (n_ // {FOLDS + 1}) * ({FOLDS} - f.fold_) + n_ // {FOLDS + 1} then '-' when i_ >= n_ - (n_ // {FOLDS + 1}) * ({FOLDS} - f.fold_) then 'E' else 'T' end role_
  from nm cross join range({FOLDS}) f(fold_) cross join (values (1), (2), (3), (4)) h(h)),
fit_ as (select * from ro where role_ = 'T'),
"""
X_SQL = ["kw", "score", "seasonal", "r4", '"hour"', "is_operating"]


def point_sql(penalty):
    return ROWS_SQL + ln.gram_sql("fit_", ["fold_", "h"], X_SQL, "yh - kw", penalty) + f"""
select series_id, ro.h horizon, ro.fold_ fold, count(*) n, avg(abs(yh - (kw + {ln.value_sql(X_SQL)}))) mae, avg(abs(yh - kw)) naive_mae
from ro join model on model.fold_ = ro.fold_ and model.h = ro.h where role_ = 'E' group by 1, 2, 3"""


POINT_SQL = {"ols": 0.0, "ridge": 1.0}
for _kind in LINEAR:

    @register(f"m7_point_{_kind}", "series_id horizon:i fold:i n:i mae:f naive_mae:f", point_sql(POINT_SQL[_kind]) if _kind in POINT_SQL else None)
    def point(spark, sf, kind=_kind):
        return errors(linear_over(by_roles(spark, sf), X, [ln.Fit.of(f"{kind}|{h}", X, f"y_h{h}", "kw", kind) for h in (1, 2, 3, 4)]), "horizon", "fold")


for _kind in ("dt", "rf", "gbt"):

    @register(f"m7_point_{_kind}", "series_id horizon:i fold:i n:i mae:f naive_mae:f")
    def tree_point(spark, sf, kind=_kind):
        return errors(point_over(frame(spark, sf), kind), "horizon", "fold")


def quantile_fold(train, cal, test, qs=(0.05, 0.95), names=("lo", "hi"), features=X):
    m, leaves = ml.fit_quantiles(train, features, "y", list(qs))
    leaves = cut(leaves)
    at = lambda d: ml.predict_quantiles(m, leaves, d, ["series_id", "step"], list(names))
    return at(cal), at(test)


@register("m8_leaf_quantiles", "series_id fold:i n:i coverage:f width:f over75:f over90:f")
def m8(spark, sf):
    def each(train, cal, test):
        c, t = quantile_fold(train, cal, test, (0.05, 0.75, 0.90, 0.95), ("lo", "q75", "q90", "hi"))
        return iv.conformal(c, t, "y", "lo", "hi", 0.1, K)

    p = ml.over_folds(frame(spark, sf), each, range(FOLDS))
    one = lambda c: F.avg(c.cast("int"))
    inside = (F.col("y") >= F.col("int_lo")) & (F.col("y") <= F.col("int_hi"))
    return p.groupBy("series_id", "fold").agg(F.count("*").alias("n"), one(inside).alias("coverage"), F.avg(F.col("int_hi") - F.col("int_lo")).alias("width"), one(F.col("y") > F.col("q75")).alias("over75"), one(F.col("y") > F.col("q90")).alias("over90"))


KINDS = ("logistic", "nb", "dt", "rf", "gbt", "mlp")


def probability_fold(kind, label="label"):
    """each(train, cal, test) with p_cal and the prior, for over_folds."""

    def each(train, cal, test):
        if kind == "vote":
            c, t = ml.vote(train, [cal.drop("p"), test.drop("p")], X, label, ["logistic", "nb", "dt"])
        elif kind == "stack":
            c = t = None
        else:
            m = ml.fit_classifier(train, X, label, kind.removesuffix("_balanced"), kind.endswith("_balanced"))
            c, t = ml.predict_probability(m, cal.drop("p")), ml.predict_probability(m, test.drop("p"))
        prior = train.agg(F.avg(label)).first()[0]
        if kind == "stack":
            return ml.stack(train, cal.drop("p"), test.drop("p"), X, label, ["logistic", "nb"]).withColumns({"p_cal": F.col("p"), "prior": F.lit(prior)})
        return ml.calibrate(c, t, label, "p").withColumn("prior", F.lit(prior))

    return each


for _name, _kind in [*[(f"m12_classifier_{k}", k) for k in KINDS], ("m13_balanced", "logistic_balanced"), ("m14_soft_vote", "vote"), ("m15_stacking", "stack")]:

    @register(_name, "series_id fold:i n:i brier:f prior_brier:f")
    def classifier(spark, sf, kind=_kind):
        t = ml.over_folds(frame(spark, sf), probability_fold(kind), range(FOLDS))
        square = lambda c: F.avg((F.col(c) - F.col("label")) ** 2)
        return t.groupBy("series_id", "fold").agg(F.count("*").alias("n"), square("p_cal").alias("brier"), square("prior").alias("prior_brier"))


@register("m17_state_models", "series_id horizon:i fold:i n:i mae:f naive_mae:f")
def m17(spark, sf):
    """A model per state with 500 rows or more, else that of all rows; states are not counted
    or listed on the driver."""
    d, x = by_roles(spark, sf), ["kw", "score", "seasonal"]
    fits = [ln.Fit.of(f"state|{h}", x, f"y_h{h}", None, "ridge") for h in (1, 2, 3, 4)]
    whole = fold_models(d, x, fits)
    own = fold_models(d.where("is_operating is not null"), x, fits, ["is_operating"], least=500)
    chosen = whole.select("fold", "model", F.col("intercept").alias("_i"), F.col("coef").alias("_c"))
    t = tests_of(d).join(F.broadcast(chosen), "fold").join(own, ["fold", "model", "is_operating"], "left")
    t = t.withColumns({"intercept": F.coalesce("intercept", "_i"), "coef": F.coalesce("coef", "_c")}).withColumn("pred", ln.value(x))
    return errors(at_horizon(t), "horizon", "fold")


def weighted_models(long, names, fits):
    """(fold, variant, model, intercept, coef) of training rows that stand once per fold and
    variant with a weight _w."""
    return ln.solve(ln.moments(long, [*names, *YS], ["fold", "variant"], "_w"), [*names, *YS], fits)


def training(d):
    """Rows of TRAIN and CAL, once per fold."""
    long = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    return long.where(F.substr("roles", F.col("fold") + 1, F.lit(1)).isin("T", "C"))


def each_weight(long, weights):
    return long.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), w.cast("double").alias("_w")) for n, w in weights.items()]))).select("*", "_v.*").drop("_v").where("_w > 0")


@register("m18_duplicate_variants", "series_id variant horizon:i n:i mae:f naive_mae:f")
def m18(spark, sf):
    """All rows, the first of each group of repeats, all weighted by one over their group's
    size, and clean rows alone: weights of one pass, on one fixed test set."""
    d = by_roles(spark, sf)
    group = Window.partitionBy("fold", "series_id", "kw", "score", "seasonal")
    long = training(d).withColumns({"_n": F.count("*").over(group), "_rn": F.row_number().over(group.orderBy(S))})
    long = each_weight(long, {"raw": F.lit(1), "first": F.col("_rn") == 1, "weighted": 1 / F.col("_n"), "clean": F.col("clean")})
    models = cut(weighted_models(long, X, [ln.Fit.of(f"m|{h}", X, f"y_h{h}", "kw", "ridge") for h in (1, 2, 3, 4)]))
    all_four = models.groupBy("fold").agg(F.count_distinct("variant").alias("_k")).where("_k = 4")  # early folds have no clean rows
    models = models.join(all_four, "fold", "left_semi")
    return errors(at_horizon(ln.predict(tests_of(d), F.broadcast(models), X, ["fold"])), "variant", "horizon")


PUBLIC = [*X, "tod_sin1", "tod_cos1", "tod_sin2", "tod_cos2"]


MODES = {"core": X, "public": PUBLIC}


def gates(d):
    """(fold, horizon, gain, peak_loss, width_loss, mode) by CAL forecasts of models of TRAIN;
    widths are those of the 90 % conformal interval of a mode's errors."""
    fits = [ln.Fit.of(f"{mode}|{h}", x, f"y_h{h}", "kw", "ridge") for mode, x in MODES.items() for h in (1, 2, 3, 4)]
    cal = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where(F.substr("roles", F.col("fold") + 1, F.lit(1)) == "C")
    p = at_horizon(ln.predict(cal, F.broadcast(fold_models(d, PUBLIC, fits, letters="T")), PUBLIC, ["fold"]))
    p = p.withColumn("peak", (F.col("y") >= F.col("thr")).cast("int"))
    wide = p.groupBy("fold", "horizon", "series_id", S, "y", "peak").pivot("model", list(MODES)).agg(F.first("pred"))
    wide = wide.withColumnsRenamed({m: f"pred_{m}" for m in MODES})
    width = lambda m: (2 * F.percentile(F.abs(F.col("y") - F.col(f"pred_{m}")), F.lit(0.9))).alias(f"width_{m}")
    widths = wide.groupBy("fold", "horizon").agg(*[width(m) for m in MODES])
    return ml.mode_gate(wide.join(F.broadcast(widths), ["fold", "horizon"]), "y", "peak", ["fold", "horizon"])


@register("m19_mode_gate", "fold:i horizon:i mode gain:f peak_loss:f width_loss:f")
def m19(spark, sf):
    return gates(by_roles(spark, sf))


@register("m38_refit_all", "series_id horizon:i mode n:i mean_forecast:f")
def m38(spark, sf):
    """At every horizon the mode that the last fold's gate takes, fitted on all history, on the
    rows of the last test block."""
    d = by_roles(spark, sf)
    mode = gates(d).where(F.col("fold") == FOLDS - 1).select(F.concat(F.lower("mode"), F.lit("|"), "horizon").alias("model"), "mode")
    fits = [ln.Fit.of(f"{m}|{h}", x, f"y_h{h}", "kw", "ridge") for m, x in MODES.items() for h in (1, 2, 3, 4)]
    models = ln.solve(ln.moments(d, [*PUBLIC, *YS], []), [*PUBLIC, *YS], fits).join(F.broadcast(mode), "model")
    new = tests_of(d).where(F.col("fold") == FOLDS - 1)
    p = new.crossJoin(F.broadcast(models)).withColumn("pred", ln.value(PUBLIC))  # one model a horizon
    return p.groupBy("series_id", F.split("model", r"\|")[1].cast("int").alias("horizon"), "mode").agg(F.count("*").alias("n"), F.avg("pred").alias("mean_forecast"))


SHUT = ["off_run_len", "on_run_len", "restart_recent"]
CYCLIC = PUBLIC[len(X) :]
#: Toggles of the recipe: residual target, cyclic features, relevance weights, shutdown features.
VARIANTS = {"A0_baseline": (False, False, False, False), "A1_resid": (True, False, False, False), "A2_cyclic": (False, True, False, False), "A3_extreme_weight": (False, False, True, False), "A4_shutdown_feat": (False, False, False, True), "A5_all": (True, True, True, True)}
INFORMATION = {"L0_power": ["kw", "score", "seasonal", "ramp4"], "L1_calendar": ["kw", "score", "seasonal", "ramp4", "hour", "tod_sin1", "tod_cos1"], "L2_weather": ["kw", "score", "seasonal", "ramp4", "hour", "tod_sin1", "tod_cos1", "temp", "temp_diff3h"], "L3_production": [*PUBLIC, "qty", "temp", "temp_diff3h"]}


#: What comes from outside a site, level by level: calendar, weather, sun and tariff.
EXTERNAL = {"E0_core": [], "E1_calendar": ["is_workday", "days_to_off"]}
EXTERNAL["E2_weather"] = [*EXTERNAL["E1_calendar"], "temp", "temp_diff3h"]
EXTERNAL["E3_tariff"] = [*EXTERNAL["E2_weather"], "solar_elevation", "is_daylight", "zone_peak", "zone_light"]


def external(spark, sf, d):
    """d with the external columns; gaps of the weather are filled for 6 hours, then by the site's mean."""
    days = d.select("day").distinct().withColumn("_off", F.lit(0))
    cal = ft.work_calendar(days, "day", "_off").select("day", "is_workday", "days_to_off")
    air = clean.ffill(weather(spark, sf), ["temp"], K, "ts", 6)
    air = ft.weather_derived(air, "temp", K, "ts").withColumn("_mean", F.avg("temp").over(Window.partitionBy("series_id")))
    air = air.select("series_id", F.col("ts").alias("_hour"), F.coalesce("temp", "_mean", F.lit(0.0)).alias("temp"), F.coalesce("temp_diff3h", F.lit(0.0)).alias("temp_diff3h"))
    d = d.withColumn("_hour", F.date_trunc("hour", "ts15").cast("timestamp_ntz")).join(cal, "day", "left").join(air, ["series_id", "_hour"], "left").drop("_hour")
    d = d.withColumns(ft.solar("ts15", 37.5, 127.0, 9)).withColumns({f"zone_{z}": (ft.load_zone("ts15") == z).cast("int") for z in ("peak", "light")})
    return d.fillna(0.0, ["temp", "temp_diff3h"]).fillna(0, ["is_workday", "days_to_off"])


@register("m21_ablation", "series_id variant horizon:i n:i mae:f naive_mae:f")
def m21(spark, sf):
    """Every recipe over all folds and horizons: plain ones from one pass, weighted ones from
    one more, in which a row stands once for each fold and horizon that weighs it."""
    d = by_roles(spark, sf)
    names = [*PUBLIC, *SHUT]

    def fit(name, h):
        residual, cyclic, _, shut = VARIANTS[name]
        return ln.Fit.of(f"{name}|{h}", [*X, *(CYCLIC if cyclic else []), *(SHUT if shut else [])], f"y_h{h}", "kw" if residual else None, "ridge")

    plain = fold_models(d, names, [fit(v, h) for v in VARIANTS if not VARIANTS[v][2] for h in (1, 2, 3, 4)])
    long = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where(F.substr("roles", F.col("fold") + 1, F.lit(1)).isin("T", "C"))
    long = long.withColumn("h", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3, 4)]))).withColumn("_y", F.element_at(F.array(*YS), F.col("h")))
    ends = long.groupBy("fold", "h").agg(F.percentile("_y", F.array(F.lit(0.9), F.lit(0.995))).alias("_e"))  # folds x horizons rows
    long = long.join(F.broadcast(ends), ["fold", "h"])
    place = (F.col("_y") - F.col("_e")[0]) / F.greatest(F.col("_e")[1] - F.col("_e")[0], F.lit(1e-6))
    grams = ln.moments(long.withColumn("_w", 1 + 4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))), [*names, *YS], ["fold", "h"], "_w")
    weighted = ln.solve(grams, [*names, *YS], [fit(v, h) for v in VARIANTS if VARIANTS[v][2] for h in (1, 2, 3, 4)])
    weighted = weighted.where(F.split("model", r"\|")[1].cast("int") == F.col("h")).drop("h")
    p = at_horizon(ln.predict(tests_of(d), F.broadcast(plain.unionByName(weighted)), names, ["fold"]))
    return errors(p.withColumnRenamed("model", "variant"), "variant", "horizon")


@register("m22_information_ablation", "series_id variant horizon:i n:i mae:f naive_mae:f ratio:f")
def m22(spark, sf):
    """Levels of information on the same rows, from one pass: errors, and their ratio to the
    best level's. L is what the site has; E adds what comes from outside it."""
    d = cut(external(spark, sf, by_roles(spark, sf)))
    names = [*PUBLIC, "qty", *EXTERNAL["E3_tariff"]]
    levels = INFORMATION | {k: [*X, *v] for k, v in EXTERNAL.items()}
    fits = [ln.Fit.of(f"{k}|{h}", x, f"y_h{h}", "kw", "ridge") for k, x in levels.items() for h in (1, 2, 3, 4)]
    e = errors(linear_over(d, names, fits).withColumnRenamed("model", "variant"), "variant", "horizon")
    best = F.min("mae").over(Window.partitionBy("series_id", "horizon", F.substring("variant", 1, 1)))
    return e.withColumn("ratio", F.col("mae") / F.nullif(best, F.lit(0.0)))


@register("m23_added_channel", "series_id variant coverage:f width:f low_share:f")
def m23(spark, sf):
    """Levels A, B, C of channels: what a channel changes in coverage, width and wide rows."""
    train, cal, test = parts(spark, sf)
    out = None
    for name, features in {"A_power": ["kw", "score", "seasonal"], "B_production": ["kw", "score", "seasonal", "is_operating", "qty"], "C_calendar": PUBLIC}.items():
        c, t = quantile_fold(train, cal, test, features=features)
        p = iv.conformal(c, t, "y", "lo", "hi", 0.1, K).withColumn("width", F.col("int_hi") - F.col("int_lo"))
        cal_w = iv.conformal(c, c, "y", "lo", "hi", 0.1, K).withColumn("width", F.col("int_hi") - F.col("int_lo"))
        b = iv.bands(p, "width", iv.width_cuts(cal_w, "width", K), K, F.lit(False))
        g = b.groupBy("series_id").agg(F.avg(F.col("y").between(F.col("int_lo"), F.col("int_hi")).cast("int")).alias("coverage"), F.avg("width").alias("width"), F.avg((F.col("band") == "LOW").cast("int")).alias("low_share")).withColumn("variant", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


@register("m24_distance_weight", "series_id variant horizon:i n:i mae:f naive_mae:f")
def m24(spark, sf):
    """Training rows weighted by their distance from TRAIN's centre, against plain ones."""
    d = by_roles(spark, sf)
    long = None
    for f in range(FOLDS):  # a covariance of four features a fold
        fit = training(d).where(F.col("fold") == f)
        train = fit.where(F.substr("roles", F.lit(f + 1), F.lit(1)) == "T")
        far, limit = iv.mahalanobis(train, fit, X[:4])
        part = ml.distance_weight(far, "maha", limit, "_far")
        long = part if long is None else long.unionByName(part)
    models = weighted_models(each_weight(long, {"plain": F.lit(1), "distance": F.col("_far")}), X, [ln.Fit.of(f"m|{h}", X, f"y_h{h}", "kw", "ridge") for h in (1, 2, 3, 4)])
    return errors(at_horizon(ln.predict(tests_of(d), F.broadcast(models), X, ["fold"])), "variant", "horizon")


@register("m25_transfer", "series_id horizon:i fold:i n:i local_mae:f others_mae:f naive_mae:f within_10:i beats_naive:i")
def m25(spark, sf):
    """Each site by its own model and by that of all other sites, whose moments are the total
    less its own; no loop over sites."""
    d = by_roles(spark, sf)
    names = [*X, *YS]
    own = ln.of_folds(ln.moments(d, names, ["series_id", "roles"]), FOLDS, "TC", ["series_id"], len(names))
    own = cut(own)  # a row per site and fold, read three times
    others = ln.without(ln.added(own, ["fold"], len(names)), own, ["fold"])
    fits = [ln.Fit.of(f"m|{h}", X, f"y_h{h}", "kw", "ridge") for h in (1, 2, 3, 4)]
    on = ["series_id", "fold", "model"]
    both = ln.solve(own, names, fits).join(ln.solve(others.select(*own.columns), names, fits).select(*on, F.col("intercept").alias("_i"), F.col("coef").alias("_c")), on)
    p = ln.predict(tests_of(d), both, X, ["series_id", "fold"], "local")
    p = at_horizon(p.withColumns({"intercept": F.col("_i"), "coef": F.col("_c")}).withColumn("others", ln.value(X)))
    err = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    g = p.groupBy("series_id", "horizon", "fold").agg(F.count("*").alias("n"), err("local").alias("local_mae"), err("others").alias("others_mae"), err("kw").alias("naive_mae"))
    return g.withColumns({"within_10": (F.col("others_mae") <= 1.1 * F.col("local_mae")).cast("int"), "beats_naive": (F.col("others_mae") < F.col("naive_mae")).cast("int")})


@register("m29_error_model", "series_id n:i mae:f spread:f auc:f")
def m29(spark, sf):
    """How well context tells the size of a forecast's error, and whether it is a large one."""
    train, cal, test = parts(spark, sf)
    m = ml.fit_point(train, X, "y", "ridge", base="kw")
    err = lambda d: ml.predict_point(m, d, "kw").withColumn("err", F.abs(F.col("y") - F.col("pred"))).drop("pred", "p")
    c, t = err(cal), err(test)
    limit = c.agg(F.percentile("err", F.lit(0.8))).first()[0]
    high = lambda d: d.withColumn("high", (F.col("err") >= limit).cast("int"))
    t = ml.predict_point(ml.fit_point(c, X, "err", "rf"), high(t), name="guess")
    t = ml.predict_probability(ml.fit_classifier(high(c), X, "high", "logistic"), t)
    auc = mt.roc_auc(t.withColumn("p", F.round("p", 9)), "high", "p", K)
    return t.groupBy("series_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("err") - F.col("guess"))).alias("mae"), F.avg(F.abs(F.col("err") - limit)).alias("spread")).join(auc, "series_id")


@register("m30_importance", "feature importance:f")
def m30(spark, sf):
    train, cal, _ = parts(spark, sf)
    m = ml.fit_point(train.unionByName(cal), X, "y", "rf", base="kw")
    return spark.createDataFrame(ml.importances(m, X), "feature string, importance double")


@register("m31_one_class", "label:i n:i outside:f")
def m31(spark, sf):
    """Distance from one class; the cut leaves 1 % of it outside."""
    x = [f"e{i}" for i in range(8)]
    e = cut(table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)]))
    normal = e.agg(F.min("label")).first()[0]
    d, limit = iv.mahalanobis(e.where(F.col("label") == normal), e, x)
    return d.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("maha") > limit).cast("int")).alias("outside"))


@register("m32_redundancy", "target r2:f")
def m32(spark, sf):
    d = cut(shots(spark, sf).withColumns({"ac": F.col("a") * F.col("c"), "acd": F.col("a") * F.col("c") * F.col("d")}))
    return spark.createDataFrame([(t, ml.redundancy(d, t, ["a", "b", "c", "d"])) for t in ("ac", "acd", "a")], "target string, r2 double")


BUNDLE = ["kw", "score", "seasonal", "ramp4", "hour", "is_operating"]


def bundle(spark, sf):
    """A saved and reloaded bundle, and the rows to score."""
    train, cal, test = parts(spark, sf)
    path = scratch(spark, "bundle")
    ml.save_bundle(path, *sc.fit_bundle(train, cal, BUNDLE, [1, 2, 3, 4], [0.5, 0.7, 0.9], K, S))
    return sc.load(spark, path, [1, 2, 3, 4]), test


def scored_rows(rows, loaded):
    return sc.score(rows, loaded, BUNDLE, 0.7, 0.9, "confirm_only_if_unsure", K, S)


OPERATOR = "series_id step:i forecast_h1:f forecast_h2:f forecast_h3:f forecast_h4:f interval_low_h4:f interval_high_h4:f reliability_h4 risk_h4:f early:i alert:i regime explained:i gap:i advisory_level"


@register("m33_batch_scoring", OPERATOR)
def m33(spark, sf):
    loaded, test = bundle(spark, sf)
    return scored_rows(test, loaded)


@register("s10_prediction_file", "series_id step:i " + " ".join(f"forecast_h{h}:f actual_h{h}:f" for h in (1, 2, 3, 4)))
def s10(spark, sf):
    loaded, test = bundle(spark, sf)
    path = scratch(spark, "predictions")
    scored_rows(test, loaded).select("series_id", S, *[f"forecast_h{h}" for h in (1, 2, 3, 4)], *[F.col(f"y_h{h}").alias(f"actual_h{h}") for h in (1, 2, 3, 4)]).write.parquet(path)
    return spark.read.parquet(path)


@register("w6_stream_scoring", OPERATOR)
def w6(spark, sf):
    """The rows of m33 as a stream: the same score on each batch."""
    from wattloom.streaming import streams as ss

    loaded, test = bundle(spark, sf)
    path = scratch(spark, "rows")
    test.write.parquet(path)
    return ss.score_stream(spark.readStream.schema(test.schema).parquet(path), lambda rows: scored_rows(rows, loaded), scratch(spark, "scored"))


FAMILIES = {"amplitude": ["a"], "level": ["b"], "shape": ["c", "d"], "all": ["a", "b", "c", "d"]}


def fold_aucs(d, names, fits, by=()):
    """(by..., model, fold, auc): linear discriminant scores of each fold by the moments of all
    other folds, the total less its own; no fit per family."""
    names = [*names, "_y"]
    d = d.withColumn("_y", F.col("label").cast("double"))
    own = cut(ln.moments(d, names, [*by, "fold"]))
    rest = ln.without(ln.added(own, list(by), len(names)), own, list(by)) if by else own.withColumnRenamed("m", "_own").crossJoin(F.broadcast(ln.added(own, [], len(names)))).withColumn("m", F.zip_with("m", "_own", lambda x, y: x - y)).drop("_own")
    models = ln.solve(rest.select(*by, "fold", "m"), names, fits)
    p = ln.predict(d, F.broadcast(models), names[:-1], [*by, "fold"]).withColumn("p", F.round("pred", 9))
    return mt.roc_auc(p, "label", "p", [*by, "model", "fold"])


@register("m35_feature_families", "family quantised:i auc:f folds:i")
def m35(spark, sf):
    """Mean AUC over five folds of whole machines, of every family, plain and quantised."""
    d = shots(spark, sf)
    d = cut(iv.group_kfold(d, "machine", "label", 5).withColumns({"a_q": clean.requantise("a", 5.0), "b_q": clean.requantise("b", 1000.0), "c_q": clean.requantise("c", 0.05), "d_q": clean.requantise("d", 0.05)}))
    names = ["a", "b", "c", "d", "a_q", "b_q", "c_q", "d_q"]
    fits = [ln.Fit.of(f"{family}|{q}", [f"{c}_q" for c in columns] if q else columns, "_y") for family, columns in FAMILIES.items() for q in (0, 1)]
    part = F.split("model", r"\|")
    return fold_aucs(d, names, fits).groupBy(part[0].alias("family"), part[1].cast("int").alias("quantised")).agg(F.avg("auc").alias("auc"), F.count("auc").alias("folds"))


@register("m36_baseline_table", "series_id model horizon:i mae:f difference:f low:f high:f")
def m36(spark, sf):
    """Models against the naive forecast at every horizon, with day-block intervals."""
    columns = ["series_id", "model", "horizon", "fold", "day", "y", "kw", "pred"]
    linear = linear_over(by_roles(spark, sf), X, [ln.Fit.of(f"ridge|{h}", X, f"y_h{h}", "kw", "ridge") for h in (1, 2, 3, 4)])
    p = linear.select(*columns).unionByName(linear.withColumns({"model": F.lit("naive"), "pred": F.col("kw")}).select(*columns))
    d = frame(spark, sf)
    for kind in ("rf", "gbt"):  # over the same folds
        p = p.unionByName(point_over(d, kind).withColumn("model", F.lit(kind)).select(*columns))
    p = cut(p)
    by = ["series_id", "model", "horizon"]
    boot = st.block_bootstrap(p, F.abs(F.col("y") - F.col("pred")), F.abs(F.col("y") - F.col("kw")), ["day"], by, 200, 4)
    return errors(p, "model", "horizon").join(boot, by)


@register("m37_split_contrast", "split auc:f folds:i")
def m37(spark, sf):
    """The same model under random folds of rows, folds of whole machines and folds of time."""
    d = cut(shots(spark, sf))
    groups = iv.group_kfold(d, "machine", "label", 5)
    leaky = d.withColumn("fold", F.floor(uniform(F.lit("leaky"), "id") * 5).cast("int"))
    ends = d.agg(F.percentile_approx(F.unix_date("day"), [0.2, 0.4, 0.6, 0.8], 10000).alias("_e"))
    late = d.crossJoin(F.broadcast(ends)).withColumn("fold", F.size(F.filter("_e", lambda e: e < F.unix_date("day")))).drop("_e")
    tagged = lambda rows, name: rows.select("id", "a", "b", "c", "d", "label", F.col("fold").cast("int").alias("fold"), F.lit(name).alias("split"))
    rows = cut(tagged(leaky, "leaky").unionByName(tagged(groups, "grouped")).unionByName(tagged(late, "temporal")))
    return fold_aucs(rows, ["a", "b", "c", "d"], [ln.Fit.of("lda", ["a", "b", "c", "d"], "_y")], ["split"]).groupBy("split").agg(F.avg("auc").alias("auc"), F.count("auc").alias("folds"))


@register("m39_classifier_benchmark", "model target window tp:i fp:i fn:i tn:i f1:f mcc:f")
def m39(spark, sf):
    """Classifiers on exact-slot and within-an-hour labels; the cut of best F1 on CAL."""
    train, cal, test = parts(spark, sf)
    within = lambda d: d.withColumn("within60", (F.greatest("y_h1", "y_h2", "y_h3", "y_h4") >= F.col("thr")).cast("int"))
    out = None
    for kind in ("logistic", "nb", "rf"):
        for target in ("label", "within60"):
            tr, ca, te = (within(d).drop("p") for d in (train, cal, test))
            m = ml.fit_classifier(tr, X, target, kind)
            c, t = (ml.predict_probability(m, d).withColumn("p", F.round("p", 9)) for d in (ca, te))
            best = mt.best_f1_cut(c, target, "p", K, True).select("series_id", "cut")
            t = t.join(best, "series_id", "left").withColumn("on", F.coalesce((F.col("p") >= F.col("cut")).cast("int"), F.lit(0)))
            t = clean.window_tags(t, F.col("clean") == 1).select("window", F.col(target).alias("y1"), "on", F.lit(kind).alias("model"), F.lit(target).alias("target"))
            out = t if out is None else out.unionByName(t)
    return mt.class_metrics(out, "y1", "on", ["model", "target", "window"])


@register("m40_reference_scores", "series_id naive:f scaled:f prior:f n:i", SCORED + """, c_ as (select series_id, min(kw - thr) a, max(kw - thr) b, avg("label") prior from scored where fold = 1 group by 1) select s.series_id, avg(kw - thr) naive, avg(greatest(0, least(1, (kw - thr - a) / nullif(b - a, 0)))) scaled, max(prior) prior, count(*) n from scored s join c_ on c_.series_id = s.series_id where fold > 1 group by 1""")
def m40(spark, sf):
    d = scored(spark, sf).withColumn("margin", F.col("kw") - F.col("thr"))
    c = d.where("fold = 1").groupBy("series_id").agg(F.min("margin").alias("a"), F.max("margin").alias("b"), F.avg("label").alias("prior"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("margin") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))))
    return d.where("fold > 1").join(c, "series_id").groupBy("series_id").agg(F.avg("margin").alias("naive"), F.avg(scaled).alias("scaled"), F.max("prior").alias("prior"), F.count("*").alias("n"))


@register("f18_forecast_margins", "series_id step:i margin:f q75_margin:f q90_margin:f")
def f18(spark, sf):
    def each(train, cal, test):
        p = ml.predict_point(ml.fit_point(train, X, "y", "ridge", base="kw"), test, base="kw")
        m, leaves = ml.fit_quantiles(train, X, "y", [0.75, 0.90])
        return ml.predict_quantiles(m, cut(leaves), p, ["series_id", "step"], ["q75", "q90"])

    p = ml.over_folds(frame(spark, sf), each, range(FOLDS))
    return p.select("series_id", S, *[(F.col(c) - F.col("thr")).alias(n) for c, n in (("pred", "margin"), ("q75", "q75_margin"), ("q90", "q90_margin"))])


def points(spark, sf):
    return cut(table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)]))


@register("x10_silhouette", "k:i silhouette:f")
def x10(spark, sf):
    return spark.createDataFrame([(k, s) for k, _, s, _ in ml.kmeans_check(points(spark, sf), [f"e{i}" for i in range(8)], [3], "label")], "k int, silhouette double")


@register("x16_stability", "other ari:f")
def x16(spark, sf):
    return ml.clustering_stability(points(spark, sf), [f"e{i}" for i in range(8)], "vec_id", 3, [7, 11, 13])


@register("m26_mixture_regimes", "regime n:i mean_kw:f")
def m26(spark, sf):
    train, _, test = parts(spark, sf)
    r = ml.mixture_regimes(train, test, ["kw", "score", "ramp4"], "kw", "ramp4")
    return r.groupBy("regime").agg(F.count("*").alias("n"), F.avg("kw").alias("mean_kw"))


@register("m27_kmeans_check", "k:i cost:f silhouette:f ari:f")
def m27(spark, sf):
    e = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    return spark.createDataFrame(ml.kmeans_check(cut(e), [f"e{i}" for i in range(8)], range(2, 7), "label"), "k int, cost double, silhouette double, ari double")


@register("m28_rule_leaves", "leaf:f n:i rate:f lift:f")
def m28(spark, sf):
    return ml.rule_leaves(shots(spark, sf), ["a", "b", "c", "d"], "label")


@register("m34_components", "vec_id:i pc1:f pc2:f")
def m34(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    return ml.components(e, [f"e{i}" for i in range(8)]).select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


@register("r4_mahalanobis", "label:i n:i outside:i")
def r4(spark, sf):
    x = [f"e{i}" for i in range(8)]
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)])
    d, limit = iv.mahalanobis(e, e, x)
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("maha") > limit).alias("outside"))
