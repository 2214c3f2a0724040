"""Forecast and alert models with MLlib; quantile forecasts from tree leaves.

Fits are distributed; the driver loops over folds and horizons only. Features are numeric
columns without nulls: drop or fill first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.special import uniform
from wattloom.operators.stats import adjusted_rand

Names = Sequence[str]


def _regressor(kind: str, seed: int, weight: str | None):
    more = {"weightCol": weight} if weight else {}
    base = {"featuresCol": "features", "labelCol": "_target", "predictionCol": "_pred"}
    return {
        "gbt": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=seed, **base, **more),
        "rf": lambda: RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed, **base, **more),
        "dt": lambda: DecisionTreeRegressor(maxDepth=6, seed=seed, **base, **more),
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0, **base, **more),
        "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0, **base, **more),
        "elastic": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5, **base, **more),
        "ols": lambda: LinearRegression(**base, **more),
    }[kind]()


def fit_point(train: DataFrame, features: Names, y: str, kind: str = "gbt", base: str | None = None, weight: str | None = None, seed: int = 7) -> PipelineModel:
    """A point forecast; with base the target is the residual y - base."""
    target = F.col(y) - F.col(base) if base else F.col(y)
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), _regressor(kind, seed, weight)]
    return Pipeline(stages=stages).fit(train.withColumn("_target", target.cast("double")))


def predict_point(model: PipelineModel, df: DataFrame, base: str | None = None, name: str = "pred") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, F.col("_pred") + (F.col(base) if base else 0)).drop("_pred", "features")


def fit_quantiles(train: DataFrame, features: Names, y: str, qs: Sequence[float], trees: int = 5, depth: int = 5, seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """Leaf-quantile model: a forest's leaves, and the training quantiles of y in each leaf.
    The leaf table has at most trees * 2**depth rows."""
    forest = RandomForestRegressor(featuresCol="features", labelCol=y, predictionCol="_pred", leafCol="_leaf", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=20)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(train)
    leaves = model.transform(train).select(y, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
    return model, leaves.groupBy("tree", "leaf").agg(F.percentile(y, F.array(*[F.lit(q) for q in qs])).alias("_q"))


def predict_quantiles(model: PipelineModel, leaves: DataFrame, df: DataFrame, keys: Names, names: Names) -> DataFrame:
    """df with a column per quantile: the mean over trees of the leaf's quantile."""
    rows = model.transform(df).select(*keys, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
    q = rows.join(F.broadcast(leaves), ["tree", "leaf"]).groupBy(*keys).agg(*[F.avg(F.col("_q")[i]).alias(n) for i, n in enumerate(names)])
    return df.join(q, list(keys))


def fit_classifier(train: DataFrame, features: Names, label: str, kind: str = "logistic", balanced: bool = False, seed: int = 7) -> PipelineModel:
    n = len(features)
    base = {"featuresCol": "features", "labelCol": label, "predictionCol": "_class"}
    if balanced:
        share = train.agg(F.avg(label)).first()[0] or 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        train = train.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        base["weightCol"] = "_w"
    model = {
        "logistic": lambda: LogisticRegression(regParam=0.01, **base),
        "nb": lambda: NaiveBayes(modelType="gaussian", **base),
        "dt": lambda: DecisionTreeClassifier(maxDepth=5, seed=seed, **base),
        "rf": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **base),
        "gbt": lambda: GBTClassifier(maxIter=15, maxDepth=3, seed=seed, **base),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[n, 8, 2], maxIter=50, seed=seed, **{k: v for k, v in base.items() if k != "weightCol"}),
    }[kind]()
    model = model.setRawPredictionCol("_raw").setProbabilityCol("_prob")  # not all take these as keywords
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True), model]
    return Pipeline(stages=stages).fit(train)


def predict_probability(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("_prob")[1]).drop("_x", "features", "_raw", "_prob", "_class")


def calibrate(cal: DataFrame, test: DataFrame, label: str, p: str, name: str = "p_cal") -> DataFrame:
    """Isotonic calibration fitted on cal."""
    iso = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol=name)
    return iso.fit(cal.withColumn(label, F.col(label).cast("double"))).transform(test)


def soft_vote(df: DataFrame, columns: Names, name: str = "vote") -> DataFrame:
    return df.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


def state_models(train: DataFrame, test: DataFrame, features: Names, y: str, state: str, least: int = 500, kind: str = "ridge") -> DataFrame:
    """A model per state that has enough rows, and the model of all rows for the rest. test is
    read once: each model adds a column, and the row's state chooses."""
    out = predict_point(fit_point(train, features, y, kind), test, name="_all")
    pred = None
    for s, n in [(r[0], r[1]) for r in train.groupBy(state).count().collect()]:  # one row per state
        if s is None or n < least:
            continue
        out = predict_point(fit_point(train.where(F.col(state) == s), features, y, kind), out, name=f"_of_{s}")
        own = F.col(state) == s
        pred = F.when(own, F.col(f"_of_{s}")) if pred is None else pred.when(own, F.col(f"_of_{s}"))
    out = out.withColumn("pred", F.col("_all") if pred is None else pred.otherwise(F.col("_all")))
    return out.drop(*[c for c in out.columns if c == "_all" or c.startswith("_of_")])


def over_folds(frame: DataFrame, each: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], folds: Sequence[int]) -> DataFrame:
    """The union of each(train, cal, test) over the folds of a frame with fold and role. The
    driver loops over folds; every fit and forecast is distributed."""
    out = None
    for f in folds:
        d = frame.where(F.col("fold") == f)
        part = each(*(d.where(F.col("role") == r) for r in ("TRAIN", "CAL", "TEST")))
        out = part if out is None else out.unionByName(part)
    return out


def stack(train: DataFrame, cal: DataFrame, test: DataFrame, features: Names, label: str, bases: Sequence[str], top: str = "logistic") -> DataFrame:
    """Base classifiers fitted on train; their probabilities, beside the features, feed a
    classifier fitted on cal. test with p."""
    names = [f"_p_{k}" for k in bases]
    for kind, name in zip(bases, names):
        m = fit_classifier(train, features, label, kind)
        cal, test = predict_probability(m, cal, name), predict_probability(m, test, name)
    return predict_probability(fit_classifier(cal, [*features, *names], label, top), test).drop(*names)


def vote(train: DataFrame, parts: Sequence[DataFrame], features: Names, label: str, kinds: Sequence[str]) -> list[DataFrame]:
    """The parts with p, the mean probability of the kinds fitted on train."""
    names = [f"_p_{k}" for k in kinds]
    out = list(parts)
    for kind, name in zip(kinds, names):
        m = fit_classifier(train, features, label, kind)
        out = [predict_probability(m, d, name) for d in out]
    return [soft_vote(d, names, "p").drop(*names) for d in out]


def duplicate_variants(train: DataFrame, test: DataFrame, features: Names, y: str, base: str, group: Names, order: str, clean: Column, kind: str = "ridge") -> DataFrame:
    """test once per variant with pred: all rows, the first of each group of repeats, all rows
    weighted by one over their group's size, and clean rows alone; one fixed test."""
    w = Window.partitionBy(*group)
    d = train.withColumns({"_n": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy(order))}).withColumn("_w", 1.0 / F.col("_n"))
    sets = {"raw": (d, None), "first": (d.where("_rn = 1"), None), "weighted": (d, "_w"), "clean": (d.where(clean), None)}
    out = None
    for name, (rows, weight) in sets.items():
        part = predict_point(fit_point(rows, features, y, kind, base, weight), test, base).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mode_gate(cal: DataFrame, y: str, peak: str, by: Names, gain: float = 0.01, peak_loss: float = 0.02, width_loss: float = 0.05) -> DataFrame:
    """The mode of each group by its CAL figures: PUBLIC only if its MAE is lower by `gain`, its
    MAE at peaks higher by at most `peak_loss` and its intervals wider by at most `width_loss`.
    cal has pred_core, pred_public, width_core, width_public."""
    err = lambda m: F.abs(F.col(y) - F.col(f"pred_{m}"))
    at = lambda c: F.avg(F.when(F.col(peak) == 1, c))
    g = cal.groupBy(*by).agg(F.avg(err("core")).alias("a"), F.avg(err("public")).alias("b"), at(err("core")).alias("pa"), at(err("public")).alias("pb"), F.avg("width_core").alias("wa"), F.avg("width_public").alias("wb"))
    part = lambda a, b: a / F.nullif(b, F.lit(0.0))
    g = g.select(*by, part(F.col("a") - F.col("b"), F.col("a")).alias("gain"), part(F.col("pb") - F.col("pa"), F.col("pa")).alias("peak_loss"), part(F.col("wb") - F.col("wa"), F.col("wa")).alias("width_loss"))
    ok = (F.col("gain") >= gain) & (F.col("peak_loss") <= peak_loss) & (F.col("width_loss") <= width_loss)
    return g.withColumn("mode", F.when(F.coalesce(ok, F.lit(False)), "PUBLIC").otherwise("CORE"))


def relevance_weight(train: DataFrame, y: str, name: str = "_w") -> DataFrame:
    """train with 1 + 4 * the place of y between its p90 and p99.5, within 0 and 1."""
    lo, hi = train.agg(F.percentile(y, F.array(F.lit(0.9), F.lit(0.995)))).first()[0]
    return train.withColumn(name, 1 + 4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(y) - lo) / max(hi - lo, 1e-6))))


def distance_weight(train: DataFrame, maha: str, cut: float, name: str = "_w") -> DataFrame:
    """train with 1 + 3 * the place of its distance between the p80 and the cut."""
    lo = train.agg(F.percentile(maha, F.lit(0.8))).first()[0]
    return train.withColumn(name, 1 + 3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(maha) - lo) / max(cut - lo, 1e-6))))


def clustering_stability(df: DataFrame, features: Names, key: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """Adjusted Rand index of a k-means fit with the first seed against fits with other seeds
    (all rows) and against one fitted on a hashed half of the rows; all label all rows."""
    x = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True)]).fit(df).transform(df)
    half = x.where(uniform(F.lit("half"), key) < 0.5)
    fits = {f"seed_{s}": KMeans(k=k, seed=s, predictionCol=f"c_{s}").fit(x) for s in seeds} | {"half": KMeans(k=k, seed=seeds[0], predictionCol="c_half").fit(half)}
    for m in fits.values():
        x = m.transform(x)
    first = f"c_{seeds[0]}"
    others = [(n, f"c_{n.removeprefix('seed_')}") for n in fits if n != f"seed_{seeds[0]}"]
    long = x.select(F.col(first).alias("a"), F.inline(F.array(*[F.struct(F.lit(n).alias("other"), F.col(c).alias("b")) for n, c in others])))
    return adjusted_rand(long, "a", "b", ["other"])


def redundancy(df: DataFrame, target: str, features: Names) -> float:
    """R squared of a column explained linearly by others."""
    m = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), LinearRegression(featuresCol="features", labelCol=target)]).fit(df)
    return float(m.stages[-1].summary.r2)


def mixture_regimes(train: DataFrame, df: DataFrame, features: Names, level: str, ramp: str, k: int = 3, seed: int = 7) -> DataFrame:
    """Mixture clusters named by their training means: lowest level LOW, of the others the
    largest ramp TRANSITION, the rest STABLE."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True), GaussianMixture(k=k, seed=seed, predictionCol="cluster", probabilityCol="_p")]).fit(train)
    stats = pipe.transform(train).groupBy("cluster").agg(F.avg(level).alias("_l"), F.avg(F.abs(ramp)).alias("_r"))
    w = Window.partitionBy(F.lit(0))
    stats = stats.withColumn("_low", F.row_number().over(w.orderBy("_l", "cluster")) == 1)
    stats = stats.withColumn("_top", F.row_number().over(w.orderBy("_low", F.desc("_r"), "cluster")) == 1)
    name = F.when(F.col("_low"), "LOW").when(F.col("_top"), "TRANSITION").otherwise("STABLE")
    return pipe.transform(df).join(F.broadcast(stats.select("cluster", name.alias("regime"))), "cluster", "left").drop("_x", "features", "_p")


def kmeans_check(df: DataFrame, features: Names, ks: Sequence[int], label: str, seed: int = 7) -> list[tuple[int, float, float, float | None]]:
    """(k, cost, silhouette by squared distance, adjusted Rand index with label) for each k."""
    x = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True)]).fit(df).transform(df).select("features", F.col(label).alias("_label"))
    out = []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(x)
        t = m.transform(x)
        out.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(t)), adjusted_rand(t, "_label", "prediction").first()[0]))
    return out


def rule_leaves(df: DataFrame, features: Names, label: str, depth: int = 3, least: int = 50) -> DataFrame:
    """Leaves of a shallow tree: size, rate and lift."""
    tree = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", seed=7)
    m = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), tree]).fit(df)
    g = m.transform(df).groupBy("leaf").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    whole = Window.partitionBy(F.lit(0))
    return g.withColumn("lift", F.col("rate") / F.nullif(F.sum(F.col("n") * F.col("rate")).over(whole) / F.sum("n").over(whole), F.lit(0.0)))


def components(df: DataFrame, features: Names, k: int = 2) -> DataFrame:
    """Principal components as an array column."""
    m = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), PCA(k=k, inputCol="_x", outputCol="_pc")]).fit(df)
    return m.transform(df).withColumn("pc", vector_to_array("_pc")).drop("_x", "_pc")


def importances(model: PipelineModel, features: Names) -> list[tuple[str, float]]:
    return list(zip(features, map(float, model.stages[-1].featureImportances.toArray())))


def save_bundle(path: str, models: dict[str, PipelineModel], tables: dict[str, DataFrame]) -> None:
    """Models and parameter tables under one folder."""
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/models/{name}")
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_bundle(spark, path: str, models: Names, tables: Names) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in models}, {n: spark.read.parquet(f"{path}/tables/{n}") for n in tables}
