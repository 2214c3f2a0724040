"""Queries without a twin run and have the rows that they promise; every kind of classifier fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom import queries as meter
from wattloom.operators import diagnosis, metrics
from wattloom.operators import models as ml


@pytest.mark.parametrize("kind", ["logistic", "nb", "dt", "rf", "gbt", "mlp"])
@pytest.mark.parametrize("balanced", [False, True])
def test_every_classifier(spark, kind, balanced):
    if kind == "mlp" and balanced:
        pytest.skip("has no weights")
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a + 0.3 * b > 0.5)) for a, b in rng.normal(size=(300, 2))]
    d = spark.createDataFrame(rows, "a double, b double, label int")
    p = ml.predict_probability(ml.fit_classifier(d, ["a", "b"], "label", kind, balanced), d)
    assert set(p.columns) == {"a", "b", "label", "p"}
    r = p.groupBy("label").agg(F.avg("p").alias("p"), F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("label").collect()
    assert r[0]["p"] + 0.2 < r[1]["p"] and min(x["lo"] for x in r) >= 0 and max(x["hi"] for x in r) <= 1


#: Rows that a query has on the fixture: series x variants x horizons, and so on.
ROWS = {
    "m7_point_lasso": 5 * 4 * 5, "m17_state_models": 5 * 4 * 5, "m18_duplicate_variants": 5 * 4 * 4, "m19_mode_gate": 5 * 4, "m21_ablation": 5 * 6 * 4, "m22_information_ablation": 5 * 8 * 4,
    "m24_distance_weight": 5 * 2 * 4, "m25_transfer": 5 * 4 * 5, "m35_feature_families": 8, "m37_split_contrast": 3, "m38_refit_all": 5 * 4,
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_queries_over_all_folds_and_horizons(spark, sf, name):
    rows = meter.QUERIES[name](spark, sf).collect()
    assert len(rows) == ROWS[name]
    for c in ("mae", "local_mae", "auc", "mean_forecast"):
        if c in rows[0].asDict():
            assert all(r[c] is not None and np.isfinite(r[c]) for r in rows)


def test_variants_share_one_test_set(spark, sf):
    rows = meter.QUERIES["m18_duplicate_variants"](spark, sf).collect()
    n = {}
    for r in rows:
        n.setdefault((r["series_id"], r["horizon"]), set()).add(r["n"])
    assert all(len(v) == 1 for v in n.values())


def test_flag_validation_by_hand(spark):
    rows = [("a", 1, 10.0, 0, 1), ("a", 1, 2.0, 1, 0), ("a", 0, 1.0, 1, 0), ("a", 0, 3.0, 1, 1), ("a", 0, 2.0, 0, 0)]
    d = spark.createDataFrame(rows, "k string, f int, err double, hit int, pk int")
    r = diagnosis.flag_validation(d, ["f"], "err", "hit", "pk", ["k"], high=0.75).first()  # large: over 3.0, two rows
    assert (r["n"], r["share"], r["mae_in"], r["mae_out"]) == (2, 0.4, 6.0, 2.0) and r["mae_ratio"] == 3.0
    assert (r["coverage_in"], r["peaks_in"]) == (0.5, 0.5) and r["coverage_out"] == pytest.approx(2 / 3)
    assert r["auc"] == pytest.approx(0.5 + (1 / 2 - 1 / 3) / 2) and r["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.4) and r["lift"] == pytest.approx(0.45 / 0.4)


def test_screening_power_by_hand(spark):
    d = spark.createDataFrame([("a", 0.9, 1, 1.0), ("a", 0.8, 0, 2.0), ("a", 0.7, 1, 3.0), ("a", 0.1, 0, 2.0), ("a", 0.5, None, 9.0)], "k string, p double, y int, e double")
    r = metrics.screening_power(d, "y", "p", "e", ["k"]).first()
    assert (r["n"], r["n_peak"], r["prevalence"], r["mae"], r["auc"]) == (4, 2, 0.5, 2.0, 0.75)
    assert r["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and r["ap_lift"] == pytest.approx(r["ap"] / 0.5)
