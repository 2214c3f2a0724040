"""Expanding quantiles by two levels of order statistics equal those of a growing list."""

import random

import pandas as pd
import pytest

from wattloom.plans.expanding import expanding_quantile


@pytest.mark.parametrize("chunk, bucket", [(1, 1), (2, 7), (7, 2), (16, 16), (64, 5), (4096, 4096)])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_every_size_of_chunk_and_bucket(spark, chunk, bucket, q):
    rng = random.Random(chunk * 10 + bucket)
    rows = []
    for k, n in (("a", 90), ("b", 40), ("c", 1), ("d", 30)):
        for t in range(n):
            rows.append((k, t, None if k == "d" or rng.random() < 0.15 else float(rng.choice([rng.randrange(5), rng.gauss(0, 50)]))))
    d = spark.createDataFrame(rows, "k string, t long, x double")
    got = {(r["k"], r["t"]): r["thr_expanding"] for r in expanding_quantile(d, "x", q, 3, ["k"], "t", chunk=chunk, bucket=bucket).collect()}
    f = pd.DataFrame(rows, columns=["k", "t", "x"])
    assert len(got) == len(rows)
    for k, g in f.groupby("k"):
        want = g["x"].expanding(min_periods=3).quantile(q).shift(1)
        for t, w in zip(g["t"], want):
            assert (pd.isna(w) and got[k, t] is None) or abs(got[k, t] - w) < 1e-12, (k, t, w, got[k, t])


def test_no_rows(spark):
    assert expanding_quantile(spark.createDataFrame([], "k string, t long, x double"), "x", 0.95, 3, ["k"], "t").collect() == []
