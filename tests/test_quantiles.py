"""Exact quantiles by ranges, and the queries that use them."""

import numpy as np
from pyspark.sql import functions as F

from wattloom.operators import audit as au, stats as st
from wattloom.plans.quantiles import quantiles
from wattloom.queries import QUERIES


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), None if i % 17 == 0 else float(rng.integers(0, 40) / 8 + g)) for i, g in enumerate(rng.integers(0, 3, 500))] + [(5, 1.5), (6, None), (7, -0.0), (7, 0.0)]
    d = spark.createDataFrame(rows, "g int, x double").repartition(5)
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.975, 1.0]
    want = F.percentile("x", F.array(*[F.lit(q) for q in qs]))
    assert [list(r) for r in quantiles(d, "x", qs).collect()] == [list(r) for r in d.agg(want).collect()]
    got = {r["g"]: r["_q"] for r in quantiles(d, "x", qs, ["g"]).collect()}
    assert got == {r["g"]: r["q"] for r in d.groupBy("g").agg(want.alias("q")).where("g <> 6").collect()}
    assert quantiles(d.where("g = 6"), "x", [0.5]).collect()[0]["_q"] == [None]


def holds_distinct_values(df):
    """An exact percentile keeps all distinct values of a group in one task."""
    return "percentile(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_bins_without_a_task_of_all_values(spark, sf):
    assert not holds_distinct_values(QUERIES["a12_equal_bins"](spark, sf))
    d = spark.createDataFrame([(k % 2, float(k), k % 3, float(k % 7) if k % 5 else None) for k in range(60)], "g int, x double, y int, s double")
    got = au.equal_bins(d, "x", "y", "s", 4, ["g"]).collect()
    assert sorted((r["g"], r["bin"], r["n"]) for r in got) == [(g, b, n) for g in (0, 1) for b, n in enumerate((8, 7, 7, 8))]


def test_two_regimes_without_a_task_of_all_values(spark, sf):
    assert not holds_distinct_values(QUERIES["a15_two_regimes"](spark, sf))


def test_block_ranks_over_ranges_and_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(int(f), None if k % 29 == 0 else float(np.round(rng.normal(), int(f) + 1)), int(rng.integers(0, 4)), k % 3 % 2) for f in range(3) for k in range(400)]
    d = spark.createDataFrame(rows, "form int, v double, _b int, _y int").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {(r["form"], r["_b"]): (r["n"], r["pos"], r["r"], r["rp"]) for r in st.block_ranks(d, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for form, v, b, y in rows:
        if v is not None:
            others = [w for f, w, _, _ in rows if f == form and w is not None]
            rank = sum(w < v for w in others) + (sum(w == v for w in others) + 1) / 2
            n, pos, r, rp = want.get((form, b), (0, 0, 0, 0))
            want[form, b] = n + 1, pos + y, r + rank, rp + y * rank
    assert got == want
