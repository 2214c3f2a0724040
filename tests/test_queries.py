"""Registered queries against their DuckDB twins."""

import collections
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from wattloom import queries as meter




@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(meter.ORACLE))
def test_twin(spark, sf, duck, name):
    df = meter.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    q = duck.execute(meter.ORACLE[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = collections.Counter(tuple(norm(r[i]) for i in at) for r in q.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["w1_stream_demand", "w2_sliding_mean", "w3_sessions"])
def test_streams_of_shuffled_part_files(spark, sf, duck, tmp_path, name):
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    df = meter.QUERIES[name](spark, str(tmp_path))
    got = collections.Counter(tuple(norm(r[c]) for c in df.columns) for r in df.collect())
    q = duck.execute(meter.ORACLE[name])
    at = [[d[0] for d in q.description].index(c) for c in df.columns]
    assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in q.fetchall())


def test_mahalanobis_counts_every_row(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "embedding").collect()
    x = np.array([r["embedding"][:8] for r in rows], float)
    c = x - x.mean(0)
    far = ((c @ np.linalg.pinv(np.cov(x.T, ddof=0))) * c).sum(1)
    want = collections.Counter(r["label"] for r, f in zip(rows, far) if f > np.percentile(far, 99))
    got = {r["label"]: (r["n"], r["outside"]) for r in meter.QUERIES["r4_mahalanobis"](spark, sf).collect()}
    assert got == {k: (n, want[k]) for k, n in collections.Counter(r["label"] for r in rows).items()}


def test_kmeans_check_of_every_k(spark, sf):
    rows = meter.QUERIES["m27_kmeans_check"](spark, sf).collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5, 6] and all(-1 <= r["ari"] <= 1 for r in rows)
    from wattloom.operators import models as ml

    d = spark.createDataFrame([(float(10 * c + i % 3), c) for c in range(3) for i in range(30)], "x double, c int")
    assert {k: ari for k, _, _, ari in ml.kmeans_check(d, ["x"], [3], "c")} == {3: 1.0}


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(meter.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
