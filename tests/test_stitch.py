"""Runs and running values over chunks equal plain windows for every size of chunk."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.operators import events as ev
from wattloom.operators import features as ft
from wattloom.plans import halo, stitch

def W():
    return Window.partitionBy("k").orderBy("step")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for k in range(6):
        share = rng.choice([0.05, 0.3, 0.6, 0.97])
        for step in range(rng.choice([1, 7, 40, 53])):
            out.append((f"s{k}", step, int(rng.random() < share), rng.choice(["a", "a", "b", None]), round(rng.random(), 3)))
    return spark.createDataFrame(out, "k string, step long, flag int, state string, x double").cache()


def same(a, b, columns):
    key = lambda d: sorted(map(str, d.select(*columns).collect()))
    return key(a) == key(b)


SIZES = [(1, 1), (1, 3), (2, 2), (3, 1), (5, 4), (7, 100), (53, 2), (4096, 4096)]


@pytest.mark.parametrize("steps, fan", SIZES)
@pytest.mark.parametrize("gap", [1, 2, 9])
def test_run_ids(rows, steps, fan, gap):
    flagged = rows.where("flag = 1")
    new = F.coalesce((F.col("step") - F.lag("step").over(W()) > gap).cast("int"), F.lit(1))
    want = flagged.withColumn("new", new).withColumn("event_id", F.sum("new").over(W()))
    assert same(stitch.run_ids(rows, "flag", ["k"], "step", gap, steps, fan), want, ["k", "step", "event_id"])


@pytest.mark.parametrize("steps, fan", SIZES)
def test_run_length_and_rows_since(rows, steps, fan):
    s = F.struct("state")
    change = F.when(~F.lag(s).over(W()).eqNullSafe(s), 1).otherwise(F.when(F.row_number().over(W()) == 1, 1).otherwise(0))
    want = rows.withColumn("c", change).withColumn("r", F.sum("c").over(W()))
    want = want.withColumn("n", F.row_number().over(Window.partitionBy("k", "r").orderBy("step")))
    assert same(stitch.run_length(rows, "state", ["k"], "step", "n", steps, fan), want, ["k", "step", "n"])
    d = rows.withColumn("rn", F.row_number().over(W()))
    last = F.last(F.when(F.col("flag") == 1, F.col("rn")), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1))
    assert same(stitch.rows_since(rows, "flag", ["k"], "step", "n", steps, fan), d.withColumn("n", F.col("rn") - last - 1), ["k", "step", "n"])


@pytest.mark.parametrize("chunk", [1, 2, 3, 10, 100])
@pytest.mark.parametrize("back, ahead", [(0, 0), (1, 0), (0, 4), (8, 8), (3, 1)])
def test_frames_reach_over_borders(rows, chunk, back, ahead):
    columns = lambda w: {"n": F.count("*").over(w.rowsBetween(-back, ahead)), "s": F.round(F.sum("x").over(w.rowsBetween(-back, ahead)), 6)}
    assert same(halo.with_frames(rows, ["k"], "step", back, ahead, columns, chunk), rows.withColumns(columns(W())), ["k", "step", "n", "s"])


def test_no_window_holds_a_series(rows):
    keyed = rows.checkpoint()
    for d in (ev.runs(keyed, "flag", ["k"], "step"), ev.anatomy(keyed, "flag", "x", ["k"], "step"), ev.onsets(keyed, "flag", ["k"], "step"), ft.run_length(keyed, "flag", ["k"], "step"), ft.steps_since_peak(keyed, "flag", ["k"], "step"), ev.event_recall(keyed, "flag", "flag", 4, ["k"], "step")):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        keys = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
        assert keys and all("_chunk" in k or "_group" in k or "_w" in k for k in keys), plan


def test_empty_and_null(spark):
    d = spark.createDataFrame([], "k string, step long, flag int")
    assert stitch.run_ids(d, "flag", ["k"], "step").collect() == [] and stitch.run_length(d, "flag", ["k"], "step", "n").collect() == []
    d = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("a", 2, 1)], "k string, step long, flag int")
    assert [r["n"] for r in stitch.run_length(d, "flag", ["k"], "step", "n").orderBy("step").collect()] == [1, 2, 1]
    assert [r["n"] for r in stitch.rows_since(d.union(spark.createDataFrame([("a", 3, 0)], d.schema)), "flag", ["k"], "step", "n").orderBy("step").collect()] == [None, None, None, 0]
