"""Stateful streams: rows that cross batches out of order give the result of the whole batch."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattloom.streaming import streams as ss

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp, early int, confirm int"


def stamp(step):
    return T0 + dt.timedelta(minutes=15 * step)


def plain_timer(rows, k, m):
    out, rows = {}, sorted(rows)
    for i, (step, early, _) in enumerate(rows):
        out[step] = int(sum(r[1] for r in rows[max(0, i - m + 1) : i + 1]) >= k)
    return out


def plain_alerts(rows, last):
    """Every state with the step at which it is known, up to step last."""
    at, out = {s: (e, c) for s, e, c in rows}, []
    for step, (early, _) in at.items():
        if early:
            decisions = [(s, at[s][1]) for s in (step + 3, step + 4) if s in at]
            hit = [s for s, c in decisions if c]
            out.append((step, step + 4, "watch"))
            out.append((hit[0], step + 4, "confirmed") if hit else (step + 4, step + 4, "rejected" if decisions else "expired"))
    return collections.Counter((t, s) for known, t, s in out if known <= last)


@pytest.fixture(scope="module")
def disordered(spark, tmp_path_factory):
    """Ten files, each a trigger: rows come up to 12 steps after their turn; steps are missing."""
    rng = random.Random(9)
    rows = {k: [(s, int(rng.random() < 0.4), int(rng.random() < 0.3)) for s in range(120) if rng.random() < 0.75] for k in "ab"}
    rows["a"] = [r for r in rows["a"] if not 40 <= r[0] <= 44]  # a gap: alerts expire
    dealt = collections.defaultdict(list)
    for k, rs in rows.items():
        for s, e, c in rs:
            dealt[min(9, (s + rng.randrange(12)) // 12)].append((k, stamp(s), e, c))
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for i in sorted(dealt):
        rng.shuffle(dealt[i])
        spark.createDataFrame(dealt[i], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def steps(column):
    return (F.unix_timestamp(column) - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))) / 900


def test_delay_timer_over_many_triggers(spark, disordered):
    rows, path = disordered
    out = ss.run_now(ss.stateful(read(spark, path).withColumn("flag", F.col("early")), ss.DelayTimer(2, 4), "series_id string, ts timestamp, timer int", "6 hours"))
    got = collections.Counter((r[0], int(r[1]), r[2]) for r in out.select("series_id", steps("ts"), "timer").collect())
    last = max(s for rs in rows.values() for s, _, _ in rs) - 24  # the watermark
    assert got == collections.Counter((k, s, v) for k, rs in rows.items() for s, v in plain_timer(rs, 2, 4).items() if s <= last)


def test_sequential_alert_over_many_triggers(spark, disordered):
    rows, path = disordered
    out = ss.run_now(ss.stateful(read(spark, path), ss.SequentialAlert(), "series_id string, target timestamp, state string", "6 hours"))
    last = max(s for rs in rows.values() for s, _, _ in rs) - 24
    for k, rs in rows.items():
        got = collections.Counter((int(r[0]), r[1]) for r in out.where(F.col("series_id") == k).select(steps("target"), "state").collect())
        assert got == plain_alerts(rs, last)
        assert {s for _, s in got} >= {"watch", "confirmed", "rejected"}
    assert out.where("state = 'expired'").count() > 0


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([("a", stamp(0), 1, 0), ("a", stamp(40), 0, 0)], [("a", stamp(1), 1, 0), ("a", stamp(39), 1, 0)], [("b", stamp(90), 0, 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = ss.run_now(ss.stateful(read(spark, path).withColumn("flag", F.col("early")), ss.DelayTimer(1, 2), "series_id string, ts timestamp, timer int", "1 hour"))
    assert sorted((int(r[0]), r[1]) for r in out.select(steps("ts"), "timer").collect()) == [(0, 1), (39, 1), (40, 1)]
