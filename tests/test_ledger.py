"""The ledger of policies by day: hand-worked days, an event over midnight, sums and choices."""

import datetime as dt

from pyspark.sql import functions as F

from wattloom.operators import ledger as lg
from wattloom.operators import policy as pl

DAY = dt.date(2024, 1, 1)
SCHEMA = "k string, step long, day date, peak int, early int, confirm int, unsure int, future int, future1 int"


def rows_of(peaks, early, confirm, n=24, a_day=8):
    """n steps, a_day of them a day, with the levels given by step."""
    flag = lambda s, k: int(any(p in peaks for p in range(s + 1, s + k + 1)))
    return [("a", s, DAY + dt.timedelta(days=s // a_day), int(s in peaks), early.get(s, 0), confirm.get(s, 0), 0, flag(s, 4), flag(s, 1)) for s in range(n)]


def book_of(spark, *args):
    d = spark.createDataFrame(rows_of(*args), SCHEMA)
    return lg.ledger(d, "peak", "early", "confirm", "unsure", "future", "future1", 4, 2, ["k"], "step", "day")


def test_an_event_over_midnight_is_owned_by_its_onset(spark):
    # peaks at steps 7 (day 1) and 8, 9 (day 2) are one event of day 1; 20 is one of day 3
    b = book_of(spark, {7, 8, 9, 20}, {5: 1, 12: 1, 18: 2}, {6: 1})
    early1 = {r["day"].day: r for r in b.where("kind = 'single_early' and early = 1").collect()}
    assert {k: (r["n_events"], r["missed"], r["lead_sum"]) for k, r in early1.items()} == {1: (1, 0, 30.0), 2: (0, 0, 0.0), 3: (1, 0, 30.0)}
    assert {k: (r["fp"], r["alerts"]) for k, r in early1.items()} == {1: (0, 1), 2: (1, 1), 3: (0, 1)}
    early2 = {r["day"].day: (r["n_events"], r["missed"], r["alerts"]) for r in b.where("kind = 'single_early' and early = 2").collect()}
    assert early2 == {1: (1, 1, 0), 2: (0, 0, 0), 3: (1, 0, 1)}
    both = {r["day"].day: (r["n_events"], r["missed"]) for r in b.where("kind = 'escalate' and early = 1 and confirm = 1 and gate = 'none'").collect()}
    assert both[1] == (1, 1) and both[3] == (1, 1)  # no row is early and confirmed at once
    assert b.where("kind = 'single_confirm' and confirm = 1").agg(F.sum("missed"), F.sum("n_events")).first()[:] == (1, 2)


def test_the_ledger_adds_up_to_the_sweeps(spark):
    d = spark.createDataFrame(rows_of({3, 7, 8, 15, 16, 22}, {s: s % 3 for s in range(24)}, {s: s % 2 for s in range(24)}), SCHEMA)
    b = lg.ledger(d, "peak", "early", "confirm", "unsure", "future", "future1", 4, 2, ["k"], "step", "day")
    total = {tuple(r[c] for c in lg.POLICY): (r["n"], r["m"], r["f"]) for r in b.groupBy(*lg.POLICY).agg(F.sum("n_events").alias("n"), F.sum("missed").alias("m"), F.sum("fp").alias("f")).collect()}
    for r in pl.event_sweep(d, "peak", "early", "confirm", "unsure", 4, 2, ["k"], "step").collect():
        assert total[tuple(r[c] for c in lg.POLICY)][:2] == (r["n_events"], r["missed"])
    for r in pl.pair_sweep(d, "early", "confirm", "unsure", "future", 2, ["k"]).collect():
        assert total["escalate", r["early"], r["confirm"], r["gate"]][2] == r["fp"]


def test_choice_on_sel_and_reference_on_test(spark):
    row = lambda part, kind, place, fp, n, missed, lead: (part, kind, 1, None, "none", place, fp, fp + 1, n, missed, lead)
    rows = [
        row("SEL", "single_early", 1, 10, 4, 0, 240.0), row("SEL", "escalate", 2, 2, 4, 1, 45.0), row("TEST", "single_early", 1, 1, 2, 0, 120.0), row("TEST", "escalate", 2, 0, 2, 2, 0.0),
        row("LOCK", "single_early", 1, 3, 2, 1, 60.0), row("LOCK", "escalate", 2, 1, 2, 0, 60.0),
    ]
    b = spark.createDataFrame(rows, "part string, kind string, early int, confirm int, gate string, place int, fp long, alerts long, n_events long, missed long, lead_sum double").withColumns({"k": F.lit("a"), "day": F.lit(DAY)})
    got = {(r["ratio"], r["scope"], r["part"]): (r["kind"], r["cost"], r["cost_on_sel"]) for r in lg.select_then_apply(lg.costs(b, [1, 10], ["k"]), ["k"]).collect()}
    assert got[1.0, "all", "TEST"] == ("escalate", 1.0, 0.75) and got[1.0, "all", "LOCK"] == ("escalate", 0.5, 0.75)
    assert got[10.0, "all", "TEST"] == ("single_early", 0.05, 0.25)  # 10 false steps against a miss of 10
    assert got[1.0, "lead_constrained", "TEST"][0] == "single_early"  # 60 minutes a found event; escalation has 15
    assert got[1.0, "post_hoc", "TEST"] == ("single_early", 0.5, None) and (1.0, "post_hoc", "LOCK") not in got


def test_paired_days(spark):
    b = book_of(spark, {7, 8, 9, 20}, {5: 1, 12: 1, 18: 2}, {6: 1})
    last = spark.createDataFrame([("a", DAY + dt.timedelta(days=2))], "k string, _last date")
    b = lg.parts_of(b, last, ["k"], "day", 1, 1)
    assert {r["day"].day: r["part"] for r in b.select("day", "part").distinct().collect()} == {1: "SEL", 2: "TEST", 3: "LOCK"}
    place = {(r["kind"], r["early"]): r["place"] for r in b.where("gate = 'none' and kind = 'single_early'").collect()}
    chosen = spark.createDataFrame([("a", place["single_early", 1], place["single_early", 2])], "k string, place_a int, place_b int")
    got = {r["day"].day: (r["fp_a"], r["missed_a"], r["fp_b"], r["missed_b"], r["events"]) for r in lg.paired_days(b, chosen, ["k"], "day").collect()}
    assert got == {1: (0, 0, 0, 1, 1), 2: (1, 0, 0, 0, 0), 3: (0, 0, 0, 0, 1)}
