"""A ledger of policies by day: false alarm steps, events, missed events and lead minutes.

An event belongs to the day of its onset, so days can be split, added up and resampled:
selection on some days, application to others, and the bootstrap of a cost are sums over
the ledger, without a look at the rows again. It has a row per series, day and policy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators import policy as pl

Keys = Sequence[str]
POLICY = ["kind", "early", "confirm", "gate"]
COUNTS = ["fp", "alerts", "n_events", "missed", "lead_sum"]
KINDS = ("single_confirm", "single_early", "escalate")


def place(kind: str = "kind") -> Column:
    """A number of a policy, which puts simple ones first: it decides between equal costs."""
    order = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1
    return order(kind, KINDS) * 100000 + F.coalesce("early", F.lit(0)) * 1000 + F.coalesce("confirm", F.lit(0)) * 10 + order("gate", pl.GATES)


def ledger(df: DataFrame, peak: str, early: str, confirm: str, unsure: str, future: str, future_confirm: str, k: int, qs: int, by: Keys, step: str, day: str) -> DataFrame:
    """(by, day, policy, place, fp, alerts, n_events, missed, lead_sum) of all policies that
    policy.event_sweep knows; levels, futures and gates as there. Days on which a policy has
    neither an alert nor an event have no row."""
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    steps = lambda d, kind, e, c, gate: d.select(*by, day, F.lit(kind).alias("kind"), e.alias("early"), c.alias("confirm"), gate.alias("gate"), "fp", (F.col("tp") + F.col("fp")).alias("alerts"), zero.alias("n_events"), zero.alias("missed"), F.lit(0.0).alias("lead_sum"))
    own = [*by, day]
    rows = steps(pl.pair_sweep(df, early, confirm, unsure, future, qs, own), "escalate", F.col("early"), F.col("confirm"), F.col("gate"))
    rows = rows.unionByName(steps(pl.single_sweep(df, early, future, qs, own), "single_early", F.col("early"), none, F.lit("none")))
    rows = rows.unionByName(steps(pl.single_sweep(df, confirm, future_confirm, qs, own), "single_confirm", none, F.col("early"), F.lit("none")))
    events = pl.event_sweep(df, peak, early, confirm, unsure, k, qs, by, step, day=day)
    lead = F.coalesce(F.col("lead") * F.col("detected"), F.lit(0.0))
    rows = rows.unionByName(events.select(*own, *POLICY, zero.alias("fp"), zero.alias("alerts"), "n_events", "missed", lead.alias("lead_sum")))
    return rows.groupBy(*own, *POLICY).agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("place", place())


def parts_of(book: DataFrame, last: DataFrame, by: Keys, day: str, test: int, lock: int) -> DataFrame:
    """The ledger with part: the last `lock` days up to last (by, _last) are LOCK, the `test`
    days before them TEST, the rest SEL."""
    left = F.datediff("_last", day)
    return book.join(last, list(by)).withColumn("part", F.when(left < lock, "LOCK").when(left < lock + test, "TEST").otherwise("SEL")).drop("_last")


def costs(book: DataFrame, ratios: Sequence[float], by: Keys) -> DataFrame:
    """Cost of every policy, part and ratio, with its mean lead; parts without an event have none."""
    total = book.groupBy(*by, "part", *POLICY, "place").agg(*[F.sum(c).alias(c) for c in COUNTS])
    total = total.withColumn("lead", F.col("lead_sum") / F.nullif(F.col("n_events") - F.col("missed"), F.lit(0)))
    return pl.cost_curve(total, ratios)


def select_then_apply(table: DataFrame, by: Keys, least_lead: float = 30.0) -> DataFrame:
    """The cheapest policy of each scope on SEL, applied to TEST and LOCK, and as a reference
    the cheapest on TEST itself (scope post_hoc). table is of costs(); cost_on_sel is what the
    choice rested on."""
    scopes = {"all": F.lit(True), "single_only": F.col("kind") != "escalate", "escalation_only": F.col("kind") == "escalate", "lead_constrained": F.col("lead") >= least_lead}
    pick = lambda part, s: pl.best_points(table.where((F.col("part") == part) & F.col("cost").isNotNull()), s, [*by, "ratio"], ["place"])
    chosen = pick("SEL", scopes).select(*by, "ratio", "scope", "place", F.col("cost").alias("cost_on_sel"))
    out = table.where("part <> 'SEL'").join(chosen, [*by, "ratio", "place"])
    best = pick("TEST", {"post_hoc": F.lit(True)}).withColumn("cost_on_sel", F.lit(None).cast("double"))
    return out.unionByName(best.select(*out.columns))


def paired_days(book: DataFrame, chosen: DataFrame, by: Keys, day: str) -> DataFrame:
    """(by, part, day, fp_a, missed_a, fp_b, missed_b, events): the days of the chosen policies
    (by, place_a, place_b); events are the same for both."""
    d = book.join(chosen, list(by)).where((F.col("place") == F.col("place_a")) | (F.col("place") == F.col("place_b")))
    one = lambda c, p: F.coalesce(F.sum(F.when(F.col("place") == F.col(f"place_{p}"), F.col(c))), F.lit(0))
    return d.groupBy(*by, "part", day).agg(*[one(c, p).alias(f"{c}_{p}") for p in "ab" for c in ("fp", "missed")], F.max("n_events").alias("events"))
