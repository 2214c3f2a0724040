"""Streams over the events table, compared with their batch forms on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.queries.base import register
from wattloom.streaming import streams as ss


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


CLOSED = "(select max(ts) - interval 30 minutes from events)"


@register("w1_stream_demand", "series_id ts15 kw:f n:i", f"select event_type series_id, time_bucket(interval '15 minutes', ts) ts15, round(sum(value), 2) kw, count(*) n from events group by 1, 2 having time_bucket(interval '15 minutes', min(ts)) + interval 15 minutes <= {CLOSED}")
def w1(spark, sf):
    return naive(ss.run_now(ss.demand(ss.read_events(spark, sf))), "ts15")


@register("w2_sliding_mean", "series_id ts15 mean:f n:i", f"""with s as (select event_type series_id, value, time_bucket(interval '15 minutes', ts) - to_minutes(15 * k::int) ts15 from events, range(4) r(k)) select series_id, ts15, avg(value) mean, count(*) n from s group by 1, 2 having ts15 + interval 1 hour <= {CLOSED}""")
def w2(spark, sf):
    return naive(ss.run_now(ss.sliding_mean(ss.read_events(spark, sf))), "ts15")


@register("w3_sessions", "user_id:i start n:i", f"""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end nw from events), b as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) seg from e)
select user_id, min(ts) "start", count(*) n from b group by user_id, seg having max(ts) + interval 6 hours <= {CLOSED}""")
def w3(spark, sf):
    return naive(ss.run_now(ss.sessions(ss.read_events(spark, sf), "6 hours")), "start")
