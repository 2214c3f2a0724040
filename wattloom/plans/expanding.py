"""Quantiles of all the past of a series, by two levels of order statistics.

Every value gets its place in the order of all values; places are dealt to buckets of equal
size. Counts of (chunk of steps, bucket), added up over earlier chunks, tell each chunk in
which buckets the order statistics can lie that its rows will ask for: a chunk of m rows moves
a place by m at most. So a task gets a chunk's rows and the earlier values of these few
buckets, at most about two chunks and two buckets, never a series. The table of counts has
(n / chunk) * (n / bucket) rows for a series of n rows.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.plans.ranks import numbered
from wattloom.plans.stitch import CHUNK, before
from wattloom.session import cut

PLACE, BUCKET = "_place", "_bucket"


def expanding_quantile(df: DataFrame, x: str, q: float, least: int, keys: Sequence[str], step: str, name: str = "thr_expanding", chunk: int = 4096, bucket: int = 4096) -> DataFrame:
    """df with the quantile, by linear interpolation, of x in all earlier rows of the series;
    null where fewer than `least` (1 at least) of them have a value. step is an integer and
    unique in a series."""
    d = cut(df.withColumn(CHUNK, F.floor(F.col(step) / chunk).cast("long")))
    v, _ = numbered(d.where(F.col(x).isNotNull()).select(*keys, step, x, CHUNK), [*keys, x, step], PLACE)
    v = cut(v.withColumn(BUCKET, F.floor(F.col(PLACE) / bucket).cast("long")))
    chunks = d.groupBy(*keys, CHUNK).agg(F.count(x).alias("_m"))
    chunks = before(chunks.withColumn("_n", F.col("_m")), keys, {"_n": "sum"})
    # rows of each bucket before each chunk, and in all buckets up to it
    grid = chunks.select(*keys, CHUNK).join(v.select(*keys, BUCKET).distinct(), list(keys))
    grid = grid.join(v.groupBy(*keys, CHUNK, BUCKET).agg(F.count("*").alias("_c")), [*keys, CHUNK, BUCKET], "left")
    past = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, BUCKET).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_past", past).withColumn("_upto", F.sum("_past").over(Window.partitionBy(*keys, CHUNK).orderBy(BUCKET)))
    first = F.floor(q * (F.col("_n") - 1)) - F.col("_m") - 1  # of earlier values, the places that may be asked for
    last = F.floor(q * (F.col("_n") + F.col("_m"))) + 2
    grid = grid.join(chunks, [*keys, CHUNK])
    near = (F.col("_upto") > first) & (F.col("_upto") - F.col("_past") <= last) & (F.col("_past") > 0)
    need = grid.where(near).groupBy(*keys, CHUNK).agg(F.min(BUCKET).alias("_lo"), F.max(BUCKET).alias("_hi"), F.min(F.col("_upto") - F.col("_past")).alias("_below"))
    own = d.join(v.select(*keys, step, PLACE, BUCKET), [*keys, step], "left").join(chunks.drop("_m"), [*keys, CHUNK]).join(need, [*keys, CHUNK], "left")
    wanted = need.select(*keys, F.col(CHUNK).alias("_to"), F.explode(F.sequence("_lo", "_hi")).alias(BUCKET))
    earlier = v.join(wanted, [*keys, BUCKET]).where(F.col(CHUNK) < F.col("_to")).select(*keys, F.col("_to").alias(CHUNK), PLACE, x)

    def grow(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(step)
        known = sorted(zip(held[PLACE].tolist(), held[x].tolist()))
        n, below, low, high = (rows[c].iloc[0] for c in ("_n", "_below", "_lo", "_hi"))
        n, m, out = int(n), int(rows[x].count()), []
        below = 0 if pd.isna(below) else int(below)
        # where no earlier value bounds what may be asked for, the chunk's own rows count on that side
        if pd.isna(low) or q * (n - 1) - m - 1 < 1:
            below, low = 0, -np.inf
        if pd.isna(high) or q * (n + m) + 2 > n - 2:
            high = np.inf
        for place, value, at in zip(rows[PLACE].tolist(), rows[x].tolist(), rows[BUCKET].tolist()):
            if n < max(least, 1):
                out.append(None)
            else:
                exact = q * (n - 1)
                i = int(exact)
                a = known[i - below][1]
                out.append(a if exact == i else a + (known[i + 1 - below][1] - a) * (exact - i))
            if value == value and value is not None:
                n += 1
                if at < low:
                    below += 1
                elif at <= high:
                    insort(known, (place, value))
        return rows.assign(**{name: pd.array(out, "Float64")})[schema.names]

    own, earlier = own.toDF(*own.columns), earlier.toDF(*earlier.columns)  # columns of their own on each side
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return own.groupBy(*keys, CHUNK).cogroup(earlier.groupBy(*keys, CHUNK)).applyInPandas(grow, schema)
