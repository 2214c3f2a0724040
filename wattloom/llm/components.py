"""Connected components of a link table, and joins that a hot key does not stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut, few

#: A key is hot if it holds over 1 / HOT of the rows, and over LEAST rows (fewer of these small
#: rows are no work for one task): so at most HOT keys are hot, whatever the size of the table,
#: and their rows can be broadcast.
HOT, LEAST = 10_000, 20_000


def hot_limit(rows: int) -> int:
    return max(LEAST, rows // HOT)


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame | None:
    """(key, n) of the hot keys of df, which has so many rows: at most HOT; None if none is."""
    return some(few(df.groupBy(key).agg(F.count("*").alias("n")), rows).where(F.col("n") > hot_limit(rows))) if rows > LEAST else None


def some(hot: DataFrame) -> DataFrame | None:
    """The at most HOT rows of hot as a local table, None if there are none."""
    rows = hot.collect()
    return hot.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """left join right (inner; right has one small row a key) with the hot keys of left
    joined by broadcast, where left's rows stay, and the others by a shuffle."""
    if hot is None:
        return left.join(right, key)
    keys = F.broadcast(hot.select(key))
    rest = left.join(keys, key, "left_anti").join(right, key)
    return left.join(F.broadcast(right.join(keys, key)), key).select(*rest.columns).unionByName(rest)


def tidy(df: DataFrame) -> None:
    """A round of a loop is over: its shuffle files and checkpoints, which nothing refers to any
    more, can go. Spark deletes them after the driver's garbage collection alone, and a driver
    with little work may not come to one before the disks of the executors are full."""
    df.sparkSession.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (a, b); label is the component's least node.

    Each round takes the least label among neighbours and then the label of that label
    (pointer jumping), so the number of rounds follows the logarithm of a chain's length. A
    node with very many links, or a label of very many nodes, is a hot key of these joins.
    No links: no rows. Each step runs in no more tasks than the links need (see few)."""
    rows = 2 * links.count()
    links = few(links, rows)
    edges = cut(few(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), rows))
    hubs = hot_keys(edges, "b", rows)
    labels = cut(few(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), rows))
    while True:
        seen = few(join_hot(edges, labels.withColumnRenamed("node", "b"), "b", hubs), rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = cut(few(labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("low")), rows))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = join_hot(low, jump, "low", hot_keys(low, "low", rows)).select("node", F.col("label").alias("old"), F.least("low", "lower").alias("label"))
        new = cut(few(new, rows))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
        del seen, low, jump, new
        tidy(labels)
