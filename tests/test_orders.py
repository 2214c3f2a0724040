"""Results that the order of rows in tasks must not change."""

import pyarrow as pa
import pyarrow.parquet as pq

from wattloom.operators import bursts as bu
from wattloom.queries import QUERIES


def test_first_line_is_the_first_in_file_order(spark, tmp_path):
    # Spark reads large files first, so rows meet in another order than that of the files
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    rows = [(k % 50, 1 + k // 50 % 2, float(k)) for k in range(4000)]
    for part, some in enumerate((rows[:120], rows[120:])):
        pq.write_table(pa.table(dict(zip(("l_orderkey", "l_linenumber", "l_quantity"), map(list, zip(*some))))), folder / f"part-{part}.parquet")
    want = {}
    for key, number, quantity in rows:
        if number == 1:
            want.setdefault(key, quantity)
    got = QUERIES["t14_first_per_group"](spark, str(tmp_path)).collect()
    assert {r["l_orderkey"]: r["l_quantity"] for r in got} == want


def test_crossings_do_not_follow_the_order_of_input(spark):
    # the mean of 0.1, 0.3, 0.2 is over or under 0.2 by the order of its sum
    rows = [(1, 1, 1, 0.1), (1, 1, 2, 0.3), (1, 1, 3, 0.2)]
    got = []
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame(some, "user_id int, seg int, t int, x double").coalesce(1)
        got.append(bu.shape(d, "x", ["user_id"], "t", "t").first()["crossings"])
    assert got == [2, 2]
