"""Pieces numbered in their partitions are packed as well as those dealt by length."""

import collections

import pytest
from pyspark.sql import functions as F

from wattloom.llm import packing


@pytest.mark.parametrize("cells", [1 << 20, 3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_ranks_of_partitions(spark, monkeypatch, cells, partitions):
    monkeypatch.setattr(packing, "CELLS", cells)
    rows = [(None if i % 9 == 0 else i % 50, 0, 1 + (i * i) % 37, i) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length int, ids_crc32 long").repartition(partitions).checkpoint()
    got = packing.pack_in_place(pieces, 40, packing.best_fit_decreasing).collect()
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == collections.Counter((a, c, d) for a, _, c, d in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for at, length in sorted(held):
            assert at == end  # gapless from 0
            end += length
        assert end <= 40
    same = packing.pack(pieces, 40, packing.best_fit_decreasing)
    assert len(bins) == same.select("sequence_id").distinct().count()


def test_no_pieces(spark):
    none = spark.createDataFrame([], "doc_id long, piece int, length int, ids_crc32 long").checkpoint()
    assert packing.pack_in_place(none, 40, packing.best_fit_decreasing).withColumn("x", F.lit(1)).collect() == []
