"""Small tables of links and texts run in few tasks, however many partitions a shuffle has."""

import pytest

from wattloom.llm import components, near_dup
from wattloom.session import few


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_components_of_few_links(spark, many_partitions):
    links = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 10 != 9], "a long, b long").repartition(61, "a")
    out = components.components(links)
    assert out.rdd.getNumPartitions() <= 24  # was: as many as a shuffle has
    assert {(r["node"], r["label"]) for r in out.collect()} == {(i, i // 10 * 10) for i in range(400)}


def test_near_duplicates_of_few_texts(spark, many_partitions, monkeypatch):
    tasks = []
    cut = near_dup.cut

    def counted(df):
        out = cut(df)
        tasks.append(out.rdd.getNumPartitions())
        return out

    for module in (near_dup, components):
        monkeypatch.setattr(module, "cut", counted)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i] + ["x"] + words[i:])) for i in range(0, 60, 2)] + [(100 + i, f"text {i} of its own kind here") for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 0 if d < 100 else d for d, _ in rows}
    assert len(tasks) > 8 and max(tasks) <= 24


def test_large_tables_keep_their_tasks(spark):
    df = spark.range(1000).repartition(61)
    assert few(df, 10_000_000).rdd.getNumPartitions() == 61
    assert few(df, 400_000).rdd.getNumPartitions() == 40
    assert few(df, 1000, 10).rdd.getNumPartitions() == 61
