"""Inventory of files that no task holds whole."""

import gzip
import hashlib

import numpy as np
import pytest

from wattloom.sources import files

LONG = np.random.default_rng(5).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
BOM = b"\xef\xbb\xbf"
FILES = {
    "long.parquet": LONG, "ended.parquet": LONG + b"\n", "marked.parquet": BOM + LONG, "both.parquet": BOM + LONG + b"\n\n",
    "line.csv": b"\n", "lines.csv": b"\n\r\n\n", "mark.csv": BOM, "mark line.csv": BOM + b"\n", "two.csv": BOM + BOM + b"a\r", "a [1]*.csv": b"a\nb", "ümlaut%20.csv": b"\xff\xfe\x00",
    "rows.csv.gz": gzip.compress(b"a\nb\n" * 9999), "not.gz": b"no archive\n", "rows.zst": b"\x28\xb5\x2f\xfd", "x.snappy": LONG, "dotless": LONG, "b": b"b", "zz2": b"c\n",
    "one line.json": b'{"a":1},' * 2000, "zeros.bin": bytes(6000), "marked.json": BOM + b'[1,22],' * 2000, "undivided.bin": b"x" * 9000, "a [2]{b}*?.bin": b"z" * 9000, "part.bin": b"x" * 9000 + LONG, "undivided": b"y" * 9000 + b"\n",
}


@pytest.mark.parametrize("piece", ["65536", "134217728"])
def test_inventory_reads_any_bytes_in_lines(spark, tmp_path, monkeypatch, piece):
    # no file of over 10,000 bytes may be one row; lines of over 5,000 are too long; files would be cut in pieces
    limits = {"spark.sql.sources.binaryFile.maxLength": "10000", "spark.sql.files.maxPartitionBytes": piece}
    want = {n: d for n, d in FILES.items() if n != "part.bin"}
    monkeypatch.setattr(files, "LONGEST", 5000)
    for name, data in want.items():
        folder = tmp_path / ("a" if len(name) % 2 else "b")
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        got = [tuple(r) for r in files.inventory(spark, str(tmp_path)).collect()]
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert sorted(got) == sorted((name, len(data), hashlib.md5(data).hexdigest()) for name, data in want.items())


def test_a_file_with_one_long_line_is_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LONGEST", 5000)
    (tmp_path / "part.bin").write_bytes(FILES["part.bin"])
    got = files.inventory(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("part.bin", 409_000, hashlib.md5(FILES["part.bin"]).hexdigest())]


def test_lines_that_are_not_all_of_a_file_have_no_digest():
    import pyarrow as pa

    for size, md5 in ((9, None), (None, None), (3, hashlib.md5(b"abc").hexdigest()), (4, hashlib.md5(b"abc\n").hexdigest())):
        d = files.Digest("f", size, b"\n")
        d.add(pa.array([b"abc"], pa.binary()))
        assert d.row() == ("f", md5)
