"""Readers and writers of meter, shot, press and site files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.session import cut, ship

_long, _double = T.LongType(), T.DoubleType()
METER = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("hour", _long)]
    + [T.StructField(f"kw_{m}", _double) for m in (15, 30, 45, 60)]
    + [T.StructField(c, _double) for c in ("kw_mean", "production", "temp", "wind", "humidity", "rain", "tariff")]
    + [T.StructField("dow", _long), T.StructField("day", _long), T.StructField("month", _long), T.StructField("headcount", _double), T.StructField("labour_factor", _double)]
)


def read_meter(spark: SparkSession, path: str) -> DataFrame:
    """Hourly meter CSV with a header (a byte-order mark is harmless: columns go by place)."""
    df = spark.read.csv(path, schema=METER, header=True, enforceSchema=True)
    return df.withColumn("date", F.to_date("date", "yyyyMMdd").cast("timestamp_ntz"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """Shot CSV whose first column, whatever its name, is idx."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumnRenamed(df.columns[0], "idx")


def read_labelled(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several files as one table with their label in `source`."""
    out = None
    for label, path in paths.items():
        part = spark.read.csv(path, header=True, inferSchema=True).withColumn("source", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_sites(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files of a folder with their site: the folder's `site=` part, or else the file's
    name without its ending."""
    df = spark.read.csv(path, schema=schema, header=True)
    if "site" in df.columns:
        return df
    return df.withColumn("site", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


BOM = b"\xef\xbb\xbf"
#: A file is read in lines that end with one of these, the first that makes none longer.
SEPARATORS, LONGEST = ("\n", ","), 16 << 20


class Digest:
    """MD5 of a file that comes in lines. The reader drops the last separator and a byte-order
    mark: the size tells which of them the file has, so the digest is kept with and without a
    mark until the end. It is None where the size shows that lines are missing."""

    def __init__(self, path: str, size: int | None, separator: bytes):
        self.path, self.size, self.separator, self.seen = path, size, separator, 0
        self.plain, self.marked = hashlib.md5(usedforsecurity=False), hashlib.md5(BOM, usedforsecurity=False)

    def add(self, lines: pa.Array) -> None:
        body = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), self.separator)[0].as_buffer()
        for h in (self.plain, self.marked):
            if self.seen:
                h.update(self.separator)
            h.update(body)
        self.seen += body.size + 1

    def row(self) -> tuple[str, str | None]:
        over = None if self.size is None else self.size - self.seen  # seen has a separator after every line
        if over not in (-1, 0, 2, 3):
            return self.path, None
        h = self.plain if over < 2 else self.marked
        if over in (0, 3):
            h.update(self.separator)
        return self.path, h.hexdigest()


def digests(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[pa.RecordBatch]:
    """(file, md5) of files whose lines stand together and in order: file, size, line."""
    now = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in now.row()], ["file", "md5"])

    for batch in batches:
        file, size, line = (batch.column(c) for c in ("file", "size", "line"))
        start = 0
        for end in pc.run_end_encode(file).run_ends.to_pylist():
            path = file[start].as_py()
            if now is None or now.path != path:
                if now is not None:
                    yield out()
                now = Digest(path, size[start].as_py(), separator)
            now.add(line.slice(start, end - start))
            start = end
    if now is not None:
        yield out()


def in_one_piece(ending: str) -> dict[str, str]:
    """Options of a text reader by which files of this ending are neither unpacked nor split:
    Hadoop's pass-through codec has them (in Spark's jars its key has the shaded name)."""
    key = "io.compress.passthrough.extension"
    return {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", key: ending, f"org.apache.hadoop.shaded.{key}": ending}


def line_digests(spark: SparkSession, path: str, names: set[str], separator: str, only: list[str] | None) -> DataFrame:
    """(file, md5) of the files of these names, or of those in only, that lines of at most LONGEST
    bytes make up. Longer lines are passed over by the reader, never held."""
    m = F.col("_metadata")
    literal = lambda text: re.sub(r"([^\w.])", r"\\\1", text)

    def lines(glob: str, options: dict[str, str]) -> DataFrame:
        reader = spark.read.options(**options, **{"mapreduce.input.linerecordreader.line.maxlength": LONGEST})
        d = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", separator).text(path)
        d = d if only is None else d.where(m["file_path"].isin(only))
        return d.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_block_start"].alias("start"), m["file_block_length"].alias("length"), F.col("value").cast("binary").alias("line"))

    found = []
    for ending in sorted({n[n.rindex(".") :] for n in names if "." in n}):
        # a file that was split all the same has no size, and so no digest
        d = lines(f"*{literal(ending)}", in_one_piece(ending))
        found.append(d.withColumn("size", F.when(F.col("length") == F.col("size"), F.col("size"))))
    plain = sorted(literal(n) for n in names if "." not in n)
    if plain:  # a codec goes by the ending: pieces of these files are put in order by a sort
        d = lines("{" + ",".join(plain) + "}", {}).withColumn("at", F.monotonically_increasing_id())
        found.append(d.repartition("file").sortWithinPartitions("file", "start", "at"))
    mark = separator.encode()
    out = spark.createDataFrame([], "file string, md5 string")
    for d in found:
        out = out.union(d.select("file", "size", "line").mapInArrow(lambda batches: digests(batches, mark), out.schema))
    return out.where("md5 is not null")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and checksum of files of any size (Spark's scans leave out empty ones). An
    MD5 is a chain, so one task digests a file, but it holds a batch of lines, and no file
    whole: only a file that no separator divides is one row, of under 2 GB."""
    ship(spark)
    load = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    files, name = load(path), F.element_at(F.split("path", "/"), -1).alias("name")
    listed = files.select("path", name, F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("file"))
    names = {unquote(f).rsplit("/", 1)[-1] for f in files.inputFiles()}
    done, left = spark.createDataFrame([], "file string, md5 string"), []
    for separator in SEPARATORS:
        done = done.union(cut(line_digests(spark, path, names, separator, [r["file"] for r in left] or None)))
        left = listed.join(done, "file", "left_anti").collect()
        if not left:
            break
    out = listed.join(done, "file").select("name", "bytes", "md5")
    if left:
        whole = load([re.sub(r"([{}\[\]*?\\])", r"\\\1", r["path"]) for r in left])
        out = out.union(whole.select(name, F.length("content").alias("bytes"), F.md5("content").alias("md5")))
    return out


def save_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Write a result table, replacing an earlier one."""
    writer = df.write.mode("overwrite").format(form)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where it was never written: the plan is then built without it."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
