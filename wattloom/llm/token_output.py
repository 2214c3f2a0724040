"""Packed token matrices for training, by best-fit-decreasing.

Documents become pieces of token ids (packing.split_tokens cuts only overlong ones, and
their pieces joined in order are the document's ids again). Best-fit-decreasing with
segment-tree capacity search plans on the histogram of lengths. Pieces then go to the
shard of their sequence. A shard is one row of a table that Spark commits: the ids of
SHARD sequences as one matrix of little-endian unsigned integers, padded to `capacity`, a
matrix of position ids that start again at each piece, and per sequence the cumulative
lengths of its pieces and where they come from. `read_shards` gives the sequences back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.packing import best_fit_decreasing, pack_in_place, split_tokens
from wattloom.llm.tokens import tokenizer
from wattloom.session import cut, scratch, ship

#: Sequences of a shard.
SHARD = 64
SHARDS = "shard long, rows int, width int, kind string, ids binary, positions binary, sequences array<struct<sequence_id:long,cu_seqlens:array<int>,doc_ids:array<long>,pieces:array<int>>>"
SEQUENCE = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


def write_shards(docs: DataFrame, path: str, folder: str, capacity: int = 2048, pad_id: int = 0, end_id: int = 0) -> None:
    """Write the packed sequences of docs to a table of shards (see SHARDS) in folder.

    Ids are of kind <u2 where the vocabulary and pad_id fit, else <u4; a row of the id matrix
    has pad_id after its tokens, one of the positions (<u2) has 0. cu_seqlens starts with 0 and
    ends with the row's tokens. A null or empty text is the one id end_id. Repeated rows are
    packed as often; extra columns are ignored; no rows give no shards."""
    if capacity > 1 << 16:
        raise ValueError("positions are 16-bit: capacity is at most 65536")
    kind = "<u2" if max(tokenizer(path).model.get_vocab_size() - 1, pad_id, end_id) < 1 << 16 else "<u4"
    placed = pack_in_place(cut(split_tokens(docs, path, capacity, end_id, kind)), capacity, best_fit_decreasing)
    shard = F.floor(F.col("sequence_id") / SHARD).cast("long").alias("shard")
    piece = F.struct("sequence_id", "offset", "doc_id", "piece", "ids")
    # at most SHARD * capacity ids
    rows = placed.groupBy(shard).agg(F.sort_array(F.collect_list(piece)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = pa.struct([("sequence_id", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(sequence)]
        names = [f.split()[0] for f in SHARDS.split(", ")]
        for batch in batches:
            for number, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[int, list[dict]] = {}
                for p in parts:
                    found.setdefault(p["sequence_id"], []).append(p)
                ids = np.full((len(found), capacity), pad_id, kind)
                positions = np.zeros((len(found), capacity), "<u2")
                told = []
                for row, (which, own) in enumerate(found.items()):
                    ends = [0]
                    for p in own:
                        given = np.frombuffer(zlib.decompress(p["ids"]), kind)
                        ends.append(ends[-1] + len(given))
                        ids[row, ends[-2] : ends[-1]] = given
                        positions[row, ends[-2] : ends[-1]] = np.arange(len(given))
                    told.append({"sequence_id": which, "cu_seqlens": ends, "doc_ids": [p["doc_id"] for p in own], "pieces": [p["piece"] for p in own]})
                values = (number, len(found), capacity, kind, ids.tobytes(), positions.tobytes(), told)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    rows.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sequence of the shards in folder: see SEQUENCE; ids are its row of the id
    matrix as little-endian unsigned 32-bit integers."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SEQUENCE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for batch in batches:
            for shard in batch.to_pylist():
                shape = shard["rows"], shard["width"]
                ids = np.frombuffer(shard["ids"], shard["kind"]).reshape(shape).astype("<u4")
                positions = np.frombuffer(shard["positions"], "<u2").reshape(shape)
                out = [(s["sequence_id"], s["cu_seqlens"][-1], s["doc_ids"], s["pieces"], s["cu_seqlens"], ids[k].tobytes(), positions[k].tobytes()) for k, s in enumerate(shard["sequences"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return spark.read.schema(SHARDS).parquet(folder).mapInArrow(run, SEQUENCE)


def packed_sequences(docs: DataFrame, path: str, capacity: int = 2048, pad_id: int = 0, end_id: int = 0) -> DataFrame:
    """The sequences of docs, written as shards to the shared folder and read back."""
    folder = scratch(docs.sparkSession, "packed")
    write_shards(docs, path, folder, capacity, pad_id, end_id)
    return read_shards(docs.sparkSession, folder)


def summary(sequences: DataFrame) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, doc_ids, pieces, cu_seqlens and checksums."""
    return sequences.select("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
