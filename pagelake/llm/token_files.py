"""Writing documents as files of token ids, in ascending doc_id order, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import ship
from .tokens import tokenizer, with_end

#: A segment is closed at so many ids or more, so that memory is bounded.
SEGMENT_IDS = 1 << 19
FILES = "shard int, segment int, n_ids long, data binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ids of all documents below `path`, as Parquet rows (shard, segment, n_ids, data) of coded segments.

    Documents are dealt out by ranges of doc_id, so shards follow each other in ascending order (null first, then
    rows of equal doc_id by text). A null text is an empty document: it has the end id alone. A document stands whole
    in one segment.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        names: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            blob = simple8b.pack_segment(names, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["shard", "segment", "n_ids", "data"])

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for lo, hi, ids, bounds in tokenizer(vocabulary).encode(b.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                names += doc_ids[lo:hi]
                counts.append(np.diff(bounds))
                parts.append(ids)
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield close()
                    names, counts, parts, held, segment = [], [], [], 0, segment + 1
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    rows.mapInArrow(run, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    Where a segment begins is the sum of those before it: one number for each segment is added up, not one for each
    document."""
    ship(spark)
    files = spark.read.schema(FILES).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    segments = files.select("shard", "segment", "n_ids")
    segments = segments.select("shard", "segment", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).alias("inside"))
    base = segments.join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, shard, segment in zip(b.column("data"), b.column("shard"), b.column("segment"), strict=True):
                names, counts, ids = simple8b.read_segment(data.as_buffer())
                raw = memoryview(ids.astype("<u4")).cast("B")
                upto = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(upto[:-1]), pa.array(counts), pa.array(crc, pa.int64())], ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("shard", "segment", "data").mapInArrow(run, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
