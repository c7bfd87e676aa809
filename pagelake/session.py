"""Running per-page kernels over DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pages in one Arrow batch for a kernel, and rows of one batch that it gives back.
PAGES_PER_BATCH, ROWS_OUT = 512, 8192

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark's file server, once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_PER_BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), "pagelake_base.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def flat_map(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str | StructType, columns: list[str] | None = None) -> DataFrame:
    """Rows that kernel(*values of a row) gives, for every row; only `columns` of them are built and sent back.

    One narrow stage over Arrow batches: no shuffle, and memory is bounded by PAGES_PER_BATCH rows in and ROWS_OUT out."""
    ship(df.sparkSession)
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keep = [i for i, f in enumerate(full.fields) if columns is None or f.name in columns]
    out_schema = StructType([full.fields[i] for i in keep])
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in zip(keep, arrow, strict=True)], schema=arrow)

        held: list[tuple] = []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.extend(kernel(*values))
                if len(held) >= ROWS_OUT:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return df.mapInArrow(run, out_schema)
