"""Session helpers, written intermediate tables and distributed connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most so many rows; texts can be long.
ROWS_PER_BATCH = 512

_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors and bound the Arrow batches.

    The archive goes through Spark's own file server, once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(), "pagelake_ship.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs on one machine, as in tests, a local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pagelake-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear_scratch() deletes."""
    path = f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends, and lost executors cost nothing that is written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # type: ignore[attr-defined]
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that cut() made and that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove(path)


def scratch_paths() -> list[str]:
    """Paths that were given out and not deleted yet."""
    return list(_written)


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these paths, or all that were given out, once the results that read them are written."""
    for path in list(_written) if paths is None else paths:
        _delete(spark, path)
        _written.remove(path)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that stands in an edge; root is the smallest node reachable.

    Alternates the large-star and small-star steps; every round is written to the shared folder, so the
    plan stays short. Minima combine before the shuffle. The rows of a hub meet the one row of its minimum in a join, which Spark
    broadcasts where the minima are few and splits where a partition is skewed (AQE).
    """
    pair = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        seen = Observation()
        new = cut(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "cc")
        discard(now)
        now, mark = new, seen.get
        if mark == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
    raise RuntimeError("connected components did not settle")


def crc32_mod4(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % F.lit(4)
