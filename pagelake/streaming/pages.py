"""Pages that arrive as a stream, through the same kernels: stateless, so there is no watermark to wait for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..kernels.html_tree import Options
from ..sources.pages import compute_styles, parse_nodes

PAGES = "page_id long, url string, html string"


def stream_pages(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 100) -> DataFrame:
    """Pages from Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_nodes(pages: DataFrame, options: Options | None = None, columns: list[str] | None = None) -> DataFrame:
    return parse_nodes(pages, options, columns)


def stream_styles(pages: DataFrame, properties: list[str]) -> DataFrame:
    return compute_styles(pages, properties=properties)


def write_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a folder, each file of the source once, and stop when all that is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
