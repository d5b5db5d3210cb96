"""The batch functions on streams: they keep no state, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from webloom.operators.fetch import fetch_with_options
from webloom.operators.rpc import replies
from webloom.options import FetchOptions
from webloom.schemas import CAPTURE_SCHEMA


def captures(spark: SparkSession, path: str, schema: StructType = CAPTURE_SCHEMA, files_per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    """A stream of captures from a folder, ``files_per_trigger`` files in each batch."""
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def results(stream: DataFrame, options: FetchOptions) -> DataFrame:
    return fetch_with_options(stream, options)


def rpc(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """Replies to the JSON-RPC lines of text files that arrive in a folder."""
    return replies(spark.readStream.text(path), pages)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that takes what is there and ends; start() it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
