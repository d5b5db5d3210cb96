"""A JSON-RPC server over lines: a stream of requests in, files of replies out, many lines in each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from webloom.operators.rpc import parse, replies
from webloom.options import FetchOptions
from webloom.sources import lines, live, sink

#: Given the URLs of a batch's calls (distinct), their captures.
Capture = Callable[[DataFrame], DataFrame]


def live_captures(options: FetchOptions = FetchOptions(enable_markdown=True)) -> Capture:
    return lambda urls: live.capture(urls.selectExpr("url", "cast(null as string) method", "true as_markdown", "false as_text"), options)


def answered(batch: DataFrame, capture: Capture | None) -> DataFrame:
    """Replies to lines (file, at, value), in their order, as one column value."""
    known = None
    if capture is not None:
        known = capture(parse(batch).where("rpc_method = 'tools/call' and url is not null").select("url").distinct())
    return replies(batch, known).sort("file", "at").select(F.col("reply").alias("value"))


def serve(spark: SparkSession, path: str, out: str, checkpoint: str, capture: Capture | None = None) -> DataStreamWriter:
    """A writer that answers the lines of ``path`` (a growing file, or a folder of such) under ``out``; start() it.

    Replies of batch n are in ``out``/batch-n, in the order of their lines. Offsets are in ``checkpoint``: a server that is
    started again answers what it hasn't answered, and a batch that broke off is replaced whole, so no reply is lost or
    doubled. Each batch is one job over all lines that have come, and fetches each of their URLs once.
    """
    lines.register(spark)
    sink.register(spark)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # lines are read once, for the URLs and the replies
        answered(kept, capture).write.format("webloom_files").mode("overwrite").option("path", f"{out}/batch-{number:08d}").save()
        kept.unpersist()

    stream = spark.readStream.format("webloom_lines").load(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def committed(out: str) -> list[str]:
    """Files of replies in the order of their lines."""
    from pyarrow import fs

    from webloom.sources.places import opened

    store, root = opened(out)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return []
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and "/_pending-" not in f.path and f.base_name.startswith("part-"))
