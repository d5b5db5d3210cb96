"""Tables of stored pages as captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.schemas import CAPTURE_SCHEMA


def from_pages(pages: DataFrame, as_markdown: bool | None = None, as_text: bool | None = None, content_type: str | None = "text/html") -> DataFrame:
    """Captures of (page_id, url, html) as responses of status 200; page_id stays."""
    headers = F.create_map(F.lit("content-type"), F.lit(content_type)) if content_type else F.lit(None).cast("map<string,string>")
    return pages.select(
        "page_id", "url", F.lit(None).cast("string").alias("method"), F.lit(as_markdown).cast("boolean").alias("as_markdown"), F.lit(as_text).cast("boolean").alias("as_text"),
        F.lit(200).alias("status_code"), headers.alias("headers"), F.col("html").cast("binary").alias("body"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("net_error"),
    )


def varied(pages: DataFrame) -> DataFrame:
    """Captures of all kinds made from pages by rules on page_id: types, methods, statuses, headers, failures."""
    i, k = F.col("page_id"), F.col("page_id") % 8
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    length = F.when(i % 17 == 0, "abc").otherwise(F.octet_length("html").cast("string"))
    headers = {
        "content-type": pick(["text/html", "text/html; charset=utf-8", "TEXT/HTML", None, "text/plain", "application/pdf", "IMAGE/png", "application/json"]),
        "content-length": length,
        "last-modified": F.when(i % 5 == 0, "Tue, 01 Jan 2024 00:00:00 GMT"),
        "content-disposition": pick(['attachment; filename="report.txt"', "attachment; filename=file.pdf", 'inline; filename="r.xlsx"; size=1', "inline", 'attachment; filename=""', None, None, None]),
    }
    made = {
        "method": F.when(i % 10 == 0, "HEAD"), "as_markdown": i % 3 == 0, "as_text": (i % 3).isin(0, 1), "status_code": F.when(i % 11 == 0, 404).when(i % 13 == 0, 500).otherwise(200),
        "headers": F.create_map(*[x for n, v in headers.items() for x in (F.lit(n), v.cast("string"))]), "body": F.col("html").cast("binary"), "truncated": i % 7 == 0,
        "net_error": F.when(i % 19 == 0, "timeout").when(i % 23 == 0, "connect").when(i % 29 == 0, "other"),
    }
    return pages.select("page_id", "url", *[made[n].alias(n) for n in CAPTURE_SCHEMA.fieldNames() if n != "url"])
