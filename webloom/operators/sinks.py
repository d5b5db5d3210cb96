"""Serialised results: Markdown with front matter, JSON, JSON-RPC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.schemas import REQUEST_SCHEMA, RESPONSE_FIELDS


def front_matter(r: dict[str, Column] | None = None) -> Column:
    """Metadata between dashes, values as they are, then the content, or else the error text."""
    c = r or {n: F.col(n) for n in RESPONSE_FIELDS}
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v.cast("string"), F.lit("\n"))
    return F.concat_ws(
        "", F.lit("---\n"), line("url", c["url"]), line("status_code", c["status_code"]), line("source_content_type", c["content_type"]), line("source_size", c["size"]),
        line("last_modified", c["last_modified"]), line("filename", c["filename"]), F.when(c["truncated"], "truncated: true\n"), F.lit("---\n"), F.coalesce(c["content"], c["error"], F.lit("")),
    )


def _member(name: str) -> Column:
    """A field as a member of a JSON object with a blank after the colon, null if the field is."""
    value = F.regexp_replace(F.to_json(F.array(F.col(name))), r"^\[|\]$", "")
    return F.when(F.col(name).isNotNull(), F.concat(F.lit(f'"{name}": '), value))


def response_json(pretty: bool = False) -> Column:
    """A result as JSON, without its null fields; ``pretty`` with a line for each field, two blanks ahead."""
    if pretty:
        return F.concat(F.lit("{\n  "), F.concat_ws(",\n  ", *[_member(n) for n in RESPONSE_FIELDS]), F.lit("\n}"))
    return F.to_json(F.struct(*RESPONSE_FIELDS))


def request_json() -> Column:
    return F.to_json(F.struct(*REQUEST_SCHEMA.fieldNames()))


def parse_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Requests from JSON lines, with error_kind: null, or InvalidRequest for bad JSON, a missing url, or a method that isn't exactly GET or HEAD."""
    r = F.from_json(column, REQUEST_SCHEMA)
    good = r.url.isNotNull() & F.coalesce(r.method.isin("GET", "HEAD"), F.lit(True))
    return df.select("*", *[r[n].alias(n) for n in REQUEST_SCHEMA.fieldNames()], F.when(~F.coalesce(good, F.lit(False)), "InvalidRequest").alias("error_kind"))


def short_form() -> Column:
    """One line for people."""
    return F.format_string('FetchResponse(url="%s", status_code=%d)', F.col("url"), F.col("status_code"))
