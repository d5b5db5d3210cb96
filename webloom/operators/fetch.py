"""Captured responses to results: HEAD, binary and text branches, conversion, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import errors
from webloom.functions import html as H
from webloom.functions import http
from webloom.functions.text import filter_excessive_newlines, lossy
from webloom.options import FetchOptions
from webloom.schemas import CAPTURE_SCHEMA, RESPONSE_FIELDS, RESPONSE_SCHEMA

# Fixed values.
TRUNCATED = "\n\n[..more content timed out...]"
BINARY = "Binary content is not supported. Only textual content (HTML, text, JSON, etc.) can be fetched."

#: Columns of a capture, with those of a repository's page.
CAPTURED = [*CAPTURE_SCHEMA.fieldNames(), "repo_status", "repo_json", "readme_status", "readme_json"]
RESULT_FIELDS = [*RESPONSE_FIELDS, "error_kind", "error_message"]


def result(df: DataFrame, fields: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """Rows with the result fields in order, null where not given; of ``columns`` those that aren't a capture's stay in front."""
    rest = [c for c in columns or df.columns if c not in CAPTURED and c not in RESULT_FIELDS]
    kinds = {f.name: f.dataType for f in RESPONSE_SCHEMA} | {"error_kind": "string", "error_message": "string"}
    return df.select(*rest, *[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in RESULT_FIELDS])


def spare(columns: list[str]) -> str:
    """A prefix for helper columns that none of ``columns`` has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


Fields = tuple[DataFrame, dict[str, Column]]


def failure_fields(kind: Column, detail: Column) -> dict[str, Column]:
    return {"url": F.col("url"), "error_kind": kind, "error_message": errors.message(kind, detail)}


def default_fields(captures: DataFrame, options: FetchOptions, active: Column, known: Column | None = None) -> Fields:
    """The captures with helper columns, and the result fields of ordinary URLs for the rows that are ``active``.

    HEAD rows have metadata only, with the size from Content-Length; binary types have an error text and no content;
    others have the decoded body, converted if it is HTML and the conversion is both asked for and enabled (Markdown
    before text), with newlines capped and then, if the body was cut off, a mark. Statuses of 400 and above are
    ordinary. A network error gives error_kind and error_message alone.
    """
    headers = F.col("headers")
    p = spare(captures.columns)
    # Values that several fields need are columns of their own, which the planner computes once.
    step = captures.withColumn(f"{p}ok", F.coalesce(active & F.col("net_error").isNull(), F.lit(False)))
    ok = F.col(f"{p}ok")
    step = step.withColumns({f"{p}kind": F.when(ok, http.header(headers, "content-type")), f"{p}head": ok & (http.effective_method(F.col("method")) == "HEAD")})
    kind, head = F.col(f"{p}kind"), F.col(f"{p}head")
    step = step.withColumns({f"{p}binary": ok & ~head & http.is_binary(kind), f"{p}textual": ok & ~head & ~http.is_binary(kind)})
    textual = F.col(f"{p}textual")
    step = step.withColumn(f"{p}body", F.when(textual, F.coalesce(lossy(F.col("body")), F.lit(""))))
    markdown = F.lit(options.enable_markdown) & F.coalesce(F.col("as_markdown"), F.lit(False))
    text = F.lit(options.enable_text) & F.coalesce(F.col("as_text"), F.lit(False))
    form = F.when(textual, F.when((markdown | text) & http.is_html(kind, F.col(f"{p}body")), F.when(markdown, "markdown").otherwise("text")).otherwise("raw"))
    step = step.withColumn(f"{p}format", form)
    wanted = {name: F.coalesce(F.col(f"{p}format") == name, F.lit(False)) if on else None for name, on in (("markdown", options.enable_markdown), ("text", options.enable_text))}
    content = F.when(F.col(f"{p}format") == "raw", F.col(f"{p}body"))
    if options.enable_markdown or options.enable_text:
        content = F.coalesce(content, H.converted(F.col(f"{p}body"), wanted["markdown"], wanted["text"]))
    cut = textual & F.coalesce(F.col("truncated"), F.lit(False))
    step = step.withColumns({
        f"{p}size": F.when(textual, F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint")).when(ok, http.content_length(http.header(headers, "content-length"))),
        f"{p}content": F.concat(filter_excessive_newlines(content), F.when(cut, TRUNCATED).otherwise("")),
        f"{p}filename": F.when(ok, http.file_name(http.header(headers, "content-disposition"), F.col("url"), known)),
    })
    network = F.when(active, errors.network_kind(F.col("net_error")))
    return step, {
        "url": F.col("url"),
        "status_code": F.when(ok, F.col("status_code")),
        "content_type": kind,
        "size": F.col(f"{p}size"),
        "last_modified": F.when(ok, http.header(headers, "last-modified")),
        "filename": F.col(f"{p}filename"),
        "format": F.col(f"{p}format"),
        "content": F.col(f"{p}content"),
        "truncated": F.when(cut, True),
        "method": F.when(head, "HEAD"),
        "error": F.when(F.col(f"{p}binary"), BINARY),
        "error_kind": network,
        "error_message": errors.message(network, F.col("net_error")),
    }


def default_response(captures: DataFrame, options: FetchOptions) -> DataFrame:
    """Results of captures of ordinary URLs; see ``default_fields``."""
    step, fields = default_fields(captures, options, F.lit(True))
    return result(step, fields, captures.columns)


def fetch_with_options(captures: DataFrame, options: FetchOptions) -> DataFrame:
    """Results of captures through the default registry. Captures of repository pages carry further columns; without them those rows are errors."""
    from webloom.operators.registry import FetcherRegistry

    return FetcherRegistry.with_defaults().fetch(captures, options, missing=True)


def fetch(captures: DataFrame) -> DataFrame:
    """``fetch_with_options`` with both conversions enabled."""
    return fetch_with_options(captures, FetchOptions(enable_markdown=True, enable_text=True))
