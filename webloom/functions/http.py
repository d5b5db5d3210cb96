"""Functions on methods, headers and bodies of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import url as U

# Beginnings of content types that aren't text.
BINARY_TYPES = (
    "image/", "audio/", "video/", "application/octet-stream", "application/pdf", "application/zip", "application/gzip", "application/x-tar",
    "application/x-rar", "application/x-7z", "application/vnd.ms-", "application/vnd.openxmlformats", "font/",
)


def valid_method(method: Column) -> Column:
    return F.upper(method).isin("GET", "HEAD")


def effective_method(method: Column) -> Column:
    return F.coalesce(F.upper(method), F.lit("GET"))


def header(headers: Column, name: str) -> Column:
    """A header's value; null if it is missing or holds other than visible ASCII, blanks and tabs."""
    value = F.try_element_at(headers, F.lit(name))
    return F.when(F.rlike(value, F.lit(r"^[\x20-\x7E\t]*$")), value)


def content_length(value: Column) -> Column:
    """An unsigned number, else null; blanks aren't tolerated."""
    return F.when(F.rlike(value, F.lit(r"^\+?[0-9]+$")), value).try_cast("bigint")


def is_binary(content_type: Column) -> Column:
    return F.coalesce(U.any_prefix(F.lower(content_type), BINARY_TYPES), F.lit(False))


def is_html(content_type: Column, body: Column) -> Column:
    """By the type, or by a body that begins, after white space, with ``<!DOCTYPE`` or ``<html`` in that case."""
    kind = F.lower(content_type)
    typed = F.coalesce(F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml")), F.lit(False))
    return typed | F.coalesce(F.rlike(body, F.lit(r"(?U)\A\s*(?:<!DOCTYPE|<html)")), F.lit(False))


def disposition_name(value: Column) -> Column:
    """File name of a Content-Disposition header: the quoted form (which may be empty) before the bare one; else null."""
    quoted = r'^(?s:.*?)filename="([^"]*)"'
    # The first place of each form decides, even where a later one would fit.
    first_quoted = F.rlike(value, F.lit(r'^(?>(?s:.*?)filename=")[^"]*"'))
    bare = F.regexp_replace(F.regexp_extract(value, r"(?U)^(?>(?s:.*?)filename=)([^\s;]*)", 1), r'^"+|"+$', "")
    return F.when(first_quoted, F.regexp_extract(value, quoted, 1)).when(bare != "", bare)


def file_name(disposition: Column, url: Column, known: Column | None = None) -> Column:
    return F.coalesce(disposition_name(disposition), U.file_name(url, known))
