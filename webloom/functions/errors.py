"""Error kinds and their messages, as columns; a bad row never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages by kind.
MESSAGES = {
    "MissingUrl": "Missing required parameter: url",
    "InvalidUrlScheme": "Invalid URL: must start with http:// or https://",
    "InvalidMethod": "Invalid method: must be GET or HEAD",
    "BlockedUrl": "Blocked URL: prefix not allowed",
    "ClientBuildError": "Failed to create HTTP client",
    "FirstByteTimeout": "Request timed out: server did not respond within 1 second",
    "ConnectError": "Failed to connect to server",
    "RequestError": "Request failed: ",
    "FetcherError": "Fetcher error: ",
}


def message(kind: Column, detail: Column | None = None) -> Column:
    """Message of a kind; the last two kinds take a detail."""
    base = F.coalesce(*[F.when(kind == k, F.lit(m)) for k, m in MESSAGES.items()])
    return F.concat(base, F.when(kind.isin("RequestError", "FetcherError"), F.coalesce(detail, F.lit(""))).otherwise("")) if detail is not None else base


#: Kinds of what a capture's net_error may say instead of a message: what befell the request, or why it wasn't made.
NETWORK = {"timeout": "FirstByteTimeout", "connect": "ConnectError", "missing": "MissingUrl", "scheme": "InvalidUrlScheme", "method": "InvalidMethod", "blocked": "BlockedUrl"}


def network_kind(net_error: Column) -> Column:
    out = F.when(F.lit(False), "")
    for said, kind in NETWORK.items():
        out = out.when(net_error == said, kind)
    return out.when(net_error.isNotNull(), "RequestError")


def method_kind(method: Column) -> Column:
    from webloom.functions.http import valid_method

    return F.when(~F.coalesce(valid_method(method), F.lit(True)), "InvalidMethod")
