"""JSON-RPC 2.0 lines to replies: a DataFrame function, for batches and streams alike."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import __version__
from webloom.functions import errors
from webloom.operators import guard
from webloom.operators.fetch import fetch
from webloom.operators.sinks import front_matter
from webloom.options import TOOL_DESCRIPTION, TOOL_NAME, FetchOptions
from webloom.schemas import RESPONSE_FIELDS

# The protocol's version, its error codes, and the messages that go with them.
PROTOCOL = "2024-11-05"
PARSE_ERROR, NOT_FOUND, BAD_PARAMS = -32700, -32601, -32602
UNKNOWN_TOOL, MISSING_URL, UNKNOWN_METHOD = "Unknown tool: ", "Missing required argument: url", "Method not found: "


def _reply(id_: Column, body: Column) -> Column:
    """The envelope; ``id_`` and ``body`` (result or error, with its key) are JSON."""
    return F.concat(F.lit('{"jsonrpc":"2.0"'), F.coalesce(F.concat(F.lit(',"id":'), id_), F.lit("")), F.lit(","), body, F.lit("}"))


def _error(code: int, message: Column) -> Column:
    return F.concat(F.lit(f'"error":{{"code":{code},"message":'), _quoted(message), F.lit("}"))


def _quoted(s: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with id (raw JSON, null if absent or null), rpc_method, params (raw JSON) and bad. Empty lines are dropped."""
    v = F.col("_json")
    raw = lambda at: F.to_json(F.try_variant_get(v, at, "variant"))
    parts = {"_version": "$.jsonrpc", "_id": "$.id", "_method": "$.method", "_tool": "$.params.name", "_url": "$.params.arguments.url"}
    told = lines.where(F.col(column) != "").withColumn("_json", F.try_parse_json(F.col(column))).withColumns({n: raw(at) for n, at in parts.items()})
    text = lambda n: F.when(F.startswith(n, F.lit('"')), F.from_json(F.concat(F.lit('{"s":'), F.col(n), F.lit("}")), "s string").s)
    told = told.withColumns({"id": F.when(F.col("_id") != "null", F.col("_id")), "rpc_method": text("_method"), "tool": text("_tool"), "url": text("_url"), "bad": v.isNull() | text("_version").isNull()})
    return told.withColumn("bad", F.col("bad") | F.col("rpc_method").isNull()).drop("_json", *parts)


def replies(lines: DataFrame, captures: DataFrame | None = None, column: str = "value", tool_name: str = TOOL_NAME, by: Sequence[str] = ()) -> DataFrame:
    """One row (…, reply) for each line that gets a reply.

    Notifications without an id get none; an unknown method without an id gets one all the same. A tool call's URL is
    looked up in ``captures`` (as for ``fetch``, one row a URL); one that isn't there counts as a failed connection.
    Where a URL was captured more than once, ``by`` names columns of both tables that tell whose captures a line sees:
    those of equal values (nulls are equal), one row a URL.
    """
    told = parse(lines, column)
    told = told.where(F.col("bad") | ~(F.col("id").isNull() & F.startswith("rpc_method", F.lit("notifications/"))))
    kept = [c for c in lines.columns]
    call = ~F.col("bad") & (F.col("rpc_method") == "tools/call") & (F.col("tool") == tool_name) & F.col("url").isNotNull()
    told = told.withColumn("call_url", F.when(call, F.col("url")))
    told = told.withColumn("call_error", F.coalesce(guard.error_kind(F.col("call_url"), FetchOptions()), F.lit("ConnectError")))
    told = told.withColumn("call_error", errors.message(F.col("call_error")))
    failure = F.col("call_error")
    if captures is None:
        told = told.withColumn("text", F.lit(None).cast("string"))
    else:
        # only pages that are called for are converted; a broadcast of the calls, where they are few, saves the shuffle
        called = told.where("call_url is not null").select("call_url", *[F.col(n).alias(f"call_{n}") for n in by]).distinct()
        captures = captures.join(called, reduce(and_, [F.col(n).eqNullSafe(F.col(f"call_{n}")) for n in by], captures["url"] == called["call_url"]), "left_semi")
        pages = fetch(captures.withColumn("as_markdown", F.lit(True)).select(*captures.columns if "as_markdown" in captures.columns else [*captures.columns, "as_markdown"]))
        pages = pages.select(F.col("url").alias("page_url"), *[F.col(n).alias(f"page_{n}") for n in by], F.when(F.col("error_kind").isNull(), front_matter({n: F.col(n) for n in RESPONSE_FIELDS})).alias("text"), "error_message")
        told = told.join(pages, reduce(and_, [F.col(n).eqNullSafe(F.col(f"page_{n}")) for n in by], told.call_url == pages.page_url), "left")
        failure = F.coalesce("error_message", failure)
    content = lambda s, more: F.concat(F.lit('"result":{"content":[{"type":"text","text":'), _quoted(s), F.lit("}]" + more + "}"))
    listed = {"tools": [{"name": tool_name, "description": TOOL_DESCRIPTION, "inputSchema": {"type": "object", "properties": {"url": {"type": "string", "description": "Address of the page, beginning with http:// or https://"}}, "required": ["url"]}}]}
    first = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": tool_name, "version": __version__}}
    constant = lambda x: F.lit('"result":' + json.dumps(x, separators=(",", ":")))
    method = F.col("rpc_method")
    body = (
        F.when(F.col("bad"), _error(PARSE_ERROR, F.lit("Parse error: not a request")))
        .when(method == "initialize", constant(first))
        .when(method == "tools/list", constant(listed))
        .when((method == "tools/call") & ~F.coalesce(F.col("tool") == tool_name, F.lit(False)), _error(BAD_PARAMS, F.concat(F.lit(UNKNOWN_TOOL), F.coalesce("tool", F.lit("")))))
        .when((method == "tools/call") & F.col("call_url").isNull(), _error(BAD_PARAMS, F.lit(MISSING_URL)))
        .when((method == "tools/call") & F.col("text").isNotNull(), content(F.col("text"), ""))
        .when(method == "tools/call", content(F.concat(F.lit("Error: "), failure), ',"isError":true'))
        .when(method == "notifications/initialized", F.lit('"result":null'))
        .otherwise(_error(NOT_FOUND, F.concat(F.lit(UNKNOWN_METHOD), method)))
    )
    return told.select(*kept, _reply(F.when(~F.col("bad"), F.col("id")), body).alias("reply"))
