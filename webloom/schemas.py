"""Schemas of requests, captured responses, results and repository records."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


#: A request. ``method`` is GET where it is null; flags that are null are false.
REQUEST_SCHEMA = StructType([StructField("url", StringType(), False), *_struct(("method", StringType()), ("as_markdown", BooleanType()), ("as_text", BooleanType()))])

#: A request and what came back for it. Header names are lower-case. ``net_error`` is timeout, connect or a message.
CAPTURE_SCHEMA = _struct(
    ("url", StringType()), ("method", StringType()), ("as_markdown", BooleanType()), ("as_text", BooleanType()), ("status_code", IntegerType()),
    ("headers", MapType(StringType(), StringType())), ("body", BinaryType()), ("truncated", BooleanType()), ("net_error", StringType()),
)

#: What ``sources.live`` captures: beside that, the code host's records of a repository's page.
LIVE_SCHEMA = StructType([*CAPTURE_SCHEMA, *_struct(("repo_status", IntegerType()), ("repo_json", StringType()), ("readme_status", IntegerType()), ("readme_json", StringType()))])

#: A result, in the order in which its fields are written. Null fields are left out of JSON.
RESPONSE_SCHEMA = _struct(
    ("url", StringType()), ("status_code", IntegerType()), ("content_type", StringType()), ("size", LongType()), ("last_modified", StringType()), ("filename", StringType()),
    ("format", StringType()), ("content", StringType()), ("truncated", BooleanType()), ("method", StringType()), ("error", StringType()),
)
RESPONSE_FIELDS = RESPONSE_SCHEMA.fieldNames()

#: A repository record of the code host's API, and its README record.
REPO_SCHEMA = _struct(
    ("name", StringType()), ("full_name", StringType()), ("description", StringType()), ("html_url", StringType()), ("homepage", StringType()), ("stargazers_count", LongType()),
    ("forks_count", LongType()), ("open_issues_count", LongType()), ("language", StringType()), ("license", _struct(("name", StringType()), ("spdx_id", StringType()))),
    ("default_branch", StringType()), ("created_at", StringType()), ("updated_at", StringType()), ("pushed_at", StringType()), ("topics", ArrayType(StringType())),
    ("archived", BooleanType()), ("fork", BooleanType()), ("owner", _struct(("login", StringType()), ("type", StringType()))),
)
README_SCHEMA = _struct(("content", StringType()), ("encoding", StringType()))
