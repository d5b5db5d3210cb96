"""Requests, results and the tool as plain Python objects, for one URL at a time; tables go through ``webloom.operators``."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from webloom.options import FetchOptions, Tool
from webloom.schemas import REQUEST_SCHEMA, RESPONSE_FIELDS

# Fixed value: the message for a method that isn't known.
BAD_METHOD = "Invalid method: must be GET or HEAD"


def _json(values: dict) -> str:
    return json.dumps({k: v for k, v in values.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class FetchRequest:
    """What is asked for. The method, GET where it is None, is taken in any case; another one is a ValueError."""

    url: str
    method: str | None = None
    as_markdown: bool | None = None
    as_text: bool | None = None

    def __post_init__(self) -> None:
        if self.method is not None:
            if self.method.upper() not in ("GET", "HEAD"):
                raise ValueError(BAD_METHOD)
            object.__setattr__(self, "method", self.method.upper())

    def to_json(self) -> str:
        return _json(asdict(self))

    @staticmethod
    def from_json(text: str) -> FetchRequest:
        """A request from JSON; ValueError if it isn't one. Methods must be written GET or HEAD; other fields are ignored."""
        given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError("a request is an object")
        kinds = {"url": str, "method": str, "as_markdown": bool, "as_text": bool}
        for name, kind in kinds.items():
            if given.get(name) is not None and type(given[name]) is not kind:
                raise ValueError(f"{name} must be a {kind.__name__}")
        if given.get("url") is None:
            raise ValueError("missing field url")
        if given.get("method") not in (None, "GET", "HEAD"):
            raise ValueError(BAD_METHOD)
        return FetchRequest(**{k: given.get(k) for k in kinds})


@dataclass(frozen=True, repr=False)
class FetchResponse:
    """A result; what it lacks is None."""

    url: str
    status_code: int
    content_type: str | None = None
    size: int | None = None
    last_modified: str | None = None
    filename: str | None = None
    format: str | None = None
    content: str | None = None
    truncated: bool | None = None
    method: str | None = None
    error: str | None = None

    def to_json(self) -> str:
        return _json(asdict(self))

    def __repr__(self) -> str:
        return f"FetchResponse(url={json.dumps(self.url, ensure_ascii=False)}, status_code={self.status_code})"


class FetchTool:
    """The tool with fixed options. A request without a result is a ValueError with the reason."""

    def __init__(self, enable_markdown: bool = True, enable_text: bool = True, user_agent: str | None = None, allow_prefixes: list[str] | None = None, block_prefixes: list[str] | None = None, spark: SparkSession | None = None):
        self.options = FetchOptions(user_agent, tuple(allow_prefixes or ()), tuple(block_prefixes or ()), enable_markdown, enable_text)
        self.tool, self.spark = Tool(self.options), spark

    def description(self) -> str:
        return self.tool.description

    def system_prompt(self) -> str:
        return self.tool.system_prompt

    def llmtxt(self) -> str:
        return self.tool.guide

    def input_schema(self) -> str:
        return json.dumps(self.tool.input_schema())

    def output_schema(self) -> str:
        return json.dumps(self.tool.output_schema())

    def results(self, request: FetchRequest) -> DataFrame:
        """The result of a live request as a table of one row."""
        from webloom.sources.live import capture

        spark = self.spark or SparkSession.builder.appName("webloom").config("spark.ui.enabled", "false").getOrCreate()
        asked = spark.createDataFrame([(request.url, request.method, request.as_markdown, request.as_text)], REQUEST_SCHEMA)
        return self.tool.execute(capture(asked, self.options))

    def execute(self, request: FetchRequest) -> FetchResponse:
        row = self.results(request).select(*RESPONSE_FIELDS, "error_message").first()
        if row["error_message"]:
            raise ValueError(row["error_message"])
        return FetchResponse(**{n: row[n] for n in RESPONSE_FIELDS})

    def fetch(self, url: str, method: str | None = None, as_markdown: bool | None = None, as_text: bool | None = None) -> FetchResponse:
        return self.execute(FetchRequest(url, method, as_markdown, as_text))


def fetch(url: str, method: str | None = None, as_markdown: bool | None = None, as_text: bool | None = None) -> FetchResponse:
    """A live request with both conversions enabled."""
    return FetchTool().fetch(url, method, as_markdown, as_text)
