"""Options, the tool with its builder and status, and its texts and schemas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_USER_AGENT = "webloom/0.1"
TOOL_NAME = "webloom"
TOOL_DESCRIPTION = "Turns web responses into Markdown or plain text with their metadata; binary content gives metadata only."
TOOL_GUIDE = """# webloom

Input: url (http or https), method (GET or HEAD), as_markdown, as_text.
Output: url, status_code, content_type, size, last_modified, filename, format (markdown, text, raw or github_repo),
content, truncated, method (HEAD only), error. What a response lacks is left out.
Statuses of 400 and above are results like others. Bad or blocked URLs and network failures are errors.
"""


@dataclass(frozen=True)
class FetchOptions:
    """What a run may do. Both conversions are off unless they are enabled here."""

    user_agent: str | None = None
    allow_prefixes: tuple[str, ...] = ()
    block_prefixes: tuple[str, ...] = ()
    enable_markdown: bool = False
    enable_text: bool = False


@dataclass(frozen=True)
class ToolStatus:
    phase: str
    message: str | None = None
    percent_complete: float | None = None
    eta_ms: int | None = None

    def with_message(self, message: str) -> ToolStatus:
        return replace(self, message=message)

    def with_percent(self, percent: float) -> ToolStatus:
        return replace(self, percent_complete=percent)

    def with_eta(self, eta_ms: int) -> ToolStatus:
        return replace(self, eta_ms=eta_ms)


@dataclass
class ToolBuilder:
    """Builds a ``Tool``; both conversions are on unless they are switched off."""

    options: FetchOptions = field(default_factory=lambda: FetchOptions(enable_markdown=True, enable_text=True))

    def _set(self, **changes: Any) -> ToolBuilder:
        self.options = replace(self.options, **changes)
        return self

    def enable_markdown(self, enable: bool) -> ToolBuilder:
        return self._set(enable_markdown=enable)

    def enable_text(self, enable: bool) -> ToolBuilder:
        return self._set(enable_text=enable)

    def user_agent(self, agent: str) -> ToolBuilder:
        return self._set(user_agent=agent)

    def allow_prefix(self, prefix: str) -> ToolBuilder:
        return self._set(allow_prefixes=(*self.options.allow_prefixes, prefix))

    def block_prefix(self, prefix: str) -> ToolBuilder:
        return self._set(block_prefixes=(*self.options.block_prefixes, prefix))

    def build(self) -> Tool:
        return Tool(self.options)


@dataclass(frozen=True)
class Tool:
    """Applies fixed options to DataFrames of captured responses, or of requests (``live``)."""

    options: FetchOptions = field(default_factory=lambda: FetchOptions(enable_markdown=True, enable_text=True))

    @staticmethod
    def builder() -> ToolBuilder:
        return ToolBuilder()

    description = TOOL_DESCRIPTION
    system_prompt = ""
    guide = TOOL_GUIDE

    def input_schema(self) -> dict:
        """JSON Schema of a request, without the conversions that are off."""
        flag = lambda text: {"type": ["boolean", "null"], "description": text}
        properties = {
            "url": {"type": "string", "description": "Address of the page, beginning with http:// or https://"},
            "method": {"enum": ["GET", "HEAD", None], "description": "GET unless it is given; HEAD gives metadata alone"},
            "as_markdown": flag("Turn HTML into Markdown"), "as_text": flag("Turn HTML into plain text"),
        }
        off = {"as_markdown": not self.options.enable_markdown, "as_text": not self.options.enable_text}
        return {"type": "object", "required": ["url"], "properties": {k: v for k, v in properties.items() if not off.get(k)}}

    @staticmethod
    def output_schema() -> dict:
        """JSON Schema of a result."""
        from webloom.schemas import RESPONSE_SCHEMA

        kinds = {"string": "string", "integer": "integer", "long": "integer", "boolean": "boolean"}
        told = {
            "url": "Address as it was asked for", "status_code": "HTTP status", "content_type": "Content-Type header", "size": "Bytes of the body", "last_modified": "Last-Modified header",
            "filename": "From Content-Disposition, else from the address", "format": "markdown, text, raw or github_repo", "content": "The text", "truncated": "Whether the body was cut off",
            "method": "HEAD for such a request", "error": "Why there is no content",
        }
        kind = lambda f: kinds[f.dataType.typeName()]
        properties = {f.name: {"type": kind(f) if f.name in ("url", "status_code") else [kind(f), "null"], "description": told[f.name]} for f in RESPONSE_SCHEMA}
        return {"type": "object", "required": ["url", "status_code"], "properties": properties}

    def execute(self, captures: DataFrame) -> DataFrame:
        from webloom.operators.fetch import fetch_with_options

        return fetch_with_options(captures, self.options)

    def execute_with_status(self, captures: DataFrame, report: Callable[[ToolStatus], None], every: float = 0.2) -> DataFrame:
        """Runs the job now, with reports: validate 0, connect 10, fetch 20 and on as its tasks end, complete 100.

        Meanwhile percents rise from 20 towards 100 by the share of tasks that have ended, with the time that the rest will
        take at that pace; ``report`` is called for these, every ``every`` seconds at most, by another thread.

        The result is persisted, as the job has run once it is returned; unpersist() it when it isn't needed any more.

        As soon as a URL of the batch is empty or lacks a scheme, nothing after validate is reported; such rows carry
        their errors all the same.
        """
        from webloom.functions.url import has_scheme
        from webloom.streaming.progress import watched

        report(ToolStatus("validate").with_percent(0.0))
        bad = captures.where(~F.coalesce(has_scheme(F.col("url")), F.lit(False))).limit(1).count()
        out = self.execute(captures)
        if bad:
            return out
        report(ToolStatus("connect").with_percent(10.0))
        report(ToolStatus("fetch").with_percent(20.0))
        out = out.persist()
        with watched(captures.sparkSession, lambda done, eta: report(ToolStatus("fetch").with_percent(20 + 80 * done).with_eta(eta)), every):
            out.count()
        report(ToolStatus("complete").with_percent(100.0))
        return out
