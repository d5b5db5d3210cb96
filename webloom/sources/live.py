"""Live HTTP: requests to captures, by the standard library.

Requests are made in Arrow batches on the executors, several at a time per task. The captures should be written before
anything else reads them: a repeated task asks the servers again.
"""

from __future__ import annotations

import functools
import http.client
import io
import ssl
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib import error, parse, request

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from webloom.functions.hosts import has_scheme, parsed, refused
from webloom.functions.hosts import repository as repository_of
from webloom.options import DEFAULT_USER_AGENT, FetchOptions
from webloom.schemas import LIVE_SCHEMA, REQUEST_SCHEMA

#: Seconds for a request as a whole, from the connection to the last byte, and for one to the code host's API.
TOTAL, API = 1.0, 10.0
API_BASE = "https://api.github.com"

# Accept headers.
ACCEPT_MARKDOWN = "text/html, text/markdown, text/plain, */*;q=0.8"
ACCEPT_TEXT = "text/html, text/plain, */*;q=0.8"
ACCEPT_RAW = "*/*"
ACCEPT_API = "application/vnd.github+json"


def accept(markdown: bool, text: bool) -> str:
    return ACCEPT_MARKDOWN if markdown else ACCEPT_TEXT if text else ACCEPT_RAW


class _Timed(io.RawIOBase):
    """A socket's stream whose reads end at a moment, however many there are."""

    def __init__(self, raw: io.RawIOBase, sock, end: float):
        self.inner, self.sock, self.end = raw, sock, end

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int | None:
        left = self.end - time.monotonic()
        if left <= 0:
            raise TimeoutError("timed out")
        self.sock.settimeout(left)
        return self.inner.readinto(buffer)

    def close(self) -> None:
        self.inner.close()
        super().close()


class _Response(http.client.HTTPResponse):
    def __init__(self, sock, *args, end: float, **kwargs):
        super().__init__(sock, *args, **kwargs)
        self.fp = io.BufferedReader(_Timed(self.fp.detach(), sock, end))


class _Redirects(request.HTTPRedirectHandler):
    """Redirects to http(s) URLs; any other is a failure of the request."""

    def redirect_request(self, asked, *args):
        if not has_scheme(args[-1].lower()):
            raise ValueError("redirected to a URL that isn't http or https")
        return super().redirect_request(asked, *args)

    def http_error_302(self, asked, answer, code, message, headers):
        target = headers.get("location", headers.get("uri"))
        if target and not has_scheme(parse.urljoin(asked.full_url, target).lower()):
            raise ValueError("redirected to a URL that isn't http or https")
        return super().http_error_302(asked, answer, code, message, headers)

    http_error_301 = http_error_303 = http_error_307 = http_error_308 = http_error_302


def _opener(end: float) -> request.OpenerDirector:
    """Opens URLs with one deadline for connections, redirects, headers and bodies together."""

    def timed(kind):
        def connect(host: str, **kwargs):
            connection = kind(host, **kwargs | {"timeout": max(0.001, end - time.monotonic())})
            connection.response_class = functools.partial(_Response, end=end)
            return connection

        return connect

    class Plain(request.HTTPHandler):
        def http_open(self, asked):
            return self.do_open(timed(http.client.HTTPConnection), asked)

    class Secure(request.HTTPSHandler):
        def https_open(self, asked):
            return self.do_open(timed(http.client.HTTPSConnection), asked, context=ssl.create_default_context())

    opener = request.OpenerDirector()  # nothing but HTTP: no files, no FTP, no data URLs
    for handler in (request.ProxyHandler, Plain, Secure, _Redirects, request.HTTPDefaultErrorHandler, request.HTTPErrorProcessor, request.UnknownHandler):
        opener.add_handler(handler())
    return opener


def inflate(body: bytes, coding: str) -> tuple[bytes, bool]:
    """The decoded body as far as it goes, and whether it is whole."""
    if coding == "br":
        out, stream = [], pa.CompressedInputStream(pa.BufferReader(body), "brotli")
        try:
            while part := stream.read(65536):
                out.append(part)
        except OSError:
            return b"".join(out), False
        return b"".join(out), True
    raw = coding == "deflate" and body[:1] and (body[0] & 15 != 8 or (body[0] << 8 | body[1] if len(body) > 1 else 1) % 31)
    out = []
    while body:
        unpack = zlib.decompressobj(-15 if raw else 47)
        try:
            for a in range(0, len(body), 65536):
                out.append(unpack.decompress(body[a : a + 65536]))
                if unpack.eof:
                    break
        except zlib.error:
            return b"".join(out), False
        if not unpack.eof:
            return b"".join(out), False
        body = unpack.unused_data + body[a + 65536 :] if coding == "gzip" else b""
    return b"".join(out), True


def get(url: str, method: str | None, markdown: bool, text: bool, agent: str | None, seconds: float = TOTAL, accepted: str | None = None) -> tuple:
    """status_code, headers, body, truncated, net_error of one request. Statuses of 400 and above are responses.

    ``seconds`` are for all of it. A body that breaks off, or isn't there in time, is kept as far as it came; it counts as
    truncated if any of it came. Decoded bodies lose the headers on their coded form.
    """
    end = time.monotonic() + seconds
    agent = agent if agent and agent.isascii() and agent.isprintable() else DEFAULT_USER_AGENT
    head = (method or "GET").upper() == "HEAD"
    headers = {"User-Agent": agent, "Accept": accepted or accept(markdown, text), "Accept-Encoding": "gzip, br, deflate"}
    try:
        try:
            answer = _opener(end).open(request.Request(url, method="HEAD" if head else "GET", headers=headers), timeout=seconds)
        except error.HTTPError as e:
            answer = e
        headers = {k.lower(): v for k, v in answer.headers.items()}
        parts, cut = [], False
        with answer:
            while not head:
                try:
                    if not (part := answer.read1(65536)):
                        cut = bool(getattr(answer, "length", None)) and bool(parts)  # fewer bytes than were announced
                        break
                except (OSError, ValueError, http.client.HTTPException):
                    cut = bool(parts)
                    break
                parts.append(part)
        body = b"".join(parts)
        coding = headers.get("content-encoding", "").strip().lower()
        if coding in ("gzip", "br", "deflate") and headers.get("content-length") != "0":
            headers = {k: v for k, v in headers.items() if k not in ("content-encoding", "content-length")}
            body, whole = inflate(body, coding) if body else (body, True)
            cut = bool(body) and (cut or not whole)
        return answer.status, headers, body, cut, None
    except TimeoutError:
        return None, None, None, None, "timeout"
    except error.URLError as e:
        return None, None, None, None, "timeout" if isinstance(e.reason, TimeoutError) else "connect"
    except (OSError, ValueError, http.client.HTTPException) as e:
        return None, None, None, None, str(e) or type(e).__name__


def repository(owner: str, repo: str, agent: str | None, base: str = API_BASE) -> tuple:
    """The five fields of ``get`` and repo_status, repo_json, readme_status, readme_json of a repository's page, by two API calls.

    Only a failure of the first is one; the second, which isn't made unless the first succeeds, may fail.
    """

    def ask(path: str) -> tuple[int | None, str | None, str | None]:
        status, _, body, _, failed = get(f"{base}/repos/{owner}/{repo}{path}", None, False, False, agent, API, ACCEPT_API)
        return status, None if body is None else body.decode("utf-8", "replace"), failed

    status, record, failed = ask("")
    readme = ask("/readme")[:2] if status is not None and 200 <= status < 300 else (None, None)
    return None, None, None, None, failed, status, record, *readme


def asked(url: str | None, method: str | None, markdown: bool, text: bool, options: FetchOptions, api: str = API_BASE) -> tuple:
    """What LIVE_SCHEMA has of a request behind its first four fields. Requests that fail a check aren't made; net_error says why."""
    why = refused(url, options.allow_prefixes, options.block_prefixes) or ("method" if method is not None and method.upper() not in ("GET", "HEAD") else None)
    if why:
        return None, None, None, None, why, *(None,) * 4
    if page := repository_of(url):
        return repository(*page, options.user_agent, api)
    return *get(url, method, options.enable_markdown and markdown, options.enable_text and text, options.user_agent), *(None,) * 4


def capture(requests: DataFrame, options: FetchOptions = FetchOptions(), together: int = 16, api: str = API_BASE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Captures (LIVE_SCHEMA, behind the columns ``keep``) of a DataFrame of requests.

    URLs that fail the checks of ``options`` aren't asked for; net_error says which check it was. Repository pages are
    asked for by the code host's API, under ``api``.
    """
    rows = requests.select(*keep, *REQUEST_SCHEMA.fieldNames())
    names = LIVE_SCHEMA.fieldNames()
    schema = StructType([*requests.select(*keep).schema, *LIVE_SCHEMA])
    flag = lambda v: bool(v) if v is not None else False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(together) as pool:
            for b in batches:
                made = pool.map(lambda r: asked(r.url, r.method, flag(r.as_markdown), flag(r.as_text), options, api), b.itertuples())
                found = pd.DataFrame(list(made), columns=names[4:], dtype=object)
                yield pd.concat([b.reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(run, schema)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def _holds(f: Filter, url: str) -> bool | None:
    """Whether a URL passes a filter of the plan; None if the filter isn't one on URLs that the source decides."""
    if isinstance(f, Not):
        found = _holds(f.child, url)
        return None if found is None else not found
    if getattr(f, "attribute", None) != ("url",):
        return None
    tests = {EqualTo: lambda: url == f.value, EqualNullSafe: lambda: url == f.value, In: lambda: url in f.value, IsNotNull: lambda: True, StringStartsWith: lambda: url.startswith(f.value), StringEndsWith: lambda: url.endswith(f.value), StringContains: lambda: f.value in url}
    return tests[type(f)]() if type(f) in tests else None


class _Reader(DataSourceReader):
    """Requests by host: neighbours in a partition are of one host, and a host with many URLs has several partitions."""

    def __init__(self, options: dict):
        words = lambda name: tuple(options.get(name, "").split())
        on = lambda name, default="false": str(options.get(name, default)).lower() == "true"
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.parts = max(1, int(options.get("partitions", 1)))
        self.method, self.markdown, self.text, self.api = options.get("method"), on("as_markdown"), on("as_text"), options.get("api", API_BASE)
        self.options = FetchOptions(options.get("user_agent"), words("allow_prefixes"), words("block_prefixes"), on("enable_markdown", "true"), on("enable_text", "true"))

    def partitions(self) -> list[_Part]:
        host = lambda u: (parsed(u) or ("", ""))[0]
        urls = sorted(self.urls, key=host)
        each = max(1, -(-len(urls) // self.parts))
        return [_Part(urls[a : a + each]) for a in range(0, max(1, len(urls)), each)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with ThreadPoolExecutor(16) as pool:
            ask = lambda u: (u, self.method, self.markdown, self.text, *asked(u, self.method, self.markdown, self.text, self.options, self.api))
            yield from pool.map(ask, partition.urls)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on URLs are decided before anything is asked for."""
        for f in filters:
            if _holds(f, "") is None:
                yield f
            else:
                self.urls = [u for u in self.urls if _holds(f, u)]


class WebSource(DataSource):
    """``spark.read.format("webloom")``: captures of option urls (separated by blanks).

    Further options: method, as_markdown, as_text, enable_markdown, enable_text, user_agent, allow_prefixes and
    block_prefixes (separated by blanks), api (of the code host), partitions. URLs that aren't http(s), or that the lists
    refuse, are rows without a response whose net_error says so, and are never asked for. With option pushdown, which needs
    ``spark.sql.python.filterPushdown.enabled``, filters on url drop rows before their requests are made.
    """

    @classmethod
    def name(cls) -> str:
        return "webloom"

    def schema(self) -> StructType:
        return LIVE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (_PushedReader if options.get("pushdown", "").lower() == "true" else _Reader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)
