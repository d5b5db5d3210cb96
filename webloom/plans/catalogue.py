"""Queries over the driver's tables, each with its DuckDB equivalent.

The SQL is written apart from the expressions it checks. Where it converts pages it leans on what the test pages hold:
no lists in lists, no preformatted text, no quotes; ``html_nested`` makes pages with these.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webloom.functions import errors, http
from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions import url as U
from webloom.operators import guard, repository, rpc, sinks
from webloom.operators.conformance import check_schema
from webloom.operators.fetch import fetch_with_options, result
from webloom.operators.registry import DefaultFetcher, FetcherRegistry
from webloom.options import FetchOptions, Tool
from webloom.plans import derived as D
from webloom.schemas import CAPTURE_SCHEMA, RESPONSE_FIELDS
from webloom.sources import lines, live, sink
from webloom.sources.captured import from_pages, varied
from webloom.sources.layout import shared_dir, spread
from webloom.streaming.fetch_stream import to_parquet
from webloom.streaming.server import serve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BOTH = FetchOptions(enable_markdown=True, enable_text=True)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for expensive expressions: a small table is dealt to all cores."""
    return spread(_pages(spark, sf_dir))


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# ---- SQL parts -------------------------------------------------------------------------------------------------------

SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NO_NEWLINE = SPACE.replace(r"\t-\r", r"\t\x{b}-\r")


def _sql_clean(x: str) -> str:
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, '[{NO_NEWLINE}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?(\n+) ?', '\1', 'g')"
    return rf"regexp_replace({x}, '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_cap(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _sql_convert(html: str, opens: dict[str, str], closes: dict[str, str], links: bool) -> str:
    skip = "|".join(rf"<[{SPACE}]*{t}(?:[{SPACE}](?:[^>]*[^/>])?)?>[\s\S]*?</[{SPACE}]*{t}(?:[{SPACE}][^>]*)?>" for t in H.SKIPPED.split("|"))
    tokens = f"regexp_extract_all({html}, '(?i){skip}|<[^>]*>?|&[^;{SPACE}]{{0,11}};?|[^<&]+')"
    text = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    table = lambda d: "map {" + ", ".join(f"'{k}': {text(v)}" for k, v in d.items()) + "}"
    name = rf"lower(regexp_extract(t, '^</?[{SPACE}]*([^{SPACE}>]*)', 1))"
    mapped = f"coalesce(case when starts_with(t, '</') then map_extract_value({table(closes)}, {name}) else map_extract_value({table(opens)}, {name}) end, '')"
    if links:
        href = r"""coalesce('[](' || regexp_extract(t, '(?i)href="([^"]*)"', 1) || ')', '')"""
        mapped = rf"case when {name} = 'a' and not starts_with(t, '</') and regexp_matches(t, '(?i)href=') then {href} when {name} = 'a' then '' else {mapped} end"
    entity = f"case when ends_with(t, ';') then coalesce(map_extract_value({table(H.ENTITIES)}, t[2:-2]), '&') else '&' end"
    one = f"case when starts_with(t, '<') then case when regexp_matches(t, '(?i)^<[{SPACE}]*(?:{H.SKIPPED})[{SPACE}>]') then '' else {mapped} end when starts_with(t, '&') then {entity} else t end"
    return _sql_clean(f"coalesce(array_to_string(list_transform({tokens}, lambda t: {one}), ''), '')")


SQL_MARKDOWN = _sql_convert("html", H.MARKDOWN_OPEN, H.MARKDOWN_CLOSE, True)
SQL_TEXT = _sql_convert("html", H.TEXT_OPEN, H.TEXT_CLOSE, False)
SQL_PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
SQL_HOST = r"lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
SQL_FILE = f"case when contains(string_split({SQL_PATH}, '/')[-1], '.') then string_split({SQL_PATH}, '/')[-1] end"
SQL_SCHEME = "(starts_with(url, 'http://') or starts_with(url, 'https://'))"

SQL_CAPTURE = """
cap as (select page_id, url, html,
  case when page_id % 10 = 0 then 'HEAD' end as method, page_id % 3 = 0 as as_markdown, page_id % 3 in (0, 1) as as_text,
  case when page_id % 11 = 0 then 404 when page_id % 13 = 0 then 500 else 200 end as status_code,
  ['text/html', 'text/html; charset=utf-8', 'TEXT/HTML', null, 'text/plain', 'application/pdf', 'IMAGE/png', 'application/json'][page_id % 8 + 1] as content_type,
  case when page_id % 17 = 0 then 'abc' else strlen(html)::varchar end as content_length,
  case when page_id % 5 = 0 then 'Tue, 01 Jan 2024 00:00:00 GMT' end as last_modified,
  ['attachment; filename="report.txt"', 'attachment; filename=file.pdf', 'inline; filename="r.xlsx"; size=1', 'inline', 'attachment; filename=""', null, null, null][page_id % 8 + 1] as disposition,
  page_id % 7 = 0 as truncated,
  case when page_id % 19 = 0 then 'timeout' when page_id % 23 = 0 then 'connect' when page_id % 29 = 0 then 'other' end as net_error from pages)"""
# Fixed values, once more.
SQL_BINARY = r"""regexp_matches(lower(content_type), '^(image/|audio/|video/|font/|application/(octet-stream|pdf|zip|gzip|x-tar|x-rar|x-7z|vnd\.ms-|vnd\.openxmlformats))')"""
SQL_IS_HTML = r"(coalesce(contains(lower(content_type), 'text/html'), false) or coalesce(contains(lower(content_type), 'application/xhtml'), false) or regexp_matches(html, '^\s*(<!DOCTYPE|<html)'))"
SQL_DISPOSITION = r"""case when regexp_matches(disposition, 'filename="[^"]*"') then regexp_extract(disposition, 'filename="([^"]*)"', 1)
  when contains(disposition, 'filename=') and trim(regexp_extract(disposition, 'filename=([^\s;]*)', 1), '"') <> '' then trim(regexp_extract(disposition, 'filename=([^\s;]*)', 1), '"') end"""
SQL_KIND = "case when net_error = 'timeout' then 'FirstByteTimeout' when net_error = 'connect' then 'ConnectError' when net_error is not null then 'RequestError' end"
SQL_RESULT = f"""with {SQL_CAPTURE},
x as (select *, net_error is null as ok, coalesce(method, 'GET') = 'HEAD' as head, coalesce({SQL_BINARY}, false) as bin, {SQL_IS_HTML} as is_html, {SQL_DISPOSITION} as dn from cap),
y as (select *, case when ok and not head and not bin then case when is_html and as_markdown then 'markdown' when is_html and as_text then 'text' else 'raw' end end as format from x),
z as (select *, {_sql_cap(f"case format when 'markdown' then {SQL_MARKDOWN} when 'text' then {SQL_TEXT} when 'raw' then html end")} as c from y),
r as (select page_id, url, case when ok then status_code end as status_code, case when ok then content_type end as content_type,
  case when format is not null then strlen(html) when ok and regexp_matches(content_length, '^[0-9]+$') then content_length::bigint end as size,
  case when ok then last_modified end as last_modified, case when ok then coalesce(dn, {SQL_FILE}) end as filename, format,
  case when format is not null and truncated then c || chr(10) || chr(10) || '[..more content timed out...]' else c end as content,
  case when format is not null and truncated then true end as truncated, case when ok and head then 'HEAD' end as method,
  case when ok and not head and bin then 'Binary content is not supported. Only textual content (HTML, text, JSON, etc.) can be fetched.' end as error,
  {SQL_KIND} as error_kind,
  case when net_error = 'timeout' then 'Request timed out: server did not respond within 1 second' when net_error = 'connect' then 'Failed to connect to server' when net_error is not null then 'Request failed: ' || net_error end as error_message
  from z)"""


# ---- URL checks and routes -------------------------------------------------------------------------------------------


@query(f"select page_id, url from pages where {SQL_SCHEME}")
def scheme_filter(spark, sf_dir):
    return guard.passed(_pages(spark, sf_dir), FetchOptions()).select("page_id", "url")


def _mutated(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    changed = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("ftp://"), F.col("url"))).when(i % 5 == 2, F.concat(F.lit(" "), F.col("url"))).when(i % 5 == 3, F.upper("url")).otherwise(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", changed.alias("url"))


SQL_MUTATED = "m as (select page_id, case page_id % 5 when 0 then '' when 1 then 'ftp://' || url when 2 then ' ' || url when 3 then upper(url) else url end as url from pages)"


@query(f"""with {SQL_MUTATED} select page_id, case when url = '' then 'MissingUrl' when not {SQL_SCHEME} then 'InvalidUrlScheme' end as error_kind,
  case when url = '' then 'Missing required parameter: url' when not {SQL_SCHEME} then 'Invalid URL: must start with http:// or https://' end as error_message from m""")
def invalid_scheme_errors(spark, sf_dir):
    kind = guard.error_kind(F.col("url"), FetchOptions())
    return _mutated(spark, sf_dir).select("page_id", kind.alias("error_kind"), errors.message(kind).alias("error_message"))


@query("select page_id, url from pages where starts_with(url, 'https://')")
def allow_prefix(spark, sf_dir):
    return guard.passed(_pages(spark, sf_dir), FetchOptions(allow_prefixes=("https://",))).select("page_id", "url")


@query(f"select page_id, url from pages where {SQL_SCHEME} and not starts_with(url, 'http://')")
def block_prefix(spark, sf_dir):
    return guard.passed(_pages(spark, sf_dir), FetchOptions(block_prefixes=("http://",))).select("page_id", "url")


@query("select page_id, url from pages where (starts_with(url, 'https://') or starts_with(url, 'http://s')) and not starts_with(url, 'https://site1')")
def allow_then_block(spark, sf_dir):
    return guard.passed(_pages(spark, sf_dir), FetchOptions(allow_prefixes=("https://", "http://s"), block_prefixes=("https://site1",))).select("page_id", "url")


#: Beginnings of the URLs of every seventh and every fifth page: lists as long as the pages are many.
BLOCKED, ALLOWED = ("select substr(url, 1, 8 + page_id % 12) as prefix from pages where page_id % 7 = 3", "select substr(url, 1, 10 + page_id % 15) as prefix from pages where page_id % 5 = 1")


def _prefixes(pages: DataFrame, sql: str) -> DataFrame:
    return pages.sparkSession.sql(sql.replace("from pages", "from {pages}"), pages=pages)


@query(f"select page_id, url from pages where not exists (select 1 from ({BLOCKED}) where starts_with(url, prefix))")
def block_prefix_table(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return guard.blocked_by_table(pages, _prefixes(pages, BLOCKED)).select("page_id", "url")


@query(f"select page_id, url from pages where exists (select 1 from ({ALLOWED}) where starts_with(url, prefix))")
def allow_prefix_table(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return guard.allowed_by_table(pages, _prefixes(pages, ALLOWED)).select("page_id", "url")


@query(f"""with {SQL_MUTATED} select page_id, case when url = '' then 'MissingUrl' when not {SQL_SCHEME} then 'InvalidUrlScheme'
  when not starts_with(url, 'http') or starts_with(url, 'http://') then 'BlockedUrl' end as error_kind from m""")
def url_guard(spark, sf_dir):
    options = FetchOptions(allow_prefixes=("http",), block_prefixes=("http://",))
    return _mutated(spark, sf_dir).select("page_id", guard.error_kind(F.col("url"), options).alias("error_kind"))


# Fixed values, once more, so that the engine's own list is held against another one.
SQL_RESERVED = """'settings', 'explore', 'trending', 'collections', 'events', 'sponsors', 'notifications', 'marketplace', 'pulls', 'issues', 'codespaces', 'features', 'enterprise', 'organizations', 'pricing',
  'about', 'team', 'security', 'login', 'join'"""
SQL_REPO = f"""({SQL_HOST} = 'github.com' and len(string_split({SQL_PATH}, '/')) = 3 and string_split({SQL_PATH}, '/')[2] <> '' and string_split({SQL_PATH}, '/')[3] <> ''
  and string_split({SQL_PATH}, '/')[2] not in ({SQL_RESERVED}))"""


@query(f"""with u as (select page_id as id, url from pages union all select -page_id - 1, url from ({D.sql_of(url=D.REPO_URL)}))
  select id, url, case when {SQL_REPO} then 'github_repo' else 'default' end as route from u""")
def route_dispatch(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    urls = pages.select(F.col("page_id").alias("id"), "url").unionByName(D.derived(pages, url=D.REPO_URL).select((-F.col("page_id") - 1).alias("id"), "url"))
    return urls.select("id", "url", FetcherRegistry.with_defaults().route(F.col("url")).alias("route"))


@query(f"""with u as ({D.sql_of(url=D.REPO_URL)}) select page_id, case when {SQL_REPO} then string_split({SQL_PATH}, '/')[2] end as owner, case when {SQL_REPO} then string_split({SQL_PATH}, '/')[3] end as repo,
  case when {SQL_REPO} then 'https://api.github.com/repos/' || string_split({SQL_PATH}, '/')[2] || '/' || string_split({SQL_PATH}, '/')[3] end as api_url from u""")
def github_url_parse(spark, sf_dir):
    r = U.repository(F.col("url"))
    api = F.when(r.isNotNull(), repository.api_url(F.col("url")))
    return D.derived(_pages(spark, sf_dir), url=D.REPO_URL).select("page_id", r.owner.alias("owner"), r.repo.alias("repo"), api.alias("api_url"))


@query(f"select page_id, {SQL_FILE} as filename from pages")
def url_filename(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.file_name(F.col("url")).alias("filename"))


class _Notes:
    """A plug-in for addresses below a prefix: its results name it."""

    name = "notes"

    def matches(self, url: Column) -> Column:
        return F.startswith(url, F.lit("https://site1"))

    def fetch(self, captures: DataFrame, options: FetchOptions) -> DataFrame:
        return result(captures, {"url": F.col("url"), "status_code": F.lit(200), "format": F.lit("notes"), "content": F.concat(F.lit("notes on "), F.col("url"))})


@query("select page_id, url, 200 as status_code, case when starts_with(url, 'https://site1') then 'notes' else 'raw' end as format, case when starts_with(url, 'https://site1') then 'notes on ' || url end as notes from pages")
def registry_plugin(spark, sf_dir):
    registry = FetcherRegistry([_Notes()]).register(DefaultFetcher())
    out = registry.fetch(from_pages(_dealt(spark, sf_dir)))
    return out.select("page_id", "url", "status_code", "format", F.when(F.col("format") == "notes", F.col("content")).alias("notes"))


@query("select page_id, url, 'FetcherError' as error_kind, 'Fetcher error: No fetcher available for URL' as error_message from pages")
def registry_empty(spark, sf_dir):
    return FetcherRegistry().fetch(from_pages(_pages(spark, sf_dir))).select("page_id", "url", "error_kind", "error_message")


@query(f"""select page_id, case when starts_with(url, 'http://') then 'BlockedUrl' end as error_kind, case when starts_with(url, 'http://') then 'Blocked URL: prefix not allowed' end as error_message,
  case when not starts_with(url, 'http://') then 'raw' end as format, case when not starts_with(url, 'http://') then {_sql_cap("html")} end as content from pages""")
def tool_execute(spark, sf_dir):
    tool = Tool.builder().enable_markdown(False).allow_prefix("http").block_prefix("http://").build()
    return tool.execute(from_pages(_dealt(spark, sf_dir), as_markdown=True)).select("page_id", "error_kind", "error_message", "format", "content")


@query("select n, phase, percent::double as percent, (select count(*) from pages) as rows from (values (1, 'validate', 0), (2, 'connect', 10), (3, 'fetch', 20), (4, 'complete', 100)) t(n, phase, percent)")
def tool_status(spark, sf_dir):
    told = []
    out = Tool().execute_with_status(from_pages(_dealt(spark, sf_dir), as_text=True), told.append)
    rows = out.count()
    out.unpersist()
    first = {}
    for s in told:
        first.setdefault(s.phase, s.percent_complete)
    return _rows(spark, "n int, phase string, percent double, rows long", [(i + 1, phase, percent, rows) for i, (phase, percent) in enumerate(first.items())])


# ---- headers, types, methods -----------------------------------------------------------------------------------------


@query(f"with {SQL_CAPTURE} select page_id, coalesce({SQL_DISPOSITION}, {SQL_FILE}) as filename from cap")
def content_disposition_filename(spark, sf_dir):
    c = varied(_pages(spark, sf_dir))
    return c.select("page_id", http.file_name(http.header(F.col("headers"), "content-disposition"), F.col("url")).alias("filename"))


@query(f"with {SQL_CAPTURE} select page_id, coalesce({SQL_BINARY}, false) as is_binary from cap")
def binary_content_type(spark, sf_dir):
    return varied(_pages(spark, sf_dir)).select("page_id", http.is_binary(http.header(F.col("headers"), "content-type")).alias("is_binary"))


@query(f"with {SQL_CAPTURE} select page_id, {SQL_IS_HTML} as is_html from cap")
def is_html_by_type(spark, sf_dir):
    c = varied(_pages(spark, sf_dir))
    return c.select("page_id", http.is_html(http.header(F.col("headers"), "content-type"), T.lossy(F.col("body"))).alias("is_html"))


@query(r"select doc_id, coalesce(regexp_matches(text, '^\s*(<!DOCTYPE|<html)'), false) as is_html from documents")
def is_html_by_body(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", http.is_html(F.lit(None).cast("string"), F.col("text")).alias("is_html"))


@query(f"""select page_id, coalesce(upper(method), 'GET') as effective, case when upper(method) not in ('GET', 'HEAD') then 'InvalidMethod' end as error_kind,
  case when upper(method) not in ('GET', 'HEAD') then 'Invalid method: must be GET or HEAD' end as error_message from ({D.sql_of(method=D.METHOD)})""")
def method_parse(spark, sf_dir):
    kind = errors.method_kind(F.col("method"))
    return D.derived(_pages(spark, sf_dir), method=D.METHOD).select("page_id", http.effective_method(F.col("method")).alias("effective"), kind.alias("error_kind"), errors.message(kind).alias("error_message"))


@query("select page_id, strlen(html) as size from pages")
def body_size(spark, sf_dir):
    return from_pages(_pages(spark, sf_dir)).select("page_id", F.octet_length("body").cast("bigint").alias("size"))


# ---- text and HTML ---------------------------------------------------------------------------------------------------


def _texts(spark, sf_dir) -> DataFrame:
    d = spread(_table(spark, sf_dir, "documents")).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    return d.unionByName(_table(spark, sf_dir, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))


SQL_TEXTS = "(select 'd' as kind, doc_id as id, 0::bigint as turn, text from documents union all select 'c', conv_id, turn, text from conversations)"


@query(f"select kind, id, turn, {_sql_cap('text')} as text from {SQL_TEXTS}")
def filter_newlines(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", "turn", T.filter_excessive_newlines(F.col("text")).alias("text"))


@query(f"select kind, id, turn, {_sql_clean('text')} as text from {SQL_TEXTS}")
def clean_whitespace(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", "turn", T.clean_whitespace(F.col("text")).alias("text"))


@query(rf"""select page_id, array_to_string(list_transform(regexp_extract_all(html, '&[^;{SPACE}]{{0,11}};?'), lambda t: case when ends_with(t, ';')
  then coalesce(map_extract_value(map {{{', '.join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in H.ENTITIES.items())}}}, t[2:-2]), '&') else '&' end), '') as entities from pages""")
def decode_entities(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?U)&[^;\s]{0,11};?"), F.lit(0))
    return _pages(spark, sf_dir).select("page_id", F.array_join(F.transform(found, lambda t: H.decode_entity(t, F.lit(False))), "").alias("entities"))


@query(r"""select page_id, len(regexp_extract_all(html, '<a\s[^>]*>')) as links, coalesce(array_to_string(list_transform(regexp_extract_all(html, '<a\s[^>]*>'),
  lambda t: case when regexp_matches(t, '(?i)href="[^"]*"') then regexp_extract(t, '(?i)href="([^"]*)"', 1) else '-' end), ' '), '') as hrefs from pages""")
def extract_href(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*>"), F.lit(0))
    hrefs = F.array_join(F.transform(tags, lambda t: F.coalesce(H.attribute(t, "href"), F.lit("-"))), " ")
    return _pages(spark, sf_dir).select("page_id", F.size(tags).cast("bigint").alias("links"), hrefs.alias("hrefs"))


SQL_STRIP = "html"
for _tag in H.SKIPPED.split("|"):
    SQL_STRIP = rf"regexp_replace({SQL_STRIP}, '(?i)<\s*{_tag}(?:\s(?:[^>]*[^/>])?)?>[\s\S]*?</\s*{_tag}(?:\s[^>]*)?>', '', 'g')"


@query(f"select page_id, {SQL_STRIP} as html from pages")
def strip_skip_elements(spark, sf_dir):
    return _dealt(spark, sf_dir).select("page_id", H.without_skipped(F.col("html")).alias("html"))


@query(f"select page_id, {SQL_TEXT} as text from pages")
def html_to_text(spark, sf_dir):
    return _dealt(spark, sf_dir).select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query(f"select page_id, {SQL_MARKDOWN} as markdown from pages")
def html_to_markdown(spark, sf_dir):
    return _dealt(spark, sf_dir).select("page_id", H.html_to_markdown(F.col("html")).alias("markdown"))


@query(D.sql_of(**{name: D.by_page([n[i] for n in D.NESTED]) for i, name in enumerate(("html", "markdown", "text"))}))
def html_nested(spark, sf_dir):
    rows = D.derived(_dealt(spark, sf_dir), html=D.by_page([n[0] for n in D.NESTED]))
    return rows.select("page_id", "html", H.html_to_markdown(F.col("html")).alias("markdown"), H.html_to_text(F.col("html")).alias("text"))


@query(f"select page_id, {SQL_MARKDOWN} as markdown, {SQL_TEXT} as text from pages")
def sql_functions(spark, sf_dir):
    H.register(spark)
    return _dealt(spark, sf_dir).selectExpr("page_id", "html_to_markdown(html) as markdown", "html_to_text(html) as text")


# ---- results ---------------------------------------------------------------------------------------------------------


def _fetched(spark, sf_dir, options: FetchOptions, **flags) -> DataFrame:
    return fetch_with_options(from_pages(_dealt(spark, sf_dir), **flags), options).select("page_id", "url", "status_code", "size", "format", "content")


def _sql_fetched(form: str, content: str) -> str:
    return f"select page_id, url, 200 as status_code, strlen(html) as size, '{form}' as format, {_sql_cap(content)} as content from pages"


@query(_sql_fetched("markdown", SQL_MARKDOWN))
def fetch_markdown(spark, sf_dir):
    return _fetched(spark, sf_dir, BOTH, as_markdown=True)


@query(_sql_fetched("text", SQL_TEXT))
def fetch_text(spark, sf_dir):
    return _fetched(spark, sf_dir, BOTH, as_text=True)


@query(_sql_fetched("raw", "html"))
def fetch_raw(spark, sf_dir):
    return _fetched(spark, sf_dir, BOTH)


@query(_sql_fetched("raw", "html"))
def fetch_conversion_disabled(spark, sf_dir):
    return _fetched(spark, sf_dir, FetchOptions(), as_markdown=True, as_text=True)


@query(f"{SQL_RESULT} select * from r")
def fetch_varied(spark, sf_dir):
    return fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH)


@query(f"{SQL_RESULT} select page_id, status_code, content_type, size, last_modified, filename, method from r where method = 'HEAD'")
def head_metadata(spark, sf_dir):
    out = fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("method = 'HEAD'")
    return out.select("page_id", "status_code", "content_type", "size", "last_modified", "filename", "method")


@query(f"{SQL_RESULT} select page_id, truncated, content from r where truncated")
def truncation_marker(spark, sf_dir):
    return fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("truncated").select("page_id", "truncated", "content")


@query(f"{SQL_RESULT} select page_id, size, content, format, error from r where error is not null")
def binary_response(spark, sf_dir):
    return fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error is not null").select("page_id", "size", "content", "format", "error")


@query(f"{SQL_RESULT} select page_id, status_code, format, content from r where status_code >= 400")
def status_passthrough(spark, sf_dir):
    return fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("status_code >= 400").select("page_id", "status_code", "format", "content")


@query(f"""{SQL_RESULT} select page_id, concat('---', chr(10), 'url: ', url, chr(10), 'status_code: ' || status_code || chr(10), 'source_content_type: ' || content_type || chr(10), 'source_size: ' || size || chr(10),
  'last_modified: ' || last_modified || chr(10), 'filename: ' || filename || chr(10), case when truncated then 'truncated: true' || chr(10) end, '---', chr(10), coalesce(content, error, '')) as front from r where error_kind is null""")
def front_matter(spark, sf_dir):
    return fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error_kind is null").select("page_id", sinks.front_matter().alias("front"))


@query(f"""{SQL_RESULT}, j as (select page_id, json_merge_patch('{{}}', to_json({{url: url, status_code: status_code, content_type: content_type, size: size, last_modified: last_modified, filename: filename, format: format,
  content: content, truncated: truncated, method: method, error: error}}))::varchar as json from r where error_kind is null) select * from j""")
def response_json(spark, sf_dir):
    out = fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error_kind is null")
    return out.select("page_id", sinks.response_json().alias("json"))


def _sql_member(name: str) -> str:
    return f"""'"{name}": ' || to_json({name})::varchar"""


@query(f"""{SQL_RESULT} select page_id, '{{' || chr(10) || '  ' || array_to_string(list_filter([{', '.join(_sql_member(n) for n in RESPONSE_FIELDS)}], lambda x: x is not null), ',' || chr(10) || '  ') || chr(10) || '}}' as json
  from r where error_kind is null""")
def response_json_pretty(spark, sf_dir):
    out = fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error_kind is null")
    return out.select("page_id", sinks.response_json(pretty=True).alias("json"))


@query("select page_id, 'FetchResponse(url=\"' || url || '\", status_code=200)' as line from pages")
def short_form(spark, sf_dir):
    return fetch_with_options(from_pages(_dealt(spark, sf_dir)), BOTH).select("page_id", sinks.short_form().alias("line"))


@query(f"""with l as ({D.sql_of(value=D.REQUEST)}), j as (select page_id, case when json_valid(value) then value end as value from l),
  r as (select page_id, json_extract_string(value, '$.url') as url, json_extract_string(value, '$.method') as method, (value->'$.as_markdown')::boolean as as_markdown, (value->'$.as_text')::boolean as as_text from j)
  select *, case when url is null or method not in ('GET', 'HEAD') then 'InvalidRequest' end as error_kind from r""")
def request_json(spark, sf_dir):
    return sinks.parse_requests(D.derived(_pages(spark, sf_dir), value=D.REQUEST)).select("page_id", "url", "method", "as_markdown", "as_text", "error_kind")


@query(f"""with n as ({D.sql_of(net_error=D.NET_ERROR)}), k as (select *, case net_error when 'timeout' then 'FirstByteTimeout' when 'connect' then 'ConnectError' when 'blocked' then 'BlockedUrl' when 'scheme' then 'InvalidUrlScheme'
  when 'missing' then 'MissingUrl' when 'method' then 'InvalidMethod' else case when net_error is not null then 'RequestError' end end as error_kind from n)
  select page_id, error_kind, case error_kind when 'FirstByteTimeout' then 'Request timed out: server did not respond within 1 second' when 'ConnectError' then 'Failed to connect to server' when 'BlockedUrl' then 'Blocked URL: prefix not allowed'
  when 'InvalidUrlScheme' then 'Invalid URL: must start with http:// or https://' when 'MissingUrl' then 'Missing required parameter: url' when 'InvalidMethod' then 'Invalid method: must be GET or HEAD'
  when 'RequestError' then 'Request failed: ' || net_error end as error_message from k""")
def error_taxonomy(spark, sf_dir):
    kind = errors.network_kind(F.col("net_error"))
    return D.derived(_pages(spark, sf_dir), net_error=D.NET_ERROR).select("page_id", kind.alias("error_kind"), errors.message(kind, F.col("net_error")).alias("error_message"))


KINDS = [
    ("MissingUrl", "Missing required parameter: url"), ("InvalidUrlScheme", "Invalid URL: must start with http:// or https://"), ("InvalidMethod", "Invalid method: must be GET or HEAD"),
    ("BlockedUrl", "Blocked URL: prefix not allowed"), ("ClientBuildError", "Failed to create HTTP client"), ("FirstByteTimeout", "Request timed out: server did not respond within 1 second"),
    ("ConnectError", "Failed to connect to server"), ("RequestError", "Request failed: "), ("FetcherError", "Fetcher error: "),
]


@query(D.sql_of(kind=D.by_page([f"'{k}'" for k, _ in KINDS]), message=D.by_page([f"'{m}'" + (" || url" if m.endswith(": ") else "") for _, m in KINDS])))
def error_messages(spark, sf_dir):
    rows = D.derived(_pages(spark, sf_dir), kind=D.by_page([f"'{k}'" for k, _ in KINDS]), url="url")
    return rows.select("page_id", "kind", errors.message(F.col("kind"), F.col("url")).alias("message"))


# ---- repositories ----------------------------------------------------------------------------------------------------

ENCODED = D.by_page([
    "regexp_replace(base64(encode(html, 'UTF-8')), '\\r', '')", "''", "substring(base64(encode(html, 'UTF-8')), 1, 4 * (page_id % 5) + 3)", f"base64(encode({D.LABEL}, 'UTF-8')) || base64(encode({D.NAME}, 'UTF-8'))", "'////'",
    "base64(encode(url, 'UTF-8')) || chr(9) || ' '",
])


@query(D.sql_of(text=D.by_page(["html", "''", "null", f"{D.LABEL} || {D.NAME}", "null", "decode(from_base64(to_base64(encode(url))))"])))
def github_base64(spark, sf_dir):
    return D.derived(_pages(spark, sf_dir), encoded=ENCODED).select("page_id", T.base64_text(F.col("encoded")).alias("text"))


def _repo_sql() -> str:
    line = lambda label, v: f"'- **{label}:** ' || {v} || chr(10)"
    text = f"""concat('# ', full_name, chr(10), chr(10), description || chr(10) || chr(10), '## Repository Info', chr(10), chr(10), {line('Stars', 'stars')}, {line('Forks', 'forks')}, {line('Open Issues', 'issues')}, {line('Language', 'language')},
      {line('License', 'coalesce(spdx, license)')}, {line('Topics', 'topics')}, {line('URL', 'html_url')}, {line('Homepage', "nullif(homepage, '')")}, {line('Default Branch', "'main'")}, {line('Owner', "login || ' (User)'")},
      case when archived then '- **Status:** Archived' || chr(10) end, case when fork then '- **Fork:** Yes' || chr(10) end, {line('Created', 'created')}, {line('Last Updated', 'updated')}, {line('Last Push', 'pushed')},
      chr(10) || '---' || chr(10) || chr(10) || '## README' || chr(10) || chr(10) || case when encoded then readme end)"""
    return f"""with g as (select *, repo_status between 200 and 299 as found, found and not bad and pushed is not null as fine from ({D.sql_of(**D.RECORD)}))
      select page_id, case when not found then repo_status when fine then 200 end as status_code, case when fine then 'text/markdown' end as content_type, case when fine then 'github_repo' end as format,
      case when fine then {text} end as content, case when found then null when repo_status = 404 then 'Repository ' || full_name || ' not found' when repo_status = 403 then 'GitHub API rate limit exceeded'
      else 'GitHub API error: HTTP ' || repo_status end as error, case when found and not fine then 'Fetcher error: Failed to parse repo data' end as error_message from g"""


def _captures(rows: DataFrame) -> DataFrame:
    """Rows with all fields of a capture, those that are missing as nulls."""
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CAPTURE_SCHEMA if f.name not in rows.columns])


@query(_repo_sql())
def github_markdown(spark, sf_dir):
    return fetch_with_options(_captures(D.repository_records(_dealt(spark, sf_dir))), BOTH).select("page_id", "status_code", "content_type", "format", "content", "error", "error_message")


FAILED = {"net_error": D.by_page(["'timeout'", "'connect'", f"'reset by ' || {D.LABEL}", "null", "null", "null"]), "repo_status": D.by_page(["null", "200", "null", "null", "404", "403"]), "url": f"'https://github.com/' || {D.PAGE}"}


@query(f"""with f as ({D.sql_of(name=D.PAGE, **FAILED)}), k as (select *, case when net_error = 'timeout' then 'FirstByteTimeout' when net_error = 'connect' then 'ConnectError' when net_error is not null then 'RequestError'
  when repo_status is null then 'FetcherError' end as error_kind from f) select page_id, case when error_kind is null then repo_status end as status_code,
  case when error_kind is null then case repo_status when 404 then 'Repository ' || name || ' not found' else 'GitHub API rate limit exceeded' end end as error, error_kind,
  case error_kind when 'FirstByteTimeout' then 'Request timed out: server did not respond within 1 second' when 'ConnectError' then 'Failed to connect to server' when 'RequestError' then 'Request failed: ' || net_error
  when 'FetcherError' then 'Fetcher error: No repository record was captured' end as error_message from k""")
def github_network_errors(spark, sf_dir):
    rows = D.derived(_pages(spark, sf_dir), **FAILED).withColumn("repo_status", F.col("repo_status").cast("int"))
    return fetch_with_options(_captures(rows), BOTH).select("page_id", "status_code", "error", "error_kind", "error_message")


@query(D.sql_of(**D.NORMAL))
def url_normalised(spark, sf_dir):
    r = U.repository(F.col("url"))
    return D.derived(_pages(spark, sf_dir), url=D.DETOUR).select("page_id", r.owner.alias("owner"), r.repo.alias("repo"), U.file_name(F.col("url")).alias("filename"))


@query(f"""select page_id, case when status between 200 and 299 then null when status = 404 then 'Repository ' || owner || '/' || repo || ' not found' when status = 403 then 'GitHub API rate limit exceeded'
  else 'GitHub API error: HTTP ' || status end as error from ({D.sql_of(owner=D.LABEL, repo=D.NAME, status=D.STATUS)})""")
def github_api_error(spark, sf_dir):
    rows = D.derived(_pages(spark, sf_dir), owner=D.LABEL, repo=D.NAME, status=D.STATUS)
    return rows.select("page_id", repository.api_error(F.col("owner"), F.col("repo"), F.col("status")).alias("error"))


# ---- JSON-RPC, schemas, streams --------------------------------------------------------------------------------------

@query(f"select * from ({D.sql_of(reply=D.by_page([reply for _, reply in D.LINES]))}) where reply is not null")
def jsonrpc_dispatch(spark, sf_dir):
    return rpc.replies(D.derived(_pages(spark, sf_dir), value=D.by_page([line for line, _ in D.LINES]))).select("page_id", "reply")


FIRST_REPLY = """{"protocolVersion":"2024-11-05","capabilities":{"tools":{}},"serverInfo":{"name":"webloom","version":"0.1.0"}}"""
LISTED = (
    """{"tools":[{"name":"webloom","description":"Turns web responses into Markdown or plain text with their metadata; binary content gives metadata only.","inputSchema":"""
    """{"type":"object","properties":{"url":{"type":"string","description":"Address of the page, beginning with http:// or https://"}},"required":["url"]}}]}"""
)


@query(D.sql_of(reply=D.by_page([f"{D.OF_ID}\"result\":{FIRST_REPLY}}}'", f"""'{{"jsonrpc":"2.0","id":"' || {D.NAME} || '","result":{LISTED}}}'"""])))
def jsonrpc_handshake(spark, sf_dir):
    return rpc.replies(D.derived(_pages(spark, sf_dir), value=D.by_page(D.HANDSHAKE))).select("page_id", "reply")


@query(f"""select page_id, '{{"jsonrpc":"2.0","id":' || page_id || ',"result":{{"content":[{{"type":"text","text":' || to_json(concat('---', chr(10), 'url: ', url, chr(10), 'status_code: 200', chr(10), 'source_content_type: text/html', chr(10),
  'source_size: ', strlen(html), chr(10), 'filename: ' || ({SQL_FILE}) || chr(10), '---', chr(10), {_sql_cap(SQL_MARKDOWN)}))::varchar || '}}]}}}}' as reply from pages""")
def jsonrpc_tools_call(spark, sf_dir):
    pages = _dealt(spark, sf_dir)
    ask = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("page_id").cast("string"), F.lit(',"method":"tools/call","params":{"name":"webloom","arguments":{"url":"'), F.col("url"), F.lit('"}}}'))
    # pages may share a URL: a call is answered from the page it was made from
    return rpc.replies(pages.select("page_id", ask.alias("value")), from_pages(pages), by=["page_id"]).select("page_id", "reply")


SQL_KINDS = "case property when 'status_code' then 'integer' when 'size' then 'integer' when 'truncated' then 'boolean' else 'string' end"
ASKED = D.by_page([
    """'{"url":"' || url || '","method":"GET","as_markdown":true}'""", """'{"method":"HEAD"}'""", """'{"url":"' || url || '","method":"PUT"}'""", """'{"url":' || cast(page_id as string) || ',"as_text":true}'""", """'{"url":"' || url || '","as_text":null,"as_markdown":"yes"}'""",
])


@query(f"""{SQL_RESULT}, told as (select page_id, unnest([{', '.join(f"{{'property': '{n}', 'there': {n} is not null}}" for n in RESPONSE_FIELDS)}]) as field from r where error_kind is null)
  select page_id, 'out' as side, field.property as property, {SQL_KINDS.replace('property', 'field.property')} as kind, null::varchar as fault from told where field.there
  union all select page_id, 'in', property, kind, fault from ({D.sql_of(form='page_id % 5')}) join (values (0, 'url', 'string', null), (0, 'method', 'string', null), (0, 'as_markdown', 'boolean', null), (1, 'method', 'string', null),
  (1, 'url', null, 'missing'), (2, 'url', 'string', null), (2, 'method', 'string', 'value'), (3, 'url', 'integer', 'kind'), (3, 'as_text', 'boolean', 'unknown'), (4, 'url', 'string', null), (4, 'as_text', 'null', 'unknown'),
  (4, 'as_markdown', 'string', 'kind')) t(form, property, kind, fault) using (form)""")
def tool_schema(spark, sf_dir):
    """The properties of results and of requests, held against the tool's schemas; the tool has no conversion to text."""
    pages = _dealt(spark, sf_dir)
    made = fetch_with_options(varied(pages), BOTH).where("error_kind is null").select("page_id", F.lit("out").alias("side"), sinks.response_json().alias("json"))
    asked = D.derived(pages, side="'in'", json=ASKED)
    out = check_schema(made, Tool().output_schema()).unionByName(check_schema(asked, Tool.builder().enable_text(False).build().input_schema()))
    return out.select("page_id", "side", "property", "kind", "fault")


@query(_sql_fetched("text", SQL_TEXT))
def stream_fetch_text(spark, sf_dir):
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])
    # a file stream reads folders or patterns
    pages = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages.parquet*")
    out = fetch_with_options(from_pages(pages, as_text=True), BOTH).select("page_id", "url", "status_code", "size", "format", "content")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    to_parquet(out, f"{folder}/out", f"{folder}/state").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _written(spark, df: DataFrame, **options) -> str:
    """The folder that the sink wrote a table to."""
    sink.register(spark)
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    writer = df.write.format("webloom_files").mode("overwrite").option("path", path)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save()
    return path


SQL_FRONT = ORACLE_SQL["front_matter"]


@query(f"select page_id::varchar as name, front as content from ({SQL_FRONT})")
def sink_files(spark, sf_dir):
    """Pages with front matter as a file each, read again."""
    made = fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error_kind is null").select(F.col("page_id").cast("string").alias("name"), sinks.front_matter().alias("content"))
    path = _written(spark, made, form="files", suffix=".md")
    read = spark.read.text(f"{path}/*/*.md", wholetext=True)
    return read.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("content"))


@query(f"select json as value from ({ORACLE_SQL['response_json']})")
def sink_lines(spark, sf_dir):
    """Results as lines of JSON, read again by the line source."""
    made = fetch_with_options(varied(_dealt(spark, sf_dir)), BOTH).where("error_kind is null").select(sinks.response_json().alias("value"))
    lines.register(spark)
    return spark.read.format("webloom_lines").load(_written(spark, made)).select("value")


@query(f"select reply as value from ({ORACLE_SQL['jsonrpc_dispatch']})")
def stream_rpc(spark, sf_dir):
    """A line of each kind for each page through the server: a stream of lines in, files of replies out."""
    asked = _written(spark, D.derived(_dealt(spark, sf_dir), value=D.by_page([line for line, _ in D.LINES])))
    folder = f"{shared_dir(spark)}/served-{uuid.uuid4().hex}"
    serve(spark, asked, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(f"{folder}/out/batch-*/*.jsonl")


@query(f"""with {SQL_MUTATED} select page_id, case when url = '' then 'MissingUrl' when not {SQL_SCHEME} then 'InvalidUrlScheme' else 'BlockedUrl' end as error_kind,
  case when url = '' then 'Missing required parameter: url' when not {SQL_SCHEME} then 'Invalid URL: must start with http:// or https://' else 'Blocked URL: prefix not allowed' end as error_message from m""")
def live_guard(spark, sf_dir):
    """What the live source makes of requests that it must not make: none of these leaves the machine."""
    options = FetchOptions(allow_prefixes=("http://none.invalid/", "https://none.invalid/"))
    asked = _mutated(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("method"), F.lit(True).alias("as_markdown"), F.lit(False).alias("as_text"))
    return fetch_with_options(live.capture(asked, options, keep=("page_id",)), BOTH).select("page_id", "error_kind", "error_message")
