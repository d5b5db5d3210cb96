"""URL, header and result operators, sinks, JSON-RPC, the registry and the tool."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from webloom import api
from webloom.functions import errors, hosts, http
from webloom.functions import text as T
from webloom.functions import url as U
from webloom.operators import guard, sinks
from webloom.operators.fetch import TRUNCATED, default_response, fetch, fetch_with_options
from webloom.operators.registry import DefaultFetcher, FetcherRegistry, RepositoryFetcher
from webloom.options import FetchOptions, Tool, ToolStatus
from webloom.schemas import CAPTURE_SCHEMA, RESPONSE_FIELDS

BOTH = FetchOptions(enable_markdown=True, enable_text=True)
PAGE = "<html><body><h2>Low tide</h2><p>The <b>mud</b></p><style>y</style><ol><li>crab</li></ol></body></html>"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def captured(spark, url="http://h/p", method=None, md=None, text=None, status=200, headers=None, body="", cut=False, net=None):
    raw = body if isinstance(body, bytes) else None if body is None else body.encode()
    return spark.createDataFrame([(url, method, md, text, status, headers or {}, raw, cut, net)], CAPTURE_SCHEMA)


@pytest.mark.parametrize("kind", ["image/png", "audio/mp3", "video/mp4", "application/pdf", "application/octet-stream", "application/zip", "application/vnd.ms-excel", "font/woff2", "IMAGE/svg+xml"])
def test_binary(spark, kind):
    assert one(spark, kind, http.is_binary)


@pytest.mark.parametrize("kind", ["text/html", "text/plain", "application/json", "application/javascript", None])
def test_not_binary(spark, kind):
    assert not one(spark, kind, http.is_binary)


@pytest.mark.parametrize(
    "value, want",
    [('attachment; filename="tide table.csv"', "tide table.csv"), ("attachment; filename=crab.tar.gz; x=y", "crab.tar.gz"), ('inline; size=1; filename="a;b.ods"; q=1', "a;b.ods"), ("inline", None), ('a; filename=""', ""), ("filename*=UTF-8''x", None), (None, None)],
)
def test_disposition(spark, value, want):
    assert one(spark, value, http.disposition_name) == want


@pytest.mark.parametrize("url, want", [("https://e.com/m/n/tide.csv", "tide.csv"), ("https://e.com/m/n.o/p", None), ("https://e.com/m/../x%2Ey/./z.w", "z.w"), ("https://e.com/ä b.c", "%C3%A4%20b.c"), ("https://e.com/", None), ("https://e.com/a.b?x=/c.d#e.f", "a.b"), ("https://e.com", None)])
def test_url_file_name(spark, url, want):
    assert one(spark, url, U.file_name) == want


@pytest.mark.parametrize("url, good", [("http://a.b", True), ("https://a.b:80/x y", True), ("http://", False), ("https://?x", False), ("http://a:99999", False), ("http://a:x/", False), ("http://a b/", False), ("http://[::1]/", True), ("http://a%2eb/", True), ("http://a%20b/", False), ("http://a%zz/", False), ("http://a.b\n/c ", True)])
def test_parses(spark, url, good):
    assert one(spark, url, U.parses) is good


def test_guard(spark):
    options = FetchOptions(allow_prefixes=("https://a.com",), block_prefixes=("https://a.com/x",))
    rows = [("", "MissingUrl"), (None, "MissingUrl"), ("ftp://x", "InvalidUrlScheme"), ("HTTP://a.com", "InvalidUrlScheme"), ("https://a.com.evil", None), ("https://a.com/x1", "BlockedUrl"), ("https://b.com", "BlockedUrl")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert df.where(~guard.error_kind(F.col("url"), options).eqNullSafe(F.col("want"))).collect() == []
    assert spark.createDataFrame([("",)], "url string").select(guard.error_kind(F.col("url"), options, missing=False)).first()[0] == "InvalidUrlScheme"
    assert guard.passed(df.select("url"), options).collect() == [("https://a.com.evil",)]


def test_prefix_filters_reach_the_scan(spark):
    df = guard.passed(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), FetchOptions(allow_prefixes=("https://",))).select("url")
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith(url,https://)" in plan and "html" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_base64(spark):
    assert [one(spark, v, T.base64_text) for v in ("bG93IHRpZGUsIMOp", "", "abc", "////", "YQ==Yg==", "====", "=AAA", "Y===")] == ["low tide, é", "", None, None, "ab", "\0", "\0\0\0", "`"]


@pytest.mark.parametrize("raw, want", [(b"\xe2\x80A", "�A"), (b"\xf0\x9f\x98", "�"), (b"\xed\xa0\x80", "�" * 3), (b"ok", "ok")])
def test_lossy(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "b binary").select(T.lossy(F.col("b"))).first()[0] == want


@pytest.mark.parametrize("value, want", [("12", 12), (" 12", None), ("abc", None), ("-1", None), ("99999999999999999999", None)])
def test_content_length(spark, value, want):
    assert one(spark, value, http.content_length) == want


CASES = [
    (dict(headers={"content-type": "text/plain"}, body="low tide, é"), dict(format="raw", content="low tide, é", size=12, status_code=200)),
    (dict(url="http://h/path/to/file.pdf", method="HEAD", headers={"content-type": "application/pdf", "content-length": "12345"}), dict(method="HEAD", size=12345, content=None, filename="file.pdf", error=None)),
    (dict(headers={"content-type": "text/html"}, body=PAGE, md=True), dict(format="markdown", content="## Low tide\n\nThe **mud**\n\n- crab")),
    (dict(headers={"content-type": "text/html"}, body=PAGE, text=True), dict(format="text", content="Low tide\n\nThe mud\ncrab")),
    (dict(headers={"content-type": "image/png", "content-length": "4"}, body=b"\x89PNG"), dict(size=4, content=None, format=None)),
    (dict(status=404, body="gone"), dict(status_code=404, content="gone")),
    (dict(headers={"content-disposition": 'attachment; filename="report.txt"'}), dict(filename="report.txt")),
    (dict(headers={"content-type": "application/json"}, body='{"key": "value"}', md=True), dict(format="raw", content='{"key": "value"}')),
    (dict(headers={"content-type": "text/plain"}, body="<!DOCTYPE html><p>x</p>", md=True), dict(format="markdown", content="x")),
    (dict(body="a" + "\n" * 7 + "b", cut=True), dict(content="a\n\nb" + TRUNCATED, truncated=True)),
    (dict(body=None), dict(content="", size=0, truncated=None)),
    (dict(net="timeout"), dict(error_kind="FirstByteTimeout", status_code=None, content=None)),
    (dict(url="ftp://x"), dict(error_kind="InvalidUrlScheme", url="ftp://x")),
    (dict(method="POST"), dict(error_kind="InvalidMethod")),
]


def test_results(spark):
    for given, want in CASES:
        row = fetch(captured(spark, **given)).first().asDict()
        assert {k: row[k] for k in want} == want, given


def test_conversion_must_be_enabled(spark):
    row = fetch_with_options(captured(spark, headers={"content-type": "text/html"}, body="<p>x</p>", md=True), FetchOptions()).first()
    assert (row.format, row.content) == ("raw", "<p>x</p>")


def test_registry(spark):
    empty = FetcherRegistry().fetch(captured(spark))
    assert empty.first().error_message == "Fetcher error: No fetcher available for URL"
    assert [f.name for f in FetcherRegistry.with_defaults().fetchers] == ["github_repo", "default"]

    class Own:
        name = "own"

        def matches(self, url):
            return F.contains(url, F.lit("own"))

        def fetch(self, captures, options):
            return DefaultFetcher().fetch(captures.withColumn("body", F.lit(b"mine")), options)

    registry = FetcherRegistry().register(Own()).register(RepositoryFetcher()).register(DefaultFetcher())
    assert registry.fetch(captured(spark, url="http://own/")).first().content == "mine"
    assert registry.fetch(captured(spark, url="http://other/", body="x")).first().content == "x"


def test_repository_without_capture_is_an_error(spark):
    row = fetch(captured(spark, url="https://github.com/o/r")).first()
    assert (row.status_code, row.error, row.error_message) == (None, None, "Fetcher error: No repository record was captured")
    row = fetch(captured(spark, url="https://github.com/o/r", net="timeout").withColumn("repo_status", F.lit(404))).first()
    assert (row.status_code, row.error, row.error_kind) == (None, None, "FirstByteTimeout")


def test_own_columns_stay(spark):
    df = captured(spark, body="x").withColumns({c: F.lit(c) for c in ("_ok", "_kind", "__body", "_check", "_route", "_repo", "mine")})
    row = fetch(df).first().asDict()
    assert row["content"] == "x" and all(row[c] == c for c in ("_ok", "_kind", "__body", "_check", "_route", "_repo", "mine"))


def test_any_number_of_prefixes(spark):
    urls = spark.createDataFrame([(f"http://h{i}/x",) for i in range(300)] + [(None,), ("",), ("http://h1/x",)], "url string")
    prefixes = spark.range(20_000).select(F.concat(F.lit("http://h"), (F.col("id") * 2).cast("string"), F.lit("/")).alias("prefix")).union(spark.createDataFrame([(None,), ("http://h299/x and more",)], "prefix string"))
    left = [r.url for r in guard.blocked_by_table(urls, prefixes).collect()]
    assert sorted(left, key=str) == sorted([f"http://h{i}/x" for i in range(1, 300, 2)] + [None, "", "http://h1/x"], key=str)
    assert guard.blocked_by_table(urls, prefixes.limit(0)).count() == 303


def test_front_matter_and_json(spark):
    df = fetch(captured(spark, headers={"content-type": "image/png"}, body=b"x"))
    front, js = df.select(sinks.front_matter(), sinks.response_json()).first()
    assert front.startswith("---\nurl: http://h/p\nstatus_code: 200\nsource_content_type: image/png\n---\nBinary content")
    assert list(json.loads(js)) == ["url", "status_code", "content_type", "error"]
    assert df.select(sinks.short_form()).first()[0] == 'FetchResponse(url="http://h/p", status_code=200)'


def test_pretty_json(spark):
    df = fetch(captured(spark, url="http://h/\"é\n", headers={"content-type": "text/plain"}, body="a\t\"b\"\n", cut=True))
    pretty, plain = df.select(sinks.response_json(pretty=True), sinks.response_json()).first()
    assert pretty == json.dumps(json.loads(plain), indent=2, ensure_ascii=False)


def test_api_objects():
    r = api.FetchRequest("http://h/", "head", as_text=True)
    assert r.to_json() == '{"url":"http://h/","method":"HEAD","as_text":true}' and api.FetchRequest.from_json(r.to_json()) == r
    assert api.FetchRequest.from_json('{"url":"u","other":1}') == api.FetchRequest("u")
    for bad in ('{"method":"GET"}', '{"url":"u","method":"get"}', '{"url":1}', "[]", "no", '{"url":"u","as_text":1}'):
        with pytest.raises(ValueError):
            api.FetchRequest.from_json(bad)
    with pytest.raises(ValueError, match="must be GET or HEAD"):
        api.FetchRequest("u", "POST")
    got = api.FetchResponse("http://h/", 200, content="é")
    assert repr(got) == 'FetchResponse(url="http://h/", status_code=200)' and got.to_json() == '{"url":"http://h/","status_code":200,"content":"é"}'
    tool = api.FetchTool(enable_text=False)
    assert "as_text" not in json.loads(tool.input_schema())["properties"] and "status_code" in json.loads(tool.output_schema())["properties"] and tool.description() and tool.llmtxt()


def test_messages(spark):
    df = spark.createDataFrame([(k,) for k in errors.MESSAGES], "k string")
    got = dict(df.select("k", errors.message(F.col("k"), F.lit("why"))).collect())
    assert got == {k: m + ("why" if k in ("RequestError", "FetcherError") else "") for k, m in errors.MESSAGES.items()}


def test_tool(spark):
    tool = Tool.builder().enable_text(False).block_prefix("http://no").user_agent("a").build()
    assert set(tool.input_schema()["properties"]) == {"url", "method", "as_markdown"} and list(tool.output_schema()["properties"]) == RESPONSE_FIELDS
    assert tool.execute(captured(spark, url="http://no/x")).first().error_kind == "BlockedUrl"
    seen = []
    tool.execute_with_status(captured(spark), lambda s: seen.append((s.phase, s.percent_complete))).unpersist()
    # further reports of the phase fetch may stand between 20 and 100 percent
    assert [x for x in seen if x[0] != "fetch" or x[1] == 20.0] == [("validate", 0.0), ("connect", 10.0), ("fetch", 20.0), ("complete", 100.0)]
    seen.clear()
    tool.execute_with_status(captured(spark, url=""), lambda s: seen.append(s.phase))
    assert seen == ["validate"]
    assert ToolStatus("x").with_message("m").with_eta(5) == ToolStatus("x", "m", None, 5)


def test_one_scan_and_no_shuffle(spark, tmp_path):
    captured(spark).write.parquet(str(tmp_path / "c"))
    plan = fetch(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    metadata = fetch(spark.read.parquet(str(tmp_path / "c"))).select("url", "status_code", "last_modified")
    assert "body" not in metadata._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_default_fetcher_alone(spark):
    assert default_response(captured(spark, body="x"), BOTH).first().content == "x"


HOSTS = [
    ("http://Bücher.example/a", "xn--bcher-kva.example"), ("http://FAß.de/", "fass.de"), ("http://例え。テスト/", "xn--r8jz45g.xn--zckzah"), ("http://b%C3%BCcher.example", "xn--bcher-kva.example"),
    ("http://ｅｘ.com/", "ex.com"), ("http://xn--bcher-kva.example/", "xn--bcher-kva.example"), ("http://a\u00adb.com", "ab.com"), ("http://0x7f.1/", "127.0.0.1"), ("http://0177.0.0.1", "127.0.0.1"),
    ("http://2130706433/", "127.0.0.1"), ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://1.2.3.4./", "1.2.3.4"), ("http://0x/", "0.0.0.0"), ("http://4294967296/", None), ("http://08.1/", None),
    ("http://a.1b/", "a.1b"), ("http://a.12/", None), ("http://１.2.3.4/", "1.2.3.4"), ("http://user:p@h.org:80/x", "h.org"), ("http://a b/", None), ("http://[::1]/", "[::1]"), ("http://h:99999/", None), ("http://a%00b/", None),
    ("http:///", None), ("http://ü..de/", None), ("http://plain.example.com?x", "plain.example.com"), ("HTTP://x", None), ("http://0xffffffff", "255.255.255.255"), ("http://1.0x100", "1.0.1.0"), ("http://ﬁ.org", "fi.org"),
]


def test_hosts_by_the_standard(spark):
    """Each rule, in Catalyst and in the form for single URLs; only names beyond ASCII are converted."""
    df = spark.createDataFrame([(u,) for u, _ in HOSTS], "url string")
    got = df.select("url", U.host(F.col("url")).alias("host"), U.parses(F.col("url")).alias("fine")).collect()
    told = {r.url: r.host if r.fine else None for r in got}
    for url, want in HOSTS:
        assert told[url] == want, url
        assert (hosts.parsed(url) or (None,))[0] == want, url
    assert "Python" not in df.select(U.parses(F.col("url")))._jdf.queryExecution().toString()


def test_single_urls_equal_columns(spark):
    rng = random.Random(7)
    letters = ["a", "B", ".", "..", "/", "%2e", "%41", "é", " ", "\\", "?", "#", "github.com", "@", ":", "8", "settings", "x.y", "\t", "0x1"]
    urls = ["http" + rng.choice(["://", "s://", "s:///"]) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    urls += ["https://github.com/" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    u = F.col("url")
    for r in df.select("url", U.parses(u).alias("fine"), U.host(u).alias("host"), U.path(u).alias("path"), U.repository(u).alias("page")).collect():
        found = hosts.parsed(r.url)
        assert (found is not None) == r.fine, r.url
        if found:
            assert found == (r.host, r.path), r.url
            assert hosts.repository(r.url) == (tuple(r.page) if r.page else None), r.url


def test_prefix_tables(spark):
    """A million prefixes without a shuffle of the URLs; beyond the bound by joins; the same rows as by hand."""
    rng = random.Random(2)
    urls = ["http://" + "".join(rng.choice("ab./é") for _ in range(rng.randrange(9))) for _ in range(400)] + [None, "", "x"]
    prefixes = ["http://" + "".join(rng.choice("ab./é") for _ in range(rng.randrange(2, 7))) for _ in range(60)] + [None, "http://aa", "http://aab"]
    df, table = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    hit = lambda u: any(u.startswith(p) for p in prefixes if p)
    for sent in (guard.SENT, 10):
        assert sorted(r.url or "-" for r in guard.blocked_by_table(df, table, sent).collect()) == sorted(u or ("-" if u is None else "-") for u in urls if u is None or not hit(u))
        assert sorted(r.url for r in guard.allowed_by_table(df, table, sent).collect()) == sorted(u for u in urls if u is not None and hit(u))
    assert guard.blocked_by_table(df, table.limit(0)).count() == guard.allowed_by_table(df, table.limit(0)).count() == len(urls)
    many = spark.range(1_000_000).selectExpr("concat('http://h', id, '.example/') as prefix")
    out = guard.blocked_by_table(spark.range(1000).selectExpr("concat('http://h', id * 2000, '.example/x') as url"), many)
    assert out.count() == 500 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert guard.prefix_array(["b", "ab", "a", "abc", "c"]) == ["a", "b", "c"]


def prefixed(letter):
    """A plug-in of Arrow rows for hosts that begin with a letter; of a class that goes to the workers with it."""

    class Prefixed:
        name = f"by-{letter}"

        def matches(self, url):
            return F.startswith(url, F.lit(f"http://{letter}"))

        def answer(self, captures, options):
            urls, bodies = (captures.column(c).to_pylist() for c in ("url", "body"))
            return pa.record_batch([pa.array(urls), pa.array([200] * len(urls)), pa.array([f"{letter}: {u} {len(b or b'')}" for u, b in zip(urls, bodies)])], names=["url", "status_code", "content"])

    return Prefixed()


def test_plug_ins_share_one_scan(spark, tmp_path):
    """Five plug-ins of Arrow rows beside the default: one scan, each row by the first that takes it."""
    urls = [f"http://{c}{i}.example/" for i in range(30) for c in "abcdefg"] + ["bad", "http://github.com/o/r"]
    rows = [(i, u, None, True, None, 200, {"content-type": "text/html"}, b"<b>x</b>", False, None) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, StructType([StructField("n", LongType()), *CAPTURE_SCHEMA])).repartition(3).write.parquet(str(tmp_path / "captures"))
    captures = spark.read.parquet(str(tmp_path / "captures"))
    registry = FetcherRegistry([prefixed(c) for c in "abcde"])
    registry.register(RepositoryFetcher()).register(DefaultFetcher())
    out = registry.fetch(captures, BOTH)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and out.columns[0] == "n"
    found = {r.n: r for r in out.collect()}
    assert len(found) == len(urls)
    for n, url in enumerate(urls[:-2]):
        letter = url[7]
        assert found[n].content == (f"{letter}: {url} 8" if letter in "abcde" else "**x**") and found[n].error_kind is None and found[n].url == url
    assert [found[len(urls) - k].error_kind for k in (2, 1)] == ["InvalidUrlScheme", "FetcherError"]


def test_progress_of_tasks(spark):
    """Percents rise from 20 towards 100 as tasks end, with the time left."""
    slow = F.udf(lambda b: time.sleep(0.15) or b, "binary")
    captures = captured(spark, body="<p>x</p>", text=True).crossJoin(spark.range(40)).repartition(24, "id").drop("id").withColumn("body", slow("body"))
    told = []
    out = Tool().execute_with_status(captures, told.append, every=0.05)
    percents = [s.percent_complete for s in told]
    assert [s.phase for s in told][:3] == ["validate", "connect", "fetch"] and told[-1].phase == "complete" and percents == sorted(percents)
    between = [s for s in told if 20 < s.percent_complete < 100]
    assert len(between) >= 2 and all(s.eta_ms >= 0 for s in between) and out.count() == 40
    out.unpersist()
