"""Live requests against a server on this machine, the command line, and streams."""

import base64
import gzip
import json
import random
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pytest

from webloom import api, cli
from webloom.operators.fetch import fetch_with_options
from webloom.options import FetchOptions
from webloom.schemas import REQUEST_SCHEMA
from webloom.sources import lines, live, sink
from webloom.streaming import fetch_stream, server

BOTH = FetchOptions(enable_markdown=True, enable_text=True)


TEXT = "<p>" + "tide " * 4000 + "</p>"
REPO = {
    "name": "r", "full_name": "o/r", "html_url": "https://github.com/o/r", "stargazers_count": 1, "forks_count": 0, "open_issues_count": 0, "default_branch": "main", "created_at": "a", "updated_at": "b",
    "pushed_at": "c", "archived": False, "fork": False, "owner": {"login": "o", "type": "User"},
}


def brotli(raw):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "brotli") as out:
        out.write(raw)
    return sink.getvalue().to_pybytes()


CODED = {
    "gzip": gzip.compress(TEXT.encode()), "deflate": zlib.compress(TEXT.encode()), "br": brotli(TEXT.encode()), "raw-deflate": zlib.compress(TEXT.encode())[2:-4],
    "two": gzip.compress(TEXT[:99].encode()) + gzip.compress(TEXT[99:].encode()), "half": gzip.compress(random.Random(1).randbytes(90_000).hex().encode())[:20_000],
}


ASKED: list[str] = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        name = self.path.strip("/")
        if name == "slow":
            threading.Event().wait(2.5)
        if name.startswith("repos/"):
            kind = name.split("/")[1]
            status = {"o": 200, "gone": 404, "rate": 403}.get(kind, 200)
            record = {"content": base64.b64encode(b"# Tide").decode(), "encoding": "base64"} if name.endswith("/readme") else REPO
            body = json.dumps(record if self.headers["Accept"] == live.ACCEPT_API else {}).encode()
            return self.answer(404 if kind == "bare" and name.endswith("/readme") else status, body)
        ASKED.append(name)
        if name.startswith("to-"):
            self.send_response(302)
            self.send_header("Location", {"to-ftp": "ftp://127.0.0.1/x", "to-file": "file:///etc/hostname", "to-a": "/a"}[name])
            self.send_header("Content-Length", "0")
            return self.end_headers()
        if name in CODED:
            return self.answer(200, CODED[name], {"two": "gzip", "half": "gzip", "raw-deflate": "deflate"}.get(name, name))
        if name in ("cut", "trickle", "chunks"):  # a body that breaks off, one that never ends, one that breaks off between chunks
            self.send_response(200)
            self.send_header("Content-Type", "text/plain")
            self.send_header(*(("Transfer-Encoding", "chunked") if name == "chunks" else ("Content-Length", "1000")))
            self.end_headers()
            self.wfile.write(b"4\r\nsome\r\n" if name == "chunks" else b"some")
            for _ in range(40 if name == "trickle" else 0):
                self.wfile.write(b".")
                self.wfile.flush()
                time.sleep(0.1)
            self.close_connection = True
            return None
        return self.answer(404 if name == "gone" else 200, f"<h1>{self.headers['Accept']}</h1>".encode())

    def answer(self, status, body, coding=None):
        self.send_response(status)
        self.send_header("Content-Type", "text/html")
        self.send_header("Content-Length", str(len(body)))
        if coding:
            self.send_header("Content-Encoding", coding)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)

    do_HEAD = do_GET

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_capture(spark, base):
    asked = [(f"{base}/a", None, True, None), (f"{base}/gone", None, None, True), (f"{base}/a", "HEAD", None, None), ("http://127.0.0.1:9/", None, None, None), (f"{base}/slow", None, None, None), ("ftp://x", None, None, None)]
    out = fetch_with_options(live.capture(spark.createDataFrame(asked, REQUEST_SCHEMA).coalesce(1), BOTH), BOTH).collect()
    found = {(r.url, r.method): r for r in out}
    assert found[(f"{base}/a", None)].content == "# " + live.ACCEPT_MARKDOWN.replace("*/*", "*/*")
    assert found[(f"{base}/gone", None)].status_code == 404 and found[(f"{base}/gone", None)].format == "text"
    assert found[(f"{base}/a", "HEAD")].content is None
    assert [found[(u, None)].error_kind for u in ("http://127.0.0.1:9/", f"{base}/slow", "ftp://x")] == ["ConnectError", "FirstByteTimeout", "InvalidUrlScheme"]


@pytest.mark.parametrize("name", ["gzip", "deflate", "br", "raw-deflate", "two"])
def test_codings(base, name):
    status, headers, body, cut, failed = live.get(f"{base}/{name}", None, False, False, None)
    assert (status, body.decode(), cut, failed) == (200, TEXT, False, None) and "content-encoding" not in headers and "content-length" not in headers


def test_broken_bodies(base):
    assert live.get(f"{base}/cut", None, False, False, None)[2:] == (b"some", True, None)
    assert live.get(f"{base}/chunks", None, False, False, None)[2:] == (b"some", True, None)
    status, _, body, cut, failed = live.get(f"{base}/half", None, False, False, None)
    assert (status, cut, failed) == (200, True, None) and 0 < len(body) < 180_000 and random.Random(1).randbytes(90_000).hex().encode().startswith(body)


def test_one_second_for_all(base):
    began = time.monotonic()
    _, _, body, cut, failed = live.get(f"{base}/trickle", None, False, False, None)
    assert time.monotonic() - began < 1.6 and body.startswith(b"some.") and cut and failed is None


def test_repositories(spark, base):
    asked = [(f"https://github.com/{o}/r", None, None, None) for o in ("o", "gone", "rate", "bare")]
    requests = spark.createDataFrame(asked, REQUEST_SCHEMA).coalesce(1)
    found = {r.url.split("/")[3]: r for r in fetch_with_options(live.capture(requests, BOTH, api=base), BOTH).collect()}
    assert found["o"].format == "github_repo" and found["o"].content.startswith("# o/r\n") and found["o"].content.endswith("## README\n\n# Tide")
    assert found["bare"].format == "github_repo" and "README" not in found["bare"].content
    assert (found["gone"].status_code, found["gone"].error) == (404, "Repository gone/r not found") and found["rate"].error == "GitHub API rate limit exceeded"
    (row,) = fetch_with_options(live.capture(requests.limit(1), BOTH, api="http://127.0.0.1:9"), BOTH).collect()
    assert (row.status_code, row.error, row.error_kind) == (None, None, "ConnectError")


def test_api(spark, base):
    tool = api.FetchTool(spark=spark)
    got = tool.fetch(f"{base}/a", as_markdown=True)
    assert got.format == "markdown" and got.status_code == 200 and json.loads(got.to_json())["content"] == got.content
    assert tool.execute(api.FetchRequest(f"{base}/a", "HEAD")).method == "HEAD"
    with pytest.raises(ValueError, match="must start with"):
        tool.fetch("ftp://x")


def test_data_source(spark, base):
    live.register(spark)
    df = spark.read.format("webloom").option("urls", f"{base}/a {base}/gone").option("partitions", 2).load()
    assert sorted(r.status_code for r in df.collect()) == [200, 404]


def source(spark, urls, **options):
    live.register(spark)
    reader = spark.read.format("webloom").option("urls", " ".join(urls))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def test_only_http(spark, base, tmp_path):
    """Local files, FTP and data URLs are refused, blocked ones never asked for, and redirects lead nowhere else."""
    (tmp_path / "secret").write_text("secret")
    urls = [f"file://{tmp_path}/secret", "ftp://127.0.0.1/x", "data:text/plain,x", "http:///", f"{base}/b-blocked", f"{base}/a", f"{base}/to-ftp", f"{base}/to-file", f"{base}/to-a"]
    ASKED.clear()
    made = source(spark, urls, partitions=3, block_prefixes=f"{base}/b- http://other/")
    found = {r.url: r for r in fetch_with_options(made, BOTH).collect()}
    assert [found[u].error_kind for u in urls] == ["InvalidUrlScheme"] * 4 + ["BlockedUrl", None, "RequestError", "RequestError", None]
    assert found[urls[8]].content == found[urls[5]].content and "isn't http" in found[urls[6]].error_message
    assert sorted(ASKED) == ["a", "a", "to-a", "to-file", "to-ftp"]
    assert not any("secret" in str(r.asDict()) for r in made.collect() if not r.url.startswith("file"))
    for url in urls[:2]:
        assert live.get(url, None, False, False, None)[4] and live.get(url, None, False, False, None)[2] is None
    allowed = fetch_with_options(source(spark, urls[4:6], allow_prefixes=f"{base}/a"), BOTH)
    assert sorted(r.error_kind or "" for r in allowed.collect()) == ["", "BlockedUrl"]
    bad = fetch_with_options(source(spark, [f"{base}/a"], method="POST"), BOTH).first()
    assert bad.error_kind == "InvalidMethod"


def test_filters_reach_the_source(spark, base):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        ASKED.clear()
        made = source(spark, [f"{base}/{n}" for n in ("p1", "p2", "q1", "q2")], partitions=2, pushdown="true")
        assert [r.url for r in made.where(made.url.startswith(f"{base}/p") & ~made.url.endswith("2")).collect()] == [f"{base}/p1"]
        assert ASKED == ["p1"]
        assert made.where(made.url.isin(f"{base}/q1", f"{base}/x")).where("status_code = 200").count() == 1 and ASKED == ["p1", "q1"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_repositories_of_the_source(spark, base):
    made = source(spark, ["https://github.com/o/r", "https://github.com/x/../gone/r"], api=base)
    found = {r.url: r for r in fetch_with_options(made, BOTH).collect()}
    assert found["https://github.com/o/r"].content.startswith("# o/r\n") and found["https://github.com/x/../gone/r"].error == "Repository gone/r not found"


def test_hosts_make_partitions(spark):
    reader = live._Reader({"urls": " ".join([f"http://a/{i}" for i in range(6)] + ["http://c/", "http://b/", "x"]), "partitions": "3"})
    parts = [p.urls for p in reader.partitions()]
    assert [len(p) for p in parts] == [3, 3, 3] and all(u.startswith("http://a/") for u in parts[1])


def test_command_line(spark, base, capsys):
    assert cli.main(["fetch", f"{base}/a", "-o", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["format"] == "markdown"
    assert cli.main(["fetch", "ftp://x"]) == 1 and "must start with" in capsys.readouterr().err
    assert cli.main([]) == 1 and cli.main(["--guide"]) == 0


def call(i, url):
    return json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": "webloom", "arguments": {"url": url}}})


def test_server_of_many_lines(spark, tmp_path):
    """10,000 lines in one query; one that is started again loses no reply and doubles none, also where a batch broke off."""
    spool, out, state = tmp_path / "lines", str(tmp_path / "out"), str(tmp_path / "state")
    spool.write_text("".join(f'{{"jsonrpc":"2.0","id":{i},"method":"m{i}"}}\n' for i in range(10_000)) + '{"jsonrpc":"2.0","id":10000,')
    run = lambda: server.serve(spark, str(spool), out, state).trigger(availableNow=True).start().awaitTermination()
    told = lambda: [json.loads(line) for path in server.committed(out) for line in open(path)]
    run()
    assert [r["id"] for r in told()] == list(range(10_000)) and told()[77]["error"]["message"] == "Method not found: m77"
    with spool.open("a") as f:
        f.write('"method":"last"}\n\n{"jsonrpc":"2.0","id":"x","method":"y"}\n')
    run()
    assert [r["id"] for r in told()][10_000:] == [10_000, "x"]
    # a batch whose commit wasn't noted is written again, in its own place
    import pathlib

    last = sorted(pathlib.Path(state, "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    pathlib.Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert [r["id"] for r in told()] == [*range(10_001), "x"]


def test_server_fetches_each_url_once(spark, base, tmp_path):
    spool = tmp_path / "lines"
    spool.write_text("\n".join([call(1, f"{base}/z1"), call(2, f"{base}/z1"), call(3, f"{base}/z2"), call(4, "ftp://x")]) + "\n")
    ASKED.clear()
    server.serve(spark, str(spool), str(tmp_path / "out"), str(tmp_path / "state"), server.live_captures()).trigger(availableNow=True).start().awaitTermination()
    found = [json.loads(line) for path in server.committed(str(tmp_path / "out")) for line in open(path)]
    assert [r["id"] for r in found] == [1, 2, 3, 4] and ["isError" in r["result"] for r in found] == [False, False, False, True]
    assert sorted(ASKED) == ["z1", "z2"]


def test_ranges_of_lines(tmp_path):
    texts = ["", "a", "é" * 9, "x" * 50, "\r", "end"]
    (tmp_path / "f").write_bytes(("\n".join(texts * 7) + "\n").encode())
    for part in (1, 3, 16, 1000):
        reader = lines.LineReader({"path": str(tmp_path / "f"), "partbytes": str(part)})
        got = [r for p in reader.partitions() for r in reader.read(p)]
        assert [r[2] for r in got] == [t.rstrip("\r") for t in texts * 7] and len({r[1] for r in got}) == len(got)


def test_sink_leaves_no_halves(spark, tmp_path):
    """Tasks that fail leave nothing; rows of a failed write aren't seen; writes replace or add."""
    sink.register(spark)
    made = spark.range(20).repartition(4).selectExpr("cast(id as string) name", "concat('text ', id) content")
    write = lambda df, mode, **o: df.write.format("webloom_files").mode(mode).options(path=str(tmp_path / "out"), **o).save()
    write(made, "overwrite", form="files")
    files = lambda: sorted(p.name for p in (tmp_path / "out").rglob("*.md"))
    assert len(files()) == 20 and not list((tmp_path / "out").glob("_pending*"))
    from pyspark.sql import functions as F

    broken = made.withColumn("content", F.when(F.col("name") == "7", F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no"):
        write(broken, "overwrite", form="files")
    assert len(files()) == 20 and not list((tmp_path / "out").glob("_pending*")) and "new" not in {p.read_text() for p in (tmp_path / "out").rglob("*.md")}
    write(made.where("name < 3"), "append", form="files")
    assert len(files()) == 23
    write(made.selectExpr("if(name = '3', null, concat('a\\n', name)) value"), "overwrite")
    assert sorted(x for p in (tmp_path / "out").rglob("*.jsonl") for x in p.read_text().splitlines()) == sorted(f"a {i}" for i in range(20) if i != 3) and files() == []
    with pytest.raises(Exception, match="columns"):
        write(made, "append", form="lines")


def test_killed_attempts_leave_nothing(tmp_path):
    """What an attempt wrote that isn't committed can't be read, and goes with the commit."""
    from pyspark.sql import Row
    from pyspark.sql.types import StringType, StructField, StructType

    writer = sink.SinkWriter({"path": str(tmp_path)}, StructType([StructField("value", StringType())]), False)

    def dies():
        yield Row(value="half")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert not list(tmp_path.glob("part*"))
    writer.commit([writer.write(iter([Row(value="whole")])), None])
    assert [p.read_text() for p in tmp_path.rglob("*.jsonl")] == ["whole\n"]


def test_command_line_server(spark, base, monkeypatch, capsys):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join([call(1, f"{base}/a"), '{"jsonrpc":"2.0","id":2,"method":"tools/list"}', "bad"]) + "\n"))
    assert cli.main(["rpc"]) == 0
    found = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [r.get("id") for r in found] == [1, 2, None] and "status_code: 200" in found[0]["result"]["content"][0]["text"]


def test_rpc_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"jsonrpc":"2.0","id":6,"method":"zzz"}\n\n{"jsonrpc":"2.0","method":"notifications/x"}\n')
    fetch_stream.to_parquet(fetch_stream.rpc(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    assert [json.loads(r.reply)["error"]["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [-32601]
