"""Every query of the catalogue against its SQL in DuckDB."""

import datetime
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from webloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, want.fetchall())


def test_pages_that_share_a_url(spark, tmp_path):
    """A call for each page gets one reply, from that page, though others have the same URL."""
    data = [(i, f"https://h.example/{i % 2}.html", f"<p>page {i} &amp; more</p>") for i in range(5)]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["jsonrpc_tools_call"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["jsonrpc_tools_call"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


ODD = [
    "<title>a&amp;&am</title><style>p{margin:0}</style><p>b", "a & b<script>x</script>c", "<!-- <svg>x</svg> -->y", "<a title='<script>'>x</script>y", "<svg><style></svg>x</style>y", "<scr<style></style>ipt>q</script>t",
    "<script/>a</script>b", "<script a / >x</script >z", "<script >x</script/>y</script x/>z", "a<ſcript>x</script>b", "<İframe>x</iframe>y", "<iframe\x0b>x</iframe>y", "<svg\xa0>x</svg>y", "<script>if(a<b){}</script>z",
    "<SCRIPT\n>é😀</ \tScRiPt\f q>u", "<style>a</style>b<style>c<style>", "<noscript>x", "", None, "<iframe>" * 20000, "a<svg>" + "<b>" * 20000 + "</svg>c$1",
]


def test_skipped_elements(spark, tmp_path):
    """Odd and random pages against the SQL."""
    parts = ["script", "style", "noscript", "iframe", "svg", "ſ", "<", "<", "</", ">", ">", "/", " ", "\n", "\x0b", "&", "&am", ";", "x", "é", "<script>", "</script>", "<svg>", "</svg>", "<style a>", "</style >"]
    pick = random.Random(5)
    pages = ODD + ["".join(pick.choices(parts, k=pick.randint(1, 24))) for _ in range(20000)]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = dict(QUERIES["strip_skip_elements"](spark, str(tmp_path)).collect())
    want = dict(con.execute(ORACLE_SQL["strip_skip_elements"]).fetchall())
    assert len(got) == len(pages) and [(pages[i], got[i], want[i]) for i in want if got[i] != want[i]][:3] == []


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
