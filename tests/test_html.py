"""HTML conversion: exact vectors, native form against the scanner on pages and on random strings."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import scanner
from webloom.functions.sql import sql_text
from webloom.functions.text import clean_whitespace, filter_excessive_newlines

VECTORS = [
    ("<h3>Fjord</h3>tide<h6>ebb</h6>", "### Fjord\n\ntide\n###### ebb", "Fjord\ntide\nebb"),
    ("<p>oak<p>elm</p></p>ash", "oakelm\n\nash", "oak\nelm\n\nash"),
    ("<ol><li>rye<li>oat</ol>barley", "- rye\n- oat\nbarley", "ryeoatbarley"),
    ("<ul><li>A<ul><li>B</li></ul></li></ul>", "- A\n- B", "AB"),
    ("<b>loud</b><i>soft</i> <em>lean</em>", "**loud***soft* *lean*", "loudsoft lean"),
    ("<pre>a\n    b\n\n\n\nc</pre>", "```\na\nb\n\nc\n```", "a\nb\n\nc"),
    ("<pre><code>x</code></pre> <code>y</code>", "```\nx\n```\n`y`", "x y"),
    ("dawn<noscript>n<p>o</p></noscript><iframe src=f>g</iframe>dusk", "dawndusk", "dawndusk"),
    ("<p>Tom &amp; Jerry &lt;3 &gt; others &quot;quoted&quot;</p>", 'Tom & Jerry <3 > others "quoted"', 'Tom & Jerry <3 > others "quoted"'),
    ("AT&T rocks", "AT& rocks", "AT& rocks"),
    ("&middot;x", "&x", "&x"),
    ("&#8212;&#x2014;&#39;&#X41;", "——'&", "——'&"),
    ("<p>R&D</p> ok;", "R& ok;", "R& ok;"),
    ("a<br/>b<br>c<br />d", "ab\nc\nd", "ab\nc\nd"),
    ('<a href="https://x.y">link</a>', "[](https://x.y)link", "link"),
    ('<a data-href="z" href="q">t</a>', "[](z)t", "t"),
    ("<a class=k>n</a>", "n", "n"),
    ("<!-- a > b -->z", "b -->z", "b -->z"),
    ("<title>T</title><p>x</p>", "Tx", "T\nx"),
    ("<blockquote>l1\nl2<p>l3</p></blockquote>after", "> l1\n> l2l3\n\nafter", "l1\nl2\nl3\nafter"),
    ("<svg><style></svg>x</style>y", "y", "y"),
    ("<script/>a<script src=q />b", "ab", "ab"),
    ("x<p unterminated", "x", "x"),
    ("<td>a</td><td>b</td>", "ab", "ab"),
    ("x &lt;b&gt; y", "x <b> y", "x <b> y"),
    ("a\n \n \n \nb", "a\n\n\n\nb", "a\n\n\n\nb"),
    ("<hr/>a<hr>b", "a\n---\nb", "ab"),
    ("<SCRIPT>k</SCRIPT >ok", "ok", "ok"),
    ("&amp</title><style>p{}</style>z", "&z", "&z"),
    ("<script>if(a<b){}</script><p>z</p>", "", ""),
    ("<script>if(a<b && c>d){}</script><p>z</p>", "z", "z"),
    ("é &éé; &amp", "é & &", "é & &"),
    ("", "", ""),
    (None, None, None),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(VECTORS)], "i int, html string, md string, txt string")
    for got in (H.html_to_markdown(F.col("html")), clean_whitespace(scanner.scan("html", F.lit(True)))):
        assert df.select("i", got.alias("got"), "md").where("not (got <=> md)").collect() == []
    for got in (H.html_to_text(F.col("html")), clean_whitespace(scanner.scan("html", F.lit(False)))):
        assert df.select("i", got.alias("got"), "txt").where("not (got <=> txt)").collect() == []


@pytest.mark.parametrize("markdown", [True, False])
def test_native_form_equals_the_scanner(spark, markdown):
    rng = random.Random(5)
    parts = ["<", "</", ">", "&", "amp;", ";", "/", " ", "\n", "script", "style", "p", "b", "svg", " a", "href=", "'", '"', "li", "ul", "ol", "pre", "blockquote", "x", "é", "&lt;", "&#65;", "br", "h1", " ", "</p>", "<script>", "</script>", "<a href=u>"]
    strings = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))),) for _ in range(8000)]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    df = spark.createDataFrame(strings, "html string").union(pages)
    native = H.html_to_markdown(F.col("html")) if markdown else H.html_to_text(F.col("html"))
    assert df.select("html", native.alias("a"), clean_whitespace(scanner.scan("html", F.lit(markdown))).alias("b")).where("not (a <=> b)").limit(3).collect() == []


def test_most_pages_stay_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert pages.where(H.irregular(F.col("html"), True)).count() < 0.01 * pages.count()


def test_nested_forms_stay_native(spark):
    """Lists in lists, preformatted text and quotes don't need the scanner, long pages included; nested skipped elements do."""
    pages = ["<ul><li>a<ul><li>b<ol><li>c</ol></ul></ul>d", "<pre>a <code>b</code></pre><code>c</code>", "<blockquote>a\nb&#10;c<pre>d\n</pre></blockquote>e\nf", "</ul></ol>x<ul></ul></ul>y", "<pre", "<blockquote>" * 3 + "z</blockquote>\nw"]
    pages += ["<blockquote><ul><li>" + "<p>tide\n</p><ul><li>x</li></ul>" * 3000 + "</ul></blockquote>z\nz"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert df.where(H.irregular(F.col("html"), True)).count() == 0 and df.where(H.stateful(F.col("html"))).count() == len(pages) - 1
    native, slow = H.html_to_markdown(F.col("html")), clean_whitespace(scanner.scan("html", F.lit(True)))
    assert df.where(native != slow).count() == 0
    assert spark.createDataFrame([("<svg><style>s</style></svg>",)], "html string").where(H.irregular(F.col("html"), True)).count() == 1


def test_white_space_and_newlines(spark):
    df = spark.createDataFrame([("\t sea \x85 sky \n\n\n\n\u3000 sand ", "sea sky\n\nsand"), ("a  b\t\nc", "a b\nc"), ("​a", "​a")], "s string, want string")
    assert df.where(clean_whitespace(F.col("s")) != F.col("want")).collect() == []
    df = spark.createDataFrame([("ox\n\n\nyak\n\nemu\n\n\n\n",)], "s string")
    assert df.select(filter_excessive_newlines(F.col("s"))).first()[0] == "ox\n\nyak\n\nemu\n\n"


def test_sql_functions(spark):
    H.register(spark)
    rows = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, html string")
    got = rows.selectExpr("i", "html_to_markdown(html)", "html_to_text(html)").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [v[1:] for v in VECTORS]


def test_both_forms_at_once(spark):
    rows = [(i, v[0], k) for i, v in enumerate(VECTORS) for k in ("m", "t", "n", None)]
    df = spark.createDataFrame(rows, "i int, html string, k string")
    got = df.select("i", "k", H.converted(F.col("html"), F.coalesce(F.col("k") == "m", F.lit(False)), F.coalesce(F.col("k") == "t", F.lit(False))).alias("got"))
    want = {"m": 1, "t": 2}
    assert all(r.got == (VECTORS[r.i][want[r.k]] if r.k in want else None) for r in got.collect())


def test_attribute(spark):
    rows = [('area shape=rect href="/map?x=1" id=z', "href", "/map?x=1"), ("video poster='still frame.webp' loop", "poster", "still frame.webp"), ("td colspan=2>", "colspan", "2"), ("a HREF=up", "href", "up"), ('a href="open', "href", None), ("a href=>", "href", "")]
    for tag, name, want in rows:
        assert spark.createDataFrame([(tag,)], "t string").select(H.attribute(F.col("t"), name)).first()[0] == want


def test_sql_functions_are_native(spark):
    """SQL calls give what the functions give, odd pages included, and have the native form in their plans."""
    H.register(spark)
    pages = [None, "", "<p>it's a \\\\ b</p>", "a<ul><li>x<ul><li>y</li></ul></li></ul>", "<pre>k  l</pre>&#65;&amp;", "<h1>T</h1><a href='u'>v</a>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    told = df.selectExpr("html_to_markdown(html) as m", "html_to_text(html) as t")
    assert told.collect() == df.select(H.html_to_markdown(F.col("html")).alias("m"), H.html_to_text(F.col("html")).alias("t")).collect()
    assert "regexp_extract_all" in told._jdf.queryExecution().optimizedPlan().toString()


def test_sql_text():
    column = F.when((F.col("a") == "x'y\\\\=(") & ~(F.col("b") > 1) | (F.col("b") % 2 == 0), F.transform("c", lambda x: x + 1))
    text = sql_text(column)
    assert text.startswith("CASE WHEN `or`(`and`(`=`(a, ") and "=(')" in text and "`+`(x" in text
