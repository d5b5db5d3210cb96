"""Requests, records and lines of all kinds, made from the pages by rules on page_id.

The rules are SQL that Spark and DuckDB read alike, so that queries and their SQL begin with the same inputs; what comes
of these is computed by each in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First label of a page's host, and a name that differs by page.
LABEL, NAME = "regexp_extract(url, '//([^/.]+)', 1)", "'r' || cast(page_id as string)"


def by_page(cases: list[str], rest: str = "null") -> str:
    """One of some values, by turns."""
    return f"case page_id % {len(cases)} " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + f" else {rest} end"


PAGE = f"{LABEL} || '/' || {NAME}"
REPO_URL = by_page([
    f"'https://github.com/' || {PAGE}", f"'https://github.com/' || {PAGE} || '/'", f"'https://github.com/' || {NAME}", f"'https://github.com/' || {PAGE} || '/issues'", f"'https://github.com/settings/' || {NAME}", f"'https://gitlab.com/' || {PAGE}",
    f"'http://user@GitHub.com:8080/' || {PAGE} || '.git?x=1#y'", f"'https://www.github.com/' || {PAGE}", f"'https://github.com//' || {NAME}", f"'https://github.com/explore/' || {NAME}", f"'https://github.com/' || {NAME} || '/join'",
])

METHOD = by_page(["'GET'", "'get'", "'Get'", "'HEAD'", "'head'", "'POST'", LABEL, "null", "''"])

#: Owner, name and file name are those of the URL without its detours: see ``NORMAL``.
DETOUR = by_page([
    f"'https://github.com/' || {LABEL} || '/./' || {NAME}", f"'https://github.com/x/../' || {LABEL} || '/' || {NAME} || '.c'", f"'https://github.com/' || {LABEL} || '/b/%2E%2e/' || {NAME} || '.d'",
    f"'https://git%68ub.com/' || {PAGE}", f"'https://github.com/' || {PAGE} || '/..'", f"'https://h/q{{' || {NAME} || '}}.x?y.z'", f"'https://h/a/' || {NAME} || '.x/.'", f"'https://h/' || {NAME} || '.y  '", f"'https://github.com/' || {LABEL} || '/ ' || {NAME} || '.é'",
    f"'https://ＧitHub.com/' || {PAGE}", f"'http://0x7f.1/' || {NAME} || '.z'",
])
#: Owner, repository and file name of these, written apart.
NORMAL = {
    "owner": by_page([LABEL, LABEL, LABEL, LABEL, "null", "null", "null", "null", LABEL, LABEL, "null"]),
    "repo": by_page([NAME, f"{NAME} || '.c'", f"{NAME} || '.d'", NAME, "null", "null", "null", "null", f"'%20' || {NAME} || '.%C3%A9'", NAME, "null"]),
    "filename": by_page(["null", f"{NAME} || '.c'", f"{NAME} || '.d'", "null", "null", f"'q%7B' || {NAME} || '%7D.x'", "null", f"{NAME} || '.y'", f"'%20' || {NAME} || '.%C3%A9'", "null", f"{NAME} || '.z'"]),
}

NET_ERROR = by_page(["'timeout'", "'connect'", f"'reset by ' || {LABEL}", "null", "'blocked'", "'scheme'", "'missing'", "'method'"])

STATUS = "case when page_id % 11 = 3 then 404 when page_id % 13 = 4 then 403 when page_id % 17 = 5 then 500 when page_id % 19 = 6 then 301 when page_id % 23 = 7 then 299 else 200 end"

REQUEST = by_page([
    """'{"url":"' || url || '","method":"GET","as_markdown":true,"extra":' || cast(page_id as string) || '}'""", """'{"method":"GET","as_text":true}'""", """'{"url":"' || url || '","method":"get"}'""", "'not json ' || url",
    """'{"url":"' || url || '"}'""", """'{"as_text":false,"method":"HEAD","url":"' || url || '"}'""",
])

#: Nested elements around a page's names, and what becomes of them as Markdown and as plain text.
FIRST, SECOND = f"'a' || cast(page_id as string)", LABEL
NESTED = [
    (f"'<ul><li>' || {FIRST} || '<ul><li>' || {SECOND} || '</li></ul></li><li>c</li></ul>z'", f"'- ' || {FIRST} || '\n- ' || {SECOND} || '\n- c\nz'", f"{FIRST} || {SECOND} || '\n\nc\nz'"),
    (f"{SECOND} || '<pre>' || {FIRST} || '  b\n<code>c</code></pre>y'", f"{SECOND} || '\n```\n' || {FIRST} || ' b\nc\n```\ny'", f"{SECOND} || {FIRST} || ' b\ncy'"),
    (f"'p<blockquote>' || {FIRST} || '\n' || {SECOND} || '</blockquote>s'", f"'p\n> ' || {FIRST} || '\n> ' || {SECOND} || '\ns'", f"'p' || {FIRST} || '\n' || {SECOND} || 's'"),
    (f"{FIRST} || '<script>var x=''<script>'';</script>b</script>' || {SECOND}", f"{FIRST} || {SECOND}", f"{FIRST} || {SECOND}"),
    (f"'<ol><li>' || {FIRST} || '<ol><li>' || {SECOND} || '</li></ol></ol><p>t</p>'", f"'- ' || {FIRST} || '\n- ' || {SECOND} || '\nt'", f"{FIRST} || {SECOND} || '\n\nt'"),
    (f"'<pre><b>' || {FIRST} || '</b></pre>&amp;<blockquote>&lt;' || {SECOND} || '</blockquote>'", f"'```\n**' || {FIRST} || '**\n```\n&\n> <' || {SECOND}", f"{FIRST} || '&<' || {SECOND}"),
    (f"'<svg><style>s</svg>t</style></svg>' || {FIRST}", FIRST, FIRST),
    (f"'&#x41;&#66;&mdash;' || {SECOND} || '&unknown;&amp'", f"'AB—' || {SECOND} || '&&'", f"'AB—' || {SECOND} || '&&'"),
    (f"'<BLOCKQUOTE><h2>' || {FIRST} || '</h2>b</BLOCKQUOTE>'", f"'>\n## ' || {FIRST} || '\n\nb'", f"{FIRST} || '\nb'"),
    (f"'<ul><li>' || {FIRST} || '</li></ul><ul><li>' || {SECOND} || '<ul><li>d</li></ul><ul><li>e</li></ul></li></ul>'", f"'- ' || {FIRST} || '\n\n- ' || {SECOND} || '\n- d\n- e'", f"{FIRST} || '\n' || {SECOND} || 'd\ne'"),
]

#: Lines for the server, and the replies (null: none).
CALL = """'{"jsonrpc":"2.0","id":' || cast(page_id as string) || ',"method":"""
OF_ID = """'{"jsonrpc":"2.0","id":' || cast(page_id as string) || ',"""
PARSE_ERROR = """'{"jsonrpc":"2.0","error":{"code":-32700,"message":"Parse error: not a request"}}'"""
LINES = [
    (CALL + """"tools/call","params":{"name":"' || """ + LABEL + """ || '"}}'""", OF_ID + """"error":{"code":-32602,"message":"Unknown tool: ' || """ + LABEL + """ || '"}}'"""),
    (CALL + """"tools/call","params":{"name":"webloom","arguments":{}}}'""", OF_ID + """"error":{"code":-32602,"message":"Missing required argument: url"}}'"""),
    (CALL + """"tools/call","params":{"name":"webloom","arguments":{"url":' || cast(page_id as string) || '}}}'""", OF_ID + """"error":{"code":-32602,"message":"Missing required argument: url"}}'"""),
    (CALL + """"tools/call","params":{"name":"webloom","arguments":{"url":"ftp' || url || '"}}}'""", OF_ID + """"result":{"content":[{"type":"text","text":"Error: Invalid URL: must start with http:// or https://"}],"isError":true}}'"""),
    (CALL + """"' || """ + LABEL + """ || '"}'""", OF_ID + """"error":{"code":-32601,"message":"Method not found: ' || """ + LABEL + """ || '"}}'"""),
    ("""'{"jsonrpc":"2.0","method":"' || """ + LABEL + """ || '"}'""", """'{"jsonrpc":"2.0","error":{"code":-32601,"message":"Method not found: ' || """ + LABEL + """ || '"}}'"""),
    ("'not json ' || url", PARSE_ERROR),
    ("''", "null"),
    (CALL + """"notifications/initialized"}'""", OF_ID + """"result":null}'"""),
    ("""'{"id":' || cast(page_id as string) || '}'""", PARSE_ERROR),
    ("""'{"jsonrpc":"2.0","method":"notifications/' || """ + LABEL + """ || '"}'""", "null"),
    ("""'{"jsonrpc":"2.0","id":"' || """ + NAME + """ || '","method":"none"}'""", """'{"jsonrpc":"2.0","id":"' || """ + NAME + """ || '","error":{"code":-32601,"message":"Method not found: none"}}'"""),
]
HANDSHAKE = [CALL + """"initialize"}'""", """'{"jsonrpc":"2.0","id":"' || """ + NAME + """ || '","method":"tools/list"}'"""]

#: A record of the code host for each page: columns, from which both the JSON and the summary are made.
RECORD = {
    "name": NAME, "full_name": PAGE, "description": "case when page_id % 3 > 0 then 'About ' || url end", "html_url": f"'https://github.com/' || {PAGE}", "homepage": "case page_id % 4 when 0 then '' when 1 then url end",
    "stars": "page_id * 7", "forks": "page_id % 100", "issues": "page_id % 10", "language": "case when page_id % 5 > 0 then 'Java' end", "spdx": "case when page_id % 3 = 0 then 'MIT' end", "license": "case when page_id % 6 < 5 then 'Own Terms' end",
    "topics": f"case when page_id % 2 = 0 then {LABEL} || ', web' end", "created": "'2020-01-01T00:00:00Z'", "updated": "'2021-01-01T00:00:00Z'", "pushed": "case when page_id % 29 <> 8 then '2022-01-01T00:00:00Z' end",
    "archived": "page_id % 7 = 1", "fork": "page_id % 8 = 2", "login": LABEL, "readme": "case when page_id % 5 < 3 then html end", "encoded": "page_id % 10 <> 1", "repo_status": STATUS, "bad": "page_id % 31 = 9",
}


def derived(pages: DataFrame, **columns: str) -> DataFrame:
    """page_id and derived columns of the pages."""
    return pages.selectExpr("page_id", *[f"{sql} as {name}" for name, sql in columns.items()])


def sql_of(**columns: str) -> str:
    return f"select page_id, {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from pages"


def repository_records(pages: DataFrame) -> DataFrame:
    """page_id, and captures of the code host's records: url, repo_status, repo_json, readme_status, readme_json."""
    d = derived(pages, **RECORD)
    given = lambda c: F.when(F.col(c).isNotNull(), F.split(c, ", "))
    record = F.struct(
        "name", "full_name", "description", "html_url", "homepage", F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), F.col("issues").alias("open_issues_count"), "language",
        F.when(F.coalesce("license", "spdx").isNotNull(), F.struct(F.coalesce("license", F.lit("?")).alias("name"), F.col("spdx").alias("spdx_id"))).alias("license"), F.lit("main").alias("default_branch"),
        F.col("created").alias("created_at"), F.col("updated").alias("updated_at"), F.col("pushed").alias("pushed_at"), given("topics").alias("topics"), "archived", "fork", F.struct("login", F.lit("User").alias("type")).alias("owner"),
    )
    fine = F.col("repo_status").between(200, 299)
    lines = F.regexp_replace(F.base64(F.encode("readme", "UTF-8")), "\r", "")
    readme = F.to_json(F.struct(lines.alias("content"), F.when(F.col("encoded"), "base64").otherwise("none").alias("encoding")))
    return d.select(
        "page_id", F.concat(F.lit("https://github.com/"), "full_name").alias("url"), "repo_status", F.when(fine, F.when(F.col("bad"), F.concat(F.lit("no json "), "name")).otherwise(F.to_json(record))).alias("repo_json"),
        F.when(fine, F.when(F.col("readme").isNull(), 404).otherwise(200)).alias("readme_status"), F.when(fine & F.col("readme").isNotNull(), readme).alias("readme_json"),
    )
