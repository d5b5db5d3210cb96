"""HTML to Markdown and to plain text.

A page is cut into tokens by one regular expression: whole skipped elements, tags, entities, text. Each token is mapped
by itself, the results are joined, and white space is cleaned. Where a token's result depends on those before it (lists in
lists, preformatted text, quotes) the tokens are taken one after another with that state. Rows outside the expressions'
reach (see ``irregular``) go through ``webloom.functions.scanner`` in Arrow batches; all others are null there and cost
next to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from webloom.functions.scanner import scan
from webloom.functions.sql import create
from webloom.functions.text import clean_whitespace
from webloom.functions.url import bound

# Elements that are left out whole.
SKIPPED = "script|style|noscript|iframe|svg"

# Named entities. A no-break space becomes a plain one.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "copy": "©", "reg": "®"}

# What tags become in Markdown, when they open and when they close.
MARKDOWN_OPEN = {f"h{n}": f"\n{'#' * n} " for n in range(1, 7)} | {"br": "\n", "hr": "\n---\n", "li": "\n- ", "strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
MARKDOWN_CLOSE = {f"h{n}": "\n\n" for n in range(1, 7)} | dict.fromkeys(["p", "div", "section", "article", "main", "header", "footer"], "\n\n") | {
    "br": "\n", "hr": "\n---\n", "ul": "\n", "ol": "\n", "strong": "**", "b": "**", "em": "*", "i": "*", "code": "`",
}
# Tags that break lines in plain text, when they open and when they close.
TEXT_OPEN = dict.fromkeys(["p", *[f"h{n}" for n in range(1, 7)], "br"], "\n")
TEXT_CLOSE = TEXT_OPEN | dict.fromkeys(["div", "li", "tr"], "\n")

TOKEN = (
    rf"(?iU)<\s*({SKIPPED})(?:\s[^>]*)?(?<!/)>(?:[^<]++|<(?!/\s*\1(?:\s[^>]*)?>)[^>]*+>?+)*+(?:</\s*\1(?:\s[^>]*)?>)?"
    r"|<[^>]*>?"
    r"|&[^;\s]{0,11};?"
    r"|[^<&]+"
)
#: A skipped element that opens inside another.
NESTED_SKIP = rf"(?iU)<\s*({SKIPPED})(?:\s[^>]*)?(?<!/)>(?:[^<]++|<(?!/\s*\1[\s>]|\s*(?:{SKIPPED})[\s>]))*+<\s*(?:{SKIPPED})[\s>]"
#: A list that opens inside another.
NESTED_LIST = r"(?iU)<\s*[uo]l(?:\s[^>]*)?>(?:[^<]++|<(?!/\s*[uo]l[\s>]|\s*[uo]l[\s>]))*+<\s*[uo]l[\s>]"
#: Letters that fold to ASCII ones, and entities with a letter of several bytes, where a limit counts bytes.
ODD = r"[İſK]|&[^;\s]{0,11}[^\x00-\x7F]"


STATEFUL = r"(?iU)</?\s*(?:pre|blockquote)(?:[\s>]|\z)"


def irregular(html: Column, markdown: bool) -> Column:
    """Rows that need the scanner. What only letters beyond ASCII can cause is looked for only where there are any."""
    wide = F.octet_length(html) > F.length(html)
    needs = (wide & F.rlike(html, F.lit(ODD))) | F.rlike(html, F.lit(NESTED_SKIP))
    return needs | (wide & F.rlike(html, F.lit(r"(?i)<[^>]*[^\x00-\x7F][^>]*href="))) if markdown else needs


def stateful(html: Column) -> Column:
    """Rows whose Markdown depends on the order of their tokens."""
    return F.rlike(html, F.lit(NESTED_LIST)) | F.rlike(html, F.lit(STATEFUL))


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def decode_entity(token: Column, last: Column) -> Column:
    """Value of an entity token: from ``&`` to a semicolon, or as far as the scan went. ``last``: the input ends with it.

    Without a semicolon before that, and for unknown names, it is ``&`` alone; what was read is lost.
    """
    name = F.regexp_replace(token, "^&|;$", "")
    decimal = F.regexp_extract(name, r"^#\+?([0-9]+)$", 1)
    hexadecimal = F.regexp_extract(name, r"^#x\+?([0-9a-fA-F]+)$", 1)
    code = F.when(decimal != "", decimal.try_cast("bigint")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint"))
    scalar = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.when(scalar, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.when(F.endswith(token, F.lit(";")) | last, F.coalesce(F.try_element_at(_table(ENTITIES), name), letter, F.lit("&"))).otherwise("&")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag's text: the first place of ``name=`` decides. Null if it is missing or a quote stays open."""
    found = r"(?isU)^(?>.*?" + name + r"=\s*)"
    value = F.regexp_extract(tag, found + r"""(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*|(?=>|$)))""", 1)
    single = F.regexp_extract(tag, found + r"""'([^']*)'""", 1)
    bare = F.regexp_extract(tag, found + r"""([^"'\s>][^\s>]*)""", 1)
    fits = F.rlike(tag, F.lit(found + r"""(?:"[^"]*"|'[^']*'|[^"'\s>]|>|$)"""))
    return F.when(fits, F.concat(value, single, bare))


def _mapper(opens: dict[str, str], closes: dict[str, str], links: bool) -> Callable[[Column, Column], Column]:
    """What a token becomes by itself. A skipped element is one token, whose name no table has."""
    table = _table({f"<{k}": v for k, v in opens.items()} | {f"/{k}": v for k, v in closes.items()})

    def one(token: Column, last: Column) -> Column:
        side = F.when(F.startswith(token, F.lit("</")), "/").otherwise("<")
        tag = F.coalesce(F.try_element_at(table, F.concat(side, _name(token))), F.lit(""))
        if links:
            link = F.coalesce(F.concat(F.lit("[]("), attribute(token, "href"), F.lit(")")), F.lit(""))
            tag = F.when(F.rlike(token, F.lit(r"(?U)^<\s*[aA]\s")), link).otherwise(tag)
        return F.when(F.startswith(token, F.lit("<")), tag).when(F.startswith(token, F.lit("&")), decode_entity(token, last)).otherwise(token)

    return one


def _name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"(?U)^</?\s*([^\s>]*)", 1))


def _tokens(html: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the tokens: a lambda over an array of one binds them to a name, so that they are made once."""
    return F.element_at(F.transform(F.array(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))), f), 1)


def _mapped(html: Column, opens: dict[str, str], closes: dict[str, str], links: bool) -> Column:
    """All tokens mapped and joined."""
    one = _mapper(opens, closes, links)
    return _tokens(html, lambda ts: F.array_join(F.transform(ts, lambda t, i: one(t, i == F.size(ts) - 1)), ""))


def _walked(html: Column, opens: dict[str, str], closes: dict[str, str], links: bool) -> Column:
    """The same with what depends on the tokens before: the depth of lists, whether text is preformatted or quoted."""
    one = _mapper(opens, closes, links)
    kinds = _table({"ul": "list", "ol": "list", "pre": "pre", "blockquote": "quote", "code": "code"})

    def told(token: Column, last: Column) -> Column:
        tag = F.startswith(token, F.lit("<"))
        kind = F.coalesce(F.when(tag, F.try_element_at(kinds, _name(token))), F.lit(""))
        return F.struct(one(token, last).alias("value"), kind.alias("kind"), F.startswith(token, F.lit("</")).alias("closing"), tag.alias("tag"))

    def step(state: Column, t: Column) -> Column:
        value = (
            F.when(t.kind == "list", F.when(t.closing & (state.depth <= 1), "\n").otherwise(""))
            .when(t.kind == "pre", "\n```\n")
            .when(t.kind == "quote", F.when(t.closing, "\n").otherwise("\n> "))
            .when((t.kind == "code") & state.pre, "")
            .when(~t.tag & state.quote, F.replace(t.value, F.lit("\n"), F.lit("\n> ")))
            .otherwise(t.value)
        )
        depth = F.when(t.kind == "list", F.when(t.closing, F.greatest(state.depth - 1, F.lit(0))).otherwise(state.depth + 1)).otherwise(state.depth)
        pre, quote = (F.when(t.kind == k, ~t.closing).otherwise(state[k]) for k in ("pre", "quote"))
        return F.struct(F.concat(state.out, value).alias("out"), depth.alias("depth"), pre.alias("pre"), quote.alias("quote"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("pre"), F.lit(False).alias("quote"))
    return _tokens(html, lambda ts: F.aggregate(F.transform(ts, lambda t, i: told(t, i == F.size(ts) - 1)), first, step, lambda state: state.out))


def converted(html: Column, markdown: Column | None, text: Column | None, scan: Callable[[Column, Column], Column] = scan) -> Column:
    """Markdown of the pages where ``markdown`` holds, plain text of those where ``text`` does, null for others.

    Either may be None, if no row wants that form. Both forms share one pass of the scanner (``scan``) and one cleaning.
    """
    odd, parts = F.lit(False), []
    for wanted, form, links in ((markdown, (MARKDOWN_OPEN, MARKDOWN_CLOSE), True), (text, (TEXT_OPEN, TEXT_CLOSE), False)):
        if wanted is not None:
            given = F.when(wanted, html)
            odd = odd | F.coalesce(irregular(given, links), F.lit(False))
            # which way a page takes is told once: by itself, by walking, or by the scanner
            way = F.when(given.isNull() | irregular(given, links), 2).when(stateful(given) if links else F.lit(False), 1).otherwise(0)
            walked = lambda k: [_walked(F.when(k == 1, html), *form, links)] if links else []  # noqa: B023, E731
            parts.append(bound(way, lambda k: F.coalesce(_mapped(F.when(k == 0, html), *form, links), *walked(k))))  # noqa: B023
    return clean_whitespace(F.coalesce(*parts, scan(F.when(odd, html), F.lit(False) if markdown is None else F.coalesce(markdown, F.lit(False)))))


def without_skipped(html: Column) -> Column:
    """A page without its skipped elements, else as it is: kind after kind, each element up to the first closing tag of its kind.

    Tags count wherever they stand, in entities, comments and attributes too. An element that is never closed stays, and
    so does all behind it for that kind: it is taken in one piece, so the page isn't read once more for every such tag.
    """
    blank = r"[\t\n\f\r ]"
    for name in SKIPPED.split("|"):
        name = name.replace("s", "[sſ]")
        opening, closing = rf"<{blank}*{name}(?:{blank}[^>]*+(?<!/))?>", rf"</{blank}*{name}(?:{blank}[^>]*+)?>"
        html = F.regexp_replace(html, rf"(?i)(?=<)(?:{opening}[\s\S]*?{closing}|({opening}[\s\S]*+))", "$1")
    return html


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page. A null page gives null; the output may hold more than two newlines in a row."""
    return converted(html, F.lit(True), None)


def html_to_text(html: Column) -> Column:
    """Plain text of a page. A null page gives null."""
    return converted(html, None, F.lit(True))


#: Name under which the scanner is known to SQL.
SCANNER = "webloom_scan"


def register(spark: SparkSession) -> None:
    """``html_to_markdown`` and ``html_to_text`` as SQL functions of the session.

    Their bodies are the expressions of the functions here, so calls are planned as these are: natively, and by the
    scanner for the rows that need it. What one call returns must be written before another one can take it.
    """
    spark.udf.register(SCANNER, scan)
    for name, forms in (("html_to_markdown", (F.lit(True), None)), ("html_to_text", (None, F.lit(True)))):
        create(spark, name, "html STRING", "STRING", converted(F.col("html"), *forms, scan=lambda html, markdown: F.call_function(SCANNER, html, markdown)))
