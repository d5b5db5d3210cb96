"""The stateful form of the HTML conversion, for rows that token-wise expressions can't express.

A page is walked token by token; a token ends where the scan of a tag, an entity or plain text would end. The state is
what later tokens depend on: open skipped elements, list depth, preformatted text, quotes. White space is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode White_Space; Python's own notion differs.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(r"<([^>]*)>?|&|[^<&]+")
NAME = re.compile(rf"[{BLANK}]*([^{BLANK}]*)")
BLANKS = re.compile(rf"[{BLANK}]*")
BARE = re.compile(rf"[^{BLANK}>]*")


def _entity(text: str, at: int) -> tuple[str, int]:
    """Value of the entity behind the ``&`` before ``at``, and where reading goes on."""
    from webloom.functions.html import ENTITIES

    end, size = at, 0
    while end < len(text) and text[end] != ";":
        if size > 10 or BLANKS.match(text[end])[0]:
            return "&", end
        size += len(text[end].encode("utf-8", "surrogatepass"))
        end += 1
    name, after = text[at:end], min(end + 1, len(text))
    if name in ENTITIES:
        return ENTITIES[name], after
    if m := re.fullmatch(r"#(?:x\+?([0-9a-fA-F]+)|\+?([0-9]+))", name, re.ASCII):
        code = int(m[1], 16) if m[1] else int(m[2])
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            return chr(code), after
    return "&", after


def _href(tag: str) -> str | None:
    at = tag.lower().find("href=")
    if at < 0:
        return None
    value = tag[BLANKS.match(tag, at + 5).end() :]
    if value[:1] in ('"', "'"):
        inner, end, _ = value[1:].partition(value[0])
        return inner if end else None
    return BARE.match(value)[0]


def convert(html: str, markdown: bool) -> str:
    """The text of ``html`` before white space is cleaned."""
    from webloom.functions import html as H

    opens, closes = (H.MARKDOWN_OPEN, H.MARKDOWN_CLOSE) if markdown else (H.TEXT_OPEN, H.TEXT_CLOSE)
    skipped = H.SKIPPED.split("|")
    out: list[str] = []
    inside: list[str] = []
    depth, pre, quote, at = 0, False, False, 0
    while at < len(html):
        m = PIECE.match(html, at)
        at = m.end()
        if (tag := m[1]) is None:
            if inside:
                continue
            value = m[0]
            if value == "&":
                value, at = _entity(html, at)
            out.append(value.replace("\n", "\n> ") if quote else value)
            continue
        low = tag.lower()
        closing = low.startswith("/")
        name = NAME.match(low, 1 if closing else 0)[1]
        if name in skipped:
            if not closing and not tag.endswith("/"):
                inside.append(name)
            elif closing and name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name)]
        elif inside:
            pass
        elif not markdown:
            out.append((closes if closing else opens).get(name, ""))
        elif name in ("ul", "ol"):
            depth = max(0, depth - 1) if closing else depth + 1
            out.append("\n" if closing and not depth else "")
        elif name == "pre":
            pre = not closing
            out.append("\n```\n")
        elif name == "blockquote":
            quote = not closing
            out.append("\n" if closing else "\n> ")
        elif name == "code" and pre:
            pass
        elif name == "a" and not closing:
            href = _href(tag)
            out.append("" if href is None else f"[]({href})")
        else:
            out.append((closes if closing else opens).get(name, ""))
    return "".join(out)


@F.arrow_udf(StringType())
def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, markdown in batches:
        kinds = markdown.to_pylist()
        yield pa.array([None if h is None else convert(h, k) for h, k in zip(html.to_pylist(), kinds)], pa.string())


def clean(text: str) -> str:
    """White space cleaned as by ``webloom.functions.text.clean_whitespace``."""
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(rf"[{BLANK.replace('t-', 't' + chr(92) + 'x0b-')}]+", " ", text)
    return re.sub(r" ?(\n+) ?", r"\1", text).strip(" \n")
