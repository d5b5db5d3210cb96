"""URL predicates and parts of http(s) URLs, normalised as a browser does.

Blanks at the ends and line breaks are dropped, dot segments resolved, signs that a path can't hold percent-encoded, and
hosts percent-decoded; international names become Punycode, numeric addresses get their common form. A sharp s counts as
ss and a final sigma as sigma, as in the older of the two rules for names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.reserved import RESERVED_OWNERS

AUTHORITY = r"^https?:[/\\]*([^/\\?#]*)"


def any_prefix(s: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    """Whether ``s`` starts with one of some prefixes: a chain of OR, which reaches the Parquet scan."""
    return reduce(lambda a, b: a | b, [F.startswith(s, F.lit(p)) for p in prefixes], F.lit(False))


def has_scheme(url: Column) -> Column:
    return any_prefix(url, ("http://", "https://"))


def bare(url: Column) -> Column:
    """The URL without the control signs and blanks at its ends, and without tabs and line breaks."""
    odd = F.rlike(url, F.lit(r"[\t\n\r]|[\x00-\x20]\z"))
    return F.when(odd, F.regexp_replace(F.regexp_replace(url, r"[\x00-\x20]+\z", ""), r"[\t\n\r]", "")).otherwise(url)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: A last label that makes a host a numeric address.
NUMERIC = r"(?:^|\.)(?:0x[0-9a-f]*|[0-9]+)\.?\z"
FORBIDDEN = r"[\x00-\x20\x7f<>^|%\"`{}\\]"


def _address(name: Column) -> Column:
    """A numeric host of one to four parts (decimal, octal after 0, hexadecimal after 0x) as four decimals; null if it isn't valid."""
    value = lambda p: F.when(F.rlike(p, F.lit(r"^0x[0-9a-f]*\z")), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 99)), 16, 10)).when(F.rlike(p, F.lit(r"^0[0-7]*\z")), F.conv(p, 8, 10)).when(F.rlike(p, F.lit(r"^[1-9][0-9]*\z")), p).try_cast("bigint")
    power = lambda n: F.pow(F.lit(256), n).cast("bigint")

    def whole(vs: Column) -> Column:
        n = F.size(vs)
        good = (n <= 4) & F.forall(F.transform(vs, lambda v, i: (v >= 0) & (v < F.when(i < n - 1, F.lit(256)).otherwise(power(5 - n)))), lambda ok: F.coalesce(ok, F.lit(False)))
        total = F.aggregate(F.transform(vs, lambda v, i: F.when(i < n - 1, v * power(3 - i)).otherwise(v)), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return F.when(good, bound(total, lambda t: F.concat_ws(".", *[F.shiftright(t, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])))

    return bound(F.transform(F.split(F.regexp_replace(name, r"\.\z", ""), r"\."), value), whole)


def _authority(url: Column) -> Column:
    return F.regexp_extract(bare(url), AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host, percent-decoded, in ASCII, without user and port; null if it isn't valid, empty if there is none."""
    return _host(_authority(url))


def _host(authority: Column) -> Column:
    raw = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return bound(raw, _named)


def _named(raw: Column) -> Column:
    decoded = F.when(F.contains(raw, F.lit("%")), F.lower(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")))).otherwise(raw)
    # the JVM's own conversion of names, for rows that have letters beyond ASCII
    named = bound(decoded, lambda h: F.when(F.rlike(h, F.lit(r"[^\x00-\x7F]")), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h))).otherwise(h))
    return bound(named, lambda h: F.when(F.rlike(h, F.lit(NUMERIC)), _address(h)).otherwise(h))


def parses(url: Column) -> Column:
    """Whether the URL has a host without forbidden characters and, if any, a port in range."""
    return bound(_authority(url), lambda a: _valid(a, _host(a)))


def _valid(authority: Column, name: Column) -> Column:
    behind = F.regexp_extract(authority, r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
    good = bound(name, lambda h: (h != "") & F.when(F.startswith(h, F.lit("[")), F.rlike(h, F.lit(r"^\[[0-9a-f:.]+\]$"))).otherwise(~F.rlike(h, F.lit(FORBIDDEN))))
    number = F.when(F.rlike(behind, F.lit("^:[0-9]{1,9}$")), F.substring(behind, 2, 9)).try_cast("int")
    return F.coalesce(good, F.lit(False)) & (behind.isin("", ":") | F.coalesce(number <= 65535, F.lit(False)))


#: What is percent-encoded in a path, and segments that are resolved.
ENCODED = r"[\x00-\x20\x22<>`{}\x7f]|[^\x00-\x7F]"
DOTS = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"


def _resolved(raw: Column) -> Column:
    """A path without its dot segments."""
    segments = F.split(raw, "/")
    inner = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))
    told = F.transform(inner, lambda x, i: F.struct(F.regexp_replace(x, "(?i)%2e", ".").alias("plain"), x.alias("text"), (i == F.size(inner) - 1).alias("last")))

    def add(made: Column, x: Column) -> Column:
        ends = F.when(x.last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        shorter = F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0)))
        return F.when(x.plain == "..", F.concat(shorter, ends)).when(x.plain == ".", F.concat(made, ends)).otherwise(F.concat(made, F.array(x.text)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(told, F.array().cast("array<string>"), add), "/"))


def path(url: Column) -> Column:
    """Path, beginning with a slash or empty, normalised."""
    return bound(F.translate(F.regexp_extract(bare(url), r"^https?:[/\\]*[^/\\?#]*([^?#]*)", 1), "\\", "/"), _normalised)


def _normalised(raw: Column) -> Column:
    raw = F.when(F.rlike(raw, F.lit(DOTS)), _resolved(raw)).otherwise(raw)
    signs = F.regexp_extract_all(raw, F.lit("(?s)."), F.lit(0))
    encoded = F.array_join(F.transform(signs, lambda c: F.when(F.rlike(c, F.lit(ENCODED)), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")
    return F.when(F.rlike(raw, F.lit(ENCODED)), encoded).otherwise(raw)


def parts(url: Column) -> Column:
    """(host, path, fine) of a URL: what the checks, the routes and the file names need of it, each computed once."""
    return bound(_authority(url), lambda a: bound(_host(a), lambda h: F.struct(h.alias("host"), path(url).alias("path"), _valid(a, h).alias("fine"))))


def file_name(url: Column, known: Column | None = None) -> Column:
    """Last segment of the path if it holds a dot, else null. ``known``: the URL's parts, if there are any."""
    last = F.regexp_extract(path(url) if known is None else known.path, "[^/]*\\z", 0)
    return F.when(F.contains(last, F.lit(".")), last)


def repository(url: Column, known: Column | None = None) -> Column:
    """(owner, repo) of a repository's page on the code host, else null: two segments, no slash behind, no reserved owner."""
    name, way = (host(url), path(url)) if known is None else (known.host, known.path)
    owner, repo = F.regexp_extract(way, "^/([^/]+)/[^/]+\\z", 1), F.regexp_extract(way, "^/[^/]+/([^/]+)\\z", 1)
    fits = has_scheme(url) & (name == "github.com") & (owner != "") & ~owner.isin(*RESERVED_OWNERS)
    return F.when(fits, F.struct(owner.alias("owner"), repo.alias("repo")))
