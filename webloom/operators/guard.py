"""URL checks before anything is fetched, and the route of each URL."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.options import FetchOptions


def error_kind(url: Column, options: FetchOptions, missing: bool = True, known: Column | None = None) -> Column:
    """First check that a URL fails, else null: missing, scheme, parsing, allow list, block list.

    A null URL counts as an empty one. Without ``missing``, as for a registry that is called by itself, an empty URL
    fails the scheme check. ``known``: the URL's parts, if there are any.
    """
    text = F.coalesce(url, F.lit(""))
    out = F.when(text == "", "MissingUrl") if missing else F.when(F.lit(False), "MissingUrl")
    out = out.when(~U.has_scheme(text) | ~F.coalesce(U.parses(text) if known is None else known.fine, F.lit(False)), "InvalidUrlScheme")
    if options.allow_prefixes:
        out = out.when(~U.any_prefix(text, options.allow_prefixes), "BlockedUrl")
    if options.block_prefixes:
        out = out.when(U.any_prefix(text, options.block_prefixes), "BlockedUrl")
    return out


def passed(df: DataFrame, options: FetchOptions) -> DataFrame:
    """Rows whose URL passes; the prefix tests reach a Parquet scan."""
    url = F.col("url")
    df = df.where(U.has_scheme(url))
    if options.allow_prefixes:
        df = df.where(U.any_prefix(url, options.allow_prefixes))
    for p in options.block_prefixes:
        df = df.where(~F.startswith(url, F.lit(p)))
    return df.where(U.parses(url))


#: Bytes of prefixes that go to all tasks.
SENT = 64 << 20


def prefix_array(prefixes: list[str]) -> list[str]:
    """The prefixes in order, without those that begin with another one: then only the last one not behind a URL can begin it."""
    kept: list[str] = []
    for p in sorted(set(prefixes)):
        if not kept or not p.startswith(kept[-1]):
            kept.append(p)
    return kept


def _search(known: Broadcast):
    """An Arrow function that tells whether a URL starts with one of the prefixes: one binary search a URL."""

    @F.arrow_udf("boolean")
    def found(urls: pa.Array) -> pa.Array:
        array = known.value
        out = []
        for u in urls.to_pylist():
            at = bisect_right(array, u) if u is not None else 0
            out.append(None if u is None else at > 0 and u.startswith(array[at - 1]))
        return pa.array(out, pa.bool_())

    return found


def _cut(df: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """The distinct URLs (_url) that start with a prefix: each is cut to every length that a prefix has, and the cuts meet the prefixes in an equi-join."""
    cuts = F.array(*[F.when(F.length("_url") >= n, F.substring("_url", 1, n)) for n in lengths])
    urls = df.select(F.col("url").alias("_url")).where("_url is not null").distinct().select("_url", F.explode(cuts).alias("prefix"))
    return urls.join(known, "prefix", "left_semi").select("_url").distinct()


def _by_table(df: DataFrame, prefixes: DataFrame, matching: bool, sent: int) -> DataFrame:
    known = prefixes.select("prefix").where("prefix is not null").distinct()
    size = known.agg(F.sum(F.octet_length("prefix"))).first()[0]
    if size is None:
        return df
    if size <= sent:
        array = df.sparkSession.sparkContext.broadcast(prefix_array([r[0] for r in known.collect()]))
        found = _search(array)(F.col("url"))
        return df.where(found if matching else ~F.coalesce(found, F.lit(False)))
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    hits = _cut(df, known, lengths)
    return df.join(hits, df["url"] == hits["_url"], "left_semi" if matching else "left_anti")


def blocked_by_table(df: DataFrame, prefixes: DataFrame, sent: int = SENT) -> DataFrame:
    """Rows whose URL starts with none of the prefixes of a table (prefix), however many these are. Null URLs stay.

    Up to ``sent`` bytes the prefixes go to all tasks as a sorted array, in which each URL is searched for: nothing is
    shuffled but the prefixes, and their number hardly matters. Beyond that the URLs meet them by equi-joins.
    """
    return _by_table(df, prefixes, False, sent)


def allowed_by_table(df: DataFrame, prefixes: DataFrame, sent: int = SENT) -> DataFrame:
    """Rows whose URL starts with one of the prefixes of a table; all rows if it has none. Null URLs go, unless it has none."""
    return _by_table(df, prefixes, True, sent)
