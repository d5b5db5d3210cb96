"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host (source); a line is boilerplate of a host if the pages that contain it, divided by the host's
page total, exceed ``ratio``. As a page holds each of its lines once, a host with pages of k different lines on average
has fewer than k / ratio such lines, however many pages it has; so they fit into one array a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Stored, pick

#: Boilerplate lines of all hosts up to which their table is broadcast: 16 bytes each and the hosts' names.
BROADCAST = 500_000


def key(line: Column) -> Column:
    """128 bits for a trimmed line."""
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))


def trimmed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\t\r]", " "))


def keys(lines: Column) -> Column:
    """The distinct keys of the lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(lines, trimmed), lambda v: v != ""), key))


def boilerplate(docs: DataFrame, ratio: float, least_pages: int, distinct_texts: bool) -> DataFrame:
    """(source, lines: array of keys) of the hosts that have boilerplate."""
    # the null line stands for the page itself, so that the pages of a host are counted with its lines
    lines = F.concat(F.array(F.lit(None).cast("struct<k1:bigint,k2:bigint>")), F.coalesce(keys(F.split("text", "\n")), F.array()))
    found = docs.select("source", F.xxhash64("text").alias("page"), F.explode(lines).alias("line")).select("source", "page", "line.k1", "line.k2")
    if distinct_texts:
        found = found.distinct()
    found = found.groupBy("source", "k1", "k2").agg(F.count(F.lit(1)).alias("pages"))
    counts = Stored(found.where((F.col("pages") >= least_pages) | F.col("k1").isNull()))
    hosts = counts.df.where("k1 is null").select(F.col("source").alias("host"), F.col("pages").alias("host_pages"))
    common = counts.df.where("k1 is not null").join(hosts, F.col("source").eqNullSafe(F.col("host")))
    common = common.where(F.col("pages") > F.col("host_pages") * ratio)
    return common.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("lines"))


def dedup_lines(docs: DataFrame, ratio: float = 0.02, least_pages: int = 2, distinct_texts: bool = False, salt: int = 64) -> DataFrame:
    """Texts without the boilerplate lines of their source: doc_id, text, lang, source, n_lines, n_dropped.

    A line goes if it is on more than ``ratio`` of its host's pages, every row of ``docs`` being a page, and on
    ``least_pages`` of them or more: a line on a single page repeats nothing, however small its host. With
    ``distinct_texts`` equal texts of a host count as one page.

    Lines are compared after trimming; blank lines are never dropped, and kept lines stay as they are, in order. A null
    text stays null with no lines, and is a page; a text of which all lines go becomes empty; null sources are one host.
    Very long texts are split whole. A ratio reached exactly isn't exceeded. One row for each row of ``docs``, repeated
    ones too; an empty table gives none; other columns are ignored. The texts aren't shuffled as long as the boilerplate
    table is small; otherwise they are joined by source and a salt of ``salt`` values, so that a hot source is spread.
    """
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be at least 0 and less than 1")
    rows = pick(docs, "doc_id", "text", "lang", "source")
    known = Stored(boilerplate(rows, ratio, least_pages, distinct_texts))
    total = known.df.agg(F.sum(F.size("lines"))).first()[0] or 0
    side = known.df.select(F.col("source").alias("host"), F.col("lines").alias("boiler"), F.col("lines.k1").alias("boiler_k1"))
    if total <= BROADCAST:
        joined = rows.join(F.broadcast(side), rows.source.eqNullSafe(side.host), "left")
    else:
        side = side.withColumn("side_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salt)))
        joined = rows.join(side, rows.source.eqNullSafe(side.host) & (rows.salt == side.side_salt), "left")
    split = F.split("text", "\n")
    # which lines of the text are boilerplate is found by hashing, whatever their number; blank lines have no key there
    joined = joined.select("*", split.alias("split"), F.when(F.col("boiler").isNotNull(), F.transform(split, trimmed)).alias("bare"))
    joined = joined.withColumn("k1", F.transform("bare", lambda v: F.when(v != "", F.xxhash64(v))))
    joined = joined.withColumn("bad", F.array_intersect("k1", "boiler_k1"))
    joined = joined.withColumn("exact", F.filter("boiler", lambda b: F.array_contains("bad", b.k1)))
    kept = F.filter("split", lambda v, i: F.coalesce(~F.array_contains(F.col("bad"), F.col("k1")[i]) | ~F.array_contains(F.col("exact"), key(F.col("bare")[i])), F.lit(True)))
    out = joined.select("doc_id", "text", "lang", "source", "split", F.when(F.size("bad") > 0, kept).otherwise(F.col("split")).alias("kept"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("split"))
    return out.select(
        "doc_id", F.array_join("kept", "\n").alias("text"), "lang", "source", n.cast("bigint").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("split") - F.size("kept")).cast("bigint").alias("n_dropped"),
    )


#: DuckDB SQL for ``dedup_lines`` on documents, with its default parameters.
ORACLE_SQL = r"""
with d as (select row_number() over () as page, doc_id, text, lang, source from documents),
l as (select page, source, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\t\r]', ' ', 'g'), ' ') as line from d),
p as (select source, line, count(distinct page) as pages from l where line <> '' group by source, line),
h as (select source, count(*) as host_pages from d group by source),
b as (select p.source, list(line) as boiler from p join h on p.source is not distinct from h.source
      where pages > host_pages * 0.02 and pages >= 2 group by p.source),
k as (select d.doc_id, d.lang, d.source, d.text, string_split(d.text, chr(10)) as lines,
      list_filter(string_split(d.text, chr(10)), lambda v: trim(regexp_replace(v, '[\t\r]', ' ', 'g'), ' ') = ''
        or not list_contains(coalesce(b.boiler, []), trim(regexp_replace(v, '[\t\r]', ' ', 'g'), ' '))) as kept
      from d left join b on d.source is not distinct from b.source)
select doc_id, array_to_string(kept, chr(10)) as text, lang, source, coalesce(len(lines), 0)::bigint as n_lines,
  coalesce(len(lines) - len(kept), 0)::bigint as n_dropped from k
"""
