"""Ranked lexical search with block-max pruning.

Documents lie in blocks, ranges of neighbours. A block has a forward index, its documents' terms with their counts, and
for each term the largest count and the smallest length among the documents that have it, from which follows what the
term can add to a score there at most. For each query the blocks are visited by the sum of these bounds, from the
highest down, until a bound is below the score that the query's k-th best document has at least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import packed
from webloom.llm.common import Stored, pick, stretches

#: Documents of a block, and bytes of text whose blocks make one row of the index.
BLOCK, HELD = 64, 4 << 20
#: Term occurrences of the queries that are searched for together; their terms go to all tasks.
TOGETHER = 500_000

#: Lower-cases A-Z and turns the bytes that are in no term into blanks. Bytes beyond ASCII are in terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

# Those of the score.
UNIT, TF, LENGTH, PERCENT, SHARE = 1_000_000_000, 1000, 8, 100, 75


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of whatever isn't ASCII, A-Z lower-cased."""
    return list(filter(None, text.translate(FOLDED).split(b" ")))


def gain(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a score, over its weight: grows with ``tf``, falls with the length ``n``."""
    wide = n if SHARE * docs * int(n.max(initial=0)) < 2**63 else n.astype(object)
    m = PERCENT - SHARE + ((SHARE * docs * wide) // max(total, 1)).astype(np.int64)
    return (UNIT * tf) // np.maximum(TF * tf + LENGTH * m, 1)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


INDEX = "n_docs bigint, n_terms bigint, doc binary, none binary, n binary, cuts binary, term binary, tf binary, top_cuts binary, top_term binary, top_tf binary, top_n binary"
KINDS = {"doc": np.int64, "none": np.int8, "n": np.int64, "cuts": np.int64, "term": np.int32, "tf": np.int32, "top_cuts": np.int64, "top_term": np.int32, "top_tf": np.int32, "top_n": np.int64}


def index(docs: DataFrame, known: dict[bytes, int], block: int = BLOCK) -> DataFrame:
    """The index of ``docs`` (doc_id, text as bytes, n_bytes) for the terms of ``known``: a row for each HELD bytes of text.

    n_docs: documents with a term at all, n_terms: all their terms. Packed: doc_id (0 where it is null, with none set), n
    and the range of entries of each document; term and tf of the entries; for each block its range of terms, with their largest tf and smallest n.
    """
    source = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = source.value
        for batch in stretches(batches, "n_bytes", HELD):
            parts = [terms(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            term = np.fromiter((number.get(t, -1) for t in chain.from_iterable(parts)), np.int64, int(n.sum()))
            del parts
            doc = np.repeat(np.arange(len(n)), n)[term >= 0]
            key, tf = np.unique(doc * len(number) + term[term >= 0], return_counts=True)
            doc, term = np.divmod(key, max(len(number), 1))
            cuts = np.searchsorted(doc, np.arange(len(n) + 1))
            of, inverse = np.unique(doc // block * len(number) + term, return_inverse=True)
            top_tf, top_n = np.zeros(len(of), np.int64), np.full(len(of), np.iinfo(np.int64).max)
            np.maximum.at(top_tf, inverse, tf)
            np.minimum.at(top_n, inverse, n[doc])
            block_of, top_term = np.divmod(of, max(len(number), 1))
            top_cuts = np.searchsorted(block_of, np.arange(-(-len(n) // block) + 1))
            ids = batch.column("doc_id")
            columns = {"doc": ids.fill_null(0).to_numpy(), "none": ids.is_null().to_numpy(zero_copy_only=False), "n": n, "cuts": cuts, "term": term, "tf": tf, "top_cuts": top_cuts, "top_term": top_term, "top_tf": top_tf, "top_n": top_n}
            told = [pa.array([packed.pack(v.astype(KINDS[k]))], pa.binary()) for k, v in columns.items()]
            yield pa.record_batch([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), *told], names=["n_docs", "n_terms", *columns])

    return docs.mapInArrow(run, INDEX)


def found_in(index_: DataFrame, size: int) -> np.ndarray:
    """Documents of each term: summed by task, then as arrays of ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("term").to_pylist():
                df += np.bincount(packed.unpack(raw, np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], names=["term", "df"])

    got = index_.select("term").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return df


class Queries:
    """Queries of one batch: for each its distinct terms with weight times repeats, one after another."""

    def __init__(self, asked: list[list[int]], weights: np.ndarray):
        self.cuts, term, much = [0], [], []
        for own in asked:
            at, times = np.unique(np.array(own, np.int64), return_counts=True)
            term.append(at)
            much.append(times * weights[at])
            self.cuts.append(self.cuts[-1] + len(at))
        self.term, self.much = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, much))
        self.starts = np.array(self.cuts[:-1], np.int64)

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """Of each query what a document can score at most where terms add ``top`` at most."""
        return np.add.reduceat(self.much * top[self.term], self.starts)


class Segment:
    """One row of the index, with what terms add in its documents and blocks."""

    def __init__(self, row: dict, docs: int, total: int, size: int, block: int):
        x = {k: packed.unpack(row[k], kind).astype(np.int64) for k, kind in KINDS.items()}
        self.doc, self.none, self.cuts, self.term, self.block, self.size = x["doc"], x["none"], x["cuts"], x["term"], block, size
        self.gain = gain(x["tf"], np.repeat(x["n"], np.diff(self.cuts)), docs, total)
        self.top_cuts, self.top_term, self.top = x["top_cuts"], x["top_term"], gain(x["top_tf"], x["top_n"], docs, total)

    def __len__(self) -> int:
        return len(self.top_cuts) - 1

    def bounds(self, queries: Queries) -> np.ndarray:
        """Bound of each block (rows) for each query."""
        out = np.zeros((len(self), len(queries)), np.int64)
        top = np.zeros(self.size, np.int64)
        for b in range(len(self)):
            own = slice(self.top_cuts[b], self.top_cuts[b + 1])
            top[self.top_term[own]] = self.top[own]
            out[b] = queries.bounds(top)
            top[self.top_term[own]] = 0
        return out

    def scores(self, b: int, much: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """(score, none, doc) of a block's documents that score ``least`` or more; ``much``: weights by term, 0 for others."""
        first, last = b * self.block, min((b + 1) * self.block, len(self.doc))
        own = slice(self.cuts[first], self.cuts[last])
        sums = np.concatenate([[0], np.cumsum(much[self.term[own]] * self.gain[own])])
        score = np.diff(sums[self.cuts[first : last + 1] - self.cuts[first]])
        good = np.flatnonzero(score >= least)
        return score[good], self.none[first + good], self.doc[first + good]


NOTHING = (np.zeros(0, np.int64),) * 3


def best(held: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of both by falling score, then by doc_id, nulls last."""
    score, none, doc = (np.concatenate(x) for x in zip(held, more))
    order = np.lexsort((doc, none, -score))[:k]
    return score[order], none[order], doc[order]


def search_batch(slim: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, block: int) -> DataFrame:
    """(q, doc_id, score) of the best documents of each of some queries, and some more of each: at most ``k`` a task."""
    spark = slim.sparkSession
    known = {t: i for i, t in enumerate(sorted({t for _, ts in queries for t in ts}))}
    size = len(known)
    made = Stored(index(slim, known, block)).df
    docs, total = made.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = found_in(made, size)
    weights = np.array([weight(docs, x) for x in df.tolist()], np.int64)
    queries = [(q, ts) for q, ts in queries if ts]
    asked, names = Queries([[known[t] for t in ts] for _, ts in queries], weights), np.array([q for q, _ in queries], np.int64)
    many = len(asked)

    def visited(least) -> DataFrame:
        """Without ``least``, the best of the block of the highest bound of each row of the index; else all that may be among the k best."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [NOTHING] * many
            floor = np.ones(many, np.int64) if least is None else least.value.copy()
            own: Queries = source.value
            much = np.zeros(size, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment({c: batch.column(c)[i].as_py() for c in KINDS}, docs, total, size, block)
                    bounds = segment.bounds(own)
                    for q in np.flatnonzero((bounds >= floor).any(0)).tolist():
                        at = slice(own.cuts[q], own.cuts[q + 1])
                        much[own.term[at]] = own.much[at]
                        order = np.argsort(-bounds[:, q], kind="stable").tolist()
                        for b in order[:1] if least is None else order:
                            if bounds[b, q] < floor[q]:
                                break
                            held[q] = best(held[q], segment.scores(b, much, floor[q]), k)
                            if len(held[q][0]) == k:
                                floor[q] = max(floor[q], held[q][0][-1])
                        much[own.term[at]] = 0
            q = np.repeat(np.arange(many), [len(x[0]) for x in held])
            score, none, doc = (np.concatenate(x) for x in zip(*held))
            yield pa.record_batch([pa.array(names[q]), pa.array(doc, mask=none == 1), pa.array(score)], names=["q", "doc_id", "score"])

        return made.select(*KINDS).mapInArrow(run, RANKED)

    if not many:
        return spark.createDataFrame([], RANKED)
    source = spark.sparkContext.broadcast(asked)
    first = ranked(visited(None), k).groupBy("q").agg(F.min(F.when(F.col("rank") == k, F.col("score"))))
    sure = dict(map(tuple, first.collect()))  # a row a query
    return visited(spark.sparkContext.broadcast(np.array([sure.get(q) or 1 for q in names.tolist()], np.int64)))


RANKED = "q bigint, doc_id bigint, score bigint"


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batches_of(asked: DataFrame, together: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The queries with their terms, a batch after another; the driver holds one at a time."""
    held: list[tuple[int, list[bytes]]] = []
    total = 0
    for q, text in asked.select("q", "text").toLocalIterator():
        own = terms(bytes(text))
        if held and total + len(own) > together:
            yield held
            held, total = [], 0
        held.append((q, own))
        total += len(own)
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, k: int = 10, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each query (item_id, text): item_id, rank, doc_id, score.

    Terms and scores are those of ``terms`` and ``gain`` with ``weight``, counted over all documents. Each row of
    ``queries`` is a query of its own, repeated ids too; null texts, and texts without a term, have no results. Each row
    of ``docs`` is a document, repeated ids too; equal scores go by ascending doc_id, null ids last; ranks are unique. Documents without a term of the query aren't results, so there may be fewer than ``k``. Very long
    texts are read whole. Empty tables give no rows; other columns are ignored.

    The queries are searched for in batches of about ``together`` terms (a single longer query is one), so what goes to
    the tasks is bounded: each batch makes an index of its own terms in one scan of the texts, without a shuffle. A first
    pass over the index visits the best block of each row of it, which bounds the score of the k-th best from below;
    the second one visits what remains above. Tasks return ``k`` rows a query at most.
    """
    asked = pick(queries, "item_id", "text").select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("q", F.monotonically_increasing_id())
    asked = Stored(asked).df
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    slim = slim.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    found = [search_batch(slim, batch, k, block) for batch in batches_of(asked, together)]
    rows = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], RANKED)
    return ranked(rows, k).join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL = rf"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) as term from documents
), counts as (select doc_id, term, count(*) as tf from terms group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counts group by all),
whole as (select count(*) as docs, sum(n)::bigint as total from lengths),
asked as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) as term from benchmark) group by all
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from counts group by all), whole
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
  from asked join counts using (term) join lengths using (doc_id) join weights using (term), whole group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""
