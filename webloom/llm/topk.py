"""Exact top-k by inner product: norm-bucketed retrieval.

Candidates are grouped by length. For a query q with a known lower bound on its k-th best score, a bucket whose longest
vector has length l can only hold results at a cosine of bound / (|q| l) or more. Beyond 1 the bucket is skipped before
anything is sent; else that local threshold chooses how the bucket is pruned: high, by the ranges it leaves for the
largest coordinates of q; low, by length. Whatever is left is verified by its product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import Stored, pick

#: Candidates and queries of one group, about.
CANDIDATES, QUERIES = 8192, 8192
#: Vectors from which the first bounds come, about: those of the longest buckets.
FIRST = 2048
#: Local cosine threshold from which coordinates are pruned, and how many coordinates.
STEEP, FOCUS = 0.5, 4
#: Slack for rounding in bounds; only products decide.
SLACK = 1e-9


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats as long as every partial sum stays below 2**53, else by 64-bit integers."""
    most = x.shape[-1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("an inner product may exceed 64 bits")
    return x @ q


class Bucket:
    """Candidates of one group, longest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.rows, self.ids, self.x, self.length = rows[order], ids[order], x[order], length[order]
        self.exact = self.x.astype(np.float64)
        self.unit = self.exact / np.maximum(self.length, 1e-300)[:, None]

    def search(self, own: int, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k for the query of row ``own``, among scores of ``bound`` or more."""
        size = math.sqrt(float((q.astype(np.float64) ** 2).sum()))
        best, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        unit = q / max(size, 1e-300)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        for a in range(0, len(self.ids), 2048):
            part = slice(a, a + 2048)
            reach = size * self.length[a]
            if bound > 0 and reach * (1 + SLACK) < bound:
                break
            local = bound / reach if bound > 0 and reach > 0 else -1.0
            if local >= STEEP:
                left = np.ones(len(self.ids[part]), bool)
                spread_ = math.sqrt(max(0.0, 1 - local * local))
                for f in focus:
                    u, s = unit[f], spread_ * math.sqrt(max(0.0, 1 - unit[f] ** 2)) + SLACK
                    column = self.unit[part, f]
                    if u <= local:
                        left &= column <= u * local + s
                    if u >= -local:
                        left &= column >= u * local - s
                at = np.flatnonzero(left) + a
            elif bound > 0:  # as many of the longest as can reach the bound
                at = np.arange(a, a + int(np.searchsorted(-self.length[part], -bound / size * (1 - SLACK), "right")))
            else:
                at = np.arange(a, min(a + 2048, len(self.ids)))
            at = at[self.rows[at] != own]
            score = products(self.x[at], q)
            good = score >= bound
            best, ids = np.concatenate([best, score[good]]), np.concatenate([ids, self.ids[at][good]])
            if len(best) >= k:
                order = np.lexsort((ids, -best))[:k]
                best, ids = best[order], ids[order]
                bound = max(bound, float(best[-1]))
        return ids, best


def blocks_of(needed: np.ndarray, each: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of about ``most`` queries, by the length that a candidate needs at least to matter to a query.

    ``needed`` is a sorted sample of these lengths, each of which stands for ``each`` queries. Returns for ranges of needed
    lengths their lower bounds, the number of the first block of each, and how many blocks it has: more than one where
    very many queries need the same.
    """
    step = max(1, int(most / each))
    lower, cuts = np.unique(needed[::step], return_counts=True)
    blocks = np.maximum(1, np.ceil(cuts * step * each / most)).astype(np.int64)
    return lower, np.cumsum(blocks) - blocks, blocks


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """Best ``k`` candidates by inner product of floor(``scale`` * component): query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but the query's own, so another row
    of the same vec_id is one. Ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors that are null,
    empty, or hold null or non-finite components take no part, nor do rows with a null vec_id. Vectors are compared with
    those of their own length only. A repeated query row gives its ranks again. An empty table gives no rows; other
    columns are ignored. Scores are exact; beyond 64 bits an error is raised.

    Only about FIRST vectors, of the longest buckets, are sent to all tasks, from which each query has a first bound and
    with it the length that a candidate needs. Queries are dealt into blocks by that length, so that a bucket of shorter candidates goes
    only to the blocks that it can matter to. Candidates of a bucket are dealt into groups by hash, so many vectors of one
    length make many groups.
    """
    x = F.col("embedding")
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = rows.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("v"), F.size(x).alias("dim"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    whole = whole.withColumn("length", length).withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log2("length") * 4)).otherwise(-1000).cast("int"))
    stored = Stored(whole.withColumn("row", F.monotonically_increasing_id()))
    stats = stored.df.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).collect()
    spark = vectors.sparkSession
    dims = sorted({r["dim"] for r in stats})
    shares = []  # any candidates give bounds: whole buckets from the longest on, and of the last one as many as are missing, by hash
    for dim in dims:
        wanted = max(2 * (k + 1), FIRST // len(dims))
        for r in sorted((r for r in stats if r["dim"] == dim), key=lambda r: -r["bucket"]):
            if wanted <= 0:
                break
            shares.append((dim, r["bucket"], min(1.0, wanted / r["n"])))
            wanted -= r["n"]
    chosen = F.broadcast(spark.createDataFrame(shares, "dim int, bucket int, share double"))
    some = stored.df.select("dim", "bucket", "row", "v").join(chosen, ["dim", "bucket"]).where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("dim", "row", "v").toArrow()
    first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    dim_of = some.column("dim").to_numpy()
    for dim in dims:
        own = some.take(pa.array(np.flatnonzero(dim_of == dim)))
        first[dim] = own.column("row").to_numpy(), own.column("v").combine_chunks().flatten().to_numpy().reshape(own.num_rows, dim)
    shared = spark.sparkContext.broadcast(first)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, v, dim in zip(*(batch.column(c).to_pylist() for c in ("row", "v", "dim"))):
                at, c = shared.value[dim]
                score = np.sort(products(c[at != own], np.array(v, np.int64)))
                found.append(float(score[-k]) if len(score) >= k else -math.inf)
            bound = np.array(found)
            size = batch.column("length").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(bound > 0, bound / size, 0.0)
            yield pa.record_batch([*batch.columns, pa.array(bound), pa.array(needed)], names=[*batch.schema.names, "bound", "needed"])

    asked = stored.df.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "dim", "length")
    asked = Stored(asked.mapInArrow(bounded, "row bigint, vec_id bigint, v array<bigint>, dim int, length double, bound double, needed double")).df
    queries = sum(r["queries"] for r in stats)
    points = min(1_000, queries)
    at_ = [(i + 0.5) / points for i in range(points)]
    quantiles = asked.agg(F.percentile_approx("needed", F.array(*map(F.lit, at_)), F.lit(10_000))).first()[0] if queries > QUERIES else [0.0]
    lower, at, blocks = blocks_of(np.array([0.0, *quantiles[1:]]), max(queries, 1) / len(quantiles), QUERIES)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.searchsorted(lower, batch.column("needed").to_numpy(), "right") - 1
            mixed = batch.column("row").to_numpy() * 2654435761 >> 16
            yield batch.append_column("block", pa.array((at[i] + mixed % blocks[i]).astype(np.int32)))

    reach = [float(r["longest"]) * (1 + SLACK) for r in stats]
    most = [int((at + blocks)[np.searchsorted(lower, x, "right") - 1]) for x in reach]  # blocks that a bucket can matter to
    buckets = spark.createDataFrame(
        [(r["dim"], r["bucket"], x, math.ceil(r["n"] / CANDIDATES), n) for r, x, n in zip(stats, reach, most)], "of int, its int, reach double, groups int, blocks int"
    )
    asked = asked.mapInArrow(in_blocks, "row bigint, vec_id bigint, v array<bigint>, dim int, length double, bound double, needed double, block int")
    sent = asked.join(F.broadcast(buckets), (F.col("dim") == F.col("of")) & (F.col("needed") <= F.col("reach")))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("dim", F.col("its").alias("bucket"), "part", "block", "row", "v", "vec_id", "bound")
    held = stored.df.join(F.broadcast(buckets), (F.col("dim") == F.col("of")) & (F.col("bucket") == F.col("its")))
    held = held.withColumns({"part": F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    held = held.select("dim", "bucket", "part", "block", "row", "vec_id", "v")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(asked) and len(held):
            bucket = Bucket(held["row"].to_numpy(np.int64), held["vec_id"].to_numpy(np.int64), np.stack(held["v"].to_numpy()).astype(np.int64))
            for row, own, v, bound in zip(asked["row"], asked["vec_id"], asked["v"], asked["bound"]):
                ids, score = bucket.search(row, np.asarray(v, np.int64), bound, k)
                out.append(pd.DataFrame({"row": row, "query_id": own, "vec_id": ids[:k], "score": score[:k]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("row", "query_id", "vec_id", "score")})

    key = ["dim", "bucket", "part", "block"]
    best = sent.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(search, "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
