"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. Random Gaussian projections are quantised to steps of ``width``;
the steps of several projections together are a bucket of a table, and several tables are made. How many projections
and tables follows from the number of vectors and from the recall asked for at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Stored, pick, settled
from webloom.llm.links import components, dealt, heavy_from, in_blocks, join_labels, looked_up, pairs, whole_groups

#: Entries of one bucket that are compared in one task, at most twice this many.
BLOCK = 256


def collide(distance: float, width: float) -> float:
    """Probability that one quantised projection of two points at ``distance`` is equal (Datar et al. 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float, width: float, bucket: int) -> tuple[int, int]:
    """Projections a table and tables: unrelated vectors fill buckets to about ``bucket``, pairs at the threshold are found with ``recall``."""
    near, far = collide(math.sqrt(2 - 2 * threshold), width), collide(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(n / bucket, 1)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


@lru_cache(maxsize=8)
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.random(tables * k), rng.integers(1, 1 << 62, tables * k) | 1


def codes(unit: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table, as a 64-bit number."""
    axes, shift, mix = projections(unit.shape[1], k, tables, seed)
    steps = np.floor(unit @ axes / width + shift).astype(np.int64)
    with np.errstate(over="ignore"):
        mixed = (steps * mix).reshape(len(unit), tables, k).sum(2)
        return (mixed ^ (mixed >> 29)) * np.int64(-4658895280553007687)


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sketches(unit: np.ndarray) -> np.ndarray:
    """A byte for each component, then two floats: the step of the bytes, and how far the vector is from its sketch."""
    step = np.maximum(np.abs(unit).max(1), 1e-30) / 127
    rough = np.rint(unit / step[:, None]).astype(np.int8)
    # a little more than the distance, so that rounding to float doesn't make it less
    away = np.sqrt(((unit - rough * step.astype(np.float32).astype(np.float64)[:, None]) ** 2).sum(1)) * (1 + 1e-5) + 1e-6
    return np.hstack([rough.view(np.uint8), np.stack([step, away], 1).astype("<f4").view(np.uint8).reshape(len(unit), 8)])


def read_sketches(sketch: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketched vectors, and how far the vectors are from them."""
    step, away = sketch[:, dim:].copy().view("<f4").T
    return sketch[:, :dim].view(np.int8) * step[:, None], away


def may_reach(rough: np.ndarray, away: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of pairs of sketched vectors can be ``threshold`` or more; never false for one that is.

    u.v is that of the sketches, and what the sketches miss is |v - v'| |u'| + |u - u'| |v| at most.
    """
    dot = np.einsum("nd,nd->n", rough[p], rough[q])
    slack = 3e-5 + 1.2e-7 * rough.shape[1]  # for sums in single precision
    return dot + away[q] * (1 + away[p]) + away[p] + slack >= threshold


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, width: float = 2.0, bucket: int = 50, seed: int = 7) -> DataFrame:
    """Links between vectors (vec_id, embedding) of cosine >= ``threshold``: vec_id, n_links, component_id, kept.

    One row for each row of ``vectors``. Equal vectors are one node from the start and count as linked. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths don't link.
    A null vec_id takes part, but is never a component's smallest; kept is false for it. Each pair found is counted
    once, in the first table where it meets, and no pair is written: tasks give counts and stars. Repeated rows stay, and
    are linked as equal vectors; an empty table gives no rows; other columns, the label too, are ignored.

    Through the tables go sketches of a byte a component, which tell the entries that can have a partner; only these
    get their vectors, for the exact cosines.
    """
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{kind}>"))
    fit = F.coalesce((F.size("embedding") > 0) & finite, F.lit(False))
    signed = rows.withColumns({"s1": F.when(fit, F.xxhash64("embedding")), "s2": F.when(fit, F.xxhash64(F.lit(1), "embedding"))})
    ids = signed.select("vec_id", "s1", "s2")
    groups = signed.where("s1 is not null").groupBy("s1", "s2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    nodes = Stored(groups.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.df.count()
    k, tables = plan_tables(n, threshold, recall, width, bucket)
    key = ["dim", "lsh_table", "code"]
    group = [*key, "low_block", "high_block"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column("dim").to_pylist(), np.int64)
            for dim in np.unique(size):
                for part in np.array_split(at := np.flatnonzero(size == dim), len(at) // 1000 + 1):
                    own = batch.take(pa.array(part))
                    unit = unit_rows(own.column("embedding"), dim)
                    found = codes(unit, k, tables, width, seed)
                    index = pa.array(np.tile(np.arange(len(part)), tables))
                    sketch = pa.array([x.tobytes() for x in sketches(unit)], pa.binary()).take(index)
                    yield pa.record_batch(
                        [pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(part))), pa.array(found.T.ravel()), *(own.column(c).take(index) for c in ("dim", "node")), sketch],
                        names=["lsh_table", "code", "dim", "node", "sketch"],
                    )

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [*group, "own_block", "node"]
        for rows, number in whole_groups(batches, group):
            again = np.flatnonzero(np.bincount(number)[number] > 1)
            rows, number = rows.take(pa.array(again)), number[again]
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part, own_number = rows.take(pa.array(at)), number[at]
                own, low, high = (part.column(c).to_numpy() for c in ("own_block", "low_block", "high_block"))
                rough, away = read_sketches(np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, dim + 8), dim)
                hit = np.zeros(len(at), bool)
                for i, j in pairs(own_number, own, low, high):
                    for a in range(0, len(i), 50_000):
                        p, q = i[a : a + 50_000], j[a : a + 50_000]
                        near = may_reach(rough, away, p, q, threshold)
                        hit[p[near]] = hit[q[near]] = True
                yield from part.select(kept).take(pa.array(np.flatnonzero(hit))).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in whole_groups(batches, group):
            again = np.flatnonzero(np.bincount(number)[number] > 1)
            if not len(again):
                continue
            rows, number = rows.take(pa.array(again)), number[again]
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                yield from inside(rows.take(pa.array(at)), number[at], int(dim))

    def inside(rows: pa.Table, number: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        node, copies, own, low, high, lsh = (rows.column(c).to_numpy() for c in ("node", "copies", "own_block", "low_block", "high_block", "lsh_table"))
        unit = unit_rows(rows.column("embedding"), dim)
        rough, found = unit.astype(np.float32), codes(unit, k, tables, width, seed)
        label, links, before = np.arange(len(node)), np.zeros(len(node), np.int64), np.arange(tables)
        for i, j in pairs(number, own, low, high):
            for a in range(0, len(i), 50_000):
                p, q = i[a : a + 50_000], j[a : a + 50_000]
                likely = np.einsum("nd,nd->n", rough[p], rough[q]) >= threshold - 1e-4
                p, q = p[likely], q[likely]
                near = (unit[p] * unit[q]).sum(1) >= threshold
                p, q = p[near], q[near]
                met = ((found[p] == found[q]) & (before < lsh[p][:, None])).any(1)  # counted in an earlier table
                p, q = p[~met], q[~met]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                join_labels(label, p, q)
        out = np.flatnonzero(links)
        yield pa.record_batch([pa.array(node[out]), pa.array(node[label[out]]), pa.array(links[out])], names=["a", "b", "links"])

    entries = nodes.df.select("node", "embedding", F.size("embedding").alias("dim")).mapInArrow(spread, "lsh_table int, code bigint, dim int, node bigint, sketch binary")
    found = settled(lambda: in_blocks(entries, key, F.col("node"), BLOCK).mapInArrow(likely, "dim int, lsh_table int, code bigint, low_block int, high_block int, own_block int, node bigint"))
    stars = Stored(dealt(found.join(nodes.df.select("node", "copies", "embedding"), "node"), key).mapInArrow(compare, "a bigint, b bigint, links bigint"))
    links = stars.df.groupBy("a").agg(F.sum("links").alias("links"))
    root = settled(lambda: components(stars.df.select("a", "b")))
    known = nodes.df.select("node", "s1", "s2", "smallest", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = known.join(links, known.node == links.a, "left").select("s1", "s2", "smallest", "copies", "links", "root")
    # a component's smallest id may be null, which a look-up would take for a miss: so it goes as a struct
    least = known.groupBy(F.col("root").alias("node")).agg(F.struct(F.min("smallest").alias("id")).alias("m"), F.count(F.lit(1)).alias("n"))
    named = looked_up(known, "root", least, heavy_from(n)).select("s1", F.struct("s2", F.col("m.id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).alias("of"), "copies")
    # by the first half of the signature, whose second half is compared then; a vector that very many rows share is looked up apart
    signed = named.groupBy(F.col("s1").alias("node")).agg(F.collect_list("of").alias("m"), F.sum("copies").alias("n"))
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = looked_up(ids.where("s1 is not null"), "s1", signed, heavy_from(total))
    linked = linked.withColumn("of", F.filter("m", lambda x: x.s2 == F.col("s2"))[0]).select("vec_id", "of.n_links", "of.component_id")
    alone = ids.where("s1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
