"""Connected components, and pairs inside groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Stored


#: Rows of a table of heavy keys, at most, that is sent to all tasks.
HEAVY = 50_000
#: Keys that the links of a node are spread over in a join.
SALT = 8


def heavy_from(rows: int, least: int = 64) -> int:
    """Rows from which on a key of a table of ``rows`` counts as heavy, so that no more than HEAVY keys can be."""
    return max(least, -(-rows // HEAVY))


def looked_up(rows: DataFrame, key: str, found: DataFrame, heavy: int) -> DataFrame:
    """``rows`` with column m of ``found`` (node, m, n) where node is their ``key``; n is how many rows a node has, about.

    Keys with more than ``heavy`` rows are HEAVY at most (see ``heavy_from``) and are sent to the tasks; the rest is
    joined, and no key of it has more rows than that. So a hub doesn't meet in one task.
    """
    top = found.where(F.col("n") > heavy).select(F.col("node").alias("heavy_node"), F.col("m").alias("heavy_m"))
    marked = rows.join(F.broadcast(top), F.col(key) == F.col("heavy_node"), "left")
    rest = found.where(F.col("n") <= heavy).select(F.col("node").alias("light_node"), F.col("m").alias("light_m"))
    light = marked.where("heavy_m is null").join(rest, F.col(key) == F.col("light_node"))
    return light.select(*rows.columns, F.col("light_m").alias("m")).union(marked.where("heavy_m is not null").select(*rows.columns, F.col("heavy_m").alias("m")))


def joined(rows: DataFrame, key: str, other: str, least: DataFrame) -> DataFrame:
    """``rows`` with column m of ``least`` (node, m) where node is their ``key``, whose rows are spread by ``other`` over SALT keys."""
    salts = least.select(F.col("node").alias("its"), "m", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("its_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALT)).cast("int"))
    return salted.join(salts, (F.col(key) == F.col("its")) & (F.col("salt") == F.col("its_salt"))).select(*rows.columns, "m")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node reaches: ``edges`` (a, b bigint) to (node, root), for nodes with an edge to another.

    Large-star and small-star rounds, each written to the shared folder: every node is linked to the smallest of its
    neighbours, until all components are stars. The minima are taken before the shuffle, and the links of a node are
    spread over SALT keys in joins whose large partitions the planner can split further, so a hub is no hot spot. Nothing
    but a count and a checksum comes to the driver.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = Stored(edges.where("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct())
    state = _state(now.df)
    while state[0]:
        stars = now.df.select(F.col("hi").alias("node"), F.col("lo").alias("v")).union(now.df.select("lo", "hi"))
        least = stars.groupBy("node").agg(F.least(F.col("node"), F.min("v")).alias("m"))
        large = joined(now.df, "lo", "hi", least).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        small = joined(large, "hi", "lo", least).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = Stored(small.union(least.select("node", "m")).distinct())
        now.drop()
        now, last, state = after, state, _state(after.df)
        if state == last:
            break
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.df.select("lo", "lo").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1]


def heavy_keys(entries: DataFrame, key: list[str], most: int) -> tuple[Stored, int, int]:
    """Keys with more than ``most`` entries, with these counts; how many they are, and how many entries they have."""
    heavy = Stored(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > most))
    n, total = heavy.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    return heavy, n, total


def with_counts(entries: DataFrame, key: list[str], heavy: Stored, n: int, total: int) -> DataFrame:
    """``entries`` with column entries: the count of a heavy key, else null.

    The heaviest keys, HEAVY at most, are sent to all tasks. If there are more, the others are joined, each of which has
    no more than a HEAVYth part of all entries of heavy keys.
    """
    if n <= HEAVY:
        return entries.join(F.broadcast(heavy.df), key, "left")
    cut = F.col("entries") > total // HEAVY
    top = entries.join(F.broadcast(heavy.df.where(cut)), key, "left")
    rest = top.where("entries is null").drop("entries").join(heavy.df.where(~cut), key, "left")
    return rest.select(*top.columns).union(top.where("entries is not null"))


def in_blocks(entries: DataFrame, key: list[str], row: Column, most: int) -> DataFrame:
    """Entries dealt out so that two of the same ``key`` meet exactly once, and at most about 2 * ``most`` in one group.

    A key with more than ``most`` entries is cut into blocks by the hash of ``row``, and its entries go to each pair of
    blocks. Adds own_block, low_block, high_block; a group is (key, low_block, high_block), and inside a group of two
    blocks only pairs across them are new.
    """
    heavy, n, total = heavy_keys(entries, key, most)
    if n:
        entries = with_counts(entries, key, heavy, n, total)
        blocks = F.coalesce(F.ceil(F.col("entries") / most), F.lit(1)).cast("int")
        entries = entries.withColumn("own_block", F.pmod(F.xxhash64(row), blocks).cast("int"))
        entries = entries.withColumn("other_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("entries")
        entries = entries.withColumns({"low_block": F.least("own_block", "other_block"), "high_block": F.greatest("own_block", "other_block")})
        entries = entries.drop("other_block")
    else:
        entries = entries.withColumns({c: F.lit(0) for c in ("own_block", "low_block", "high_block")})
    return dealt(entries, key)


def dealt(entries: DataFrame, key: list[str]) -> DataFrame:
    group = [*key, "low_block", "high_block"]
    return entries.repartition(*group).sortWithinPartitions(*group)


def edges_in_blocks(entries: DataFrame, key: str, most: int, compare, schema: str = "a bigint, b bigint") -> DataFrame:
    """Edges that connect what ``compare`` connects among the entries (node, ``key``), lists of any length included.

    ``compare`` maps dealt batches to edges. Lists of up to ``most`` entries are compared whole. A longer one is first
    cut into blocks that are compared by themselves; where this, over all lists, connects all of a list, which is so
    for one group of near copies, nothing more can come of it. Only the other long lists are compared whole, block by
    block. So the result is exact, and a list of n near copies costs n * ``most`` comparisons instead of n * n.
    """
    heavy, n, total = heavy_keys(entries, [key], most)
    if not n:
        return dealt(entries.withColumns({c: F.lit(0) for c in ("own_block", "low_block", "high_block")}), [key]).mapInArrow(compare, schema).distinct()
    counted = with_counts(entries, [key], heavy, n, total)
    blocks = F.coalesce(F.ceil(F.col("entries") / most), F.lit(1)).cast("int")
    own = counted.withColumn("own_block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    own = own.withColumns({c: F.col("own_block") for c in ("low_block", "high_block")})
    first = Stored(dealt(own.drop("entries"), [key]).mapInArrow(compare, schema).distinct())
    root = components(first.df)
    long = Stored(counted.where("entries is not null").drop("entries"))
    named = long.df.join(root, "node", "left").select(key, F.coalesce("root", "node").alias("root"))
    torn = Stored(named.groupBy(key).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(key))
    if not torn.df.limit(1).count():
        return first.df
    few = torn.df.count() <= HEAVY
    rest = long.df.join(F.broadcast(torn.df) if few else torn.df, key, "left_semi")
    return first.df.union(in_blocks(rest, [key], F.col("node"), most).mapInArrow(compare, schema)).distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut where a group ends: each table with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in group]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held:
            last = held[-1]
            if any(last.column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in group):
                changes = np.concatenate([[0], changes])
        if len(changes):
            cut = int(changes[-1])
            ready = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
            if ready.num_rows:
                yield ready, _numbers(ready, group)
        else:
            held.append(batch)
    if held:
        ready = pa.Table.from_batches(held)
        yield ready, _numbers(ready, group)


def _numbers(rows: pa.Table, group: list[str]) -> np.ndarray:
    columns = [rows.column(c).to_numpy() for c in group]
    return np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in columns], axis=0))])


def pairs(number: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group, some at a time: all pairs of a group of one block, else those across its two."""
    at, step = np.arange(len(number)), 1
    while len(at := at[at + step < len(number)]) and len(at := at[number[at] == number[at + step]]):
        i, j = at, at + step
        new = (low[i] == high[i]) | (own[i] != own[j])
        if new.any():
            yield i[new], j[new]
        step += 1


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the ends of each pair, and all that had their labels, the smaller of their labels; in place."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


