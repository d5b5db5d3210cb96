"""SimHash near-duplicates: an inverted index over byte positions with count filtering.

Fingerprints of 64 bits at a distance of ``bits`` at most share at least 8 - ``bits`` of their 8 positional bytes, the
guaranteed minimum. So among any joint + ``bits`` positions they share ``joint`` or more; the postings are kept by sets of
``joint`` positions and their bytes. Fingerprints that meet in a posting list have their shared positional bytes
tallied over all 8 positions; pairs that reach the minimum are verified bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Stored, chunks, few, pick, release, settled
from webloom.llm.jaccard import bands, hashes, link, shingles, signature
from webloom.llm.links import components, edges_in_blocks, heavy_from, join_labels, looked_up, pairs, whole_groups

#: Entries of one posting list that are compared in one task, at most twice this many; and whole sets of shingles, with
#: the bytes of these in one task at most (but for two sets that are larger together).
BLOCK, SETS, SET_BYTES = 2048, 512, 512 << 20


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of UTF-8 text: A-Z lower-cased, shingles of ``words`` words, XXH64 with seed 42, strict majority of bits."""
    return majority(hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; none of none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Fingerprint of every whole text: doc_id, fp (the 64 bits as a signed long). Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = []
            for a, b in chunks(batch.column("n_bytes").to_pylist(), 1 << 20):
                found += [fingerprint(t, words) for t in batch.column("text").slice(a, b - a).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def joint_bytes(n: int, bits: int, length: int = 64) -> int:
    """Positional bytes of a posting, for lists of about ``length`` unrelated fingerprints out of ``n``; no more than can be guaranteed."""
    return min(8 - bits, max(2, math.ceil(math.log(max(n / length, 1), 256))))


def linked(distinct: DataFrame, bits: int = 3, joint: int | None = None) -> DataFrame:
    """Edges (a, b) that join every two distinct fingerprints (column fp) at ``bits`` or fewer differing bits.

    Edges are not all pairs: what is connected inside a group of a task is given as a star, so a group of n near
    copies leaves no more than n rows for each list. ``joint`` (1 to 8 - bits) sets how long the lists are: a list has
    about n / 256**joint of n fingerprints besides true neighbours. It follows from n if it isn't given.
    """
    if not 0 <= bits < 8 or joint is not None and not 1 <= joint <= 8 - bits:
        raise ValueError("bits must be 0 to 7 and joint 1 to 8 - bits")
    joint = joint or joint_bytes(distinct.count(), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in whole_groups(batches, ["posting", "low_block", "high_block"]):
            fp, own, low, high = (rows.column(c).to_numpy() for c in ("node", "own_block", "low_block", "high_block"))
            label = np.arange(len(fp))
            for i, j in pairs(number, own, low, high):
                differ = fp[i] ^ fp[j]
                shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally
                i, j, differ = (x[shared >= 8 - bits] for x in (i, j, differ))
                near = np.bitwise_count(differ.view(np.uint64)) <= bits
                join_labels(label, i[near], j[near])
            out = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.record_batch([pa.array(fp[out]), pa.array(fp[label[out]])], names=["a", "b"])

    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(joint + bits)]
    postings = []
    for n, at in enumerate(combinations(range(joint + bits), joint)):
        code = F.lit(n).cast("bigint")
        for p in at:
            code = F.shiftleft(code, 8).bitwiseOR(byte[p])
        postings.append(code)
    entries = Stored(distinct.select(F.col("fp").alias("node"), F.explode(F.array(*postings)).alias("posting")))
    return edges_in_blocks(entries.df, "posting", BLOCK, run)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, joint: int | None = None) -> DataFrame:
    """Components of documents whose fingerprints are linked: doc_id, fp, component_id (the smallest doc_id reachable).

    One row for each row of ``docs``. Equal fingerprints are one node from the start, so copies are never expanded into
    pairs. Null and empty texts have fingerprint zero and are linked like others. A null doc_id is never the smallest;
    a component of null ids alone has a null component_id. Very long texts are read whole, 65,536 shingles at a time.
    Repeated rows stay; an empty table gives none; other columns are ignored. A fingerprint that very many documents
    share is looked up apart, so its documents don't meet in one task.
    """
    rows = Stored(fingerprints(docs, words))
    nodes = Stored(rows.df.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")))
    total = nodes.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    root = settled(lambda: components(linked(nodes.df.select("fp"), bits, joint)))
    nodes_root = nodes.df.join(root, nodes.df.fp == root.node, "left").select("fp", "smallest", "n", F.coalesce("root", "fp").alias("root"))
    of_roots = nodes_root.groupBy(F.col("root").alias("node")).agg(F.min("smallest").alias("m"), F.count(F.lit(1)).alias("n"))
    # a root's smallest id may be null, which a lookup would take for a miss: so it goes as a struct
    of_roots = of_roots.withColumn("m", F.struct("m"))
    named = looked_up(nodes_root, "root", of_roots, heavy_from(total)).select(F.col("fp").alias("node"), "m", "n")
    return looked_up(rows.df, "fp", named, heavy_from(total)).select("doc_id", "fp", F.col("m.m").alias("component_id"))


def row_keys() -> dict[str, Column]:
    """Two hashes of id and text, 128 bits together, so that at 10**10 rows no two share both."""
    row = [F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary")]
    return {"row": F.xxhash64(*row), "row2": F.xxhash64(F.lit(1), *row)}


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def near_copies(docs: DataFrame, words: int = 5, bits: int = 5) -> DataFrame:
    """Groups of texts linked by a Jaccard similarity of 0.8 or more of their shingles: doc_id, row and row2 (hashes of id and text), group.

    Candidates are what the byte-position index links at ``bits`` or fewer differing bits, and, as pairs at 0.8 differ by
    up to some 15 bits of 64, which no number of shared bytes guarantees, also what shares a MinHash band. The connected
    candidates are only a way to deal texts out: inside, every set of shingles is compared whole with all that aren't
    yet known to belong to it, and only similarity decides.

    One row for each row of ``docs``. Equal sets of shingles, told by 128 bits, are one node from the start. Null and empty texts are
    equal, and linked to no others. Very long texts are read whole. Repeated rows and null ids stay; an empty table
    gives none; other columns are ignored.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            signs, prints, codes = [], [], []
            for a, b in chunks(batch.column("n_bytes").to_pylist(), 1 << 20):
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    h = hashes(text, words)
                    found = np.unique(h)
                    signs.append(signature(found))
                    prints.append(majority(h))
                    codes.append(bands(found).view(np.int64))
            known = [batch.column(c) for c in ("doc_id", "row", "row2")]
            made = [_signed([s[0] for s in signs]), _signed([s[1] for s in signs]), _signed(prints), pa.array(codes, pa.list_(pa.int64()))]
            yield pa.record_batch([*known, *made], names=["doc_id", "row", "row2", "s1", "s2", "fp", "bands"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in chunks(batch.column("n_bytes").to_pylist(), 1 << 20):
                sets = [shingles(t, words) for t in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in ("maybe", "node")), pa.array([s.tobytes() for s in sets], pa.binary())], names=["maybe", "node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows, number in whole_groups(batches, ["maybe", "low_block", "high_block"]):
            own, held = rows.column("node").to_numpy(), rows.column("shingles")
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    label = link([np.frombuffer(s.as_buffer(), np.uint64) for s in held.slice(a, b - a)])
                    yield pa.record_batch([pa.array(own[a:b]), pa.array(own[a:b][label])], names=["a", "b"])

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumns({"n_bytes": F.octet_length("text")} | row_keys())
    rows = Stored(texts.mapInArrow(sketch, "doc_id bigint, row bigint, row2 bigint, s1 bigint, s2 bigint, fp bigint, bands array<bigint>"))
    # equal sets may have several fingerprints, as these count repeated shingles; one will do
    alike = rows.df.groupBy("s1", "s2").agg(F.min(F.struct("row", "row2")).alias("one"), F.any_value("bands").alias("bands"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    nodes = Stored(alike.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = Stored(nodes.df.select("node", F.explode("bands").alias("band")))
    least = entries.df.groupBy(F.col("band").alias("node")).agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = looked_up(entries.df, "band", least, heavy_from(32 * total)).select(F.col("node").alias("a"), F.col("m").alias("b"))
    first = nodes.df.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.df.join(first, "fp").select("node", "first")

    def candidates() -> DataFrame:
        close = linked(first.select("fp"), bits)
        ends = close.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
        return components(met.union(ends).union(same).where("a <> b").distinct())

    maybe = settled(candidates)
    one = Stored(nodes.df.join(maybe, "node").select("node", "one.row", "one.row2", F.col("root").alias("maybe")))
    sets = Stored(texts.join(few(one.df), ["row", "row2"]).select("maybe", "node", "text", "n_bytes").mapInArrow(whole, "maybe bigint, node bigint, shingles binary"))
    largest = sets.df.agg(F.coalesce(F.max(F.octet_length("shingles")), F.lit(0))).first()[0]
    most = max(1, min(SETS, SET_BYTES // (2 * max(1, largest))))
    root = settled(lambda: components(edges_in_blocks(sets.df, "maybe", most, compare)))
    entries.drop()
    sets.drop()
    group = nodes.df.join(root, "node", "left").select("s1", F.struct("s2", F.coalesce("root", "node").alias("group")).alias("of"), "n")
    # by the first half of the signature, whose second half is compared then
    group = group.groupBy(F.col("s1").alias("node")).agg(F.collect_list("of").alias("m"), F.sum("n").alias("n"))
    named = looked_up(rows.df.select("doc_id", "row", "row2", "s1", "s2"), "s1", group, heavy_from(total))
    return named.select("doc_id", "row", "row2", F.filter("m", lambda x: x.s2 == F.col("s2"))[0].group.alias("group"))
