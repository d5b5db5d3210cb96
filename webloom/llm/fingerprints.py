"""Document fingerprints: a Merkle tree over the sections, paragraphs and sentences of a text.

A leaf is the hash of a sentence, a node the hash of its children's hashes, the root that of the sections. Texts are equal
if their roots are; where roots differ, only branches that differ are looked into, so edits are located without
comparing what is equal.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Stored, pick, stretches

#: A paragraph: a line with the line ends behind it.
PARAGRAPH = re.compile(r"[^\n]*+\n++|[^\n]++")
#: A sentence of a paragraph, with the blanks behind it; SENTENCE characters at most if it doesn't end before.
SENTENCE = 256
PIECE = re.compile(rf"[^.!?]{{0,{SENTENCE}}}+[.!?]++\s*+|[^.!?]{{1,{SENTENCE}}}+")
#: A section ends at a blank line, or, in texts without any, at a paragraph whose hash is divisible by this: its place depends on its content only.
SECTION = 8
#: Bytes of a hash.
SIZE = 16
#: Bytes of text handled at once.
HELD = 4 << 20


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=SIZE).digest()


@dataclass
class Node:
    hash: bytes
    #: Characters that it covers.
    length: int
    children: list[Node] | None = None


def branch(children: list[Node]) -> Node:
    """A node over others; that of a single one too, so that depths are alike."""
    return Node(digest(b"".join([c.hash for c in children])), sum([c.length for c in children]), children)


def tree(text: str) -> Node:
    """Root, sections, paragraphs, sentences: each level in the order of the text, which the sentences joined give again."""
    sections: list[Node] = []
    held: list[Node] = []
    for line in PARAGRAPH.findall(text):
        held.append(branch([Node(digest(p.encode("utf-8", "surrogatepass")), len(p)) for p in PIECE.findall(line)]))
        if line.endswith("\n\n") or held[-1].hash[0] % SECTION == 0:
            sections.append(branch(held))
            held = []
    if held:
        sections.append(branch(held))
    return branch(sections)


def differing(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node]]:
    """The nodes of either list that the other one lacks, repeats counted."""
    shared = Counter([n.hash for n in a]) & Counter([n.hash for n in b])

    def rest(nodes: list[Node]) -> list[Node]:
        left = shared.copy()
        out = []
        for n in nodes:
            if left[n.hash] > 0:
                left[n.hash] -= 1
            else:
                out.append(n)
        return out

    return rest(a), rest(b)


def likeness(a: Node, b: Node) -> float:
    """Share of the characters of both texts that stand in equal branches: 1 for equal texts, 0 for texts that share no sentence."""
    if a.hash == b.hash:
        return 1.0
    left, right = [a], [b]
    while left and right and left[0].children is not None:
        left, right = differing([c for n in left for c in n.children], [c for n in right for c in n.children])
    return 1 - (sum(n.length for n in left) + sum(n.length for n in right)) / max(a.length + b.length, 1)


def edits(a: Node, b: Node) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in the first and (start, end) in the second one, by sentences, in their order.

    Branches that are equal at the same place from either end are left alone; what is between them is looked into on the
    next level below if it is one branch on each side, and is an edit otherwise. An insertion has an empty range.
    """
    out: list[tuple[int, int, int, int]] = []

    def look(x: list[Node], y: list[Node], at: int, to: int) -> None:
        low, most = 0, min(len(x), len(y))
        while low < most and x[low].hash == y[low].hash:
            low += 1
        high = 0
        while high < most - low and x[-1 - high].hash == y[-1 - high].hash:
            high += 1
        at, to = at + sum(n.length for n in x[:low]), to + sum(n.length for n in y[:low])
        x, y = x[low : len(x) - high], y[low : len(y) - high]
        if x and y and x[0].children is not None:
            look([c for n in x for c in n.children], [c for n in y for c in n.children], at, to)
        elif x or y:
            same = set(n.hash for n in x) & set(n.hash for n in y)
            if len(x) + len(y) > 2 and same:  # sentences that stayed, in the same order, part the edits
                split(x, y, at, to, same)
            else:
                out.append((at, at + sum(n.length for n in x), to, to + sum(n.length for n in y)))

    def split(x: list[Node], y: list[Node], at: int, to: int, same: set[bytes]) -> None:
        ends = [0, *accumulate(n.length for n in y)]
        where: dict[bytes, list[int]] = {}
        for i, n in enumerate(y):
            if n.hash in same:
                where.setdefault(n.hash, []).append(i)
        start, done, place = at, 0, at
        for n in x:
            j = next((i for i in where.get(n.hash, ()) if i >= done), None)
            if j is not None:
                if place > start or ends[j] > ends[done]:
                    out.append((start, place, to + ends[done], to + ends[j]))
                done, start = j + 1, place + n.length
            place += n.length
        if place > start or ends[-1] > ends[done]:
            out.append((start, place, to + ends[done], to + ends[-1]))

    if a.hash != b.hash:
        look([a], [b], 0, 0)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, root and the tree itself: sections and their paragraphs, each with its hash (hex) and length.

    One row for each row of ``docs``, in one map. A null text counts as empty; null ids and repeated rows stay; an empty
    table gives no rows; very long texts are read whole; other columns are ignored.
    """
    node = "struct<hash:string,length:bigint,paragraphs:array<struct<hash:string,length:bigint>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches, "n_bytes", HELD):
            trees = [tree(t) for t in batch.column("text").to_pylist()]
            told = [[{"hash": s.hash.hex(), "length": s.length, "paragraphs": [{"hash": p.hash.hex(), "length": p.length} for p in s.children]} for s in t.children] for t in trees]
            kind = pa.list_(pa.struct({"hash": pa.string(), "length": pa.int64(), "paragraphs": pa.list_(pa.struct({"hash": pa.string(), "length": pa.int64()}))}))
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.length for t in trees], pa.int64()), pa.array([t.hash.hex() for t in trees]), pa.array(told, kind)], names=["doc_id", "n_chars", "root", "sections"])

    return _texts(docs).mapInArrow(run, f"doc_id bigint, n_chars bigint, root string, sections array<{node}>")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits between two versions of a table, joined by doc_id: doc_id, likeness, edits (ranges of characters in either text).

    A row for each pair of rows of one id whose roots differ; ids that only one version has, null ids and equal texts give
    none. Empty tables give no rows; other columns are ignored.
    """
    pairs = pick(before, "doc_id", "text").toDF("doc_id", "one").join(pick(after, "doc_id", "text").toDF("doc_id", "other"), "doc_id")
    pairs = pairs.select(F.col("doc_id").cast("bigint"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("one", "other")])
    pairs = pairs.where("one <> other").withColumn("n_bytes", (F.octet_length("one") + F.octet_length("other")).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "other_start", "other_end")
        kind = pa.list_(pa.struct({n: pa.int64() for n in names}))
        for batch in stretches(batches, "n_bytes", HELD):
            trees = [(tree(a), tree(b)) for a, b in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist())]
            found = [[dict(zip(names, e)) for e in edits(*t)] for t in trees]
            yield pa.record_batch([batch.column("doc_id"), pa.array([likeness(*t) for t in trees]), pa.array(found, kind)], names=["doc_id", "likeness", "edits"])

    return pairs.mapInArrow(run, "doc_id bigint, likeness double, edits array<struct<start:bigint,end:bigint,other_start:bigint,other_end:bigint>>")


def _texts(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(doc_id: int | None, text: str, own: Node, then: str, next_: Node) -> dict:
    """A text against what it becomes when its second half is replaced by the beginning of the next one, and against that."""
    half = len(text) // 2
    changed = text[: len(text) - half] + then[:half]
    other = own if changed == text else tree(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return dict(zip(SCHEMA.names, (doc_id, len(text), sha, own.hash.hex(), other.hash.hex(), likeness(own, other), likeness(own, next_))))


def with_next(docs: DataFrame) -> DataFrame:
    """Each text, its edited form (see ``edited``) and the next text, by ascending doc_id, after the last one the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (roots), near_edited, near_next, one row for
    each row of ``docs``. Null texts count as empty. Null ids come first; rows of one id stand by a hash of their text,
    so reruns agree. A table of one row is followed by itself; an empty one gives no rows; other columns are ignored.

    The texts are sorted once, in ranges; rows that nothing tells apart are dealt to several ranges. A task knows what
    follows each of its rows but the last one: the first and last texts of each task are written beside the results,
    two for each task, and meet by the task's number.
    """
    keys = ["doc_id", "place", "salt"]
    rows = _texts(docs).withColumns({"place": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in stretches(batches, "n_bytes", HELD):
            made = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                now = doc_id, text, tree(text)
                if last is None:
                    first = now
                else:
                    made.append(edited(*last, *now[1:]))
                last = now
            out = pa.RecordBatch.from_pylist(made, SCHEMA)
            yield pa.record_batch([*out.columns, *[pa.nulls(len(made), t) for t in (pa.int32(), pa.string(), pa.string())]], names=[*SCHEMA.names, "task", "first", "last"])
        if last is not None:
            edge = [pa.nulls(1, f.type) for f in SCHEMA]
            edge[0] = pa.array([last[0]], pa.int64())
            yield pa.record_batch([*edge, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first[1]]), pa.array([last[1]])], names=[*SCHEMA.names, "task", "first", "last"])

    made = Stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place", "salt").mapInArrow(run, f"{RESULT}, task int, first string, last string")).df
    edges = made.where("task is not null")
    tasks = sorted(r[0] for r in edges.select("task").collect())  # a number for each task, not for each row
    if not tasks:
        return made.select(*SCHEMA.names)
    after = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, follows int")
    ends = edges.join(F.broadcast(after), "task").select("doc_id", "last", "follows")
    pairs = ends.join(edges.select(F.col("task").alias("follows"), "first"), "follows").select("doc_id", "last", "first")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([edited(d, a, tree(a), b, tree(b)) for d, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))], SCHEMA)

    return made.where("task is null").select(*SCHEMA.names).union(pairs.mapInArrow(close, RESULT))
