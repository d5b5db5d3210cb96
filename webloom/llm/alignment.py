"""Cross-tokenizer alignment: which tokens of one tokenizer end where tokens of another one do.

Texts are encoded by both tokenizers; byte offsets at which tokens of both end cut them into groups, and link the two
tokens. Links are counted in dense matrices, one for each stripe of the second tokenizer's ids: tasks send each stripe
their distinct pairs with counts, np.add.at sums them into its block, row maxima give the best partners, and the
same stripes answer the tasks' pairs, which meet the documents they came from.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import packed, token_counts
from webloom.llm.bpe import byte_letters
from webloom.llm.common import Stored, kept, pick, release, stretches

#: Cells of a stripe's matrix, about.
CELLS = 1 << 22
#: Bytes of text that are encoded together: one chunk, whose distinct pairs are counted and answered as one.
CHUNK = 4 << 20
#: Chunks whose pairs of one stripe go to one task.
SALTED = 20_000
#: Packed bytes of a task's pairs, about.
PART = 8 << 20


class Pair:
    """Both tokenizers, and what they make of the stretches that a worker has met."""

    #: Stretches that are kept; beyond it the store starts anew, so that memory stays bounded.
    KEEP = 400_000

    def __init__(self, definition: str, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = token_counts.loaded_plain(definition), SentencePieceProcessor(model_proto=model)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        # what no piece crosses: a blank behind another sign, and a line end
        self.parts = token_counts.safe(definition) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.b.encode("a\nb  c") == [*self.b.encode("a"), *self.b.encode("\nb")[1:], *self.b.encode(" c")]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.size = len(self.a_bytes)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.groups: list[str] = []
        #: By stretch: tokens of both, groups; -1 tokens where the bytes aren't those of the text. And the ends of its links in ``codes``.
        self.n_a, self.n_b, self.ends, self.codes = array("i"), array("i"), array("q", [0]), array("q")

    def split(self, text: str) -> list[str]:
        """Stretches of a blank and the text, which both tokenizers encode each by itself."""
        if not text:
            return []
        return token_counts.stretches(" " + text, False) if self.parts else [" " + text]

    def learn(self, new: list[str]) -> None:
        raw = [s.encode("utf-8", "surrogatepass") for s in new]
        a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1)
        for i, s in enumerate(new):
            if s[0] != " ":  # the blank that every input gets in front; nothing merges with it here
                b[i] = b[i][1:] if b[i][:1] == [self.blank] else [0]
            if b"".join([self.a_bytes[t] for t in a[i]]) != raw[i] or b"".join([self.b_bytes[t] for t in b[i]]) != raw[i]:
                a[i] = b[i] = []
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        code = flat_b[at_b] * self.size + flat_a[at_a]
        told_a, told_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        told = [f"{','.join(told_a[i:j])}|{','.join(told_b[k:m])}" for i, j, k, m in zip([0, *(at_a[:-1] + 1).tolist()], (at_a + 1).tolist(), [0, *(at_b[:-1] + 1).tolist()], (at_b + 1).tolist())]
        cuts = np.searchsorted(at_a, np.cumsum([0, *map(len, a)])).tolist()
        base = len(self.codes)
        self.codes.frombytes(code.tobytes())
        for i, s in enumerate(new):
            self.seen[s] = len(self.groups)
            self.groups.append(";".join(told[cuts[i] : cuts[i + 1]]))
            self.n_a.append(len(a[i]) or -1)
            self.n_b.append(len(b[i]) or -1)
            self.ends.append(base + cuts[i + 1])

    def chunk(self, texts: list[str]) -> dict[str, object]:
        """Of each text n_a, n_b, n_groups, n_links, digest; then the distinct pairs with their counts, and the pairs of each text."""
        if len(self.seen) > self.KEEP:
            self.clear()
        parts = [self.split(t) for t in texts]
        new = list(dict.fromkeys(p for ps in parts for p in ps if p not in self.seen))
        for a in range(0, len(new), 20_000):
            self.learn(new[a : a + 20_000])
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(parts)), np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        del parts
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        n_a, n_b, ends = (np.array(x) for x in (self.n_a, self.n_b, self.ends))
        links = np.diff(ends)
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[cuts]) for x in (n_a, n_b, links, n_a < 0)]
        good = (sums[3] == 0) & (lengths > 0)
        words, get = at.tolist(), self.groups.__getitem__
        digests = [hashlib.sha256(";".join(map(get, words[i:j])).encode()).hexdigest() if g else "" for g, i, j in zip(good.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]
        text = np.repeat(np.arange(len(texts)), lengths)
        own = good[text]
        at, text = at[own], text[own]
        many = links[at]
        place = np.repeat(ends[at] + many - np.cumsum(many), many) + np.arange(many.sum())
        code, index, count = np.unique(np.frombuffer(self.codes, np.int64)[place] if len(place) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        key, times = np.unique(np.repeat(text, many) * max(len(code), 1) + index, return_counts=True)
        told = [np.where(good, x, 0).tolist() for x in (sums[0], sums[1], sums[2], sums[2])]
        return dict(zip(("n_a", "n_b", "n_groups", "n_links"), told)) | {"digest": digests, "code": code, "count": count, "key": key, "times": times}


@lru_cache(maxsize=1)
def loaded(definition: str, model: bytes) -> Pair:
    return Pair(definition, model)


kept.append(loaded.cache_clear)

CHUNKED = "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digest array<string>, code binary, count binary, key binary, times binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def encoded(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    """Chunks of documents, each with the digests of its texts and their packed pairs."""
    source = docs.sparkSession.sparkContext.broadcast((definition, model))
    lists = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in stretches(batches, "n_bytes", CHUNK):
            made = loaded(*source.value).chunk(batch.column("text").to_pylist())
            columns = [pa.array([number], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), *[pa.array([made[c]], pa.list_(pa.int64())) for c in lists], pa.array([made["digest"]], pa.list_(pa.string()))]
            columns += [pa.array([packed.pack(made[c])], pa.binary()) for c in ("code", "count", "key", "times")]
            yield pa.record_batch(columns, names=[x.split()[0] for x in CHUNKED.split(", ")])
            number += 1

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).mapInArrow(run, CHUNKED)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; what a batch holds packed is taken out a row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def dealt(df: DataFrame, parts: int, *order: str) -> DataFrame:
    return packed.dealt(df, parts).sortWithinPartitions(*order)


def block_counts(pairs: DataFrame, key: str, parts: int, cells: int, stripes: int) -> DataFrame:
    """(key, code, count): packed pairs of each value of ``key``, summed in a dense block. ``key`` mod ``stripes`` is the stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, np.zeros(cells, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            if now is not None:
                at = np.flatnonzero(block)
                columns = [pa.array([now], pa.int32()), pa.array([packed.pack(at + (now % stripes) * cells)], pa.binary()), pa.array([packed.pack(block[at])], pa.binary())]
                yield pa.record_batch(columns, names=[key, "code", "count"])
                block[at] = 0

        for row in each(batches):
            if row[key] != now:
                yield from out()
                now = row[key]
            np.add.at(block, packed.unpack(row["code"], np.int64) - (now % stripes) * cells, packed.unpack(row["count"], np.int64))
        yield from out()

    return dealt(pairs.select("part", key, "code", "count"), parts, key).mapInArrow(run, f"{key} int, code binary, count binary")


def pair_counts(chunks: DataFrame, width: int, stripes: int, salts: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of all chunks by slot (part, slot, chunk, code, count), and the counts of all pairs by stripe (stripe, code, count)."""

    def by_stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            code, count = (packed.unpack(row[c], np.int64) for c in ("code", "count"))
            salt = ((row["chunk"] >> 33) + (row["chunk"] & ((1 << 33) - 1))) % salts
            for batch in packed.by_part(code // width, {"code": code, "count": count}):
                slot = salt * stripes + batch.column("part").to_numpy().astype(np.int64)
                columns = [pa.array((slot * parts // (salts * stripes)).astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(np.full(len(slot), row["chunk"])), *batch.columns[1:]]
                yield pa.record_batch(columns, names=["part", "slot", "chunk", "code", "count"])

    pairs = chunks.select("chunk", "code", "count").mapInArrow(by_stripe, "part int, slot int, chunk bigint, code binary, count binary")
    salted = block_counts(pairs, "slot", parts, width, stripes)
    if salts == 1:
        return pairs, salted.withColumnRenamed("slot", "stripe")
    again = salted.withColumn("stripe", F.col("slot") % stripes)
    few = min(parts, stripes)
    return pairs, block_counts(again.withColumn("part", F.expr(f"stripe * {few} div {stripes}").cast("int")), "stripe", few, width, stripes)


def best_pairs(counts: DataFrame, side: int) -> DataFrame:
    """Of packed counts (stripe, code, count) the pairs that are their second id's most frequent: a, b, n. ``side``: ids of the first tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            code, n = (packed.unpack(row[c], np.int64) for c in ("code", "count"))
            own, at = np.unique(code // side, return_inverse=True)
            top = np.zeros(len(own), np.int64)
            np.maximum.at(top, at, n)
            good = n == top[at]
            yield pa.record_batch([pa.array(x) for x in (code[good] % side, code[good] // side, n[good])], names=["a", "b", "n"])

    return counts.select("code", "count").mapInArrow(run, "a bigint, b bigint, n bigint")


class Alignment:
    """The alignment of a table's texts: ``documents`` (digests and scores), ``best`` (the best partners of each id).

    definition: a ``tokenizers`` JSON file of a byte-level BPE; model: a sentencepiece file with byte fallback; both are
    read by the driver and go to the executors with the functions, whatever the data (a few MB).

    Where no token can cross the boundary between two words (``Pair.parts``, told by both vocabularies), equal stretches
    are encoded once; else whole texts are. Nothing that is shuffled is larger than a chunk's distinct pairs: the pairs
    of a hot id are one entry a chunk. Chunks and counts are written on the way, so that a lost executor costs its tasks.
    """

    def __init__(self, docs: DataFrame, definition_path: str, model_path: str, cells: int = CELLS, salted: int = SALTED):
        definition, model = Path(definition_path).read_text(encoding="utf-8"), Path(model_path).read_bytes()
        both = Pair(definition, model)
        self.side = both.size
        rows = max(1, cells // self.side)
        width, stripes = rows * self.side, math.ceil(len(both.b_bytes) / rows)
        self.chunks = Stored(encoded(docs, definition, model)).df
        many, size, tasks = self.chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("code") + F.octet_length("count")), F.lit(0)), F.coalesce(F.max(F.expr("shiftright(chunk, 33)")), F.lit(0))).first()
        cores = docs.sparkSession.sparkContext.defaultParallelism
        salts = max(1, math.ceil(many / salted))
        parts = min(stripes * salts, max(2 * cores, math.ceil(size / PART)))
        self.width, self.stripes, self.salts, self.parts, self.tasks = width, stripes, salts, parts, int(tasks) + 1
        self.pairs, counts = pair_counts(self.chunks, width, stripes, salts, parts)
        self.counts = Stored(counts).df

    def best(self) -> DataFrame:
        return best_pairs(self.counts, self.side)

    def documents(self) -> DataFrame:
        """One row for each row of the table: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        width, stripes, salts, parts, side = self.width, self.stripes, self.salts, self.parts, self.side

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, best, now, at = np.zeros(width, np.int64), np.zeros(0, np.int64), None, np.zeros(0, np.int64)
            for row in each(batches):
                code = packed.unpack(row["code"], np.int64) - (row["slot"] % stripes) * width
                if row["chunk"] is None:
                    block[at] = 0
                    now, at = row["slot"], code
                    block[at] = packed.unpack(row["count"], np.int64)
                    best = block.reshape(-1, side).max(1)
                elif row["slot"] != now:
                    raise ValueError("pairs without their counts")
                else:
                    n = block[code]
                    columns = [pa.array([row["chunk"]], pa.int64()), pa.array([now % stripes], pa.int32()), *[pa.array([packed.pack(x)], pa.binary()) for x in (n, (n == best[code // side]).astype(np.int8))]]
                    yield pa.record_batch(columns, names=["chunk", "stripe", "n", "best"])

        slot = (F.col("salt") * stripes + F.col("stripe")).cast("int")
        counts = self.counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("slot", slot)
        counts = counts.select(F.expr(f"cast(slot * bigint({parts}) div {salts * stripes} as int)").alias("part"), "slot", F.lit(None).cast("bigint").alias("chunk"), "code", "count")
        answers = dealt(counts.union(self.pairs), parts, "slot", "chunk").mapInArrow(answer, "chunk bigint, stripe int, n binary, best binary")  # nulls come first

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told: list[tuple[np.ndarray, np.ndarray]] = []
            doc: dict = {}

            def out() -> Iterator[pa.RecordBatch]:
                if doc:
                    n, best = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.int64),) * 2
                    key, times = (packed.unpack(doc[c], np.int64) for c in ("key", "times"))
                    text, index = np.divmod(key, max(len(n), 1))
                    cuts = np.searchsorted(text, np.arange(len(doc["doc_id"]) + 1))
                    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[cuts]) for x in (best[index] * times, n[index] * times)]
                    columns = [pa.array(doc[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [*map(pa.array, sums), pa.array(doc["digest"], pa.string())]
                    yield pa.record_batch(columns, names=[x.split()[0] for x in RESULT.split(", ")])

            release()
            for row in each(batches):
                if row["stripe"] is None:
                    yield from out()
                    doc = row
                    told.clear()
                elif row["chunk"] != doc["chunk"]:
                    raise ValueError("answers without their chunk")
                else:
                    told.append((packed.unpack(row["n"], np.int64), packed.unpack(row["best"], np.int8).astype(np.int64)))
            yield from out()

        lists = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "key", "times"]
        none = F.lit(None)
        left = self.chunks.select("chunk", none.cast("int").alias("stripe"), *lists, none.cast("binary").alias("n"), none.cast("binary").alias("best"))
        right = answers.select("chunk", "stripe", *[none.cast(left.schema[c].dataType).alias(c) for c in lists], "n", "best")
        both = left.union(right).withColumn("part", F.expr(f"cast(shiftright(chunk, 33) % {self.tasks} as int)"))
        return dealt(both, self.tasks, "chunk", "stripe").mapInArrow(score, RESULT)


def align(docs: DataFrame, definition_path: str, model_path: str, **options) -> DataFrame:
    """Digests and scores of all whole texts; see ``Alignment``.

    n_links counts the pairs of tokens that end together, one for each group, as every token has a byte at least. A pair
    of ids counts as often as links hold it in the table; n_best are a text's links whose count is the highest of their
    second id's, ties included, count_sum the sum of their counts. Texts that are null, empty, or not given again by the
    bytes of both tokenizers' tokens have zeros and an empty digest. Null ids and repeated rows stay; very long texts are
    encoded whole; an empty table gives no rows; other columns are ignored.
    """
    return Alignment(docs, definition_path, model_path, **options).documents()
