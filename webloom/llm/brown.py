"""LM scoring by Brown's class-based n-grams.

Exchange clustering gives every word a class. The FREQUENT most frequent words and the endings of all others are
clustered first, by exchanges whose every move is seen by the next. Then every other word seen ``own`` times or more goes
to the class that suits its own contexts, in rounds over tables that stay distributed. Only rarer words, unseen ones and
those beyond ``vocabulary`` keep the class of their ending. A word's probability is that of its class after the last
word's class, times its share of its class; unseen words get the share of a class that its words seen once have, as if
there were as many unseen ones as seen ones. This is mixed with the plain add-one unigram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import packed
from webloom.llm.common import Stored, chunks, pick

#: The token at the end of each text, also what stands before its first. No word holds a space.
END = b" "
#: Words that are exchanged one by one, endings that pool the others meanwhile, and bytes of an ending.
FREQUENT, ENDINGS, ENDING = 2048, 512, 3
#: Words whose counts and classes go to all tasks, the most frequent ones: 19 bytes each.
VOCABULARY = 2_000_000
#: Bytes of text handled at once.
HELD = 1 << 20
#: Elements that a task sums up before it passes them on, and words that it remembers.
SUMMED, REMEMBERED = 4_000_000, 300_000
#: Tokens of a part, which a task holds at once, and partitions of a shuffle at most: beyond, parts take turns in one.
PART_TOKENS, PARTITIONS = 1 << 20, 20_000


def ending_of(word: bytes, length: int, endings: int) -> int:
    """Number of a word's ending; the same as in ``ending_column``."""
    h = xxhash.xxh64_intdigest(word[-length:] if length else b"", 42)
    return (h - (1 << 64) if h >> 63 else h) % endings


def ending_column(word: str, length: int, endings: int):
    return F.pmod(F.xxhash64(F.expr(f"substring({word}, -{length}, {length})")), F.lit(endings))


@dataclass
class Parts:
    """How many parts there are, and in how many partitions they take turns."""

    tokens: int
    part_tokens: int = PART_TOKENS
    partitions: int = PARTITIONS

    @property
    def parts(self) -> int:
        return int(max(16, -(-self.tokens // self.part_tokens)))

    @property
    def spread(self) -> int:
        return min(self.parts, self.partitions)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both know only ASCII


def count_words(rows: DataFrame) -> DataFrame:
    """(word binary, n, m): how often each token stands in the texts that aren't held out, and in all; ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for held, counter in enumerate(found):
                n = pa.array(list(counter.values()), pa.int64())
                yield pa.record_batch([pa.array(list(counter), pa.binary()), pa.array([0] * len(n), pa.int64()) if held else n, n], names=["word", "n", "m"])
                counter.clear()

        for batch in batches:
            for a, b in chunks(batch.column("n_bytes").to_pylist(), HELD):
                for text, held in zip(batch.column("text").slice(a, b - a).to_pylist(), batch.column("held_out").slice(a, b - a).to_pylist()):
                    found[held].update(words(text))
                    found[held][END] += 1
                if sum(map(len, found)) > 150_000:
                    yield from out()
        yield from out()

    return rows.select("text", "n_bytes", "held_out").mapInArrow(run, "word binary, n bigint, m bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def count_bin(n):
    """A count's bin: itself below 1,024, then 1,024 bins for each doubling; so there are some ten thousands at most."""
    return F.when(n < 1024, n).otherwise(F.floor(F.log2(n) * 1024) - 10 * 1024 + 1024).cast("bigint")


def least_bin(counts: DataFrame, column: str, most: int) -> tuple[int, int]:
    """The smallest bin from which on all words together are ``most`` at most, and the next one that has a word."""
    bins = sorted(map(tuple, counts.where(F.col(column) > 0).groupBy(count_bin(F.col(column)).alias("bin")).count().collect()), reverse=True)
    least = bins[0][0] + 1 if bins else 1
    for bin_, n in bins:
        if (most := most - n) < 0:
            return least, bin_
        least = bin_
    return least, least


@dataclass
class Units:
    """Numbers of the units: the most frequent words, then the endings, then the other words of the vocabulary.

    The last ones are found by their 64-bit hashes (sorted, unsigned), so a task holds 8 bytes for each and no text.
    """

    frequent: list[bytes]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    endings: int = ENDINGS
    ending: int = ENDING
    seen: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.seen = {w: i for i, w in enumerate(self.frequent)}

    def __len__(self) -> int:
        return self.base + len(self.hashes)

    @property
    def base(self) -> int:
        """Number of the first unit that is found by its hash."""
        return len(self.frequent) + self.endings

    def of(self, ws: list[bytes]) -> np.ndarray:
        get = self.seen.get
        found = np.array([get(w, -1) for w in ws], np.int64)
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list({ws[i] for i in missing})
            unit = np.array([len(self.frequent) + ending_of(w, self.ending, self.endings) for w in new], np.int64)
            if len(self.hashes):
                h = np.array([xxhash.xxh64_intdigest(w, 42) for w in new], np.uint64)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                own = self.hashes[at] == h
                unit[own] = self.base + at[own]
            if len(self.seen) + len(new) > max(REMEMBERED, len(self.frequent) + len(new)):
                self.__post_init__()
            self.seen.update(zip(new, unit.tolist()))
            get = self.seen.get
            found[missing] = [get(ws[i], -1) for i in missing]
        return found


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    return float(plogp(m).sum() - plogp(m.sum(0)).sum() - plogp(m.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int, rounds: int, fixed: int = 0) -> np.ndarray:
    """Class of each unit by exchanges; ``pairs[a, b]``: how often unit b stands after unit a. ``fixed`` has class 0 to itself.

    Each unit in turn, most frequent first, goes to the class where the likelihood of the class bigrams is highest. A
    move is seen by all that follow: the likelihood never falls. Ends when a round moves nothing, or after ``rounds``.
    """
    size = len(pairs)
    order = [u for u in np.argsort(-pairs.sum(0), kind="stable").tolist() if u != fixed]
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size - 1) % (classes - 1) + 1
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    after, before = pairs.T @ member, pairs @ member  # of each unit: by the class that stands before it, and after it
    m = member.T @ before
    for _ in range(rounds):
        moved = 0
        for u in order:
            own, twice = of[u], pairs[u, u]
            left, right = after[u].copy(), before[u].copy()
            if not left.any():
                continue
            # without u; its pairs with itself are in left and in right, and come back with whatever class it gets
            left[own] -= twice
            right[own] -= twice
            m[:, own] -= left
            m[own] -= right
            m[own, own] -= twice
            logs, diagonal = plogp(m), np.diagonal(m)
            gain = (plogp(m + left[:, None]) - logs).sum(0) + (plogp(m + right[None, :]) - logs).sum(1)
            gain += plogp(diagonal + left + right + twice) - plogp(diagonal + left) - plogp(diagonal + right) + plogp(diagonal)
            column, row = m.sum(0) + right, m.sum(1) + left  # u stands before and after its neighbours, whatever its class
            gain -= plogp(column + left.sum() + twice) - plogp(column) + plogp(row + right.sum() + twice) - plogp(row)
            gain[of[fixed]] = -np.inf
            best = int(np.argmax(gain))
            m[:, best] += left
            m[best] += right
            m[best, best] += twice
            if best != own:
                moved += 1
                of[u] = best
                after[:, own] -= pairs[u]
                after[:, best] += pairs[u]
                before[:, own] -= pairs[:, u]
                before[:, best] += pairs[:, u]
        if not moved:
            break
    return of


def class_table(code: np.ndarray, n: np.ndarray, of: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Class transitions of unit pairs, coded a * size + b."""
    at = of[code // size].astype(np.int64) * classes + of[code % size]
    return np.bincount(at, weights=n, minlength=classes * classes).reshape(classes, classes)


def part_of_code(code: np.ndarray, kind: int, size: int, parts: int) -> np.ndarray:
    """The part of a pair, or of the context of a unit: those of a unit are in one part."""
    return (code // (2 * size) if kind == 2 else code) % parts


def count_pairs(rows: DataFrame, units, fold, deal: Parts) -> DataFrame:
    """What stands beside what, packed: (part, kind, code, n), each code in one part (mod ``deal.spread``), several times as yet.

    Kinds 0 and 1 are pairs of the units that are exchanged, a * base + b, others by ``fold`` (the endings of the units
    beyond base): 0 where both words are exchanged or endings, 1 where one is neither. Kind 2 are the contexts of the
    units beyond base: unit, neighbour and its side, 2 * (unit * size + neighbour) + (1 if it follows). ``units`` and
    ``fold`` are broadcasts.
    """

    parts, spread = deal.parts, deal.spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units.value
        base, size = known.base, len(known)
        whole = np.concatenate([np.arange(base), fold.value])
        cells = np.zeros(2 * base * base, np.int32)
        held: list[np.ndarray] = []

        def sides() -> Iterator[pa.RecordBatch]:
            if held:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield from packed.by_part(part_of_code(code, 2, size, parts) % spread, {"code": code, "n": n}, kind=2)

        for batch in batches:
            for a, b in chunks(batch.column("n_bytes").to_pylist(), HELD):
                ws = [END]
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    ws += words(text)
                    ws.append(END)
                u = known.of(ws)
                left, right, f = u[:-1], u[1:], whole[u]
                own = (left >= base) | (right >= base)
                np.add.at(cells, own * (base * base) + f[:-1] * base + f[1:], 1)
                i, j = np.flatnonzero(left >= base), np.flatnonzero(right >= base)
                held.append(np.concatenate([2 * ((left[i] - base) * size + right[i]) + 1, 2 * ((right[j] - base) * size + left[j])]))
                if sum(map(len, held)) > SUMMED:
                    yield from sides()
        yield from sides()
        for kind in (0, 1):
            own = cells[kind * base * base : (kind + 1) * base * base]
            code = np.flatnonzero(own)
            yield from packed.by_part(part_of_code(code, kind, size, parts) % spread, {"code": code, "n": own[code].astype(np.int64)}, kind=kind)

    return rows.select("text", "n_bytes").mapInArrow(run, "part int, kind int, code binary, n binary")


def summed_pairs(pairs: DataFrame, size: int, deal: Parts) -> DataFrame:
    """The same with each code once: a row for each part and kind. ``size`` is the number of units.

    Counts are summed whenever SUMMED of them have come in, so a unit's contexts take the room of the distinct ones.
    """
    parts, kinds = deal.parts, {"code": np.int64, "n": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in packed.turns(batches):
            for kind in range(3):
                code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for got in packed.pieces(part, kinds, SUMMED, {"kind": kind}):
                    code, n = packed.summed(np.concatenate([code, got["code"]]), np.concatenate([n, got["n"]]))
                if len(code):
                    yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([packed.pack(code)], pa.binary()), pa.array([packed.pack(n)], pa.binary())], names=["kind", "code", "n"])

    dealt = packed.in_turns(pairs, kinds, ("kind",), lambda x, kind: part_of_code(x["code"], kind, size, parts), parts, deal.spread, SUMMED)
    return dealt.mapInArrow(run, "kind int, code binary, n binary")


def collected(pairs: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of kind 0 or 1 on the driver: base ** 2 of them at most."""
    got = packed.gathered(pairs.where(F.col("kind") == kind).toArrow().to_batches(), {"code": np.int64, "n": np.int64})
    return got["code"], got["n"]


def place(contexts: DataFrame, base: int, of: np.ndarray, free: np.ndarray, fixed: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with the units from ``base`` on placed by their own contexts, and the table of class transitions.

    ``contexts`` are those of ``count_pairs``, ``of`` the classes to begin with, which those of ``free`` (from ``base`` on)
    may leave, ``fixed`` the class transitions among the units before ``base``. Each round gives every word the class that suits it best to first order in its own counts, with
    the table and the neighbours' classes of the round's start; a task sees the contexts of its words, whole. What comes
    to the driver is a class for each word and a table of classes. The best round counts.
    """
    spark, size = contexts.sparkSession, len(of)

    def per_word(kind: np.ndarray, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        code, n = (packed.unpack(batch.column(c)[i].as_py(), np.int64) for c in ("code", "n"))
        unit, rest = code // (2 * size), code % (2 * size)
        return unit, rest % 2, rest // 2, n

    def table(shared) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, m = shared.value.astype(np.int64), np.zeros(classes * classes)
            for batch in batches:
                for i in range(batch.num_rows):
                    unit, follows, other, n = per_word(kind, batch, i)
                    unit = kind[unit + base]
                    once = (follows == 0) | (other < base)  # pairs of two such words are in both contexts
                    at = np.where(follows == 1, unit * classes + kind[other], kind[other] * classes + unit)[once]
                    m += np.bincount(at, weights=n[once], minlength=len(m))
            at = np.flatnonzero(m)
            yield pa.record_batch([pa.array(at), pa.array(m[at].astype(np.int64))], names=["at", "n"])

        got = contexts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        m = np.zeros(classes * classes)
        m[got.column("at").to_numpy()] = got.column("n").to_numpy()
        return fixed + m.reshape(classes, classes)

    shared = spark.sparkContext.broadcast(of.astype(np.int16))
    m = table(shared)
    best = likelihood(m), of, m
    for _ in range(rounds):
        column, row = m.sum(0), m.sum(1)
        smooth = m + np.outer(row, column) / max(m.sum(), 1) / 10 + 1e-9
        # log probabilities of a neighbour's class on the left and on the right, by the class of the word
        fits = np.concatenate([np.log(smooth) - np.log(column + 1e-6), np.log(smooth.T) - np.log(row + 1e-6)])
        fits[:, (column == 0) | (np.arange(classes) == of[0])] = -1e9
        now = shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = now.value.astype(np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    unit, follows, other, n = per_word(kind, batch, i)
                    own, at = np.unique(unit, return_inverse=True)
                    to = np.zeros(len(own), np.int64)
                    for a in range(0, len(own), 20_000):  # codes are sorted, so these words' contexts are neighbours
                        c, d = np.searchsorted(at, [a, a + 20_000])
                        many = min(20_000, len(own) - a)
                        seen = np.bincount(((at[c:d] - a) * 2 + follows[c:d]) * classes + kind[other[c:d]], weights=n[c:d], minlength=many * 2 * classes)
                        to[a : a + many] = np.argmax(seen.reshape(many, 2 * classes) @ fits, 1)
                    yield pa.record_batch([pa.array([packed.pack(own)], pa.binary()), pa.array([packed.pack(to)], pa.binary())], names=["unit", "class"])

        got = packed.gathered(contexts.mapInArrow(run, "unit binary, class binary").toArrow().to_batches(), {"unit": np.int64, "class": np.int64})
        of, moved = of.copy(), free[got["unit"]]
        of[base + got["unit"][moved]] = got["class"][moved]
        shared = spark.sparkContext.broadcast(of.astype(np.int16))
        m = table(shared)
        if (value := likelihood(m)) > best[0]:
            best = value, of, m
    return best[1], best[2]


@dataclass
class Model:
    units: Units
    of: np.ndarray
    #: How often a unit's word was learned from; -1 for the endings, whose words' counts are looked up.
    count: np.ndarray
    #: Probability of a class after a class.
    follow: np.ndarray
    #: Shares of a class: of one occurrence of a seen word, and of one unseen word.
    seen: np.ndarray
    unseen: np.ndarray
    total: int
    kinds: int
    weight: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.total + self.kinds + 1)

    def mixed(self, last: np.ndarray, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probability of words of ``c`` occurrences and class ``cls`` after class ``last``."""
        return self.weight * self.follow[last, cls] * np.where(c > 0, self.seen[cls] * c, self.unseen[cls]) + (1 - self.weight) * self.base(c)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text its tokens, and over the words of known count known ones, base and score; for each other word its text, hash and two classes."""
        ws, ends = [], []
        for text in texts:
            ws += words(text)
            ends.append(len(ws))
            ws.append(END)
        unit = self.units.of(ws)
        cls, c = self.of[unit], self.count[unit]
        last = np.concatenate([[0], cls[:-1]])
        told, c = c >= 0, np.maximum(c, 0)
        starts = np.concatenate([[0], np.array(ends[:-1], np.int64) + 1])
        terms = (told & (c > 0), np.where(told, np.log10(self.base(c)), 0.0), np.where(told, np.log10(self.mixed(last, cls, c)), 0.0))
        sums = [np.add.reduceat(v, starts) for v in (terms[0].astype(np.int64), *terms[1:])]
        n = np.diff(np.concatenate([starts, [len(ws)]]))
        rare = np.flatnonzero(~told)
        hashes = np.array([xxhash.xxh64_intdigest(ws[i], 42) for i in rare.tolist()], np.uint64)
        return n, *sums, np.searchsorted(ends, rare), hashes, last[rare] * len(self.seen) + cls[rare]


def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text its tokens, and over the words of known count known ones, base and score; for each other word its text, hash and two classes."""
        ws, ends = [], []
        for text in texts:
            ws += words(text)
            ends.append(len(ws))
            ws.append(END)
        unit = self.units.of(ws)
        cls, c = self.of[unit], self.count[unit]
        last = np.concatenate([[0], cls[:-1]])
        told, c = c >= 0, np.maximum(c, 0)
        starts = np.concatenate([[0], np.array(ends[:-1], np.int64) + 1])
        terms = (told & (c > 0), np.where(told, np.log10(self.base(c)), 0.0), np.where(told, np.log10(self.mixed(last, cls, c)), 0.0))
        sums = [np.add.reduceat(v, starts) for v in (terms[0].astype(np.int64), *terms[1:])]
        n = np.diff(np.concatenate([starts, [len(ws)]]))
        rare = np.flatnonzero(~told)
        hashes = np.array([xxhash.xxh64_intdigest(ws[i], 42) for i in rare.tolist()], np.uint64)
        return n, *sums, np.searchsorted(ends, rare), hashes, last[rare] * len(self.seen) + cls[rare]


def fit(rows: DataFrame, classes: int = 64, rounds: int = 8, placing: int = 2, weight: float = 0.98, strength: float = 5.0, vocabulary: int = VOCABULARY, own: int = 3, frequent: int | None = None, endings: int | None = None, ending: int | None = None, part_tokens: int = PART_TOKENS, partitions: int = PARTITIONS) -> tuple[Model, DataFrame]:
    """The model of the texts of ``rows`` that aren't held_out, and the counts of all their words (word, n, m, listed).

    ``classes`` 127 at most. n is how often a word is learned from, m how often it occurs at all: words that occur ``own``
    times or more, the ``vocabulary`` most frequent ones at most, are listed, which means that their counts and classes go
    to all tasks; so no word that has to be looked up is a hot key, also where it is only in texts held out. A listed word
    has a class by its own contexts if it is learned from ``own`` times or more. m has no other effect on the model.
    ``frequent`` words and ``endings`` endings of ``ending`` bytes are exchanged one by one (FREQUENT, ENDINGS, ENDING if None).
    Tasks hold the pairs of about ``part_tokens`` tokens at once, and a shuffle has ``partitions`` partitions at most, however
    many tokens there are.
    """
    most, endings, ending = (own_ if given is None else given for own_, given in ((FREQUENT, frequent), (ENDINGS, endings), (ENDING, ending)))
    if not 3 <= classes <= 127:
        raise ValueError("classes must be 3 to 127")
    counts = Stored(count_words(rows)).df
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    _, nearly = least_bin(counts, "n", most)
    top = counts.where((F.col("n") > 0) & (count_bin(F.col("n")) >= nearly) & (F.col("word") != F.lit(END))).orderBy(F.desc("n"), "word").limit(most - 1).select("word", "n").collect()
    end = next((r[0] for r in counts.where(F.col("word") == F.lit(END)).select("n").collect()), 0)
    frequent, their = [END, *(bytes(r[0]) for r in top)], [end, *(r[1] for r in top)]
    least, _ = least_bin(counts, "m", vocabulary)
    common = F.col("word").isin(frequent)
    counts = counts.withColumn("listed", common | (F.col("m") >= own) & (count_bin(F.col("m")) >= least))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(hashes := batch.column("hash").to_numpy().view(np.uint64))
            columns = [hashes[order], *(batch.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "ending"))]
            yield pa.record_batch([pa.array([packed.pack(x)], pa.binary()) for x in columns], names=["hash", "n", "ending"])

    got = counts.where(F.col("listed") & ~common).select(F.xxhash64("word").alias("hash"), "n", ending_column("word", ending, endings).alias("ending"))
    got = packed.gathered(got.mapInArrow(listed, "hash binary, n binary, ending binary").toArrow().to_batches(), {"hash": np.uint64, "n": np.int64, "ending": np.int64})
    hashes, at = np.unique(got["hash"], return_index=True)
    units, n = Units(frequent, hashes, endings, ending), got["n"][at]
    fold = len(frequent) + got["ending"][at]
    context, base = rows.sparkSession.sparkContext, units.base
    deal = Parts(int(total), part_tokens, partitions)
    learned = rows.where(~F.col("held_out"))
    raw = count_pairs(learned, context.broadcast(units), context.broadcast(fold.astype(np.int16)), deal)
    pairs = Stored(summed_pairs(raw, len(units), deal))
    plain, other = collected(pairs.df, 0), collected(pairs.df, 1)
    cells = np.zeros(base * base)
    for code, many in (plain, other):
        cells[code] += many
    of = exchange(cells.reshape(base, base), classes, rounds)
    del cells, other
    m = class_table(*plain, of, base, classes)
    of = np.concatenate([of, of[fold]])
    if len(hashes):
        of, m = place(pairs.df.where("kind = 2"), base, of, n >= own, m, classes, placing)
    pairs.drop()
    column, row = m.sum(0), m.sum(1)
    prior = (column + 1) / (column.sum() + classes)
    follow = (m + strength * prior) / (row[:, None] + strength)
    rare = counts.where(~F.col("listed") & (F.col("n") > 0)).groupBy(ending_column("word", ending, endings).alias("unit")).agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1)).collect()
    count = np.concatenate([their, np.full(endings, -1), n]).astype(np.int64)
    types = np.bincount(of, weights=count > 0, minlength=classes)
    single = np.bincount(of, weights=count == 1, minlength=classes)
    for unit, words_, once in rare:
        types[of[len(frequent) + unit]] += words_
        single[of[len(frequent) + unit]] += once
    share = np.clip((single + 0.5) / (column + 1), 1e-4, 0.9)  # Good and Turing's share of what is unseen
    return Model(units, of.astype(np.int8), count, follow, (1 - share) / np.maximum(column, 1), share / (types + 1), int(total), int(kinds), weight), counts


def score(docs: DataFrame, parts: int = 7, aside: int = 2, part_tokens: int = PART_TOKENS, partitions: int = PARTITIONS, **options) -> DataFrame:
    """Scores of all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from all rows whose crc32(doc_id as text) mod ``parts`` isn't ``aside``, rows with a null id too.
    A null text counts as empty: its one token is the end. Scores are log10 probabilities; perplexity is per token.
    Without a row to learn from every count is 0. One row for each row of ``docs``; repeated rows stay and count each
    time; very long texts are read whole; an empty table gives no rows; other columns are ignored. ``options`` are those
    of ``fit``.

    Counts of the listed words go to all tasks; occurrences of the others meet their exact counts by hash, packed, and
    their terms go back to their texts; so no vocabulary has to fit into a task.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == aside, F.lit(False))
    rows = rows.withColumns({"n_bytes": F.octet_length("text"), "held_out": held})
    model, counts = fit(rows, part_tokens=part_tokens, partitions=partitions, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    looked_up = counts.where(~F.col("listed")).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    deal = Parts(int(looked_up), part_tokens, partitions)
    many, spread = deal.parts, deal.spread
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, part int, side int, hash binary, x binary, y binary"
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("part", pa.int32()), ("side", pa.int32()), ("hash", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])

    kind = {"hash": np.uint64, "x": np.int64, "y": np.int32}
    sums_of = {"row": np.int64, "b": np.float64, "s": np.float64, "k": np.int64}

    def part_of_hash(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(many)).astype(np.int64)

    def part_of_row(row: np.ndarray) -> np.ndarray:
        """That of the task that read the row's text."""
        return (row >> 33) % many

    def blank(batch: pa.RecordBatch) -> pa.RecordBatch:
        """All columns, those that ``batch`` lacks as nulls."""
        return pa.record_batch([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in kinds], schema=kinds)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                hashes, at, classes = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield from map(blank, packed.by_part(part_of_hash(hashes) % spread, {"hash": hashes, "x": at, "y": classes}, side=1))

        for batch in batches:
            for a, b in chunks(batch.column("n_bytes").to_pylist(), HELD):
                part = batch.slice(a, b - a)
                n, known, base, own, text, hashes, classes = shared.value.score(part.column("text").to_pylist())
                ids = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield blank(pa.record_batch([pa.array(ids), part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), pa.array(base), pa.array(own)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]))
                held.append((hashes, ids[text], classes.astype(np.int32)))
                if sum(len(x[0]) for x in held) > SUMMED:
                    yield from out()
        yield from out()

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            yield from packed.by_part(part_of_hash(hashes) % spread, {"hash": hashes, "x": batch.column("n").to_numpy(), "y": np.zeros(len(hashes), np.int32)}, side=0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in packed.turns(batches):
            counted = packed.gathered(part, kind, {"side": 0})
            order = np.argsort(counted["hash"], kind="stable")
            hashes, n = counted["hash"][order], counted["x"][order]
            for asked in packed.pieces(part, kind, SUMMED, {"side": 1}):
                c = np.zeros(len(asked["hash"]), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, asked["hash"]), len(hashes) - 1)
                    c = np.where(hashes[at] == asked["hash"], n[at], 0)
                last, cls = np.divmod(asked["y"].astype(np.int64), len(own.seen))
                row, sums = summed_rows(asked["x"], np.log10(own.base(c)), np.log10(own.mixed(last, cls, c)), (c > 0).astype(float))
                yield from packed.by_part(part_of_row(row) % spread, {"row": row, "b": sums[0], "s": sums[1], "k": sums[2].astype(np.int64)})

    def summed_rows(rows_: np.ndarray, *terms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        row, at = np.unique(rows_, return_inverse=True)
        return row, [np.bincount(at, weights=v, minlength=len(row)) for v in terms]

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in packed.turns(batches):
            row, sums = np.zeros(0, np.int64), [np.zeros(0)] * 3
            for got in packed.pieces(part, sums_of, SUMMED):
                row, sums = summed_rows(np.concatenate([row, got["row"]]), *[np.concatenate([x, got[c]]) for x, c in zip(sums, "bsk")])
            yield pa.record_batch([pa.array(row), *map(pa.array, sums[:2]), pa.array(sums[2].astype(np.int64))], names=["of", "b", "s", "k"])

    told = Stored(rows.mapInArrow(tell, schema)).df
    side = "part int, side int, hash binary, x binary, y binary"
    known = counts.where(~F.col("listed") & (F.col("n") > 0)).select(F.xxhash64("word").alias("hash"), "n").mapInArrow(table, "part int, side int, hash binary, x binary, y binary")
    asked = told.where("side = 1").select(*[x.split()[0] for x in side.split(", ")])
    both = packed.in_turns(known.union(asked), kind, ("side",), lambda x, side: part_of_hash(x["hash"]), many, spread, SUMMED)
    terms = both.mapInArrow(look_up, "part int, row binary, b binary, s binary, k binary")
    terms = packed.in_turns(terms, sums_of, (), lambda x: part_of_row(x["row"]), many, spread, SUMMED)
    rare = terms.mapInArrow(give_back, "of bigint, b double, s double, k bigint")
    out = told.where("row is not null").join(rare, F.col("row") == F.col("of"), "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    whole = out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))
    return whole.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
