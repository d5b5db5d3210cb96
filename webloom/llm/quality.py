"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every word has a sparse random index vector, drawn from its hash. Its context vector is the sum of the index vectors of
its neighbours in the sample. A document is the mean of both over its words; a network of one hidden layer gives a
logit, which a temperature fitted on rows set aside for that alone turns into a calibrated probability.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from webloom.llm.common import Stored, apart, chunks, pick, release

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Neighbours to either side that make a context.
NEAR = 2


#: What stands for a word that repeats the one before it.
AGAIN = "again 0"


def told(text: str) -> list[str]:
    """The words of a text, repetitions marked."""
    words = TOKEN.findall(text)
    return [AGAIN if a == b else b for a, b in zip([None, *words], words)]


def shape(token: str) -> str:
    """What stands for a word that the vocabulary lacks: its kind of letters and its length. Holds a space, unlike words."""
    kind = "digits" if token[0].isdigit() else "signs" if not token[0].isalpha() else "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower" if token.islower() else "mixed"
    return f"{kind} {min(len(token), 20) // 4}"


def index_vector(word: str, dim: int, ones: int) -> np.ndarray:
    """Sparse ternary vector of a word: ``ones`` places of 1 or -1, from its hash alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11))
    v = np.zeros(dim, np.float32)
    v[rng.choice(dim, ones, replace=False)] = rng.choice([-1.0, 1.0], ones)
    return v


@dataclass
class Model:
    number: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def ids(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([n if (n := get(t)) is not None else get(shape(t), 0) for t in told(text)], np.int64)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean vector of each text; zero for a text without a word."""
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for n, text in enumerate(texts):
            ids = self.ids(text)
            total = sum((self.vectors[ids[a : a + 65536]].sum(0, dtype=np.float64) for a in range(0, len(ids), 65536)), np.zeros(out.shape[1]))
            out[n] = total / max(len(ids), 1)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh((pooled - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logits(self.pooled(texts)) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ranges(texts: list[str], number: dict[str, int], most: int = 200_000) -> Iterator[np.ndarray]:
    """Numbers of the words of some texts, with -1 between texts, in parts of about ``most``."""
    ids = array("q")
    for text in texts:
        ids.extend(n if (n := number.get(t)) is not None else number[shape(t)] for t in told(text))
        ids.extend([-1] * NEAR)
        if len(ids) > most:
            yield np.array(ids)
            ids = array("q")
    yield np.array(ids, np.int64)


def _add(total: np.ndarray, words: np.ndarray, index: np.ndarray, near: np.ndarray) -> None:
    """Adds the index vector of each neighbour to its word's row."""
    real = (words >= 0) & (near >= 0)
    words, near = words[real], near[real]
    if len(words):
        order = np.argsort(words, kind="stable")
        words, near = words[order], near[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(words)) + 1])
        for a in range(0, len(starts), 8192):  # bounded rows at a time
            part = starts[a : a + 8192]
            end = starts[a + 8192] if a + 8192 < len(starts) else len(words)
            total[words[part]] += np.add.reduceat(index[near[part[0] : end]], part - part[0], axis=0)


def word_vectors(texts: list[str], dim: int, ones: int, most_words: int) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary (the ``most_words`` most frequent words that occur twice, then shapes) and its vectors: context, then index."""
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update(told(text))
    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most_words] if n > 1]
    shapes = sorted({f"{k} {n}" for k in ("digits", "signs", "upper", "title", "lower", "mixed") for n in range(6)})
    number = {w: i for i, w in enumerate(dict.fromkeys([*shapes, AGAIN, *words]))}
    index = np.array([index_vector(w, dim, ones) for w in number])
    context = np.zeros_like(index)
    del counts
    for ids in ranges(texts, number):
        for step in range(1, NEAR + 1):
            _add(context, ids[:-step], index, ids[step:])
            _add(context, ids[step:], index, ids[:-step])
    context /= np.maximum(np.sqrt((context**2).sum(1, keepdims=True)), 1e-9)
    index /= np.sqrt(ones)
    return number, np.hstack([context, index]).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, dim: int = 48, ones: int = 4, most_words: int = 30_000, hidden: int = 32, epochs: int = 60, seed: int = 3) -> Model:
    """Fits the model; texts without labels of both kinds give a constant score, the share of label 1."""
    number, vectors = word_vectors(texts, dim, ones, most_words)
    d = vectors.shape[1]
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = Model(number, vectors, np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))), 1.0)
    if len(set(labels.tolist())) < 2:
        return model
    x, y = model.pooled(texts), labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, warm, used = np.split(order, [len(y) // 6, len(y) // 3])  # to choose the epoch by, to fit the temperature on, to learn from
    model.mean, model.spread = x[used].mean(0), x[used].std(0) + 1e-4
    x = (x - model.mean) / model.spread
    w = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.array(model.b2)]
    first, second, best, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], (np.inf, w), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            t += 1
            h = np.tanh(x[part] @ w[0] + w[1])
            gap = (sigmoid(h @ w[2] + w[3]) - y[part]) / len(part)
            back = np.outer(gap, w[2]) * (1 - h * h)
            grads = [x[part].T @ back + 1e-4 * w[0], back.sum(0), h.T @ gap + 1e-4 * w[2], gap.sum()]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        z = np.tanh(x[aside] @ w[0] + w[1]) @ w[2] + w[3]
        loss = log_loss(z, y[aside])
        if loss < best[0]:
            best = loss, [p.copy() for p in w]
    model.w1, model.b1, model.w2, model.b2 = best[1][0], best[1][1], best[1][2], float(best[1][3])
    z = np.tanh(x[warm] @ model.w1 + model.b1) @ model.w2 + model.b2
    positive = y[warm].sum()
    # Platt's targets: as if one more row of each kind had been seen on either side, so that no certainty comes of few rows
    goal = np.where(y[warm] > 0, (positive + 1) / (positive + 2), 1 / (len(warm) - positive + 2))
    model.temperature = float(min(np.geomspace(1 / 8, 8, 121), key=lambda v: log_loss(z / v, goal)))
    return model


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int, seen: Column) -> DataFrame:
    """Up to ``rows`` labelled texts of up to ``most_bytes`` bytes, those whose ids have the smallest hashes among ``seen`` ones.

    A label whose document isn't there, or is longer, takes no place as long as no more than half of the labels are of that
    kind: so many ids are looked for. Of texts that share an id the smallest counts.
    """
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(seen)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.orderBy(*order).limit(2 * rows)
    texts = pick(docs, "doc_id", "text").where(F.octet_length("text") <= most_bytes)
    found = Stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))).df
    # no task sorts texts: which ones are taken is settled by the ids
    return found.join(F.broadcast(found.select("doc_id").orderBy(*order).limit(rows)), "doc_id")


def fit(labelled: DataFrame, most_words: int) -> Model:
    """The model of a bounded sample (doc_id, text, quality), in a process of its own, to which its partitions go one by one."""
    rows = labelled.select("doc_id", "text", "quality").toLocalIterator()
    return apart(train_rows, rows=map(tuple, rows), most_words=most_words)


def train_rows(rows: list[tuple[int, str, int]], **options) -> Model:
    """``train`` on (doc_id, text, label), in the order of the ids, so that it doesn't matter how they came."""
    rows.sort()
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), **options)


def held_out(doc_id: str = "doc_id", parts: int = 5):
    """Column: true for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 6000, sample_bytes: int = 65_536, most_words: int = 30_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score, predicted (score >= ``threshold``).

    The fit, word vectors included, uses a bounded sample: at most ``sample_rows`` labelled texts that aren't held out,
    of at most ``sample_bytes`` bytes each. Scoring covers every row and every text whole, and sees nothing but the
    text. A null or empty text is scored as a document without words. Repeated and contradictory labels of a document
    count as their majority (ties: 1). With no usable labels all scores are equal. Repeated rows and null ids stay;
    an empty table gives no rows; of other columns those named in ``carry`` go along. ``most_words`` bounds the vocabulary,
    the most frequent words of the sample, and with it the model that is sent to the tasks; other words count by their shape.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, sample_rows, sample_bytes, ~held_out()), most_words))

    rows = pick(docs, "doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    kinds = rows.schema
    rows = rows.select(*rows.columns, F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes_"), held_out().alias("held_out_"))
    names = list(dict.fromkeys(["doc_id", *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in chunks(batch.column("n_bytes_").to_pylist(), 1 << 20):
                part = batch.slice(a, b - a)
                score = model.value.score([t or "" for t in part.column("text").to_pylist()])
                made = [part.column("held_out_"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.record_batch([*map(part.column, names), *made], names=[*names, "held_out", "score", "predicted"])

    schema = StructType([kinds[c] for c in names] + [StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
