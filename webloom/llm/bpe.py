"""BPE encoding and decoding by a pair occurrence index.

All words of a batch lie in one sequence of symbols. An index maps each pair of neighbours to all its positions; the
ranks that are active wait in a heap and are applied in ascending order, each at all its positions, and the lists of
the pairs to the left and right are brought up to date.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import kept, pick, stretches

#: The word pattern of the vocabulary (contractions, letters, one digit, others), after NFC and lower-casing. White
#: space is listed, since libraries differ on it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d|"
ANY_WORD = regex.compile(SHORT + rf"\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_WORD = re.compile(SHORT + r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


# The normalizer, pre-tokenizer and flags of a definition that ``WordBpe`` reads.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
OFF = ("unk_token", "dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a ``tokenizers`` definition: BPE with an end-of-word suffix, words found by ``ANY_WORD``."""

    #: Words whose ids are kept; beyond it the store starts anew, so that memory stays bounded.
    KEEP = 200_000

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("only BPE with an end-of-word suffix, without decoder and post-processor, is read here")
        if spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != PRE_TOKENIZER:
            raise ValueError("only NFC, single blanks and lower case, and words of letters, one digit or other signs are read here")
        if on := [f for f in OFF if model.get(f)]:
            raise ValueError(f"a model with {on} isn't read here")
        if any(t.get(f) for t in spec.get("added_tokens", []) for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that are found as they stand are read here")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + suffix] for c in letters])
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merge = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.merge], np.int64)
        self.key, self.rank = (lambda order: (keys[order], order))(np.argsort(keys, kind="stable"))
        made = {}
        for r, (_, _, new) in enumerate(self.merge):
            made.setdefault(new, []).append(r)
        used = {}
        for r, (a, b, _) in reversed(list(enumerate(self.merge))):
            used[a] = used[b] = r
        #: Ranks to apply place by place: those whose places can overlap, or whose result is part of an earlier merge.
        self.single = {r for r, (a, b, new) in enumerate(self.merge) if a == b or used.get(new, r) < r}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of ``text``; a special string is one of them, as it stands."""
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(f" {m[0]}")  # no other word holds a space
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        # lower-casing goes by single characters: a final sigma stays the usual one
        return ANY_WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.rank[at], -1)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after another, and where each word's begin and end."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        final = np.zeros(n, bool)
        final[ends - 1] = True
        symbol = np.where(final, self.last[raw], self.inner[raw])
        after = np.where(final, -1, np.arange(1, n + 1))
        before = np.where(np.concatenate([[True], final[:-1]]), -1, np.arange(-1, n - 1))

        where: dict[int, list] = {}
        active: list[int] = []

        def index(places: np.ndarray) -> None:
            """Enters the pairs that start at ``places``."""
            found = self.ranks(symbol[places], symbol[after[places]])
            places, found = places[found >= 0], found[found >= 0]
            if len(found) > 64:
                order = np.argsort(found, kind="stable")
                places, found = places[order], found[order]
                cuts = np.flatnonzero(np.diff(found)) + 1
                groups = zip(found[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts))
            else:
                groups = zip(found.tolist(), places[:, None])
            for r, own in groups:
                if r in where:
                    where[r].append(own)
                else:
                    where[r] = [own]
                    heapq.heappush(active, r)

        index(np.flatnonzero(~final))
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merge[r]
            lists = where.pop(r)
            places = lists[0] if len(lists) == 1 else np.concatenate(lists)
            nexts = after[places]
            places = places[(symbol[places] == a) & (nexts >= 0) & (symbol[nexts] == b)]  # the others are taken
            if len(lists) > 1 and len(places) > 1:
                places = np.unique(places)
            if r in self.single and len(places) > 1:
                # One merge for each word, the leftmost; the rest waits, as another rank may come first now.
                word = np.searchsorted(ends, places, "right")
                first = np.concatenate([[True], word[1:] != word[:-1]])
                if not first.all():
                    where[r] = [places[~first]]
                    heapq.heappush(active, r)
                    places = places[first]
            if not len(places):
                continue
            gone = after[places]
            right = after[gone]
            symbol[places], symbol[gone], after[places] = new, -1, right
            inside = right >= 0
            before[right[inside]] = places[inside]
            left = before[places]
            index(np.concatenate([places[inside], left[left >= 0]]))
        kept = symbol >= 0
        return symbol[kept].astype(np.int32), np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, one after another, and where each text's begin and end."""
        if len(self.number) > self.KEEP:
            self._forget()
        seen, number = len(self.number), self.number.__getitem__
        told = [array("i", map(number, self.words(t))) for t in texts]
        new = list(islice(self.number, seen, None))
        flat, start = self.merge_words([w if w[0] != " " else "" for w in new])
        if any(w[0] == " " for w in new):  # special strings
            size = np.diff(start)
            ids = np.split(flat, start[1:-1])
            for i, w in enumerate(new):
                if w[0] == " ":
                    ids[i], size[i] = np.array([self.added[w[1:]]], np.int32), 1
            flat, start = np.concatenate(ids), np.concatenate([[0], np.cumsum(size)])
        self.start = np.concatenate([self.start, start[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        words = np.frombuffer(b"".join(told), np.int32)
        size = (self.start[1:] - self.start[:-1])[words]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.start[words] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[np.cumsum([0, *map(len, told)])]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, special ones too, as the library does without a decoder; unknown ids are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))


@lru_cache(maxsize=2)
def loaded(definition: str) -> WordBpe:
    return WordBpe(definition)


kept.append(loaded.cache_clear)

#: Bytes of text whose words are held at once.
HELD = 2 << 20


def _source(docs: DataFrame, tokenizer_path: str):
    """The definition for the tasks, and slim rows of the texts."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    return docs.sparkSession.sparkContext.broadcast(definition), rows.withColumn("n_bytes", F.octet_length("text"))


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False, packed: bool = True) -> DataFrame:
    """Token ids of every whole text: doc_id, ids array<int>, and if ``packed``, the ids as little-endian unsigned 32-bit integers in a column of that name.

    tokenizer_path: a ``tokenizers`` JSON file that the driver can read; its content goes to the executors. With
    ``decoded``, the ids are decoded again, as ``decode`` does it, into a further column of that name.

    A null text counts as empty (no ids); repeated rows and null ids stay; other columns are ignored. Each task merges
    each distinct word of a stretch of its rows once; there is no shuffle.
    """
    source, rows = _source(docs, tokenizer_path)
    names = ["doc_id", "ids", *["packed"] * packed, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for part in stretches(batches, "n_bytes", HELD):
            flat, ends = bpe.encode(part.column("text").to_pylist())
            flat = flat.astype("<i4")
            ids = [flat[x:y] for x, y in zip(ends, ends[1:])]
            out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
            if packed:
                out.append(pa.array([p.tobytes() for p in ids], pa.binary()))
            if decoded:
                out.append(pa.array([bpe.decode(p.tolist()) for p in ids], pa.string()))
            yield pa.record_batch(out, names=names)

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>" + ", packed binary" * packed + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Texts of rows with ids: doc_id, ids, decoded. Null ids decode to an empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                text = pa.array([bpe.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, text], names=["doc_id", "ids", "decoded"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
