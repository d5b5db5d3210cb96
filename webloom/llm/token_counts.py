"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import chunks, kept, pick

#: A stretch between safe boundaries. A boundary is one space or newline between two characters that are no white
#: space: a byte-level pre-tokenizer always starts a piece there, whatever stands before or after, and no special
#: string holds white space. Other white space stays inside a stretch.
STRETCH = re.compile(r"\s*+\S++(?:(?:\s{2,}+|[^\S \n]|[ \n]\Z)\S*+)*+|\s++")

#: Inside a stretch of LONG characters or more, a digit beside a letter is a safe boundary too, for the pre-tokenizer that
#: puts letters and digits into different pieces, if no special string holds such a pair.
TURN, LONG = regex.compile(r"(?V1)(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"), 4096

#: Stretches whose lengths a worker keeps; beyond it the store starts anew, so that memory stays bounded.
KEEP = 1_200_000


@lru_cache(maxsize=2)
def loaded(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def loaded_plain(definition: str):
    """A tokenizer that takes special strings in a text as plain text."""
    tokenizer = loaded.__wrapped__(definition)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def safe(definition: str) -> bool:
    """Whether texts may be split at the boundaries of STRETCH.

    So it is for byte-level BPE whose pre-tokenizer is ByteLevel by its own pattern and without a prefix blank, with no
    normalizer, if no added token holds white space, takes in what is beside it, or asks for word boundaries.
    """
    spec = json.loads(definition)
    cut = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    odd = any(re.search(r"\s", t["content"]) or any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens", []))
    own = spec["model"]
    return bool(plain) and own.get("type") == "BPE" and not own.get("dropout") and not odd and (spec.get("post_processor") or {}).get("type") in (None, "ByteLevel")


@lru_cache(maxsize=2)
def turns(definition: str) -> bool:
    """Whether TURN is a safe boundary."""
    return safe(definition) and not any(TURN.search(t["content"]) for t in json.loads(definition).get("added_tokens", []))


def stretches(text: str, split_long: bool) -> list[str]:
    """The stretches of a text, which joined give it again."""
    parts = STRETCH.findall(text)
    if split_long and len(text) >= LONG and any(len(p) >= LONG for p in parts):
        return [q for p in parts for q in (TURN.split(p) if len(p) >= LONG else [p])]
    return parts


@lru_cache(maxsize=2)
def known(definition: str) -> dict[str, int]:
    return {}


kept += [loaded.cache_clear, known.cache_clear]


def lengths(texts: list[str], definition: str, batch_bytes: int) -> list[int]:
    """Tokens of each text: the sum over its stretches. Equal stretches are encoded once, in batches of ``batch_bytes``."""
    tokenizer, seen = loaded(definition), known(definition)
    if len(seen) > KEEP:
        seen.clear()
    split_long = turns(definition)
    parts = [stretches(text, split_long) for text in texts] if safe(definition) else [[text] for text in texts]
    new = list({p for ps in parts for p in ps if p not in seen})
    sizes = (len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in new)
    for a, b in chunks(sizes, batch_bytes):
        seen.update(zip(new[a:b], map(len, tokenizer.encode_batch_fast(new[a:b], add_special_tokens=False))))
    return [sum(map(seen.__getitem__, ps)) for ps in parts]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, batch_bytes: int = 1 << 18) -> DataFrame:
    """Token count of every whole text.

    tokenizer_path: a ``tokenizers`` JSON file that the driver can read; its content (a few MB, whatever the data)
    goes to the executors with the function. Any kind of it gives the library's counts: texts are split at safe boundaries
    where ``safe`` can tell that these are none of the definition's concern, and are encoded whole where it can't.

    Returns doc_id, n_bytes, n_tokens, over_limit, one row for each row of ``docs``. A null text counts as empty (0
    bytes, 0 tokens); repeated rows and null ids stay as they are; an empty table gives no rows; other columns are ignored.
    However long they are, only a run without a safe boundary, such as one of letters alone, is encoded in one piece, as
    it has to be. The plan is a scan and a
    map: no shuffle, so neither a hot source nor a group of copies meets in one task.
    """
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    source = docs.sparkSession.sparkContext.broadcast(definition)
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n or 0 for n in batch.column("n_bytes").to_pylist()]
            counts: list[int] = []
            for a, b in chunks(sizes, 16 * batch_bytes):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                counts += lengths(texts, source.value, batch_bytes)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).mapInArrow(run, schema)
