"""The corpus pipeline: documents through the training-data operators, stage by stage.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. ``run`` writes each stage's rows to the folder that driver and executors share and reads them
again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, line_dedup, mixing, quality, simhash
from webloom.llm.common import Stored, few, pick, settled, small_batches, table
from webloom.sources.layout import spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Each row is judged by its text alone, so repeated rows stay or go together; a null or empty text is one without
    words. Without a usable label nothing is told apart, and the share of label 1 is taken to be a half: all rows stay.
    """
    small_batches(spark)
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars is that of the new text. No row goes.

    The share is op5's, 2 %. Equal texts of a source count as one page and a line needs five: else the lines of every
    document with many copies would pass for boilerplate before the next stage can choose the one that stays. Null texts stay null, with a
    null n_chars; a text that was nothing but boilerplate becomes empty; rows without a source are one host.
    """
    clean = line_dedup.dedup_lines(docs, ratio=0.02, least_pages=5, distinct_texts=True)
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. A document without an id counts after all others.

    Near copies have five-word shingles with a Jaccard similarity of 0.8 or more, or are linked by such ones; see
    ``simhash.near_copies``. Null and empty texts are one group. Of rows equal in id and text one stays; rows that
    share an id but not their text are kept or dropped one by one; ties of id go to the smaller hash of the row.
    """
    small_batches(spark)
    rows = pick(docs, *COLUMNS)
    groups = settled(lambda: simhash.near_copies(rows))
    # equal rows share a key: how often it occurs is known before the texts are touched
    each = groups.groupBy("group", "row", "row2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2", "n")).alias("least")
    first = Stored(each.groupBy("group").agg(least).select("least.row", "least.row2", (F.col("least.n") > 1).alias("repeated"))).df
    kept = rows.withColumns(simhash.row_keys()).join(few(first), ["row", "row2"])
    if first.where("repeated").limit(1).count():
        kept = kept.where("not repeated").union(kept.where("repeated").dropDuplicates(["row", "row2"]))
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, under the same doc_id; rows with no copy go.

    Each of several equal rows has a number of copies of its own. Texts without a word stay once, as they weigh nothing.
    """
    return mixing.mixed_documents(docs, list(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to: doc_id, n_tokens, ids, decoded.

    One row for each row of ``docs``; a null text is encoded as an empty one, which has no tokens.
    """
    small_batches(spark)
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, packed=False)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("bpe", encode),
]

#: SQL can't express these stages: a trained model, components of near copies, a numeric optimum, BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir)) if i + 1 < len(STAGES) else stage(spark, before, sf_dir)  # noqa: B023
    return docs
