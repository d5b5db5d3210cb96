"""The pipeline's stages, and the queries of the subpackage."""

import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from webloom.llm import mixing, pipeline, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        assert docs.count() > 0.5 * before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d", "en", "s", 7), (2, "A b c  d", "en", "s", 8), (2, "A b c  d", "en", "s", 8), (None, "a b c d", "en", "s", 7), (None, "q r s", None, None, 5), (None, "q r s", None, None, 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key_", F.lit(1)).withColumn("fp", F.lit(2))
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "q r s"), (1, "a b c d"), (3, "")]


def test_texts_of_one_id_are_chosen_one_by_one(spark):
    rows = [(3, "a b c d e f", "en", "s", 11), (5, "q r s t u v", "en", "s", 11), (5, "A b c d e f", "en", "s", 11), (7, "k l m n o p", "en", "s", 11), (7, "w x y z z y", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, rows[0][1]), (5, rows[1][1]), (7, rows[3][1]), (7, rows[4][1])]


def similar(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_blocks_by_bytes(spark, monkeypatch):
    """Where sets are large, fewer of them are compared in one task; groups stay the same."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 40)] + [" ".join(f"y{rng.randrange(900)}" for _ in range(200)) for _ in range(20)] + ["z " * 3000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = lambda: sorted(map(sorted, (r[0] for r in simhash.near_copies(docs).groupBy("group").agg(F.collect_list("doc_id")).select(F.col("collect_list(doc_id)")).collect())))
    want = groups()
    assert list(range(40)) in want
    monkeypatch.setattr(simhash, "SET_BYTES", 3 * 8 * 300)
    assert groups() == want


def test_equal_halves_of_hashes_lose_nothing(spark, monkeypatch):
    """Rows, or sets of shingles, that share one half of their hashes but not the other stay apart."""
    texts = ["a b c d e f", "A b c d e f", "q r s t u v", "k l m n o p", "k l m n o p", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    keys, sign = simhash.row_keys, simhash.signature
    kept = lambda: sorted(r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect())
    assert kept() == [0, 2, 3, 5]
    monkeypatch.setattr(simhash, "row_keys", lambda: keys() | {"row": F.lit(7).cast("bigint")})
    monkeypatch.setattr(simhash, "signature", lambda found: (7, sign(found)[1]))
    assert kept() == [0, 2, 3, 5]
    monkeypatch.setattr(simhash, "row_keys", lambda: keys() | {"row2": F.lit(7).cast("bigint")})
    monkeypatch.setattr(simhash, "signature", lambda found: (sign(found)[0], 7))
    assert kept() == [0, 2, 3, 5]


@pytest.mark.parametrize("block", [8, 1024])
def test_near_copies_of_changed_words_go(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SETS", block)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 400))]
        texts.append(base)
        for _ in range(5):
            other = list(base)
            for i in rng.sample(range(len(other)), max(1, len(other) * rng.randrange(1, 5) // 100)):
                other[i] = f"v{rng.randrange(500)}"
            texts.append(other)
    texts = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 12 < len(set(root)) < 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "x " * 50_000, "en", "s", 100_000), (2, "x " * 50_000, "en", "s", 100_000), (3, "fine text here", "en", None, 14)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(1) for c in ("place", "copies", "kept", "predicted", "size")})
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, given, SF).collect()


def slow_lines(docs):
    """Texts without lines on more than 5 % of the distinct texts of a source, and on 5 or more of them."""
    pages = {}
    for d in docs:
        pages.setdefault(d["source"], set()).add(d["text"])
    on = {s: Counter(x for t in ts if t is not None for x in {trim(x) for x in t.split("\n")} if x) for s, ts in pages.items()}
    bad = {s: {x for x, n in c.items() if n >= 5 and n > 0.02 * len(pages[s])} for s, c in on.items()}
    return [d | {"text": None if d["text"] is None else "\n".join(x for x in d["text"].split("\n") if trim(x) not in bad[d["source"]])} for d in docs]


def trim(line):
    return re.sub(r"[\t\r]", " ", line).strip(" ")


def slow_groups(docs):
    """One document of each group of near copies, the smallest id."""
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) if len(w := (d["text"] or "").lower().split()) > 5 else frozenset([tuple(w)] if w else []) for d in docs]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    blank = [i for i, s in enumerate(sets) if not s]
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j in [*(j for j, n in both.items() if n >= 0.8 * len(s | sets[j])), *(blank[:1] if not s else [])]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if find(i) == i]


def test_run_equals_brute_force(spark):
    """All stages against slow ones, with the classifier's decisions and the mix's copies held against their constraints."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.3").collect()}
    rows = sorted((r.asDict() for r in docs.collect() if r.doc_id in good), key=lambda d: d["doc_id"])
    kept = slow_groups(slow_lines(rows))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([tuple(d.values()) for d in kept], schema)).collect()})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d in kept:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += copies[d["doc_id"]]
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 50


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
