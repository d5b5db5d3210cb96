"""Alignment, document fingerprints and lexical search: brute force, the libraries, edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import public_tokenizers
from webloom.llm import alignment, fingerprints, lexical, token_counts
from webloom.llm.common import pick

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", " \n\t ", "a", "\na", "A b  c\n\nd", "a  b\n\n c  <|endoftext|>d\n e" * 9, "x" * 5000, "é ü ñ   z\u0085 q\x1c\x1d k" * 30, "'s don't I'll HE'S <s>hi</s><unk><0x41>",
    "a▁b", "▁ x", "中文 字 12٣4\r\n \r\n", "word " * 40_000, "aaaa aaa aa ", "​ 　 ﬁ Ǻ \x00 ﻿", "{\r\n  if (x);\r\n}\n", "\U0001f600 \U0001f600\n\n\n\n \n y", "One. Two! Three? " * 99,
]


def odd_docs(spark):
    """Odd texts twice, null ids, and further columns whose names clash with those made inside."""
    rows = [(i if i % 5 else None, t, "en", f"s{i % 3}", 7) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows + rows[:4], DOCS)
    return df.select("*", *[F.lit(1).alias(c) for c in ("n_bytes", "chunk", "part", "place", "salt", "row", "score", "task", "first", "q", "rank", "Text")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def slow_alignment(texts):
    library, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    rows, counts = [], Counter()
    for text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text, num_threads=1)
            a_raw = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
            b_raw = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = np.cumsum([*map(len, a_raw)]).tolist(), np.cumsum([*map(len, b_raw)]).tolist()
                both, i, j = sorted({*ends_a} & {*ends_b}), 0, 0
                for end in both:
                    k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                    links.append((a[k - 1], b[m - 1]))
                    i, j = k, m
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    return [
        (len_a, len_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if len_a else "")
        for len_a, len_b, groups, links in rows
    ]


def aligned(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"cells": 60_000, "salted": 2}])
def test_alignment_of_odd_texts(spark, options):
    """Against the libraries on whole texts; with small blocks and few chunks a task too."""
    docs = odd_docs(spark).repartition(5)
    rows = pick(docs, "doc_id", "text").collect()
    want = Counter((r[0], *x) for r, x in zip(rows, slow_alignment([r[1] for r in rows])))
    assert aligned(alignment.align(docs, A, B, **options)) == want
    assert alignment.align(empty(spark), A, B).count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, letters = random.Random(3), "abE 's9 \n\t.é中▁  \r​"
    more = [(10_000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(80))), "en", "s", 0) for i in range(300)]
    docs = docs.union(spark.createDataFrame(more, DOCS))
    rows = docs.select("doc_id", "text").collect()
    made = alignment.Alignment(docs, A, B)
    assert aligned(made.documents()) == Counter((r[0], *x) for r, x in zip(rows, slow_alignment([r[1] for r in rows])))
    best = made.best().groupBy("b").agg(F.countDistinct("n").alias("n"), F.count(F.lit(1))).collect()
    assert best and all(r.n == 1 for r in best)


def test_pairs_of_whole_texts(spark, monkeypatch):
    """Where words can't be told apart safely, texts are encoded whole, with the same results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    pair = alignment.Pair(open(A).read(), open(B, "rb").read())
    texts = [r.text for r in docs.collect()]
    assert pair.parts
    split = pair.chunk(texts)
    pair.parts = False
    pair.clear()
    whole = pair.chunk(texts)
    assert all(np.array_equal(split[k], whole[k]) for k in split)


def slow_tree(text):
    """Whether nodes cover the text: the sentences' hashes, in order."""
    found = [p for line in fingerprints.PARAGRAPH.findall(text) for p in fingerprints.PIECE.findall(line)]
    assert "".join(found) == text
    return [fingerprints.digest(p.encode()) for p in found]


def leaves(node):
    return [node] if node.children is None else [x for c in node.children for x in leaves(c)]


def test_trees_cover_texts():
    texts = [t or "" for t in ODD]
    for text in texts:
        made = fingerprints.tree(text)
        assert [n.hash for n in leaves(made)] == slow_tree(text) and made.length == len(text)
    roots = {t: fingerprints.tree(t).hash for t in texts}
    assert len(set(roots.values())) == len(roots)
    # the same sentences in other paragraphs are another tree
    assert fingerprints.tree("One. Two.\nThree.\n").hash != fingerprints.tree("One. \nTwo.\nThree.\n").hash


def test_likeness_and_edits():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sentence = lambda: " ".join(word() for _ in range(8)) + ". "
    for _ in range(200):
        lines = ["".join(sentence() for _ in range(rng.randrange(1, 4))).rstrip() + "\n" * rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(1, 30))]
        other = list(lines)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(2)] = [sentence() + "\n"] * rng.randrange(2)
        one, two = "".join(lines), "".join(other)
        a, b = fingerprints.tree(one), fingerprints.tree(two)
        found = fingerprints.edits(a, b)
        out, place = "", 0
        for start, end, first, last in found:
            assert start >= place
            out += one[place:start] + two[first:last]
            place = end
        assert out + one[place:] == two
        near = fingerprints.likeness(a, b)
        assert (near == 1) == (one == two) == (not found) and 0 <= near <= 1 and near == pytest.approx(fingerprints.likeness(b, a))
        if len(lines) > 12:
            assert near > 0.5
    assert fingerprints.likeness(fingerprints.tree("a b. c d."), fingerprints.tree("x y.")) == 0
    assert fingerprints.likeness(fingerprints.tree(""), fingerprints.tree("")) == 1


def slow_next(rows):
    """Rows (doc_id, text) in order, each with the sha of its edited text and its likenesses."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        then = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + then[:half]
        own, other, next_ = map(fingerprints.tree, (text, changed, then))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hash.hex(), other.hash.hex(), fingerprints.likeness(own, other), fingerprints.likeness(own, next_)))
    return out


def told(df):
    return sorted(tuple(r) for r in df.select(*fingerprints.SCHEMA.names).collect())


def test_documents_and_the_next_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    out = told(fingerprints.with_next(docs))
    assert out == sorted(slow_next(rows))
    assert np.mean([r[5] for r in out]) > 0.3 > 0.1 > np.mean([r[6] for r in out])
    one = docs.where("doc_id = 3")
    assert told(fingerprints.with_next(one)) == slow_next([r for r in rows if r[0] == 3]) and fingerprints.with_next(one).first().near_next == 1
    assert fingerprints.with_next(empty(spark)).count() == 0


def test_odd_documents_and_the_next_ones(spark):
    docs = odd_docs(spark).repartition(3)
    keyed = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("p", F.xxhash64("t")).orderBy("doc_id", "p").collect()
    assert told(fingerprints.with_next(docs).fillna(-1, "doc_id")) == sorted(slow_next([(-1 if r.doc_id is None else r.doc_id, r.t) for r in keyed]))
    plain = fingerprints.fingerprints(docs)
    assert plain.count() == docs.count() and plain.select("root").distinct().count() == len({t or "" for t in ODD})
    changed = pick(docs, "doc_id", "text").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" More.")).alias("text"))
    assert fingerprints.compare(docs, pick(docs, "doc_id", "text")).where("likeness = 1").count() == 0
    assert {len(r.edits) for r in fingerprints.compare(docs.where("doc_id = 16"), changed).collect()} == {1}


def slow_search(docs, items, k=10):
    told = [(d, Counter(ts)) for d, t in docs if (ts := lexical.terms((t or "").encode()))]
    many, total = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in told:
            m = 100 - 75 + (75 * sum(c.values()) * many) // total
            score = sum(lexical.weight(many, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in lexical.terms((text or "").encode()) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"together": 50, "block": 3}, {"k": 3, "block": 1}])
def test_search(spark, options):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = slow_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], options.get("k", 10))
    assert Counter(map(tuple, lexical.search(docs.repartition(5), items, **options).collect())) == want


def test_search_odd(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "a word, a WORD; xyz"), (1, "é 中文 12"), (None, "two three"), (4, None), (5, "..."), (6, "nowhere")], "item_id bigint, text string").withColumn("score", F.lit(1))
    want = slow_search([(r[0], r[1]) for r in pick(docs, "doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, lexical.search(docs, items, together=4).collect())) == want
    assert lexical.search(empty(spark), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_weights_of_large_tables():
    n, tf = np.array([3, 10**9]), np.array([1, 5])
    assert lexical.gain(tf, n, 10**11, 10**13).tolist() == [(10**9 * t) // (1000 * t + 8 * (25 + (75 * m * 10**11) // 10**13)) for m, t in zip(n.tolist(), tf.tolist())]


def altered(definition, **changes):
    import json

    spec = json.loads(definition)
    for key, value in changes.items():
        spec[key] = spec[key] | value if isinstance(spec.get(key), dict) else value
    return json.dumps(spec)


@pytest.mark.parametrize(
    "changes",
    [
        {"pre_tokenizer": {"add_prefix_space": True}}, {"pre_tokenizer": {"use_regex": False}}, {"normalizer": {"type": "Lowercase"}}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}},
        {"added_tokens": [{"id": 50256, "content": "two\nthree", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
        {"added_tokens": [{"id": 50256, "content": "two", "single_word": True, "lstrip": True, "rstrip": False, "normalized": False, "special": True}]},
    ],
)
def test_counts_of_other_definitions(spark, tmp_path, changes):
    """Definitions whose boundaries aren't safe are told, and give the library's counts."""
    path = tmp_path / "other.json"
    path.write_text(altered(open(A).read(), **changes))
    assert not token_counts.safe(path.read_text())
    library = Tokenizer.from_file(str(path))
    texts = [t for t in ODD if t] + ["one two\nthree four", " One TWO 12 345", "a two\nthree b"]
    out = token_counts.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), str(path)).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
