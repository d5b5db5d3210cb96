"""Classifier, mixing, language model, line dedup, BPE and token counts: brute force, held-out rows, edge cases."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer
from webloom.llm import bpe, brown, common, line_dedup, mixing, packed, quality, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t ", "a", "A b  c\n\nd", "a  b\n\n c  <|endoftext|>d\n e" * 9, "x" * 5000, "é ü ñ   z\u0085 q\x1c\x1d k" * 30, "'s don't I'll HE'S", "<|startoftext|>Hi<|endoftext|><|ENDOFTEXT|>",
    "a" * 3000 + "b" * 999, "ΑΣ ΑΣΑ İI ﬁ", "中文 字 12٣4", "word " * 40_000, "aaaa aaa aa", "​ ",
]


def odd_docs(spark):
    """Odd texts twice, null ids, and further columns whose names clash with those made inside."""
    rows = [(i if i % 5 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows + rows[:4], DOCS)
    return df.select("*", *[F.lit(1).alias(c) for c in ("n_bytes", "held_out", "size", "word", "row", "score", "ids", "place", "rank", "fp", "key_", "N_Tokens")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    letters = "aAbßΣσİıÉé'stdlm 12٣ \t\n\x1c\x85 ​　。中文<|endoftext|>ﬁé\U0001f600#!?-_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + [t for t in ODD if t is not None]
    own = bpe.WordBpe(open(WORDS).read())
    flat, ends = own.encode(texts)
    for text, a, b in zip(texts, ends, ends[1:]):
        want = library.encode(text, add_special_tokens=False).ids
        assert flat[a:b].tolist() == want, text[:60]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_query_rows(spark):
    docs = odd_docs(spark)
    out = bpe.encode(docs, WORDS, decoded=True)
    assert out.count() == docs.count() and bpe.encode(empty(spark), WORDS).count() == 0
    library = Tokenizer.from_file(WORDS)
    want = Counter(tuple(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    rows = out.collect()
    assert Counter(tuple(r.ids) for r in rows) == want
    assert all(bytes(r.packed) == np.array(r.ids, "<u4").tobytes() for r in rows)
    assert [r.decoded for r in bpe.decode(out, WORDS).collect()] == [r.decoded for r in rows]


def test_merges_made_twice_or_overlapping():
    import json

    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate([*letters, *[c + "#" for c in letters], "aa", "aaaa", "ab", "abc", "bc", "c#", "abc#", "bc#"])}
    merges = [["b", "c"], ["a", "a"], ["a", "b"], ["ab", "c"], ["a", "bc"], ["aa", "aa"], ["b", "c#"], ["a", "bc#"]]
    own = bpe.WordBpe(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": merges, "end_of_word_suffix": "#"}, "added_tokens": [], "normalizer": bpe.NORMALIZER, "pre_tokenizer": bpe.PRE_TOKENIZER}))
    rank = {tuple(m): i for i, m in enumerate(merges)}

    def slow(word):
        parts = [*word[:-1], word[-1] + "#"]
        while True:
            best = min(((rank.get(p, math.inf), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(math.inf, 0))
            if best[0] == math.inf:
                return [vocab[p] for p in parts]
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    flat, ends = own.merge_words(words)
    for w, a, b in zip(words, ends, ends[1:]):
        assert flat[a:b].tolist() == slow(w), w


def test_other_definitions_are_refused():
    import json

    spec = json.loads(open(WORDS).read())
    bpe.WordBpe(json.dumps(spec))
    token = spec["added_tokens"][0]
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [token | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.WordBpe(json.dumps(spec | change))


def test_long_runs_are_split(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    definition = open(BYTES).read()
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZé1٣½'s中-_<|>") for _ in range(rng.randrange(1, 9000))) for _ in range(60)] + ["ab12" * 5000 + "<|endoftext|>9a" * 300]
    assert token_counts.turns(definition) and any(len(token_counts.stretches(t, True)) > len(token_counts.stretches(t, False)) for t in texts)
    for long in (1, 4096):
        monkeypatch.setattr(token_counts, "LONG", long)
        token_counts.known.cache_clear()
        assert token_counts.lengths(texts, definition, 1000) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert all("".join(token_counts.stretches(t, True)) == t for t in texts)


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    docs = odd_docs(spark)
    want = Counter((len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.count_tokens(docs, BYTES, limit=100).collect()
    assert Counter((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty(spark), BYTES).count() == 0
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert token_counts.lengths(texts, open(BYTES).read(), 1000) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for text in [*texts[:50], *[t for t in ODD if t]]:
        assert "".join(token_counts.STRETCH.findall(text)) == text


def test_line_dedup(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE_SQL).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_line_dedup_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST", broadcast)
    rows = [(i, f"top\nown {i}\n top \n\nbottom {i % 20}", "en", "a" if i < 90 else None, 0) for i in range(100)] + [(200, None, None, "a", 0), (201, "", "en", "b", 0), (202, "top", "en", "b", 0), (203, "top", "en", "a", 0)]
    rows += [(300 + i, "copied\nlines", "en", "c", 0) for i in range(50)] + [(400, "alone", "en", "d", 0)]
    clashing = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("boiler", "k1", "bad", "bare", "split")})
    for distinct in (True, False):
        out = {r.doc_id: r for r in line_dedup.dedup_lines(clashing, 0.5, 2, distinct).collect()}
        assert len(out) == len(rows)
        assert (out[3].text, out[3].n_lines, out[3].n_dropped) == ("own 3\n\nbottom 3", 5, 2)
        assert out[95].text == "own 95\n\nbottom 15" and out[202].text == "top" and out[203].text == ""
        assert out[300].text == ("copied\nlines" if distinct else "") and out[400].text == "alone"
        assert out[200].text is None and out[200].n_lines == 0 and out[201].text == ""
    assert line_dedup.dedup_lines(empty(spark)).count() == 0 and line_dedup.dedup_lines(odd_docs(spark)).count() == len(ODD) + 4


def test_line_ratio_is_pages_by_host_pages(spark):
    rows = [(i, "\n".join(["x"] * 3 * (i < 2) + ["y"] * (i < 3) + [f"own {i}"]), None, "s", 0) for i in range(10)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), 0.2, 1).collect()}
    assert out[0] == "x\nx\nx\nown 0" and out[2] == "own 2"  # x is on 2 of 10 pages, which doesn't exceed 0.2; y on 3


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100], [5, 2, 1], 3) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 10], [5, 2], 3) == [0, 10] and mixing.targets([], [], 3) == []


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs)
    rows = out.collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows} and all(r.taken <= 3 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(size.values()))


def test_tilt_solves_the_constraints(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 300)
    df = spark.createDataFrame([("a", int(s), 1) for s in sizes], "source string, size bigint, n bigint")
    for ratio in (0.2, 0.9, 1.0, 1.7, 2.9):
        x = mixing.solve(df, {"a": (float(sizes.mean()), float(ratio * sizes.sum()), 300)}, 3, 1e-7, 60)["a"]
        rates = np.minimum(3, np.exp(x * sizes / sizes.mean()))
        assert (rates * sizes).sum() == pytest.approx(ratio * sizes.sum(), rel=1e-5)


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    """A group of equal rows is dealt in pieces, also where rows have numbers; results don't depend on how the table lies."""
    monkeypatch.setattr(mixing, "ROUNDED", 100)
    rows = [(None, "one two three", "en", "a", 0)] * 3000 + [(i, "w " * (i % 40 + 1), "en", "ab"[i % 2], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    slim = mixing.sized(docs)
    cut = mixing.pieces(slim, None)
    assert cut.agg(F.max("many"), F.sum("many"), F.count_if(F.col("many") > 1)).first() == (100, 3900, 30)
    numbered = mixing.pieces(mixing.sized(docs.withColumn("at", F.monotonically_increasing_id()), "at"), "at")
    assert numbered.groupBy("place", "piece").count().agg(F.max("count")).first()[0] < 150 and numbered.count() == 3900
    made = [Counter(map(tuple, mixing.mix(d).select("doc_id", "source", "size", "copies", "taken").collect())) for d in (docs, docs.repartition(5))]
    assert made[0] == made[1] and sum(made[0].values()) == 3900
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.01)
    # rows with numbers are dealt by these, so rounding differs by a copy a piece at most
    assert abs(mixing.mixed_documents(docs, ["doc_id", "text", "source"]).count() - sum(k[3] * n for k, n in made[0].items())) <= 30


def test_mixing_cases(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs)
    assert out.count() == docs.count() and mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, "a", 0)], DOCS)
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    made = {r[0]: r[1] for r in mixing.mixed_documents(plain, ["doc_id", "text", "lang", "source", "n_chars"]).groupBy("doc_id").count().collect()}
    assert made == {r.doc_id: r.copies for r in mixing.mix(plain).collect() if r.copies}


def test_copies_of_equal_rows(spark):
    rows = [(1, "a b c", "en", "s", 0)] * 3 + [(2, "a b c d e", "en", "s", 0)] * 5 + [(3, "q " * 40, "en", "t", 0), (None, "u v", None, None, 0), (None, "u v", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = [tuple(r) for r in mixing.mixed_documents(docs, ["doc_id", "text", "lang", "source", "n_chars"]).collect()]
    taken = {r.source: r.words for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    assert set(out) <= set(rows)
    for source, words in taken.items():
        assert sum(len(r[1].split()) for r in out if r[3] == source) == words


def test_brown_base_score(spark):
    docs = odd_docs(spark).select("*").union(spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(1)] * 12))
    given = docs.select("doc_id", "text").collect()
    out = brown.score(docs, classes=16, rounds=2).collect()
    told = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 == 2 if r.doc_id is not None else False, (r.text or "").encode().lower().split() + [b" "]) for r in given]
    counts = Counter(w for _, held, ws in told if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held, len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in told)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want] and [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-4)
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in out)


def learned(df):
    return df.select(F.col("text").cast("binary").alias("text"), F.octet_length("text").alias("n_bytes"), F.lit(False).alias("held_out"))


def test_brown_looked_up_counts_equal_listed_ones(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(brown, "FREQUENT", 20)
    options = {"classes": 8, "rounds": 1, "placing": 0, "own": 1}
    want = {r.doc_id: r for r in brown.score(docs, **options).collect()}
    for most in (200, 0):
        for summed in (4_000_000, 100):
            monkeypatch.setattr(brown, "SUMMED", summed)
            for r in brown.score(docs, vocabulary=most, **options).collect():
                assert r.n_known == want[r.doc_id].n_known and r.score == pytest.approx(want[r.doc_id].score, abs=1e-6) and r.base_score == pytest.approx(want[r.doc_id].base_score, abs=1e-6)


def test_brown_is_the_same_whatever_a_task_holds(spark, monkeypatch):
    """Many small parts that take turns in few partitions, sums in small pieces: the same model and scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")
    options = {"classes": 8, "rounds": 1, "vocabulary": 150, "frequent": 30, "endings": 40, "ending": 2}
    told = lambda **more: {r.doc_id: (r.n_known, r.score, r.base_score) for r in brown.score(docs, **options, **more).collect()}
    want = told()
    monkeypatch.setattr(brown, "SUMMED", 500)
    got = told(part_tokens=400, partitions=3)
    assert got.keys() == want.keys() and len(want) > 100
    for i, row in want.items():
        assert got[i] == pytest.approx(row, abs=1e-6)


def test_brown_scores_give_no_warnings(recwarn):
    model = brown.Model(brown.Units([brown.END, b"a"]), np.array([0, 1] + [1] * brown.ENDINGS, np.int8), np.array([2, 3] + [-1] * brown.ENDINGS), np.full((2, 2), 0.5), np.full(2, 0.1), np.full(2, 0.1), 5, 2, 0.98)
    n, known, base, score, *_ = model.score([b"a x", b""])
    assert n.tolist() == [3, 1] and known.tolist() == [2, 1] and np.isfinite(base).all() and np.isfinite(score).all() and not len(recwarn)


@pytest.mark.parametrize("parts, partitions", [(50, 4), (4, 50), (7, 7)])
def test_parts_take_turns(spark, parts, partitions):
    import pyarrow as pa

    spread = min(parts, partitions)

    def make(batches):
        for _ in batches:
            code = np.arange(1000)
            yield from packed.by_part(code % parts % spread, {"code": code, "n": code * 2}, kind=1)

    def told(batches):
        for held in packed.turns(batches):
            got = packed.gathered(held, {"code": np.int64, "n": np.int64}, {"kind": 1})
            small = [x["code"] for x in packed.pieces(held, {"code": np.int64, "n": np.int64}, 30)]
            assert (got["n"] == 2 * got["code"]).all() and (np.concatenate(small) == got["code"]).all()
            yield pa.record_batch([pa.array([sorted(got["code"].tolist())], pa.list_(pa.int64()))], names=["code"])

    df = spark.range(3).repartition(3).mapInArrow(make, "part int, kind int, code binary, n binary")
    out = packed.in_turns(df, {"code": np.int64, "n": np.int64}, ("kind",), lambda x, kind: x["code"] % parts, parts, partitions, 100)
    rows = sorted(r.code for r in out.mapInArrow(told, "code array<bigint>").collect())
    times = df.where("kind = 1").select("part").distinct().count() and sum(1 for b in df.select("n").collect()) // spread
    assert rows == sorted(sorted(list(range(p, 1000, parts)) * times) for p in range(parts))


def test_brown_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in brown.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    model, counts = brown.fit(learned(docs).where("n_bytes < 2000"), classes=8, rounds=2)
    seen = {bytes(r.word): r.n for r in counts.collect()}
    of = model.of[model.units.of(list(seen))]
    n = np.array(list(seen.values()))
    types = np.bincount(of, minlength=8)
    for last in range(8):
        follow = model.follow[last]
        known = (model.weight * follow[of] * model.seen[of] * n + (1 - model.weight) * model.base(n)).sum()
        unseen = model.weight * (follow * model.unseen * (types + 1)).sum() + (1 - model.weight) * model.base(np.array(0))
        assert known + unseen == pytest.approx(1, abs=1e-4)


def slow_score(texts, held, model):
    """Scores from the classes alone: counts, transitions and shares anew, word by word."""
    told = [[x for x in t.lower().split()] + [b" "] for t in texts]
    learn = [t for t, h in zip(told, held) if not h]
    count = Counter(w for t in learn for w in t)
    cls = {w: int(model.of[model.units.of([w])[0]]) for t in told for w in t}
    k = len(model.seen)
    pair = Counter((cls[a], cls[b]) for t in learn for a, b in zip([b" ", *t], t))
    mass = [sum(pair[a, b] for a in range(k)) for b in range(k)]
    total, kinds = sum(count.values()), len(count)
    kind = Counter(cls[w] for w in count)
    once = Counter(cls[w] for w, n in count.items() if n == 1)
    out = []
    for t in told:
        value = 0.0
        for a, b in zip([b" ", *t], t):
            c, d = cls[a], cls[b]
            follow = (pair[c, d] + 5 * (mass[d] + 1) / (sum(mass) + k)) / (sum(pair[c, x] for x in range(k)) + 5)
            free = min(0.9, max(1e-4, (once[d] + 0.5) / (mass[d] + 1)))
            emit = (1 - free) * count[b] / mass[d] if count[b] else free / (kind[d] + 1)
            value += math.log10(0.98 * follow * emit + 0.02 * (count[b] + 1) / (total + kinds + 1))
        out.append(value)
    return out


def test_brown_score_equals_a_slow_one(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").limit(90)
    rows = docs.select("doc_id", "text").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    with_flag = docs.withColumns({"n_bytes": F.octet_length("text"), "held_out": F.crc32(F.col("doc_id").cast("string")) % 7 == 2, "text": F.col("text").cast("binary")})
    model, _ = brown.fit(with_flag, classes=9, rounds=2, vocabulary=300)
    got = {r.doc_id: r.score for r in brown.score(docs, classes=9, rounds=2, vocabulary=300).collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(slow_score([r.text.encode() for r in rows], held, model), abs=1e-6)
    assert any(held)


def test_exchange_equals_a_slow_one():
    rng = np.random.default_rng(8)
    for _ in range(4):
        size, classes = 14, 5
        pairs = rng.poisson(0.6, (size, size)).astype(float) * rng.integers(1, 30, (size, 1))
        of = np.zeros(size, int)
        order = [u for u in np.argsort(-pairs.sum(0), kind="stable") if u]
        of[order] = np.arange(size - 1) % (classes - 1) + 1

        def value(of):
            member = np.eye(classes)[of]
            return brown.likelihood(member.T @ pairs @ member)

        for _ in range(3):
            for u in order:
                if pairs[:, u].any():
                    values = [value(np.where(np.arange(size) == u, c, of)) for c in range(1, classes)]
                    of[u] = 1 + int(np.argmax(np.round(values, 9)))
        got = brown.exchange(pairs, classes, 3)
        assert value(got) == pytest.approx(value(of)) and got[0] == 0 and 0 not in got[1:]


def test_thresholds_at_any_counts(spark):
    big = spark.range(5000).select(F.col("id").cast("string").cast("binary").alias("word"), (F.col("id") * 1_000_003 + 2_000_000).alias("m"))
    least, following = brown.least_bin(big, "m", 700)
    chosen = big.where(brown.count_bin(F.col("m")) >= least).count()
    assert 690 < chosen <= 700 and following < least
    same = spark.range(3000).select(F.lit(7).cast("bigint").alias("m"))
    assert brown.least_bin(same, "m", 700) == (8, 7) and brown.least_bin(same, "m", 3000) == (7, 7) and brown.least_bin(same.limit(0), "m", 5) == (1, 1)


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_stretches_keep_rows(most):
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(i, rng.randrange(8) if i % 7 else None) for i in range(100)]
    table = pa.table({"i": [r[0] for r in rows], "n": [r[1] for r in rows]})
    for size in (1, 9, 100):
        out = list(common.stretches(table.to_batches(size), "n", most))
        assert [(r["i"], r["n"]) for b in out for r in b.to_pylist()] == rows
        sizes = [[n for n in b.column("n").to_pylist() if n] for b in out]
        assert all(len(ns) <= 1 or sum(ns) <= most for ns in sizes)
    assert list(common.stretches([], "n", 5)) == []


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 1 << 64, 1000, np.uint64), np.sort(rng.integers(-5, 99, 77)), rng.standard_normal(10), np.zeros(0, np.int64), np.array([7], np.int32)):
        assert (packed.unpack(packed.pack(x), x.dtype) == x).all()
    part = rng.integers(0, 5, 100)
    for batch in packed.by_part(part, {"code": np.arange(100)}, kind=3):
        for r in batch.to_pylist():
            assert packed.unpack(r["code"], np.int64).tolist() == np.flatnonzero(part == r["part"]).tolist() and r["kind"] == 3
    assert [b.num_rows for b in packed.by_part(part[:0], {"code": part[:0]})] == [0]


def test_brown_empty(spark):
    assert brown.score(empty(spark)).count() == 0
    only = spark.createDataFrame([(i, None, None, None, 0) for i in range(5)], DOCS)
    assert [r.n_tokens for r in brown.score(only).collect()] == [1] * 5


def test_exchange_finds_the_two_classes(spark):
    rng = random.Random(4)
    left, right = ["aq", "bw", "ce", "dr"], ["xt", "yy", "zu", "wi"]
    texts = [(" ".join(rng.choice(left if i % 2 else right) for i in range(60)),) for _ in range(60)]
    model, _ = brown.fit(learned(spark.createDataFrame(texts, "text string")), classes=7, rounds=6)
    own = lambda ws: {int(model.of[u]) for u in model.units.of([w.encode() for w in ws])}
    assert not own(left) & own(right)


def test_brown_words_of_one_ending_part_by_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 9)
    rng = random.Random(6)
    frame = {0: ["aq", "bw", "ce", "dr"], 1: ["xt", "yy", "zu", "wi"]}
    rare = {0: [f"l{i}-end" for i in range(20)], 1: [f"r{i}-end" for i in range(20)]}
    texts = []
    for i in range(600):
        words = [rng.choice(frame[k % 2]) for k in range(20)]
        for _ in range(2):  # the words of rare[0] stand where those of frame[0] do
            at = rng.randrange(20)
            words[at] = rng.choice(rare[at % 2])
        texts.append((" ".join(words), ))
    model, _ = brown.fit(learned(spark.createDataFrame([*texts, ("once-end",)], "text string")), classes=7, rounds=6)
    units = {k: model.units.of([w.encode() for w in rare[k]]) for k in rare}
    assert len({*units[0].tolist(), *units[1].tolist()}) == 40
    assert not set(model.of[units[0]]) & set(model.of[units[1]])
    assert model.units.of([b"once-end"])[0] < model.units.base


def test_brown_transitions_are_those_of_the_classes(spark):
    rows = learned(spark.read.parquet(f"{SF}/documents.parquet"))
    model, counts = brown.fit(rows, classes=8, rounds=1)
    m = np.zeros((8, 8))
    for r in rows.collect():
        c = model.of[model.units.of([b" ", *bytes(r.text or b"").lower().split(), b" "])]
        np.add.at(m, (c[:-1], c[1:]), 1)
    prior = (m.sum(0) + 1) / (m.sum() + 8)
    assert np.allclose(model.follow, (m + 5 * prior) / (m.sum(1)[:, None] + 5), atol=1e-3)
    assert len(model.units.hashes) == sum(r.n >= 3 and bytes(r.word) not in model.units.frequent for r in counts.collect())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows) > 0.99
    assert out.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0


def test_word_vectors_equal_slow_ones():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["oak", "elm", "Ash", "12", "!", "oak oak", "x9_"]) for _ in range(rng.randrange(0, 40))) for _ in range(30)] + ["", "lonely"]
    number, vectors = quality.word_vectors(texts, 12, 3, 1000)
    context = {w: np.zeros(12) for w in number}
    for text in texts:
        words = [w if w in number else quality.shape(w) for w in quality.told(text)]
        for i, w in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    context[w] += quality.index_vector(words[j], 12, 3)
    for w, n in number.items():
        size = np.linalg.norm(context[w])
        assert np.allclose(vectors[n], np.concatenate([context[w] / size if size else context[w], quality.index_vector(w, 12, 3) / np.sqrt(3)]), atol=1e-5), w
    labels = np.array([i % 2 for i in range(len(texts))])
    model = quality.train(texts, labels, dim=12, ones=3, epochs=2)
    for text, got in zip(texts, model.pooled(texts)):
        ids = [model.number.get(w, model.number.get(quality.shape(w), 0)) for w in quality.told(text)]
        assert np.allclose(got, model.vectors[ids].mean(0) if ids else 0, atol=1e-6)


def test_a_process_apart():
    assert common.apart(quality.shape, "Abc") == quality.shape("Abc")
    with pytest.raises(RuntimeError, match="IndexError"):
        common.apart(quality.shape, "")
    rows = [(i, " ".join(["fine" if i % 2 else "poor"] * 5 + [f"w{i % 7}"]), i % 2) for i in range(80)]
    models = [common.apart(quality.train_rows, rows=(r for r in some), dim=8, epochs=3) for some in (rows, rows[::-1])] + [quality.train_rows(rows[:], dim=8, epochs=3)]
    assert len({tuple(np.round(m.score(["fine w1", "poor"]), 6)) for m in models}) == 1
    with pytest.raises(RuntimeError, match="ValueError"):
        common.apart(quality.train_rows, rows=((i, None, "x" * 100_000) for i in range(100)))


def test_temperature_is_calibrated():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 900)
    texts = [" ".join(rng.choice(["good", "fine"] if y == (rng.random() > 0.2) else ["bad", "poor"], 12)) for y in labels]
    model = quality.train(texts, labels, dim=16)
    fresh = rng.integers(0, 2, 900)
    said = model.score([" ".join(rng.choice(["good", "fine"] if y == (rng.random() > 0.2) else ["bad", "poor"], 12)) for y in fresh])
    sure = np.where(said > 0.5, said, 1 - said)
    assert abs(sure.mean() - ((said > 0.5) == fresh).mean()) < 0.06  # as often right as it says


def test_quality_sees_only_texts_and_seen_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(0))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "n_chars": F.lit(0)})
    assert {r.doc_id: r.score for r in quality.classify(other, flipped).collect()} == want


def test_quality_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ODD) + 4 and len({r.score for r in rows}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty(spark), labels).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, some).collect())
