"""Top-k search, WARC, embedding and SimHash near-duplicates, components: brute force and edge cases."""

import gzip
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import embedding_dedup, links, simhash, topk, warc

SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "code", "row", "dim", "length", "rank", "bucket", "s1")})


BAD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [math.nan] + [1.0] * 7, 1), (9005, [math.inf] + [1.0] * 7, 1), (9006, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]


@pytest.mark.parametrize("pairs", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)], [(i % 40, i) for i in range(300)] + [(3, 4)], [(5, 5)]])
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = roots(300, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in links.components(edges).collect()} == {x: want[x] for x in linked}


@pytest.mark.parametrize("heavy", [1, 7, 1000])
def test_look_ups_of_hubs(spark, heavy):
    found = spark.range(40).select(F.col("id").alias("node"), (F.col("id") * 10).alias("m"), F.when(F.col("id") == 3, 500).otherwise(5).alias("n"))
    rows = spark.createDataFrame([(3, i) for i in range(500)] + [(i, i) for i in range(60)], "k bigint, x bigint")
    got = sorted(map(tuple, links.looked_up(rows, "k", found, heavy).collect()))
    assert got == sorted((k, x, 10 * k) for k, x in map(tuple, rows.collect()) if k < 40)
    assert links.heavy_from(10) == 64 and links.heavy_from(10**9) == 20_000


def test_counts_of_many_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(links, "HEAVY", 3)
    df = spark.range(400).select((F.col("id") % 7).alias("k"), "id").where("k <> 6 or id < 20").union(spark.range(50).select(F.lit(9).cast("bigint"), F.col("id") + 1000))
    want = {r.k: r.n for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    heavy, n, total = links.heavy_keys(df, ["k"], 10)
    out = links.with_counts(df, ["k"], heavy, n, total).collect()
    assert n == 7 and len(out) == df.count() and all(r.entries == (want[r.k] if want[r.k] > 10 else None) for r in out)


def test_blocks_meet_every_pair_once(spark):
    df = spark.range(60).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")

    def run(batches):
        import pyarrow as pa

        for rows, number in links.whole_groups(batches, ["k", "low_block", "high_block"]):
            ids, own, low, high = (rows.column(c).to_numpy() for c in ("id", "own_block", "low_block", "high_block"))
            for i, j in links.pairs(number, own, low, high):
                yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    for most in (4, 100):
        got = sorted(map(tuple, links.in_blocks(df, ["k"], F.col("id"), most).mapInArrow(run, "a bigint, b bigint").collect()))
        assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if (a % 3 == 0) == (b % 3 == 0)]


def slow_fingerprint(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_a_slow_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    texts = [r.text for r in docs] + ["", " \t\n", "a", "A b", "Ä Öx\x85y z É", "a a a a a", "\x1c x\x0by z w", "İ ſ K"]
    for words in (3, 5):
        assert [simhash.fingerprint(t.encode(), words) for t in texts] == [slow_fingerprint(t, words) for t in texts]


@pytest.mark.parametrize("block", [3, 8, 2048])
@pytest.mark.parametrize("joint", [None, 4])
def test_simhash_links(spark, monkeypatch, block, joint):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for f in fps[:60]:
        g = f
        for _ in range(4):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert len(pairs) > 50
    edges = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp bigint"), joint=joint)
    at = {f: i for i, f in enumerate(signed)}
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in edges.collect()]) == roots(len(fps), pairs)


def test_simhash_documents(spark):
    rows = [(1, "a b c d e f g h"), (2, "A  B c\td e f g h"), (3, None), (4, ""), (5, "\n"), (6, "x y"), (None, "x y"), (7, "x y"), (7, "x y"), (8, "word " * 30_000), (9, "é Ä b"), (None, "only null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("fp", "root", "node", "posting")})
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    of = {r.doc_id: r for r in out if r.doc_id is not None}
    assert (of[1].component_id, of[2].component_id) == (1, 1) and {of[i].component_id for i in (3, 4, 5)} == {3} and of[3].fp == 0 and of[7].component_id == 6
    assert sorted(((r.component_id is None) for r in out if r.doc_id is None)) == [False, True]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.linked(docs, bits=8)


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8))
    near = np.repeat(base[:12], 12, 0) + rng.standard_normal((144, 8)) * 0.12
    x = np.vstack([base, near, base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD + [(9100, [1.0, 2.0], 0)]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows), recall=0.9999).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert [out[i].n_links for i in range(len(x))] == close.sum(1).tolist()
    want = roots(len(x), zip(*np.nonzero(close)))
    assert [out[i].component_id for i in range(len(x))] == want and all(out[i].kept == (want[i] == i) for i in range(len(x)))
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9100):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert embedding_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.1], 0), (None, [1.0, 0.1], 0), (4, [0.0, 1.0], 0), (None, [-1.0, 0.0], 0)]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows), recall=0.9999).collect())
    assert out == [(0, 0, 0, False), (0, 4, 1, False), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True)]


def test_sketches_never_lose_a_pair():
    rng = np.random.default_rng(9)
    for dim, spread in ((3, 0.1), (64, 0.04), (300, 0.02)):
        a = rng.standard_normal((2000, dim))
        a[::3, 1:] *= 0.01
        b = a + rng.standard_normal(a.shape) * spread * np.linalg.norm(a, axis=1, keepdims=True)
        unit = np.vstack([a, b]) / np.linalg.norm(np.vstack([a, b]), axis=1, keepdims=True)
        p, q = np.arange(2000), np.arange(2000, 4000)
        cosine = (unit[p] * unit[q]).sum(1)
        may = embedding_dedup.may_reach(*embedding_dedup.read_sketches(embedding_dedup.sketches(unit), dim), p, q, 0.95)
        assert may[cosine >= 0.95].all() and not may[cosine < 0.9].any() and 0 < (cosine >= 0.95).sum()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9505 * a + math.sqrt(1 - 0.9505**2) * b
    k, tables = embedding_dedup.plan_tables(50_000, 0.95, 0.99, 2.0, 50)
    met = (embedding_dedup.codes(a, k, tables, 2.0, 7) == embedding_dedup.codes(near, k, tables, 2.0, 7)).any(1)
    assert met.mean() > 0.98


def best(rows, k=5, every=50):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted((-int(c @ q), j) for other, (j, c) in enumerate(good) if other != at and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("groups", [(16, 2, 4), (8192, 2048, 2048)])
def test_top_k(spark, monkeypatch, groups):
    for name, n in zip(("CANDIDATES", "QUERIES", "FIRST"), groups):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)) * np.exp(rng.standard_normal((300, 1)))
    x[200:] = x[:100] + rng.standard_normal((100, 8)) * 0.01
    x[150:160] = x[150]  # ties
    rows = [(i * 5, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))] + BAD + [(9150, [0.0] * 8, 0), (9200, [1.0, 2.0], 0), (9250, [1.0, 2.0, 3.0], 0), (9300, [2.0, 1.0, 3.0], 0)]
    rows += [(0, x[0].tolist(), 0), (0, x[7].tolist(), 0), (35, x[7].tolist(), 1), (250, x[50].tolist(), 0)]  # ids that repeat, with equal and with other vectors
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == best(rows)
    assert topk.top_k(vectors(spark, rows).limit(0)).count() == 0


def test_top_k_of_two_dimensions(spark, monkeypatch):
    """First bounds from parts of buckets, without a window over all rows."""
    monkeypatch.setattr(topk, "FIRST", 24)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=(8, 3)[i % 2]) * (1 if i % 3 else 2)).astype(np.float32).tolist(), 0) for i in range(700)]
    out = topk.top_k(vectors(spark, rows))
    want = []
    for dim in (8, 3):
        own = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if len(v) == dim]
        for i, q in own:
            if i % 50 == 0:
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-int(q @ v), j) for j, v in own if j != i)[:5])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Window [dim" not in out._jdf.queryExecution().toString()


def test_blocks_of_queries():
    needed = np.array([0.0] * 500 + list(range(1, 501)), float)
    lower, at, blocks = topk.blocks_of(needed, 100.0, 2000)
    assert lower[0] == 0 and blocks[0] == 25 and (np.diff(lower) > 0).all() and (at == np.cumsum(blocks) - blocks).all() and blocks.sum() == 50
    assert [x.tolist() for x in topk.blocks_of(np.array([0.0]), 3.0, 2000)] == [[0.0], [0], [1]]


def test_products_are_exact():
    x, q = np.array([[2**40, 1]]), np.array([2**20, 1])
    assert topk.products(x, q).tolist() == [2**60 + 1]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40]]), np.array([2**40]))


PAGES = [(1, "http://a/é\n", "x" * 200), (5, "http://b", "x" * 200), (3, None, "x" * 200), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 50), (10, "u", "é" * 50), (None, "u", "y" * 150), (11, "u", "y" * 150), (12, "u", "z" * 3_000_000), (13, "u", "WARC/1.1\r\n\r\n" + "q" * 100)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "salt", "n", "first_id")})


def test_warc_round_trip(spark):
    out = {r.page_id: r for r in warc.round_trip(pages(spark)).collect()}
    assert len(out) == len(PAGES)
    for i, _, html in PAGES:
        r = out[i]
        assert r.payload_bytes == len((html or "").encode()) and (r.record_type == "revisit") == (i in (3, 5, 10) or i is None)
        assert r.record_type == "revisit" or bytes(r.payload) == (html or "").encode()
    assert {i: out[i].refers_to for i in (3, 5, 10, 1, None)} == {3: 1, 5: 1, 10: 9, 1: None, None: 11}
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_of_repeated_pages_one_is_the_response(spark, monkeypatch):
    rows = [(1, "u", "x" * 200)] * 3 + [(1, "v", "x" * 200), (2, "u", "x" * 200), (None, "u", "x" * 200), (4, "u", "x")] + [(4, "u", "x")] + [(None, "n", "z" * 300)] * 2 + [(9, None, None)] * 2
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (200_000, 0):
        monkeypatch.setattr(warc, "COPIED", most)
        out = warc.round_trip(given).collect()
        assert len(out) == len(rows)
        kinds = sorted((r.record_type, r.page_id or 0, r.refers_to or 0) for r in out if r.payload_digest == warc.hashlib.sha256(b"x" * 200).hexdigest())
        assert kinds == [("response", 1, 0)] + [("revisit", i, 1) for i in (0, 1, 1, 1, 2)]
        assert all(r.record_type == "response" for r in out if r.page_id in (4, 9) or r.payload_bytes == 300)


def test_warc_digests_and_ids(spark, tmp_path):
    warc.write(pages(spark).union(pages(spark)), f"file://{tmp_path}/a").collect()
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    out = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert len(out) == 2 * len(PAGES) and all(r.payload_digest == warc.hashlib.sha256(texts[r.page_id]).hexdigest() for r in out)
    heads = [head for p in (tmp_path / "a").glob("*.warc.gz") for _, head, _ in warc.records(warc.fs.LocalFileSystem(), str(p), 0, p.stat().st_size, p.stat().st_size)]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= set(ids)


@pytest.mark.parametrize("split", [1 << 20, 4000])
def test_a_damaged_record_is_an_error(spark, tmp_path, split):
    members = [warc.record("response", i, f"http://h/{i}", bytes(np.random.default_rng(i).integers(0, 256, 500, np.uint8)), warc.hashlib.sha256(bytes(np.random.default_rng(i).integers(0, 256, 500, np.uint8))).hexdigest(), None) for i in range(40)]
    raw, at = b"".join(members), sum(map(len, members[:20]))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    assert warc.read(spark, f"file://{tmp_path}", split).count() == 40
    for place in (at, at + 1, at + 12, at + 300, at + len(members[20]) - 6):
        (tmp_path / "a.warc.gz").write_bytes(raw[:place] + bytes([raw[place] ^ 0x55]) + raw[place + 1 :])
        with pytest.raises(Exception, match="damaged at byte"):
            warc.read(spark, f"file://{tmp_path}", split).collect()


def test_archives_are_read_once(tmp_path):
    raw = b"".join(warc.record("response", i, f"http://h/{i}", b"%d" % i * 40, warc.hashlib.sha256(b"%d" % i * 40).hexdigest(), None) for i in range(3000))
    (tmp_path / "a.warc.gz").write_bytes(raw)

    class Counted:
        def __init__(self):
            self.file, self.read_bytes = open(tmp_path / "a.warc.gz", "rb"), 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.read_bytes += n
            return self.file.read(n)

    class Store:
        def open_input_file(self, _):
            self.source = Counted()
            return self.source

    store, total, found, step = Store(), 0, 0, 100_000
    for a in range(0, len(raw), step):
        found += sum(1 for _ in warc.records(store, "a", a, min(a + step, len(raw)), len(raw)))
    assert found == 3000
    store = Store()
    assert sum(1 for _ in warc.records(store, "a", 0, len(raw), len(raw))) == 3000 and store.source.read_bytes < 1.5 * len(raw)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_warc_splits_own_each_record_once(spark, tmp_path, split):
    raw = b"".join(warc.record("response", i, f"http://h/{i}", b"\x1f\x8b\x08" * (i % 7) + bytes([i % 256]) * 50, warc.hashlib.sha256(b"\x1f\x8b\x08" * (i % 7) + bytes([i % 256]) * 50).hexdigest(), None) for i in range(60))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = warc.read(spark, f"file://{tmp_path}", split).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, 3 * (i % 7) + 50) for i in range(60)]


def test_warc_header_of_any_length(spark):
    given = spark.createDataFrame([(1, "http://h/" + "a" * 1_200_000, "x" * 50), (2, "http://h/" + "é" * 400_000, "y" * 50)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, bytes(r.payload)) for r in warc.round_trip(given).collect()) == [(1, b"x" * 50), (2, b"y" * 50)]


def test_warc_damage_is_seen(spark, tmp_path):
    raw = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\n\r\nabc\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(raw)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, f"file://{tmp_path}").collect()
