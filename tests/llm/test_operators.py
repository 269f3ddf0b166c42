"""Operators on small planted tables: nulls, empty and repeated rows, clashing names, and results by brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from siltstone.llm import bpe, decontaminate, html, language, minhash, registry, repair, substrings, vectors

SCHEMA = "doc_id long, text string, row string, res string, spans int"
PATH = registry.byte_bpe()


def prose(seed: int, n: int) -> list[str]:
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 300), prose(2, 200)
    near = a[:150] + ["changed"] + a[151:]
    texts = [(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(b + a[20:90])), (4, " ".join(b[:120])), (5, None), (6, ""), (7, " \n "), (8, "a<|endoftext|> b'll ก 12"), (9, "  two  words "), (None, " ".join(a)), (1, " ".join(a)), (10, " ".join(["again"] * 400)), (11, " ".join(["again"] * 400)), (12, " ".join(prose(3, 20000)))]
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], SCHEMA)


def test_bpe_round_trip(docs):
    t = bpe.tokenizer(PATH)
    for limit in (bpe.BROADCAST_BYTES, 0):
        found = bpe.decode(bpe.encode(docs, PATH, broadcast_bytes=limit), PATH).select("row.row.doc_id", "row.row.text", "row.ids", "res.text").collect()
        assert len(found) == docs.count()
        for _, text, ids, decoded in found:
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
            assert decoded == (text or "")


def test_word_borders():
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng, signs = np.random.default_rng(8), list(" '\n\t\u00a0srevltmd12\u00e9\u00b2\u201c!\u4e2d")
    texts = ["", *("".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)), "", "it's", "  ", "we'", ""]
    data, offsets = bpe.textvec.utf8(pa.array(texts))
    borders, first, unsure = bpe.words.split(data, offsets)
    found = bpe.strings(data, borders, np.arange(len(borders) - 1)).to_pylist()
    assert [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [pattern.findall(t) for t in texts]
    assert not unsure.any()
    assert bpe.words.split(*bpe.textvec.utf8(pa.array(["a", "\u0e01", ""])))[2].tolist() == [False, True, False]


def test_repair_files(docs, spark):
    coded = bpe.encode(docs, PATH).selectExpr("row.doc_id", "ids")
    found = repair.read(repair.write(coded, shard_tokens=2000)).orderBy("start").collect()
    want = sorted((-1 if r[0] is None else r[0], bytes(r[1])) for r in coded.collect())
    assert sorted((-1 if r[0] is None else r[0], bytes(r[2])) for r in found) == want
    ends = [r[1] + len(r[2]) // 4 for r in found]
    assert sorted(r[1] for r in found) == sorted([0, *sorted(ends)[:-1]])
    assert repair.read(repair.write(coded.where("doc_id = 99"))).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(0)
    texts = [np.tile(rng.integers(0, 6, 50), n)[: 20 * n].astype(np.uint32) for n in (0, 250, 1, 150)]
    shard = repair.Shard(repair.pack([1, 2, None, 4], texts))
    assert shard.ids == [1, 2, None, 4]
    assert len(shard.sequence) < 4000
    for k, t in enumerate(texts):
        assert (shard.document(k) == t).all()
    assert (shard.span(1234, 1300) == np.concatenate(texts)[1234:1300]).all()


def test_substrings_by_brute_force(docs):
    found = substrings.dedup(docs).select("row.doc_id", "row.text", "res.*").collect()
    assert len(found) == docs.count()
    words = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in found]
    first = {}
    for i, w in words:
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    for r, (i, w) in zip(found, words, strict=True):
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k))


def test_minhash_classes(docs):
    found = {(r.doc_id, r.class_id) for r in minhash.classes(docs).collect()}
    assert {(1, 1), (2, 1), (10, 10), (11, 10), (3, 3), (4, 4), (6, 6), (7, 7)} <= found
    assert minhash.remove(docs).where("doc_id IN (2, 11)").count() == 0
    assert minhash.classes(docs.where("doc_id = 99")).count() == 0


def test_minhash_dense_block():
    base, rng = prose(5, 120), np.random.default_rng(6)
    texts = [" ".join([w if rng.random() > 0.012 else "x" + w for w in base] + base[: rng.integers(0, 30)]) for _ in range(60)]
    n = len(texts)
    f = minhash.features(*minhash.words_of(*minhash.textvec.utf8(pa.array(texts))), minhash.Idf(60, np.arange(3, dtype=np.int64), np.array([30, 20, 10]), 10))
    pick = lambda t: (np.zeros((f[0] == t).sum(), int), f[1][f[0] == t], f[2][f[0] == t])
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if minhash.similarity(pick(a), pick(b), 1)[0] >= 0.8}
    columns = [pa.array([0] * n, pa.int32()), pa.array([7] * n), *(pa.array([0] * n, pa.int32()) for _ in range(3)), pa.array(range(n)), pa.array(range(n)), pa.array([[1] * minhash.BANDS] * n, pa.list_(pa.int64()))]
    block = minhash.Block(pa.RecordBatch.from_arrays(columns, names=["band", "bucket", "lo", "hi", "side", "node", "component", "bands"]))
    found = set(zip(*(x.tolist() for x in block.linked(f, 0.8)), strict=True))

    def parts(pairs):
        lab = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                lab[a] = lab[b] = min(lab[a], lab[b])
        return lab

    assert 0 < len(want) < n * (n - 1) // 2
    assert len(found) < 2 * n and found <= want | {p for p in found if abs(minhash.similarity(pick(p[0]), pick(p[1]), 1)[0] - 0.8) < 2e-3}
    assert parts(found & want) == parts(want)
    assert block.agreeing() is None


def test_minhash_block_leaves_no_pair_out_for_its_samples():
    # alike by their texts, but in the four samples of one band only: fewer than any number of samples that a filter could ask for
    base = prose(5, 120)
    texts = [" ".join(base), " ".join([*base[:60], "other", *base[61:]]), " ".join(prose(7, 120))]
    f = minhash.features(*minhash.words_of(*minhash.textvec.utf8(pa.array(texts))), minhash.Idf(60, np.arange(3, dtype=np.int64), np.array([30, 20, 10]), 10))
    assert minhash.similarity(*((np.zeros((f[0] == t).sum(), int), f[1][f[0] == t], f[2][f[0] == t]) for t in (0, 1)), 1)[0] >= 0.8
    samples = np.arange(3 * minhash.BANDS * minhash.ROWS, dtype=np.uint16).reshape(3, minhash.BANDS, minhash.ROWS)
    samples[:, 0] = 7
    columns = [pa.array([0] * 3, pa.int32()), pa.array([7] * 3), *(pa.array([0] * 3, pa.int32()) for _ in range(3)), pa.array(range(3)), pa.array(range(3)), pa.array(samples.view(np.int64).reshape(3, -1).tolist(), pa.list_(pa.int64()))]
    block = minhash.Block(pa.RecordBatch.from_arrays(columns, names=["band", "bucket", "lo", "hi", "side", "node", "component", "bands"]))
    x, y = block.agreeing()
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(0, 1), (0, 2), (1, 2)}
    assert [k.tolist() for k in block.links(f, 0.8)] == [[0], [1]]


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(1, " ".join(prose(2, 200)[30:45])), (2, "two words"), (3, None), (4, ""), (None, "again")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, items).selectExpr("row.doc_id", "res.spans", "res.matches").collect()}
    assert [tuple(s) for s in found[4].spans] == [(30, 45)] and [m.item_id for m in found[9].matches] == [2]
    assert not found[1].spans and not found[10].spans


def test_language_counts(docs):
    found = language.score(docs, (docs.doc_id != 12) | docs.doc_id.isNull()).selectExpr("row.text", "row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 and r.score < 0 and r.base_score < 0
    assert language.score(docs.where("doc_id = 99"), docs.doc_id.isNotNull()).count() == 0

def test_language_trains_on_all_texts(spark):
    # three million pairs, more than any fixed number of draws; each word but the last has one successor
    n, rng = 3000, np.random.default_rng(1)
    after = rng.permutation(n)
    texts = spark.createDataFrame([(" ".join(f"a{i} b{after[i]}" for i in rng.permutation(n)),) for _ in range(500)], "text string").repartition(4)
    word = [f"a{i}" for i in range(n)] + [f"b{i}" for i in range(n)]
    h = np.array([language.textvec.hash_text(w.encode()) for w in word], np.uint64)
    known = language.Symbols(h, np.arange(2 * n, 0, -1), 2 * n, 64)
    symbols = spark.sparkContext.broadcast(known)
    model = language.train(texts, symbols, np.full(known.n, 1 / known.n))
    assert (model.log_p(0, np.arange(n), n + after) > np.log(2 / n)).mean() > 0.99
    for k in (0, 1):
        total = np.zeros(3)
        for t in range(known.n):
            total += np.exp(model.log_p(k, np.array([0, 7, known.n]), np.full(3, t)))
        assert np.allclose(total, 1, atol=1e-3)


def test_language_learns_once_from_a_small_corpus(spark, monkeypatch):
    # as from a large one: the model is that of one pass, computed here by one learner
    rng, train, seen = np.random.default_rng(3), language.train, []

    def spy(texts, symbols, noise, *more, **names):
        seen.append((texts, symbols, noise, train(texts, symbols, noise, *more, **names)))
        return seen[-1][3]

    monkeypatch.setattr(language, "train", spy)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.zipf(1.5, 200) % 500)) for k in range(40)], "doc_id long, text string").repartition(1)
    assert language.score(docs, docs.doc_id >= 0).count() == 40
    (texts, symbols, noise, found), = seen
    want = language.Model(noise).own()
    for data, offsets in language.slices(texts.toArrow().to_batches()):
        h, first = language.tokens(data, offsets)
        want.learn(symbols.value.find(h)[0], first, np.random.default_rng([0, int(h[0] >> np.uint64(1))]))
    assert np.allclose(found.packed(), want.packed(), atol=1e-4)


def test_language_knows_words_beyond_the_commonest(spark):
    # 4,000 words of equal counts; each even one is followed by its odd one
    rng = np.random.default_rng(2)
    texts = [(k, " ".join(f"v{2 * i} v{2 * i + 1}" for i in rng.integers(0, 2000, 500))) for k in range(80)]
    tests = [(10000 + i, f"v{2 * i} v{2 * i + 1}") for i in range(2000)] + [(20000 + i, f"v{2 * i} v{2 * ((i + 9) % 2000) + 1}") for i in range(2000)]
    docs = spark.createDataFrame(texts + tests, "doc_id long, text string")
    found = {r.doc_id: r.score for r in language.score(docs, docs.doc_id < 10000).select("row.doc_id", "score").collect()}
    gain = np.array([found[10000 + i] - found[20000 + i] for i in range(2000)])
    assert gain.mean() > 0.3 and (gain > 0).mean() > 0.9


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base + rng.normal(0, 0.05, base.shape) for _ in range(6)]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, v[3].tolist()), (901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [])]
    found = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=8).collect()}
    u = np.concatenate([v, v[3:4]]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    links = near.sum(1) - 1
    ids = [*range(240), 900]
    have = np.array([found[i].n_links for i in ids])
    assert (have <= links).all() and have.sum() >= 0.9 * links.sum()
    assert all(found[i].component_id == i and found[i].n_links == 0 for i in range(901, 906))
    assert found[900].component_id == found[3].component_id


def test_vectors_recall_with_many_pivots(spark):
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    for m in (64, 600, 2048):
        pivots, a = unit(rng.normal(size=(m, 64))), unit(rng.normal(size=(600, 64)))
        o = rng.normal(size=a.shape)
        b = 0.95 * a + (1 - 0.95**2) ** 0.5 * unit(o - (o * a).sum(1)[:, None] * a)
        nodes = spark.createDataFrame([(i, 1, 64, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))], "node long, copies long, size int, vector array<double>")
        keys = {r.node: set(r.keys) for r in vectors.described(nodes, {64: pivots}).select("node", "keys").collect()}
        assert np.mean([bool(keys[i] & keys[600 + i]) for i in range(600)]) > 0.9


def test_html_templates_of_a_large_host(spark):
    pages = [(i, "http://a.b/" + str(i), f"<body><p>text {i}</p>" + ("<div>the same block</div>" if i < 40 else "<div>two of them</div>" if i < 42 else "") + "</body>") for i in range(600)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).select("row.page_id", "text").collect()}
    assert found == {i: f"text {i}" + ("\ntwo of them" if 40 <= i < 42 else "") for i in range(600)}


def test_digests(spark):
    sf = "/root/testdata/sf0.001"
    t = bpe.tokenizer(PATH)
    texts = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    one = {r.doc_id: r for r in registry.op1_bpe(spark, sf).collect()}
    seven = {r.doc_id: r for r in registry.op7_token_output(spark, sf).collect()}
    start = 0
    for i, text in texts:
        raw = bpe.to_bytes(t.encode(text or "", add_special_tokens=False).ids)
        assert one[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert (seven[i].start, seven[i].n_tokens, seven[i].ids_crc32) == (start, len(raw) // 4 + 1, zlib.crc32(raw + b"\2\0\0\0"))
        start += len(raw) // 4 + 1


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
    assert 0 < found.count() <= 200
