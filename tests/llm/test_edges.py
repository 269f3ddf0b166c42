"""Rows that are odd: nulls in any column, empty and long texts, ties, repeated rows, empty tables, columns with clashing names, and words built to collide."""

import re

import numpy as np
import pytest

from siltstone.llm import bpe, decontaminate, html, labelled, language, minhash, quality, registry, repair, substrings, textvec, toxicity, vectors, words

CLASHING = ["row", "res", "kept", "key", "ids", "spans", "host", "gone", "none", "special", "node", "_gone_id", "_gone_key", "score", "text_"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
PATH = registry.byte_bpe()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *(None if (k + len(t or "")) % 5 == 0 else f"{c}{k}" for c in CLASHING)) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{x}" for x in np.random.default_rng(3).integers(0, 9000, 200_000))
    return frame(spark, [(1, "one two three"), (1, "one two three"), (1, "other words here"), (None, "one two three"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "tie " * 60), (8, "tie " * 60), (9, "é中 " * 30)])


@pytest.fixture(scope="module")
def weights(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad junk {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    allowed = labelled.remainder("doc_id", 5) != 0
    return quality.fit(docs, labels, allowed), toxicity.fit(docs, labels, allowed)


def whole(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def apply(name, docs, spark, weights):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (None, "tie tie")], "item_id long, text string")
    if name == "bpe":
        return bpe.encode(docs, PATH).select("row.*")
    if name == "learnt bpe":
        return bpe.encode(docs, PATH, counted=False).select("row.*")
    if name == "decode":
        return bpe.decode(docs.withColumn("coded", docs.text.cast("binary").substr(1, 0)), PATH, "coded").selectExpr("row.*").drop("coded")
    if name == "substrings":
        return substrings.dedup(docs).select("row.*")
    if name == "decontaminate":
        return decontaminate.scan(docs, items).select("row.*")
    if name == "language":
        return language.score(docs, docs.doc_id.isNotNull()).select("row.*")
    if name == "in_order":
        return repair.in_order(docs)
    if name == "html":
        return html.extract(docs.withColumnsRenamed({"text": "html", "_gone_id": "url"})).select("row.*")
    return (quality.score(docs, weights[0]) if name == "quality" else toxicity.score(docs, weights[1])).select("row.*")


@pytest.mark.parametrize("name", ["bpe", "learnt bpe", "decode", "substrings", "decontaminate", "language", "in_order", "html", "quality", "toxicity"])
def test_rows_come_back_whole(spark, odd, weights, name):
    found = apply(name, odd, spark, weights)
    assert whole(found) == whole(odd)
    assert apply(name, odd.where("doc_id = 99"), spark, weights).count() == 0


def test_removals_keep_columns(spark, odd):
    left = minhash.remove(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    # of 5 and 6, and of 7 and 8, the first stays; rows that share an id and a text stay both, as do null ids
    assert ids == sorted([*((False, i) for i in (1, 1, 1, 2, 3, 4, 5, 7, 9)), (True, 0), (True, 0)])
    cut = {(r.doc_id, r.text) for r in substrings.remove(odd).collect()}
    assert substrings.remove(odd).columns == odd.columns
    assert {(1, "one two three"), (2, None), (3, ""), (4, " \n\t "), (None, None), (6, ""), (8, "")} <= cut
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove(odd, items).collect()} == {1, None, 2, 3, 4, 5, 6, 7, 8, 9}
    assert decontaminate.remove(odd, items.where("item_id = 9")).count() == odd.count()


def test_empty_tables(spark, odd):
    none = odd.where("doc_id = 99")
    assert minhash.classes(none).count() == 0 and minhash.remove(none).count() == 0 and substrings.remove(none).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.res.score for r in quality.score(odd, quality.fit(odd, labels, labelled.remainder("doc_id", 3) != 1)).collect()] == [0.5] * odd.count()
    assert all(r.res.score < 0.5 for r in toxicity.score(odd, toxicity.fit(odd, labels, labelled.remainder("doc_id", 5) != 0)).collect())


def test_repeated_and_null_vectors(spark):
    found = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>"))
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in found.collect())
    assert got == [((False, 1), 3, 1), ((False, 1), 3, 1), ((False, 2), 3, 1), ((False, 3), 0, 3), ((False, 4), 0, 4), ((False, 5), 0, 5), ((True, 0), 3, 1)]


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_built_to_collide(spark):
    """Sums of powers of an odd base are equal modulo 2**64 for a Thue-Morse word of 1,024 letters and its complement."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    assert textvec.hash_text(x.encode()) != textvec.hash_text(y.encode())
    pad = [f"p{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join([x, *pad])), (2, " ".join([y, *pad[:49]])), (3, thue_morse(2048, "u ", "v ")), (4, thue_morse(2048, "v ", "u "))], "doc_id long, text string")
    t = bpe.tokenizer(PATH)
    for counted in (True, False):
        for r in bpe.encode(docs, PATH, counted=counted).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.row.text, add_special_tokens=False).ids
    cut = {r.row.doc_id: r.res for r in substrings.dedup(docs).collect()}
    assert cut[2].n_removed == 0  # its only window differs from the first text's in one word
    item = spark.createDataFrame([(1, f"{x} p0 p1 p2 p3 p4 p5 p6 p7 p8")], "item_id long, text string")
    assert {r.row.doc_id: len(r.res.spans) for r in decontaminate.scan(docs, item).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.class_id for r in minhash.classes(docs.where("doc_id > 2")).collect()}.keys() == {3, 4}
    signs = textvec.hash_sequences(*minhash.words_of(*textvec.utf8(__import__("pyarrow").array([thue_morse(2048, "u ", "v "), thue_morse(2048, "v ", "u ")]))))
    assert signs[0] != signs[1]
    known = {r.row.doc_id: r.n_known for r in language.score(docs.where("doc_id < 3"), docs.doc_id == 1).collect()}
    assert known == {1: 62, 2: 50}  # the end and 49 words, but not y


def test_places():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    h[1::2] = h[::2] + (1 << 40)  # the same low bits
    h, p = np.unique(h), words.Places()
    for part in np.array_split(rng.permutation(h), 7):
        p.add(part)
    assert p.n == len(h) and (np.sort(p.find(h)) == np.arange(len(h))).all() and (p.hashes[p.find(h)] == h).all()
    assert (p.find(h + 1) == np.where(np.isin(h + 1, h), 0, -1)).all() or (p.find(h[:1] + 12345) == -1).all()
    c = words.Counts()
    for _ in range(3):
        c.take(np.repeat(h, 2))
    assert (c.c == 6).all()


def test_language_columns_by_brute_force(spark):
    texts = [(1, "The cat the Dog"), (2, "the bird  the"), (3, None), (4, ""), (5, "unseen cat"), (6, "the the"), (6, "the the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = language.score(docs, docs.doc_id != 5).selectExpr("row.doc_id", "row.text", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"] for i, t in texts}
    count = {}
    for i, t in texts:
        if i != 5:
            for w in tokens[i]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in found:
        want = sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(w in count for w in tokens[r.doc_id]), n)
        assert abs(r.base_score - want) < 1e-9 and r.score < 0
