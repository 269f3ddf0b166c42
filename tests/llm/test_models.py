"""Classifiers by their held-out rows, and the pipeline's stages on planted documents."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import bpe, registry

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label, modulus, remainder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect()]
    for r in rows[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    found = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    return np.array(found)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_held_out(spark):
    y, p, s = held_out(spark, registry.op9_quality_classifier, "quality", 3, 1).T
    assert len(y) > 1000 and (y == p).mean() > 0.98 and auc(y, s) > 0.99


def test_toxicity_held_out(spark):
    y, p, s = held_out(spark, registry.op4_toxicity, "toxic", 5, 0).T
    assert p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.02 and auc(y, s) > 0.95


def test_language_held_out(spark):
    rows = registry.op5_lm_scoring(spark, SF).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score - r.base_score for r in rows) / n > 0.14


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The documents of sf0.01, each source of removal planted once, beside odd rows."""
    folder = tmp_path_factory.mktemp("planted")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(4)
    prose = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    a, b, passage = prose(300), prose(250), prose(70)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    texts = [
        (10_001, " ".join(a)), (10_002, " ".join(a)), (10_003, " ".join([*a[:100], "other", *a[101:]])),
        (10_004, " ".join([*b[:100], *passage, *b[100:]])), (10_005, " ".join([*prose(120), *passage, *prose(120)])),
        (10_006, " ".join([*prose(60), item, *prose(60)])), (10_007, None), (10_008, ""), (None, " ".join(prose(80))), (10_009, "  two\twords "),
    ]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], docs.schema)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder), {i: t for i, t in texts}, " ".join(passage)


def test_pipeline_stages(spark, planted):
    folder, texts, passage = planted
    docs, kept = registry.table(spark, folder, "documents"), {}
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store.written(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
    toxic = {r.doc_id for r in registry.table(spark, folder, "labels").where("toxic = 1").collect()}
    gone = set(before) - set(kept["toxicity"])
    assert gone and len(gone & toxic) >= 0.5 * len(gone & {r.doc_id for r in registry.table(spark, folder, "labels").collect()})
    assert set(texts) <= set(kept["toxicity"])
    assert set(kept["toxicity"]) - set(kept["minhash_near_dedup"]) >= {10_002, 10_003}
    assert {10_001, 10_004, 10_005, 10_006, 10_007, 10_008, None, 10_009} <= set(kept["minhash_near_dedup"])
    # windows of 50 words that start in an earlier document go, by brute force over what the stage got
    first, words = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in kept["minhash_near_dedup"].items()}
    for i, w in words.items():
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        want = kept["minhash_near_dedup"][i] if all(keep) else " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert kept["substring_dedup"][i] == want
    assert passage in kept["substring_dedup"][10_004] and passage not in kept["substring_dedup"][10_005]
    # documents that hold ten words of an item, or a shorter item, go
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[p : p + min(10, len(w))]) for r in registry.table(spark, folder, "benchmark").collect() for w in [split(r.text)] if w for p in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    clean = {i for i, t in kept["substring_dedup"].items() for w in [split(t)] if not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))}
    assert set(kept["benchmark_decontamination"]) == clean and 10_006 not in clean
    t = bpe.tokenizer(registry.byte_bpe())
    assert kept["bpe"].keys() == clean
    for r in docs.collect():
        text = kept["benchmark_decontamination"][r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids and r.text == text and 4 * r.n_tokens == len(r.ids)


def test_pipeline_on_an_empty_table(spark, planted):
    folder, _, _ = planted
    docs = registry.table(spark, folder, "documents").where("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store.written(stage(spark, docs, folder), name)
        assert docs.count() == 0
