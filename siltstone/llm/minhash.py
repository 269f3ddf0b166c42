"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is its five-word shingles (all its words where it has fewer), each weighted by its count times the
mean over its words of ln(1 + documents / documents with the word). Spark counts the documents of every word; the words
of most documents, up to `WORDS`, are broadcast, and all rarer ones have the weight of a word of as many documents as
the rarest of those. Documents of one word sequence are one text. Consistent samples of each text, `ROWS` to a
band, deal texts into `BANDS` tables of buckets. In each bucket every text is compared with the smallest one.
Buckets that hold several components after that are gone through in pairs of blocks of about `BLOCK` texts and
`BLOCK_BYTES`, texts at hand: every two texts of different components are compared, one by one or, where these are
more than `MANY` a text, by matrix products, and then only a forest of the sure links leaves the block. A link is only
left out where its ends are in one component anyway; no task holds a whole large bucket. Every link is verified on
whole texts.

A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**4)**12 = 0.998. All pairs of a bucket are
compared, none is left out for its samples.

Words are runs without ASCII white space, unchanged. Texts without words, null texts and rows with a null id
link with nothing. Rows that repeat an id belong to their texts' classes each. A very long text is a slice of its own; an
empty table gives no rows. Only the id and the text are read to find classes, and `remove` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import components, rows, store, textvec, words

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 4
#: Words whose number of documents is broadcast, and words that a task counts before it hands them on.
WORDS, COUNTED = 1 << 20, 1 << 19
#: Texts and bytes of texts in a block, and pairs a text from which a block is dense.
BLOCK, BLOCK_BYTES, MANY = 1024, 16 << 20, 4
#: Features that pairs compared at once have together.
PAIRED = 1 << 20
KEYS = "band", "bucket", "lo", "hi"
_BASE = 0xE7037ED1A0B428DB | 1
_rng = np.random.default_rng(11)
_R, _LNC, _BETA = (x.astype(np.float32) for x in (_rng.gamma(2, 1, 1 << 16), np.log(_rng.gamma(2, 1, 1 << 16)), _rng.random(1 << 16)))
SIGNED = T.StructType([T.StructField("words", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = textvec.word_spans(data, offsets, textvec.SPACED)
    return textvec.hash_words(data, starts, ends), first


def document_counts(texts: DataFrame) -> DataFrame:
    """Columns word (hash) and n, in how many texts (first column) it occurs."""

    def run(batches):
        seen = words.Counts()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.hashes[: seen.n]), pa.array(seen.c)], names=["word", "n"])

        for batch in batches:
            data, offsets = textvec.utf8(batch.column(0))
            for a, b in textvec.slices(offsets):
                h, first = words_of(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a])
                doc = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(first))
                # once a text: the same word of the same text has the same mixture
                _, at = np.unique(textvec.mix(h + doc * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                seen.take(h[at].view(np.int64))
                if seen.n >= COUNTED:
                    yield out()
                    seen = words.Counts()
        if seen.n:
            yield out()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Idf:
    """Weights of words by their hashes; `rest` is the number of documents that all other words count as having."""

    def __init__(self, documents: int, word: np.ndarray, n: np.ndarray, rest: int):
        self.places = words.Places()
        self.places.add(word)
        self.weights = np.log1p(documents / np.append(n, max(rest, 1))).astype(np.float32)

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.weights[self.places.find(h.view(np.int64))]


def weights(texts: DataFrame, most: int = WORDS) -> Idf:
    table = store.written(document_counts(texts), "documents-of-words")
    held, least = 0, None
    classes = table.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()
    for n, of in classes:
        if held + of > most:
            break
        held, least = held + of, n
    top = table.where(F.col("n") >= least).toArrow() if least else table.limit(0).toArrow()
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    del top
    pa.default_memory_pool().release_unused()
    # where even the words of most documents are too many, all have the same weight
    return Idf(texts.count(), word, n, least or (classes[0][0] if classes else 1))


def features(h: np.ndarray, first: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all shingles, in order of text and shingle."""
    n = np.diff(first)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    key = textvec.hash_ranges(textvec.prefix(h, _BASE), at, at + size[text], _BASE)
    key = text.astype(np.uint64) << np.uint64(42) | key >> np.uint64(22)
    key, where, tf = np.unique(key, return_index=True, return_counts=True)
    weight = idf.of(h)
    text, at = text[where], at[where]
    total = weight[at].astype(np.float64)
    for k in range(1, SHINGLE):
        inside = size[text] > k
        total += np.where(inside, weight[np.where(inside, at + k, 0)], 0) if len(weight) else 0
    return text, key & np.uint64((1 << 42) - 1), tf * (total / size[text])


def bands(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys of each text, all keys): BANDS for a text with words, else none; a key is ROWS samples of 16 bits."""
    has = np.bincount(text, minlength=n) > 0
    if not len(text):
        return np.zeros(n, np.int64), np.zeros(0, np.uint64)
    head = np.flatnonzero(np.diff(text, prepend=-1))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(text))))
    lnw = np.log(weight).astype(np.float32)
    out = np.zeros((len(head), BANDS), np.uint64)
    low = np.uint64(0xFFFF)
    for j in range(BANDS * ROWS):
        x = (shingle + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        r, beta = _R[(x & low).astype(np.int32)], _BETA[(x >> np.uint64(16) & low).astype(np.int32)]
        t = np.floor(lnw / r + beta)
        a = _LNC[(x >> np.uint64(32) & low).astype(np.int32)] - r * (t - beta + 1)
        best = np.minimum.reduceat(a, head)
        hit = np.flatnonzero(a == best[of])
        hit = hit[np.flatnonzero(np.diff(of[hit], prepend=-1))]
        sample = textvec.mix(shingle[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        out[:, j // ROWS] |= (sample & low) << np.uint64(16 * (j % ROWS))
    return np.where(has, BANDS, 0), out.ravel()


def similarity(a: tuple, b: tuple, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the n pairs of texts of two feature lists."""
    key = [f[0].astype(np.uint64) << np.uint64(42) | f[1] for f in (a, b)]
    _, i, j = np.intersect1d(*key, assume_unique=True, return_indices=True)
    both = np.bincount(a[0][i], np.minimum(a[2][i], b[2][j]), minlength=n)
    total = np.bincount(a[0], a[2], minlength=n) + np.bincount(b[0], b[2], minlength=n)
    return both / np.maximum(total - both, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, table, least: float) -> DataFrame:
    """pairs (a, b) whose texts (node, text) are at least that similar."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                f = [features(*words_of(raw[int(off[0]) : int(off[-1])], off - off[0]), table.value) for raw, off in (textvec.utf8(part.column(c)) for c in (2, 3))]
                yield part.select([0, 1]).filter(pa.array(similarity(*f, len(part)) >= least - 1e-12))

    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def grouped(rows_: DataFrame, schema: str, fn) -> DataFrame:
    """The Arrow tables that fn gives for the rows of each KEYS, which lie next to each other; the keys come first in rows_."""

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            ids = [held.column(c).to_numpy() for c in range(len(KEYS))]
            cut = np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in ids])) + 1
            for a, b in zip([0, *cut[:-1].tolist()], cut.tolist()):
                yield fn(held.slice(a, b - a))
            held = held.slice(int(cut[-1])) if len(cut) else held
        if held is not None and len(held):
            yield fn(held)

    return rows_.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


class Block:
    """Texts of a pair of blocks of one bucket."""

    def __init__(self, batch: pa.RecordBatch):
        self.band, self.bucket, self.lo, self.hi = (batch.column(k)[0].as_py() for k in range(4))
        side, self.node, self.component = (batch.column(k).to_numpy() for k in (4, 5, 6))
        self.key = np.ascontiguousarray(batch.column(7).flatten().to_numpy(zero_copy_only=False)).reshape(len(side), BANDS)
        self.one = self.lo == self.hi
        self.first, self.second = (np.arange(len(side)),) * 2 if self.one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def new(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of rows whose ends are in different components and share no earlier band."""
        use = self.component[x] != self.component[y]
        if self.one:
            use &= x < y
        x, y = x[use], y[use]
        use = (self.key[x] == self.key[y]).argmax(1) == self.band
        return x[use], y[use]

    def agreeing(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of rows to compare one by one; None where they are more than `MANY` a row."""
        found, held = [(np.zeros(0, np.int64),) * 2], 0
        for at in range(0, len(self.first), 64):
            i = self.first[at : at + 64]
            found.append(self.new(np.repeat(i, len(self.second)), np.tile(self.second, len(i))))
            held += len(found[-1][0])
            if held > MANY * len(self.node):
                return None
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def similar(self, f: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of rows that are similar; f: their features, in order of text."""
        text, shingle, weight = f
        total = np.bincount(text, weight, minlength=len(self.node))
        # what two texts share is no more than the lighter one
        use = np.minimum(total[x], total[y]) >= (least - 1e-6) * np.maximum(total[x], total[y])
        x, y = x[use], y[use]
        start = np.searchsorted(text, np.arange(len(self.node) + 1))
        size = np.diff(start)
        ends = np.cumsum(size[x] + size[y])
        keep, a = np.zeros(len(x), bool), 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRED, "right")))
            sides = []
            for z in (x[a:b], y[a:b]):
                at = textvec.expand(z, start)
                sides.append((np.repeat(np.arange(b - a), size[z]), shingle[at], weight[at]))
            keep[a:b] = similarity(*sides, b - a) >= least - 1e-12
            a = b
        return x[keep], y[keep]

    def links(self, f: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of similar rows that connect all that new pairs of this block connect."""
        found = self.agreeing()
        return self.similar(f, *(self.linked(f, least) if found is None else found), least)

    def linked(self, f: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs of rows that are surely similar, and all pairs that may be; f: their features."""
        text, shingle, weight = f
        n = len(self.node)
        # the smaller of two weights is the sum of the steps up to it: products of 0-1 columns, one a step
        order = np.lexsort((weight, shingle))
        text, shingle, weight = text[order], shingle[order], weight[order]
        head = np.ones(len(text), bool)
        head[1:] = shingle[1:] != shingle[:-1]
        step = head.copy()
        step[1:] |= weight[1:] != weight[:-1]
        column = np.cumsum(step) - 1
        low = column[np.maximum.accumulate(np.where(head, np.arange(len(text)), 0))]
        at = np.flatnonzero(step)
        height = weight[at] - np.where(head[at], 0, weight[at - 1])
        up = column - low + 1
        row, col = np.repeat(text, up), np.repeat(low - (np.cumsum(up) - up), up) + np.arange(int(up.sum()))
        shared = np.flatnonzero(np.bincount(col, minlength=len(at)) > 1)
        place = np.full(len(at), -1)
        place[shared] = np.arange(len(shared))
        use = place[col] >= 0
        row, col = row[use], place[col[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        root = np.sqrt(height[shared]).astype(np.float32)
        both = np.zeros((len(self.first), len(self.second)), np.float32)
        for c in range(0, len(shared), 2048):
            a, b = np.searchsorted(col, (c, c + 2048))
            m = np.zeros((n, 2048), np.float32)
            m[row[a:b], col[a:b] - c] = root[col[a:b]]
            both += m[self.first] @ m[self.second].T
        total = np.bincount(text, weight, minlength=n).astype(np.float32)
        both /= np.maximum(total[self.first][:, None] + total[self.second][None, :] - both, 1e-30)
        x, y = np.nonzero(both >= least - 1e-3)
        sure = both[x, y] >= least + 1e-3
        maybe, sure = (self.new(self.first[x[k]], self.second[y[k]]) for k in (~sure, sure))
        up, forest = list(range(n)), []

        def find(e):
            while up[e] != e:
                up[e] = e = up[up[e]]
            return e

        for e, (i, j) in enumerate(zip(*(s.tolist() for s in sure), strict=True)):
            i, j = find(i), find(j)
            if i != j:
                up[j] = i
                forest.append(e)
        return tuple(np.concatenate([s[forest], m]) for s, m in zip(sure, maybe, strict=True))


def across(left: DataFrame, texts: DataFrame, table, least: float) -> DataFrame:
    """Links (a, b) of rows (band, bucket, blocks, node, component, bands): of one bucket, of different components."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = left.join(texts, "node").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "component", "bands", "text")

    def linked(batch):
        block = Block(batch)
        data, offsets = textvec.utf8(batch.column(8))
        parts = [(a, features(*words_of(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]), table.value)) for a, b in textvec.slices(offsets)]
        f = tuple(np.concatenate([p[k] + a if k == 0 else p[k] for a, p in parts]) for k in range(3))
        x, y = block.links(f, least)
        a, b = block.node[x], block.node[y]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return grouped(dealt, "a long, b long", linked)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Columns doc_id, key (hash of the text) and class_id (smallest id of the class)."""
    sc = docs.sparkSession.sparkContext
    value = F.col(f"`{text}`").cast("string")
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(value).alias("key"), value.alias("text")).where("doc_id IS NOT NULL")
    table = sc.broadcast(weights(src.select("text")))

    def make():
        idf = table.value

        def work(data, offsets):
            h, first = words_of(data, offsets)
            n, keys = bands(*features(h, first, idf), len(offsets) - 1)
            return [pa.array(textvec.hash_sequences(h, first).view(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), rows.lists(n, pa.array(keys.view(np.int64)))]

        return work

    # a slice's features are packed with 22 bits for the text
    signed = store.written(rows.with_result(src, "text", SIGNED, make, carry=["doc_id", "key"]).select("row.doc_id", "row.key", F.col("res.words").alias("node"), F.col("res.bytes").alias("bytes"), F.col("res.bands").alias("bands")), "signed")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.any_value("bands").alias("bands"), F.max("bytes").alias("bytes"))
    nodes = store.written(nodes, "nodes")
    dealt = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "bucket"))
    many = dealt.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min("node").alias("center")).where("size > 1").drop("size")
    buckets = store.written(dealt.join(many, ["band", "bucket"]).select("band", "bucket", "center", "node", "bytes"), "buckets")
    near = buckets.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = store.written(src.join(near.select("node", "first.doc_id", "first.key"), ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    pairs = buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = store.written(verified(pairs, texts, table, least), "links")
    found = components.components(links)
    parts = buckets.join(found, "node", "left").select("band", "bucket", "node", "bytes", F.coalesce("component", "node").alias("component"))
    parts = store.written(parts, "parts")
    open_ = parts.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("of"), F.sum("bytes").alias("bytes")).where("lo < hi").select("band", "bucket", F.ceil(F.greatest(F.col("of") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    left = parts.drop("bytes").join(open_, ["band", "bucket"]).join(nodes.select("node", "bands"), "node")
    links = links.unionByName(store.written(across(left, texts, table, least).distinct(), "cross"))
    found = components.components(links)
    placed = nodes.select("node", F.size("bands").alias("n"), F.col("first.doc_id").alias("lowest")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("class_id"))
    by_node = store.written(placed.join(lowest, "component").select("node", "n", "class_id"), "classes")
    return signed.select("doc_id", "key", "node").join(by_node, "node").select("doc_id", "key", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, the one of the smallest id; columns as they were."""
    gone = classes(docs, doc_id, text).where("doc_id <> class_id").select("doc_id", "key").distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("key"))
    return held.join(gone, ["doc_id", "key"], "left_anti").select("row.*")
