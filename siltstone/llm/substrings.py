"""Substring dedup by a compacted de Bruijn graph of sampled token k-mers.

The smallest k-mer (by hash) of each window of words is an edge; a document is a path over the edges it
samples, and the run of windows that share an edge is a step of that path. An edge whose steps all read the
same words does not branch: the step is compacted to one unit, however many documents repeat it. Where steps
differ the edge branches and each of its windows is a unit, if the smallest longer k-mer inside the window (its inner
edge) is one that several documents hold. Spark joins find the smallest document of each
unit, and every occurrence in a larger document comes back as source coordinates (document, first word, word
after the last). A window has exactly one edge, given by its words alone, so the units find all repeated windows.

Bitmaps of bounded size (see bitmap) leave out most units that occur once; whatever passes them is read at its source
coordinates and grouped exactly. Equal units agree in 128 bits: a hash of all their words' bytes and the edge's.

Words are runs without ASCII white space. Null and empty texts have no words, an empty table gives no rows. Rows with a
null id are kept as they are and remove nothing; rows that repeat an id never remove each other's words. Of texts that are
all alike the one of the smallest id stays whole. A very long text is a slice of its own. Rows keep all their columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import bitmap, decontaminate, rows, store, textvec

WINDOW = 50
EDGE = 12
#: Words of an inner edge, as a percentage of a window's.
INNER = 80
_POS = np.uint64((1 << 28) - 1)
_BASE = 0xA0761D6478BD642F | 1
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(decontaminate.SPAN))])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Steps:
    """Steps of all texts of a slice: text, edge hash, first and last window, hash of the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, edge: int):
        starts, ends, self.first = textvec.word_spans(data, offsets, textvec.SPACED)
        self.data, self.starts, self.ends, self.window = data, starts, ends, window
        n = len(starts)
        self.text = self.begin = self.last = np.zeros(0, np.int64)
        self.edge = self.words = np.zeros(0, np.uint64)
        if n < window:
            return
        self.pre = textvec.prefix(textvec.hash_words(data, starts, ends), _BASE)
        at = np.arange(n - edge + 1)
        kmer = textvec.hash_ranges(self.pre, at, at + edge, _BASE)
        low = sliding_min(kmer & ~_POS | at.astype(np.uint64), window - edge + 1)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        p = np.arange(n - window + 1)
        p = p[text[p] == text[p + window - 1]]
        if not len(p):
            return
        m = (low[p] & _POS).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (m[1:] != m[:-1]) | (text[p[1:]] != text[p[:-1]])
        head = np.flatnonzero(new)
        self.begin, self.last = p[head], p[np.append(head[1:], len(p)) - 1]
        self.text, self.edge = text[self.begin], kmer[m[head]]
        self.words = textvec.hash_ranges(self.pre, self.begin, self.last + window, _BASE)

    def windows(self, branching: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(step, first word, inner edge) of all windows of branching edges."""
        many = np.flatnonzero(bitmap.maybe(branching, self.edge))
        n = self.last[many] - self.begin[many] + 1
        step = np.repeat(many, n)
        at = self.begin[step] + np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        if not len(at):
            return step, at, np.zeros(0, np.uint64)
        size = max(self.window * INNER // 100, 1)
        place = np.arange(len(self.pre) - size)
        kmer = textvec.hash_ranges(self.pre, place, place + size, _BASE)
        low = sliding_min(kmer & ~_POS | place.astype(np.uint64), self.window - size + 1)
        return step, at, kmer[(low[at] & _POS).astype(np.int64)]

    def units(self, branching: np.ndarray, inner: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, edge, unit, first word, end) of all units that may repeat; words count from the text's start."""
        one = np.flatnonzero(~bitmap.maybe(branching, self.edge) & bitmap.maybe(repeated, self.words))
        step, at, edge = self.windows(branching)
        use = bitmap.maybe(inner, edge)
        step, at = step[use], at[use]
        begin, end = np.concatenate([self.begin[one], at]), np.concatenate([self.last[one], at]) + self.window
        step = np.concatenate([one, step])
        base = self.first[self.text[step]]
        return self.text[step], self.edge[step], self.read(begin, end), begin - base, end - base

    def read(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of words start:end, joined by one space each."""
        size = self.ends - self.starts
        word = np.repeat(np.arange(len(size)), size)
        byte = np.arange(len(word)) - (np.cumsum(size) - size)[word]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        spaced = np.full(int(at[-1]), 0x20, np.uint8)
        spaced[at[word] + byte] = self.data[self.starts[word] + byte]
        raw = memoryview(spaced)
        return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at[start].tolist(), (at[end] - 1).tolist(), strict=True)], np.uint64)


def emitted(docs: DataFrame, columns: str, fn) -> DataFrame:
    """Rows that fn(ids, keys, data, offsets) gives, as arrays, for slices of docs (doc_id, key, text)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = textvec.utf8(batch.column(2))
            for a, b in textvec.slices(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                cols = fn(ids[a:b], keys[a:b], data[lo:hi], offsets[a : b + 1] - lo)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=names)

    return docs.mapInArrow(run, columns)


def smallest(keys: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """The keys once each, with their smallest and largest id."""
    order = np.lexsort((ids, keys[1], keys[0]))
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    head = np.flatnonzero(new)
    return [keys[0][head], keys[1][head], ids[head], ids[np.append(head[1:], len(ids)) - 1] if len(ids) else ids]


def repeated_spans(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """Columns doc_id, key, spans (array of start, end in words) of docs (doc_id, key, text) that hold repeated windows."""
    sc = docs.sparkSession.sparkContext
    both = F.min("lo").alias("lo"), F.max("hi").alias("hi")

    def steps(ids, keys, data, offsets):
        s = Steps(data, offsets, window, edge)
        return smallest([s.edge, s.words], ids[s.text])

    graph = store.written(emitted(docs, "edge long, words long, lo long, hi long", steps).groupBy("edge", "words").agg(*both), "steps")
    branches = graph.groupBy("edge").agg(F.count("*").alias("n"), *both).where("n > 1 AND lo < hi")
    branching, repeated = sc.broadcast(bitmap.of(branches.select("edge"), "edge")), sc.broadcast(bitmap.of(graph.where("lo < hi").select("words"), "words"))
    store.forget(graph)

    def inside(ids, keys, data, offsets):
        s = Steps(data, offsets, window, edge)
        step, _, inner = s.windows(branching.value)
        return [x for k, x in enumerate(smallest([inner, np.zeros(len(inner), np.uint64)], ids[s.text[step]])) if k != 1]

    shared = emitted(docs, "inner long, lo long, hi long", inside).groupBy("inner").agg(*both).where("lo < hi")
    shared = store.written(shared.select("inner"), "inner")
    inner = sc.broadcast(bitmap.of(shared, "inner"))
    store.forget(shared)

    def units(ids, keys, data, offsets):
        text, e, unit, _, _ = Steps(data, offsets, window, edge).units(branching.value, inner.value, repeated.value)
        return smallest([e, unit], ids[text])

    shared = store.written(emitted(docs, "edge long, unit long, lo long, hi long", units).groupBy("edge", "unit").agg(*both).where("lo < hi").select("edge", "unit", "lo"), "units")
    found = sc.broadcast(bitmap.of(shared.select("unit"), "unit"))

    def places(ids, keys, data, offsets):
        text, e, unit, start, end = Steps(data, offsets, window, edge).units(branching.value, inner.value, repeated.value)
        at = np.flatnonzero(bitmap.maybe(found.value, unit))
        return [ids[text[at]], keys[text[at]], e[at], unit[at], start[at].astype(np.int32), end[at].astype(np.int32)]

    placed = emitted(docs, "doc_id long, key long, edge long, unit long, start int, end int", places)
    later = placed.join(shared, ["edge", "unit"]).where("doc_id > lo")
    return later.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, edge: int = EDGE, carry: list[str] | None = None, original: bool = False) -> DataFrame:
    """Columns row (all of docs, or those of carry) and res: n_words, n_removed, kept and spans.

    kept has the words left, joined by one space; with `original`, a text of which nothing goes is kept as it is.
    """
    value = F.col(f"`{text}`").cast("string")
    held = rows.Carried(docs, text, carry=carry, doc_id=F.col(f"`{doc_id}`").cast("long"), key=F.xxhash64(value))
    back, source = held.back, held.source
    spans = repeated_spans(source.select("doc_id", "key", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), window, edge)

    def run(batches):
        for batch in batches:
            data, offsets = textvec.utf8(batch.column("text"))
            spans, null = batch.column("spans"), batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for a, b in textvec.slices(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                part, off = data[lo:hi], offsets[a : b + 1] - lo
                starts, ends, first = textvec.word_spans(part, off, textvec.SPACED)
                raw = part.tobytes()
                n, gone, kept, where = np.diff(first), [], [], []
                for k in range(b - a):
                    i, j = int(first[k]), int(first[k + 1])
                    found = spans[a + k]
                    keep, merged = None, []
                    if found.is_valid and len(found):
                        s, e = (found.values.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
                        _, s, e = decontaminate.merge_spans(np.zeros(len(s), np.int64), s, e)
                        merged = [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)]
                        keep = np.ones(j - i, bool)
                        for x, y in zip(s, e, strict=True):
                            keep[x:y] = False
                    gone.append(0 if keep is None else int((~keep).sum()))
                    where.append(merged)
                    if original and not gone[-1]:
                        kept.append(None if null[a + k] else raw[int(off[k]) : int(off[k + 1])].decode("utf-8"))
                    else:
                        x, y = (starts[i:j], ends[i:j]) if keep is None else (starts[i:j][keep], ends[i:j][keep])
                        kept.append(b" ".join([raw[u:v] for u, v in zip(x.tolist(), y.tolist(), strict=True)]).decode("utf-8"))
                res = pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=RESULT.fieldNames())
                yield rows.again(batch, back, a, b, res=res)

    full = source.join(spans, ["doc_id", "key"], "left").select("kept", "text", "spans")
    return full.mapInArrow(run, T.StructType([*held.shape, T.StructField("res", RESULT)])).select(held.row(), "res")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated words removed from the texts that hold any; texts without stay as they are."""
    found = dedup(docs, doc_id, text, carry=[c for c in docs.columns if c != text], original=True)
    return found.select(*[F.col("res.kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
