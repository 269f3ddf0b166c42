"""Benchmark decontamination with suffix arrays of the training text.

Each slice of training text is a shard. Its words become ids of the benchmark's vocabulary
(0: any other word), its suffix array orders all suffixes whose first words can still hold a whole
window, and every suffix of every benchmark item is binary-searched in it. The suffixes left out of
the array start with fewer known words than the shortest window, so none of them can match.

Words: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII bytes. A window is `window` words of an
item, or a whole shorter item. Null and empty texts have no words and match nothing; repeated rows
and items each count for themselves; an item with a null id is left out, having no name to report. A very long
text is a shard of its own; an empty table gives no rows, an empty benchmark no hits; rows keep all their
columns, whatever their names.

The benchmark is broadcast in blocks of at most `block_bytes`, one at a time: each block is one more
narrow pass over the rows, never a join, so neither the benchmark's size nor a passage that a third of
the documents hold makes any task larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import rows, store, textvec

#: Benchmark text in one block, in bytes.
BLOCK_BYTES = 16 << 20
WINDOW = 10

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_start", T.IntegerType()), T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("matches", T.ArrayType(MATCH))])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the first word of each text."""
    data = textvec.LOWER[data]
    starts, ends, first = textvec.word_spans(data, offsets, textvec.ALNUM)
    return textvec.hash_words(data, starts, ends), first


def keys(ids: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """Sort keys of suffixes: the first `width` ids, 0 from `stop` on."""
    pos = at[:, None] + np.arange(width)
    k = np.where(pos < stop[:, None], ids[np.minimum(pos, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
    return np.ascontiguousarray(k.astype(">u4")).view(f"S{4 * width}").ravel()


class Items:
    """A block of benchmark items: vocabulary, windows and where each window lies."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = textvec.utf8(pa.array([t for _, t in items], pa.string()))
        h, first = words_of(data, offsets)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        n = np.diff(first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at, length = first[:-1][item] + start, size[item]
        self.windows, which = np.unique(keys(ids, at, at + length, window), return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.lengths = np.zeros(len(self.windows), np.int64)
        self.lengths[which] = length
        self.first = np.searchsorted(which[order], np.arange(len(self.windows) + 1))
        self.item = np.array([i for i, _ in items], np.int64)[item[order]] if len(at) else np.zeros(0, np.int64)
        self.start = start[order]
        self.window = window
        self.least = int(self.lengths.min()) if len(self.lengths) else 0

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.windows) or not len(h):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        ids = np.where(known, at + 1, 0)
        # the next position from each that is unknown or in another text
        n = len(ids)
        breaks = np.full(n + 1, n, np.int64)
        breaks[:n][~known] = np.flatnonzero(~known)
        stop = np.minimum.accumulate(breaks[::-1])[::-1][:n]
        text_end = np.repeat(first[1:], np.diff(first))
        stop = np.minimum(stop, text_end)
        can = np.flatnonzero(stop - np.arange(n) >= self.least)
        if not len(can):
            return none
        k = keys(ids, can, stop[can], self.window)
        suffixes = np.argsort(k, kind="stable")
        k = k[suffixes]
        lo = np.searchsorted(k, self.windows, "left")
        full = self.windows.view("u1").reshape(len(self.windows), -1).copy()
        full[np.arange(full.shape[1]) >= 4 * self.lengths[:, None]] = 255
        hi = np.searchsorted(k, np.ascontiguousarray(full).view(k.dtype).ravel(), "right")
        hit = np.maximum(hi - lo, 0)
        w = np.repeat(np.arange(len(self.windows)), hit)
        inner = np.arange(len(w)) - np.repeat(np.cumsum(hit) - hit, hit)
        return can[suffixes[np.repeat(lo, hit) + inner]], w

    def longest(self, pos: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows (doc, item index, item start, word position, words): occurrences that follow each other in both texts become one match."""
        each = self.first[w + 1] - self.first[w]
        entry = np.repeat(self.first[w], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        p, d, length = np.repeat(pos, each), np.repeat(doc, each), np.repeat(self.lengths[w], each)
        item, start = self.item[entry], self.start[entry]
        order = np.lexsort((p, p - start, item, d))
        p, d, length, item, start = (x[order] for x in (p, d, length, item, start))
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - start[1:] != p[:-1] - start[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(p)) - 1 if len(p) else head
        return np.stack([d[head], item[head], start[head], p[head], p[last] + length[last] - p[head]], 1) if len(p) else np.zeros((0, 5), np.int64)


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a text joined; sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    shift = doc * np.int64(1 << 32)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], start[head], reach[np.append(head[1:], len(doc)) - 1] - shift[head]


def scanner(items, window: int):
    """items: a broadcast block of (item id, text)."""

    def make():
        block = Items(items.value, window)

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            h, first = words_of(data, offsets)
            n = len(offsets) - 1
            pos, w = block.search(h, first)
            doc = np.searchsorted(first, pos, "right") - 1
            m = block.longest(pos, w, doc)
            d, s, e = merge_spans(m[:, 0], m[:, 3] - first[m[:, 0]], m[:, 3] - first[m[:, 0]] + m[:, 4])
            spans = pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["start", "end"])
            found = pa.StructArray.from_arrays([pa.array(m[:, 1]), *(pa.array(x.astype(np.int32)) for x in (m[:, 2], m[:, 3] - first[m[:, 0]], m[:, 4]))], MATCH.fieldNames())
            return [pa.array(np.diff(first).astype(np.int64)), rows.lists(np.bincount(d, minlength=n), spans), rows.lists(np.bincount(m[:, 0], minlength=n), found)]

        return work

    return make


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry) and res: n_words, spans (hit word ranges, sorted and disjoint) and matches (longest verbatim matches and where they lie)."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    block = lambda k: sc.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])
    if n == 1:
        return rows.with_result(docs, "text", RESULT, scanner(block(0), window), carry=carry)
    # each block's pass is written, so that no more than one block is held at a time
    names = docs.columns if carry is None else carry
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"), F.lit(None).cast(RESULT).alias("so_far"))
    for k in range(n):
        shared, spent = block(k), out
        found = rows.with_result(out, "text", RESULT, scanner(shared, window))
        res = F.when(F.col("row.so_far").isNull(), F.col("res")).otherwise(joined(F.col("row.so_far"), F.col("res")))
        out = store.written(found.select(F.col("row.row").alias("row"), F.col("row.text").alias("text"), res.alias("so_far")), "scanned")
        shared.destroy()
        if k:
            store.forget(spent)
    return out.select("row", F.col("so_far").alias("res"))


def joined(a: Column, b: Column) -> Column:
    """Results of two blocks as one."""
    spans = F.array_sort(F.concat(a["spans"], b["spans"]))
    fold = F.aggregate(
        spans,
        F.array().cast(T.ArrayType(SPAN)),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.struct(a["n_words"].alias("n_words"), fold.alias("spans"), F.concat(a["matches"], b["matches"]).alias("matches"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; columns as they were."""
    return scan(docs, benchmark, window).where(F.size("res.spans") == 0).select("row.*")
