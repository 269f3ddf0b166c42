"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Documents lie in ascending id order, cut into shards of about `shard_tokens` ids. In each shard frequent
neighbours are replaced by nonterminals until no pair occurs `least` times; the shard's blob stores the
rules, their expansion lengths, the remaining sequence and where each document starts, so one document
is decoded by expanding only the symbols that cover it. Blobs are rows (part, shard, start, n_tokens, blob) of a
Parquet data set, which gives commits and retries that survive lost executors; start counts the ids of the part's
earlier shards, so that one number for each part places every document.

Blob: "RPG1", then as little-endian int64 the counts (documents, rules, symbols, first nonterminal), the
document ids, null flags (1 byte each), document starts (one more at the end) as int64, then as uint32
the rules' left and right symbols, expansion lengths, and the sequence.

Null ids come first; rows of one id are ordered by a hash of their texts; an empty document has no ids unless an
end id is appended; a document longer than a shard is a shard of its own. An empty table has no shards and no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import store, textvec

MAGIC = b"RPG1"
SHARD_TOKENS = 1 << 20
LEAST = 16
#: Buckets in which neighbours are first counted, as bits: few enough for a core's cache.
BUCKETS = 18
BLOBS = "part int, shard int, start long, n_tokens long, blob binary"
DOCS = "doc_id long, start long, ids binary"


def compress(seq: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First nonterminal, rules' left and right symbols, expansion lengths of the rules, and the sequence left."""
    seq = seq.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    left, right = [], []
    made = 0

    def frequent(h, counts, level):
        """Where pairs stand whose buckets hold `level` or more, the pairs, which stands where, and which are frequent themselves."""
        at = np.flatnonzero((counts >= level)[h])
        pairs, which, n = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], return_inverse=True, return_counts=True)
        return at, pairs, which, n >= level

    while len(seq) > 1:
        h = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS)
        counts = np.bincount(h, minlength=1 << BUCKETS)
        # a bucket's count bounds its pairs' counts; those that can be frequent are counted exactly
        level = max(least, int(counts.max()) // 8)
        at, pairs, which, good = frequent(h, counts, level)
        if not good.any() and level > least:
            at, pairs, which, good = frequent(h, counts, least)
        if not good.any():
            break
        rule = np.cumsum(good) - 1
        use = good[which]
        at, rule = at[use], rule[which[use]]
        # of pairs that overlap, every other one of a run
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, rule = at[even], rule[even]
        left.append(pairs[good] >> np.uint64(32))
        right.append(pairs[good] & np.uint64(0xFFFFFFFF))
        seq[at] = (rule + base + made).astype(np.uint32)
        seq = np.delete(seq, at + 1)
        made += int(good.sum())
    left, right = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    return base, left.astype(np.uint32), right.astype(np.uint32), lengths(base, left, right), seq


def lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = np.ones(len(left), np.uint32)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        n[k] = (n[a - base] if a >= base else 1) + (n[b - base] if b >= base else 1)
    return n


def pack(ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    base, left, right, n, seq = compress(np.concatenate(tokens) if tokens else np.zeros(0, np.uint32))
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype("<i8")
    head = np.array([len(ids), len(left), len(seq), base], "<i8")
    return b"".join([MAGIC, head.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), starts.tobytes(), *(x.astype("<u4").tobytes() for x in (left, right, n, seq))])


class Shard:
    """Reads one blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, self.base = (int(x) for x in np.frombuffer(blob, "<i8", 4, 4))
        at = 36
        values = np.frombuffer(blob, "<i8", docs, at)
        null = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
        self.ids = [None if z else int(v) for v, z in zip(values, null, strict=True)]
        self.starts = np.frombuffer(blob, "<i8", docs + 1, at + 9 * docs)
        at += 9 * docs + 8 * (docs + 1)
        self.left, self.right, self.lengths = (np.frombuffer(blob, "<u4", rules, at + 4 * rules * k) for k in range(3))
        self.sequence = np.frombuffer(blob, "<u4", symbols, at + 12 * rules)
        self.reach = np.concatenate([[0], np.cumsum(self.size(self.sequence))])

    def size(self, symbols: np.ndarray) -> np.ndarray:
        n = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        n[rule] = self.lengths[symbols[rule] - self.base]
        return n

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol expands to, one after the other, and where each begins."""
        symbols = np.arange(self.base, self.base + len(self.left), dtype=np.uint32)
        while (rule := symbols >= self.base).any():
            to = np.arange(len(symbols)) + np.cumsum(rule) - rule
            out = np.empty(len(symbols) + int(rule.sum()), np.uint32)
            out[to] = symbols
            k = symbols[rule] - self.base
            out[to[rule]], out[to[rule] + 1] = self.left[k], self.right[k]
            symbols = out
        return np.concatenate([np.arange(self.base, dtype="<u4"), symbols]), np.concatenate([np.arange(self.base + 1), self.base + np.cumsum(self.lengths.astype(np.int64))])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, start = self.table
        return flat[textvec.expand(symbols, start)]

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start:end of the shard; only the symbols that cover them are expanded."""
        a, b = int(np.searchsorted(self.reach, start, "right")) - 1, int(np.searchsorted(self.reach, end, "left"))
        return self.expand(self.sequence[a:b])[start - self.reach[a] :][: end - start]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in ascending order of id, within and across partitions; rows that repeat an id and a text may fill several."""
    keys = [F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.monotonically_increasing_id().alias("at")]
    order = [F.col("id").asc_nulls_first(), "key", "at"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.struct("*").alias("row"), *keys).repartitionByRange(n, *order).sortWithinPartitions(*order).select("row.*")


def write(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards of rows that lie in ascending id order (see in_order) and gives the files as a table (part, shard, start, n_tokens, blob)."""

    def run(batches):
        part, shard, start, names, tokens, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def out():
            row = (part, shard, start, held, pack(names, tokens))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "start", "n_tokens", "blob"])

        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = np.frombuffer(b.as_py() or b"", "<u4")
                if held and held + len(t) > shard_tokens:
                    yield out()
                    shard, start, names, tokens, held = shard + 1, start + held, [], [], 0
                names.append(i)
                tokens.append(t)
                held += len(t)
        if names:
            yield out()

    return store.written(coded.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{ids}`")).mapInArrow(run, BLOBS), "shards")


def read(files: DataFrame) -> DataFrame:
    """Columns doc_id, start (ids before it in all shards) and ids of each document, decoded from the files."""
    # one number a part, and parts are no more than shuffle partitions
    totals = sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect()))
    before = dict(zip([p for p, _ in totals], itertools.accumulate((n for _, n in totals), initial=0)))
    shared = files.sparkSession.sparkContext.broadcast(before)

    def run(batches):
        for batch in batches:
            for part, start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(blob.as_py())
                raw, base, n = s.expand(s.sequence).astype("<u4").tobytes(), shared.value[part] + start, len(s.ids)
                cut = (4 * s.starts).tolist()
                for a in range(0, n, 1024):
                    b = min(a + 1024, n)
                    yield pa.RecordBatch.from_arrays([pa.array(s.ids[a:b], pa.int64()), pa.array(s.starts[a:b] + base), pa.array([raw[cut[k] : cut[k + 1]] for k in range(a, b)], pa.binary())], names=["doc_id", "start", "ids"])

    return files.select("part", "start", "blob").mapInArrow(run, DOCS)
