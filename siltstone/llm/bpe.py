"""BPE encoding and decoding through a table of distinct words.

Tasks split every whole text into the words of the byte-level pre-tokenizer (see words), the distinct words are
counted, the commonest (as many as fit in `broadcast_bytes`, by measured size) encoded once each, and their ids
joined back by position by a lookup in a broadcast copy. Words too rare for that copy are encoded where they occur,
once for each task while `learnt_bytes` last, else once for each slice of texts: they occur so seldom that a
shuffled join of positions costs more. Without counting, each worker learns its whole table as it goes. Words are told
apart by 64 bits of hash. Ids are one binary a text: little-endian unsigned 32-bit integers.
Decoding joins ids to the pieces of the vocabulary, whose size is fixed.

Null and empty texts have no ids, empty tables give none. Rows keep all their columns, whatever their names; repeated
rows count each for itself. A very long text is a slice of its own. Texts with a special token's string, or with
characters whose class may differ between Unicode versions, are not split but encoded whole by the same tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import rows, store, textvec, words

BROADCAST_BYTES, LEARNT_BYTES = 24 << 20, 24 << 20
#: Words that a task counts before it hands them on.
COUNTED = 1 << 18
IDS = T.StructType([T.StructField("ids", T.BinaryType())])
TEXT = T.StructType([T.StructField("text", T.StringType())])


@functools.cache
def tokenizer(path: str):
    """Read once a process: Python workers outlive tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def to_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def special(text: Column, path: str) -> Column:
    """Whether a text holds a special token's string."""
    found = F.lit(False)
    for s in specials(path):
        found = found | text.contains(s)
    return F.coalesce(found, F.lit(False))


@functools.cache
def byte_signs() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u4")
    out[printing] = printing
    out[out == 0] = 256 + np.arange(256 - len(printing))
    return out


def ids_of(t, data: np.ndarray, borders: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some of the words between borders by the tokenizer's model, one after the other, and how many each has."""
    text = byte_signs()[data[textvec.expand(slot, borders)]].tobytes().decode("utf-32-le")
    cut = np.concatenate([[0], np.cumsum(borders[slot + 1] - borders[slot])]).tolist()
    tokenize = t.model.tokenize
    found = [[k.id for k in tokenize(text[a:b])] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum())), size


def encoded_words(distinct: DataFrame, path: str) -> DataFrame:
    """Columns word and ids, each word once."""

    def make():
        t = tokenizer(path)

        def work(data, offsets):
            ids, size = ids_of(t, data, offsets, np.arange(len(offsets) - 1))
            cut = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32).tobytes())
            return [pa.Array.from_buffers(pa.binary(), len(size), [None, cut, pa.py_buffer(ids.tobytes())])]

        return work

    return rows.with_result(distinct.select("word"), "word", IDS, make).select("row.word", "res.ids")


def strings(data: np.ndarray, borders: np.ndarray, slot: np.ndarray) -> pa.Array:
    """Some of the words between borders, as Arrow strings."""
    sizes = np.concatenate([[0], np.cumsum(borders[slot + 1] - borders[slot])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(slot), pa.py_buffer(sizes.tobytes()), pa.py_buffer(data[textvec.expand(slot, borders)].tobytes()))


def word_counts(src: DataFrame) -> DataFrame:
    """Columns word and n of src (text, special), without the texts that are encoded whole."""

    def run(batches):
        seen, found = words.Counts(), []

        def out():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(found), pa.array(seen.c)], names=["word", "n"])

        for batch in batches:
            data, offsets = textvec.utf8(batch.column(0))
            flagged = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in textvec.slices(offsets):
                part, off = data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]
                borders, first, unsure = words.split(part, off)
                use = np.flatnonzero(np.repeat(~(unsure | flagged[a:b]), np.diff(first)))
                found.append(strings(part, borders, use[seen.take(words.hashes(part, borders)[use])]))
                if seen.n >= COUNTED:
                    yield out()
                    seen, found = words.Counts(), []
        if found:
            yield out()

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """A table of words on one machine: their hashes, and the ids of each; it takes in `learnt` bytes more."""

    def __init__(self, path: str, learnt: int, hashes: np.ndarray, ids: np.ndarray, start: np.ndarray):
        self.whole, self.places, self.ids, self.start = tokenizer(path), words.Places(), ids, start
        self.places.add(hashes)
        self.limit = 4 * int(start[-1]) + 16 * len(hashes) + learnt

    def taken(self, data: np.ndarray, borders: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each word; words that are new lie at the end, and stay there as long as there is room."""
        place, n = self.places.find(h), self.places.n
        new = np.flatnonzero(place < 0)
        late, slot, inverse = np.unique(h[new], return_index=True, return_inverse=True)
        place[new] = n + inverse
        more, size = ids_of(self.whole, data, borders, new[slot])
        used, count = int(self.start[n]), len(more)
        if used + count > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used + 2 * count + 1024, "<u4")])
        if n + len(size) >= len(self.start):
            self.start = np.concatenate([self.start[: n + 1], np.empty(n + 2 * len(size) + 256, np.int64)])
        self.ids[used : used + count] = more
        self.start[n + 1 : n + 1 + len(size)] = used + np.cumsum(size)
        if 4 * (used + count) + 16 * (n + len(size)) <= self.limit:
            self.places.add(late)
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray, flagged: np.ndarray) -> list[bytes]:
        """Ids of each text."""
        borders, first, unsure = words.split(data, offsets)
        place = self.taken(data, borders, words.hashes(data, borders))
        raw = self.ids[textvec.expand(place, self.start)].tobytes()
        cut = (np.concatenate([[0], np.cumsum(self.start[place + 1] - self.start[place])])[first] * 4).tolist()
        out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for k in np.flatnonzero(unsure | flagged):
            out[k] = to_bytes(self.whole.encode(data[int(offsets[k]) : int(offsets[k + 1])].tobytes().decode("utf-8"), add_special_tokens=False).ids)
        return out


@functools.cache
def learning(path: str, learnt: int) -> Lookup:
    """A table that starts empty, one for each process."""
    return Lookup(path, learnt, np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(1, np.int64))


def common_words(src: DataFrame, path: str, broadcast_bytes: int):
    """Hashes, ids and starts of the commonest words of src (text, special) that fit, encoded once each."""
    counted = store.written(word_counts(src.select("text", "special")), "counts")
    # the lowest count whose words, with all commoner ones, fit
    held, least = 0, 1 << 62
    sizes = counted.groupBy("n").agg(F.sum(2 * F.octet_length("word") + 20).alias("size"))
    for n, size in sizes.orderBy(F.desc("n")).collect():
        held += size
        if held > broadcast_bytes:
            break
        least = n
    table = store.written(encoded_words(counted.where(F.col("n") >= least), path), "words").toArrow()
    data, offsets = textvec.utf8(table.column("word"))
    raw, cut = textvec.utf8(table.column("ids"))
    h, slot = np.unique(words.hashes(data, offsets) if table.num_rows else np.zeros(0, np.int64), return_index=True)
    cut = (cut - cut[0]) // 4, np.frombuffer(raw[int(cut[0]) : int(cut[-1])].tobytes(), "<u4")
    return h, cut[1][textvec.expand(slot, cut[0])], np.concatenate([[0], np.cumsum(np.diff(cut[0])[slot])]).astype(np.int64)


def encode(docs: DataFrame, path: str, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, learnt_bytes: int = LEARNT_BYTES, counted: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry) and ids. counted: whether one table of the commonest words is made for all tasks first."""
    held = rows.Carried(docs, text, carry=carry, special=special(F.col(f"`{text}`").cast("string"), path))
    shared, back = None, held.back
    if counted:
        shared = docs.sparkSession.sparkContext.broadcast(common_words(held.source, path, broadcast_bytes))

    def run(batches):
        table = None
        for batch in batches:
            table = table or (learning(path, learnt_bytes) if shared is None else Lookup(path, learnt_bytes, *shared.value))
            data, offsets = textvec.utf8(batch.column(1))
            flagged = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in textvec.slices(offsets):
                ids = table.encode(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a], flagged[a:b])
                yield rows.again(batch, back, a, b, ids=pa.array(ids, pa.binary()))

    return held.source.mapInArrow(run, T.StructType([*held.shape, T.StructField("ids", T.BinaryType())])).select(held.row(), "ids")


@functools.cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, and where each begins; one more, empty, stands for ids out of the vocabulary."""
    byte_of = {chr(c): b for b, c in enumerate(byte_signs().tolist())}
    t, out = tokenizer(path), {}
    special = set(specials(path))
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = piece.encode() if piece in special or any(c not in byte_of for c in piece) else bytes(byte_of[c] for c in piece)
    table = [*(out.get(i, b"") for i in range(max(out, default=-1) + 1)), b""]
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in table])]).astype(np.int64)


def decode(coded: DataFrame, path: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of coded, or those of carry) and res.text; ids out of the vocabulary have no text."""

    def make():
        data, start = pieces(path)
        last = len(start) - 2

        def work(raw, offsets):
            slot = np.minimum(raw.view("<u4") if not raw.ctypes.data % 4 else np.frombuffer(raw.tobytes(), "<u4"), last).astype(np.int64)
            text = data[textvec.expand(slot, start)].tobytes()
            cut = np.concatenate([[0], np.cumsum(start[slot + 1] - start[slot])])[offsets // 4]
            return [pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())]

        return work

    return rows.with_result(coded, ids, TEXT, make, kind="binary", carry=carry)
