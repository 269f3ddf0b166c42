"""Whole-column text primitives in numpy: word spans, span hashes and slicing of Arrow text columns.

Texts are handled as one UTF-8 buffer with document offsets, so that splitting and
hashing cost a few vector operations a byte and never a Python call a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once, so that working arrays stay in a core's cache; a longer document is handled alone.
SLICE_BYTES = 512 << 10
#: Longer words are hashed by xxh3: sums of powers of an odd base are weak on long words of few letters.
LONG_WORD = 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = np.empty(size, np.uint64)
        p[0] = 1
        done = 1
        while done < size:
            p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = p
    return have[:n]


def prefix(codes: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial prefix sums; prefix[i] covers codes[:i]."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=out[1:])
    return out


def hash_ranges(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of codes[start:end] for each range, the same wherever the range lies."""
    inverse = powers(_INVERSE if base == _BASE else pow(base, -1, 1 << 64), len(pre))
    h = (pre[ends] - pre[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (a, b) whose text stays under the limit, or single rows."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def byte_table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: Bytes of words that ASCII white space parts: [^\x20\x09-\x0D]+
SPACED = ~byte_table([0x20, *range(0x09, 0x0E)])
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes of data) of all words and, for each text, the index of its first word (one more at the end)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = hash_ranges(prefix(_BYTE_CODES[data]), starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def hash_sequences(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of all codes of each text (codes[first[k]:first[k + 1]]), however long."""
    raw, cut = memoryview(np.ascontiguousarray(codes).view(np.uint8)), (8 * first).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.uint64)


def hash_text(text: bytes) -> int:
    """The same hash for one word, for tables built on the driver."""
    data = np.frombuffer(text, np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


def expand(slot: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places in a flat array of the parts slot[0], slot[1], ... where part k lies at start[k]:start[k + 1]."""
    n = start[slot + 1] - start[slot]
    end = np.cumsum(n)
    return np.repeat(start[slot] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
