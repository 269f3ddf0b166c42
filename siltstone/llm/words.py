"""The words of byte-level pre-tokenizers, found for many texts at once.

Characters are classed by a table (letter, number, white space, other), and the borders of words follow from the
classes of neighbours, so that splitting costs a few vector operations a character.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from . import textvec

#: Characters whose class is the same in all Unicode versions at hand.
SURE = regex.compile(r"[\u0000-ɏΑ-Ρα-ωЀ-ҁ‐-‧‰-⁞€←-⇿─-╿☀-⛿　-〠ぁ-ゖァ-ヺ一-龥가-힣\U0001F600-\U0001F640]")
LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: What may follow an apostrophe as a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, UNSURE, np.uint8)
    text = "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    for m in SURE.finditer(text):
        c = m[0]
        out[ord(c)] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) and not "\x1c" <= c <= "\x1f" else OTHER
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte borders of all words (one more at the end), the first word of each text (one more), and which texts hold a character that is not sure.

    Every byte of data belongs to a word, and no word crosses texts.
    """
    n = len(data)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
    char = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    kind = classes()[char]
    first = np.zeros(len(char) + 1, bool)
    text = np.searchsorted(at, offsets)
    first[text] = True
    unsure = np.add.reduceat(np.append(kind == UNSURE, False).astype(np.int64), np.minimum(text[:-1], len(kind))) > 0 if len(text) > 1 else np.zeros(0, bool)
    unsure &= np.diff(text) > 0
    if not len(char):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), unsure
    space = kind == SPACE
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last of some white space goes by itself, or, a blank, with what follows
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:-1]
    last[-1] = False
    begin |= last
    begin[1:] &= ~(last & (char == 0x20))[:-1]
    # an apostrophe that no blank precedes takes some letters along
    quote = np.flatnonzero(begin & (char == 0x27))
    stop = np.flatnonzero(first)
    room = stop[np.searchsorted(stop, quote, "right")] - quote
    padded = np.append(char, [0, 0])
    after, later = padded[quote + 1], padded[quote + 2]
    for e in ENDINGS:
        hit = (room > len(e)) & (after == ord(e[0]))
        if len(e) > 1:
            hit &= later == ord(e[1])
        q = quote[hit]
        begin[q + 1] = False
        end = q + 1 + len(e)
        begin[end[end < len(begin)]] = True
    starts = np.flatnonzero(begin)
    return np.append(at[starts], n), np.searchsorted(starts, text), unsure


def hashes(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return textvec.hash_words(data, borders[:-1], borders[1:]).view(np.int64)


class Places:
    """Distinct hashes, numbered 0, 1, ... as they come, in an open-addressed table that grows."""

    def __init__(self, bits: int = 12):
        self.slots, self.hashes, self.n = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits - 1, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out, mask = np.full(len(h), -1, np.int32), len(self.slots) - 1
        live, at = np.arange(len(h)), h & mask
        while len(live):
            slot = self.slots[at]
            full = slot >= 0
            hit = full & (self.hashes[slot] == h)
            out[live[hit]] = slot[hit]
            full &= ~hit
            live, at, h = live[full], at[full] + 1 & mask, h[full]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new hashes, each given once."""
        n = self.n + len(h)
        if n > len(self.hashes):
            grown = Places(n.bit_length() + 1)
            grown.add(np.concatenate([self.hashes[: self.n], h]))
            self.slots, self.hashes, self.n = grown.slots, grown.hashes, grown.n
            return
        mask = len(self.slots) - 1
        live, at = np.arange(self.n, n, dtype=np.int32), h & mask
        self.hashes[self.n : n] = h
        self.n = n
        while len(live):
            free = self.slots[at] < 0
            self.slots[at[free]] = live[free]
            lost = self.slots[at] != live
            live, at = live[lost], at[lost] + 1 & mask


class Counts(Places):
    """Distinct hashes and how often each came."""

    def __init__(self):
        super().__init__()
        self.c = np.zeros(0, np.int64)

    def take(self, h: np.ndarray) -> np.ndarray:
        """Counts hashes; gives the places in h of those not seen before, once each, in the order of their numbers."""
        place = self.find(h)
        new = np.flatnonzero(place < 0)
        late, slot, inverse = np.unique(h[new], return_index=True, return_inverse=True)
        place[new] = self.n + inverse
        self.add(late)
        self.c = np.append(self.c, np.zeros(len(late), np.int64)) + np.bincount(place, minlength=self.n)
        return new[slot]
