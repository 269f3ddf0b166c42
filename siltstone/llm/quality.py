"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of other printing characters, case kept; features are
hashed tokens and hashed pairs of neighbours, where a pair of equal tokens is one feature whatever the
token (a repeat). A document is the vector of 1 + ln(count), scaled to length 1. Scores are sparse dot
products computed over whole texts, row by row, without a shuffle. Null and empty texts have no
feature and get the score of the intercept alone; with no labelled row at all every score is 0.5.

The fit sees at most `limit` rows of each label; everything else covers all rows. Equal texts have equal scores; a very
long text is a slice of its own; an empty table gives no rows; an id labelled twice counts once, by its larger label; rows
keep all their columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import labelled, rows, textvec

#: Buckets of the feature hash, as bits.
BITS = 18
#: Labelled rows of each label that a fit may see.
LIMIT = 5000

SPACE = textvec.byte_table([0x20, *range(0x09, 0x0E)])
WORD = textvec.byte_table([0x5F, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
KIND = np.where(SPACE, 0, np.where(WORD, 1, 2)).astype(np.uint8)
_PAIR = np.uint64(0xA24BAED4963EE407)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of all features, in order of text and bucket."""
    n = len(offsets) - 1
    kind = KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    at = np.flatnonzero(new)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    h = textvec.hash_words(data, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    pair = np.where(h[1:] == h[:-1], np.uint64(0), textvec.mix(h[1:] * _PAIR + h[:-1]))[doc[1:] == doc[:-1]]
    key = np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]]).astype(np.uint64) << np.uint64(bits)
    key, count = np.unique(key | (np.concatenate([h, pair]) & np.uint64((1 << bits) - 1)), return_counts=True)
    doc, bucket = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = 1 + np.log(count)
    length = np.sqrt(np.bincount(doc, value * value, minlength=n))
    return doc, bucket, value / length[doc]


class Ftrl:
    """Logistic regression with per-coordinate FTRL-proximal updates."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.1):
        size = (1 << bits) + 1  # the last is the intercept
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], share: float, epochs: int = 3) -> Ftrl:
        """share: of label 1 among all labelled rows, which the sample's rows are weighted to."""
        have = sum(y for *_, y in examples) / max(len(examples), 1)
        for k in range(epochs):
            for e in np.random.default_rng(k).permutation(len(examples)):
                i, x, y = examples[e]
                self.update(np.append(i, len(self.z) - 1), np.append(x, 1.0), y, share / have if y else (1 - share) / (1 - have))
        return self


SCORE = T.StructType([T.StructField("score", T.DoubleType())])
FEATURES = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", limit: int = LIMIT) -> np.ndarray:
    """Dense weights, the intercept last, from rows that `allowed` (over labels) takes."""

    def make():
        def work(data, offsets):
            doc, bucket, value = features(data, offsets)
            n = np.bincount(doc, minlength=len(offsets) - 1)
            return [rows.lists(n, pa.array(bucket.astype(np.int32))), rows.lists(n, pa.array(value.astype(np.float32)))]

        return work

    both = labels.where(allowed & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]

    def learn(table: pa.Table, _: int) -> np.ndarray:
        y = table.column("y").to_numpy()
        (bucket, cut), (value, _) = (labelled.flat(table.column(c)) for c in ("bucket", "value"))
        # rows stay slices of two flat arrays
        examples = [(bucket[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], int(y[i])) for i in labelled.order(y, cut, bucket, value)]
        return Ftrl().fit(examples, both).weights(slice(None))

    if both in (0, 1):
        return np.append(np.zeros(1 << BITS), 4.0 if both else -4.0)
    sample = rows.with_result(labelled.sample(docs, labels, label, allowed, limit), "text", FEATURES, make, carry=["y"]).select("row.y", "res.bucket", "res.value")
    found = labelled.fitted(sample, learn) if both is not None else []
    return found[0] if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry) and res.score in 0 to 1."""
    weights = weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed size: 2**BITS + 1

    def make():
        w = shared.value.astype(float)

        def work(data, offsets):
            doc, bucket, value = features(data, offsets)
            logit = np.bincount(doc, w[bucket] * value, minlength=len(offsets) - 1) + w[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))]

        return work

    return rows.with_result(docs, text, SCORE, make, carry=carry)
