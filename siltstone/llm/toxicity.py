"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word is the sum of hashed embeddings: of the whole word and of its first 4 and 6 bytes. Filters over
1, 2 and 3 words, a ramp, and the maximum over the whole text feed one logistic output. The output is
shifted by a threshold found for the language that the text itself shows (its most frequent function
words; no column but the text is read), so that a score of 0.5 is that threshold. `NETWORKS` networks of different starts
and held-out parts score together, by the mean of their shifted outputs: one alone varies much where labels are few.

Words: A-Z lower-cased, runs of 0-9, a-z and non-ASCII bytes. Null and empty texts have no words: every
maximum is 0 and the output is the intercept's. With no labelled row at all every score is 0.5 less a
hair, so nothing is rejected. The fit sees at most `limit` rows of each label; scoring covers whole
texts of all rows and shuffles nothing. Equal texts have equal scores; a very long text is a slice of its own; an
empty table gives no rows; an id labelled twice counts once, by its larger label; rows keep all their columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import labelled, rows, textvec

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it with was for on are be this by from",
    "de": "der die und das ist von zu den mit für ein eine dem nicht des auf im sich",
    "fr": "le la les des et du un une que qui dans est pour par sur au pas avec",
    "es": "el los las y del se por con una para como está su al lo más pero sus",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
BITS, DIM, WIDTHS, FILTERS, NETWORKS = 16, 12, (1, 2, 3), 8, 3
#: Labelled rows of each label that a fit may see.
LIMIT = 2500


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three bucket ids a word, the first word of each text, and each text's language."""
    data = textvec.LOWER[data]
    starts, ends, first = textvec.word_spans(data, offsets, textvec.ALNUM)
    pre = textvec.prefix(textvec._BYTE_CODES[data])
    whole = textvec.hash_ranges(pre, starts, ends)
    low = np.uint64((1 << BITS) - 1)
    buckets = [whole & low] + [textvec.mix(textvec.hash_ranges(pre, starts, np.minimum(starts + k, ends)) + np.uint64(k)) & low for k in (4, 6)]
    known, which = language_table()
    at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hit = known[at] == whole
    votes = np.bincount(doc[hit] * 4 + which[at[hit]], minlength=4 * (len(offsets) - 1)).reshape(-1, 4)
    return np.stack(buckets, 1).astype(np.int32), first, np.where(votes.max(1, initial=0) > 0, votes.argmax(1), 4)


def language_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((textvec.hash_text(w.encode()), k) for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split())
    return np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])


class Network:
    """Weights: embeddings, filters (width, dim, filters), their biases, output weights and bias, thresholds by language."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        r = np.random.default_rng(seed)
        self.embed = (r.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
        self.filters = [(r.standard_normal((w, DIM, FILTERS)) * (0.5 / w)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (np.abs(r.standard_normal(len(WIDTHS) * FILTERS)) * 0.3 * np.tile([1, -1], len(WIDTHS) * FILTERS // 2)).astype(np.float32)
        self.bias = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES))
        self.slack = [g * 0 for g in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out]

    def pooled(self, buckets: np.ndarray, first: np.ndarray, where: bool = False):
        """The maximum of each filter over each text, and the word it stands at."""
        n, gap = len(first) - 1, max(WIDTHS) - 1
        docs = np.repeat(np.arange(n), np.diff(first))
        x = np.zeros((len(buckets) + gap * n + gap, DIM), np.float32)
        place = np.arange(len(buckets)) + gap * docs
        x[place] = self.embed[buckets[:, 0]] + self.embed[buckets[:, 1]] + self.embed[buckets[:, 2]]
        full = np.flatnonzero(np.diff(first) > 0)
        out, at = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        for k, (f, b) in enumerate(zip(self.filters, self.biases, strict=True)):
            y = x[: len(x) - gap] @ f[0]
            for j in range(1, len(f)):
                y += x[j : len(x) - gap + j] @ f[j]
            y = np.maximum(y[place] + b, 0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if len(full):
                out[full, cols] = np.maximum.reduceat(y, first[:-1][full])
                if where:
                    for d in full:
                        at[d, cols] = first[d] + y[first[d] : first[d + 1]].argmax(0)
        return (out, at, x, place) if where else out

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(buckets, first) @ self.out.astype(float) + float(self.bias)

    def step(self, buckets, first, y, rate: float) -> None:
        """One Adagrad step on a batch of texts."""
        pool, at, x, place = self.pooled(buckets, first, True)
        p = 1 / (1 + np.exp(-np.clip(pool @ self.out + self.bias, -35, 35)))
        g = ((p - y) / len(y)).astype(np.float32)
        live = (pool > 0) & (at >= 0)
        back = np.where(live, g[:, None] * self.out, 0).astype(np.float32)
        grads = [np.zeros_like(self.embed), *(np.zeros_like(f) for f in self.filters), *(np.zeros_like(b) for b in self.biases), pool.T @ g]
        ends = np.repeat(first[1:], np.diff(first))
        for k, f in enumerate(self.filters):
            d, c = np.nonzero(live[:, k * FILTERS : (k + 1) * FILTERS])
            s = back[d, k * FILTERS + c]
            pos = at[d, k * FILTERS + c]
            np.add.at(grads[1 + len(WIDTHS) + k], c, s)
            for j in range(len(f)):
                ok = pos + j < ends[pos]
                np.add.at(grads[1 + k][j].T, c[ok], s[ok, None] * x[place[pos[ok] + j]])
                for h in range(3):
                    np.add.at(grads[0], buckets[pos[ok] + j, h], s[ok, None] * f[j][:, c[ok]].T)
        for part, slack, grad in zip(self.parts(), self.slack, grads, strict=True):
            slack += grad * grad
            part -= rate * grad / (np.sqrt(slack) + 1e-6)
        self.bias -= np.float32(rate * g.sum())

    def fit(self, texts: list[np.ndarray], languages: np.ndarray, y: np.ndarray, share: float, epochs: int = 8, batch: int = 64) -> Network:
        """texts: buckets of each text. A fifth is kept for the thresholds."""
        order = np.random.default_rng(self.seed).permutation(len(texts))
        held = order[: len(order) // 5] if len(order) >= 50 else order
        train = order[len(order) // 5 :] if len(order) >= 50 else order
        gather = lambda ids: (np.concatenate([texts[i] for i in ids]) if len(ids) else np.zeros((0, 3), np.int32), np.cumsum([0, *(len(texts[i]) for i in ids)]))
        for k in range(epochs):
            ids = np.random.default_rng(k).permutation(train)
            for a in range(0, len(ids), batch):
                self.step(*gather(ids[a : a + batch]), y[ids[a : a + batch]].astype(np.float32), 0.1 if k < epochs - 2 else 0.03)
        logit = np.concatenate([self.logits(*gather(held[a : a + 256])) for a in range(0, len(held), 256)])
        weight = np.where(y[held] == 1, share / max(y[held].mean(), 1e-9), (1 - share) / max(1 - y[held].mean(), 1e-9))
        common = threshold(logit, y[held], weight, 0.0)
        for k in range(len(LANGUAGES)):
            at = languages[held] == k
            self.thresholds[k] = threshold(logit[at], y[held][at], weight[at], common) if min(at.sum() - y[held][at].sum(), y[held][at].sum()) >= 5 else common
        return self


class Committee:
    """Networks that score together."""

    def __init__(self, networks: list[Network]):
        self.networks = networks

    def logits(self, buckets: np.ndarray, first: np.ndarray, language: np.ndarray) -> np.ndarray:
        return sum(n.logits(buckets, first) - n.thresholds[language] for n in self.networks) / len(self.networks)


def threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, otherwise: float) -> float:
    """The middle of the widest gap among the cuts with the fewest (weighted) errors."""
    if not len(y) or y.min() == y.max():
        return otherwise
    order = np.argsort(logit, kind="stable")
    s, t, w = logit[order], y[order], weight[order]
    wrong = np.concatenate([[0], np.cumsum(w * t)]) + np.concatenate([np.cumsum((w * (1 - t))[::-1])[::-1], [0]])
    cut = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gap = np.concatenate([[0], s[1:] - s[:-1], [0]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(cut[best[np.argmax(gap[best])]])


SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("language", T.StringType())])
BUCKETS = T.StructType([T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("language", T.IntegerType())])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", limit: int = LIMIT) -> Committee:
    """Networks from the labelled rows that `allowed` (over labels) takes."""

    def make():
        def work(data, offsets):
            buckets, first, language = words_of(data, offsets)
            return [rows.lists(3 * np.diff(first), pa.array(buckets.ravel())), pa.array(language.astype(np.int32))]

        return work

    share = labels.where(allowed & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]

    def learn(table: pa.Table, k: int) -> Network:
        values, cut = labelled.flat(table.column("buckets"))
        y, language = (table.column(c).to_numpy() for c in ("y", "language"))
        order = labelled.order(y, cut, values)
        net = Network(7 + k).fit([values[cut[i] : cut[i + 1]].reshape(-1, 3) for i in order], language[order], y[order], share)
        net.slack = None
        return net

    found = []
    if share is not None and share not in (0, 1):
        sample = rows.with_result(labelled.sample(docs, labels, label, allowed, limit), "text", BUCKETS, make, carry=["y"]).select("row.y", "res.buckets", "res.language")
        found = labelled.fitted(sample, learn, NETWORKS)
    if not found:
        net = Network()
        net.out[:] = 0
        net.bias = np.float32(4.0 if share == 1 else -4.0 if share == 0 else -1e-6)
        found = [net]
    return Committee(found)


def score(docs: DataFrame, net: Committee, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry) and res: score in 0 to 1 and the language it was calibrated for."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def make():
        model = shared.value

        def work(data, offsets):
            buckets, first, language = words_of(data, offsets)
            logit = model.logits(buckets, first, language)
            return [pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35)))), pa.array(np.array(LANGUAGES, object)[language], pa.string())]

        return work

    return rows.with_result(docs, text, SCORE, make, carry=carry)


def remove(docs: DataFrame, net: Committee) -> DataFrame:
    """docs without those scored 0.5 or more; columns as they were."""
    return score(docs, net).where("res.score < 0.5").select("row.*")
