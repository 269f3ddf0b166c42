"""LM scoring with a log-bilinear neural model trained in numpy by noise-contrastive estimation.

Spark counts every token of all training texts. Symbols are the commonest words of `LEAST` or more occurrences, as far as the
max(`OWN`, 3 sqrt(tokens)) first go; all other words are dealt by hash over a power of two of classes, which grows alike;
the start of a text is a symbol of context only. For the word one place before and for the word two places before there
is a log-bilinear model (context vectors, target vectors, target biases) of all symbols. Spark tasks pass over every
training text once, whatever the corpus's size, by noise-contrastive steps with unigram noise, and their moves are averaged, weighted by how
often each row was met: what is learnt from grows with the corpus, and nothing but counts and moves is shuffled. Both models
are then normalised exactly, a batch of contexts at a time over all targets by matrix products. A token's probability mixes both
models and the unigram, by the parts that give the texts of a `FITTED`th of the training rows, which the vectors were not
trained on, the highest probability. A token without a symbol of its own has the probability of its class times its own
smoothed share, (c + 1) / (tokens + types + 1 of the class), which leaves room for the unseen.

Counts of the commonest words (at most `TABLE`, or as many as have symbols) are broadcast; all other words of a text are
joined with the count table. Words: A-Z lower-cased, runs without ASCII white space; each text ends with one end token, so
null and empty texts have that one. With no training text all counts are 0. A very long text is a slice of its own.
Repeated rows count each for itself; an empty table gives no rows; rows keep all their columns, whatever their names.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import rows, store, textvec, words

OWN, LEAST, TABLE, DIM = 8192, 3, 1 << 18, 16
#: Pairs of a step, its noise samples, its rate, and the pairs of rows that tasks give back at once.
STEP, NOISE, RATE, GIVEN = 1024, 32, 0.1, 1 << 14
#: One training text in so many only fits the parts of the mixture; and those parts where there is no such text.
FITTED, MIX = 16, (0.1, 0.6, 0.3)
#: Words that a task counts before it hands them on.
COUNTED = 1 << 20
END = textvec.hash_text(b"\\n")
PARTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("counted", "model")] + [T.StructField("rest", T.ArrayType(T.LongType()))])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token after each text's words, and the first token of each text."""
    data = textvec.LOWER[data]
    starts, ends, first = textvec.word_spans(data, offsets, textvec.SPACED)
    return np.insert(textvec.hash_words(data, starts, ends), first[1:], np.uint64(END)), first + np.arange(len(first))


def counts(texts: DataFrame) -> DataFrame:
    """Columns word (hash) and c over all texts (first column)."""

    def run(batches):
        seen = words.Counts()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.hashes[: seen.n]), pa.array(seen.c)], names=["word", "c"])

        for batch in batches:
            data, offsets = textvec.utf8(batch.column(0))
            for a, b in textvec.slices(offsets):
                seen.take(tokens(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a])[0].view(np.int64))
                if seen.n >= COUNTED:
                    yield out()
                    seen = words.Counts()
        if seen.n:
            yield out()

    return texts.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols:
    """The broadcast part of the count table; symbols are the `own` commonest words by rank, then `classes` (a power of two) of all others by hash, then the start."""

    def __init__(self, word: np.ndarray, c: np.ndarray, own: int, classes: int):
        order = np.lexsort((word, -c))
        self.places = words.Places()
        self.places.add(word[order].view(np.int64))
        self.c = np.append(c[order], -1)
        self.log = np.log10(np.maximum(self.c, 0) + 1)
        self.own, self.classes, self.n = own, classes, own + classes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and place in the table (-1: not in it) of each token."""
        at = self.places.find(h.view(np.int64))
        classed = self.own + (h & np.uint64(self.classes - 1)).astype(np.int64)
        return np.where((at >= 0) & (at < self.own), at, classed), at


def contexts(symbol: np.ndarray, first: np.ndarray, start: int) -> list[np.ndarray]:
    """The symbols one and two places before each token."""
    out = []
    place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    for k in (1, 2):
        before = np.full(len(symbol), start)
        at = np.flatnonzero(place >= k)
        before[at] = symbol[at - k]
        out.append(before)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, over float32."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """Vectors of contexts (n + 1 a distance) and targets (n a distance), and biases of targets; a copy to learn with has the sums of Adagrad too."""

    def __init__(self, noise: np.ndarray, seed: int = 3):
        self.n = n = len(noise)
        self.noise = noise
        rng = np.random.default_rng(seed)
        self.context, self.target = (rng.normal(0, 0.1, (m, DIM)).astype(np.float32) for m in (2 * n + 2, 2 * n))
        self.bias = np.tile(np.log(noise), 2).astype(np.float32)
        self.logz = np.zeros(2 * n + 2, np.float32)

    def own(self) -> Model:
        """A copy to learn with."""
        out, n = copy.copy(self), self.n
        out.context, out.target, out.bias = self.context.copy(), self.target.copy(), self.bias.copy()
        out.context_sum, out.target_sum, out.bias_sum = (np.full(m, 1e-3, np.float32) for m in (2 * n + 2, 2 * n, 2 * n))
        out.met = np.zeros(4 * self.n + 2)
        out.reach, out.floor = np.cumsum(self.noise), np.tile(np.log(self.noise * NOISE), 2).astype(np.float32)
        return out

    def step(self, far: int, before: np.ndarray, symbol: np.ndarray, rng: np.random.Generator) -> None:
        """One noise-contrastive step on pairs of a distance; they share their noise, drawn from equal parts of the unigram."""
        order = np.argsort(before, kind="stable")
        c, t = before[order] + far * (self.n + 1), symbol[order] + far * self.n
        f = far * self.n + np.searchsorted(self.reach, (np.arange(NOISE) + rng.random(NOISE)) / NOISE * self.reach[-1], "right").clip(max=self.n - 1)
        x, y, z = self.context[c], self.target[t], self.target[f]
        by = np.float32(len(c) ** -0.5)
        real = sigmoid(np.einsum("ij,ij->i", x, y) + self.bias[t] - self.floor[t])
        real -= 1
        real *= by
        noise = sigmoid(x @ z.T + (self.bias[f] - self.floor[f]))
        noise *= by
        # a row moves once, by its summed gradient
        head = np.flatnonzero(np.diff(c, prepend=-1))
        grad = noise @ z
        grad += real[:, None] * y
        move(self.context, self.context_sum, c[head], np.add.reduceat(grad, head, axis=0))
        self.met[c[head]] += np.diff(head, append=len(c))
        both = np.concatenate([t, f])
        order = np.argsort(both, kind="stable")
        head = np.flatnonzero(np.diff(both[order], prepend=-1))
        u = both[order][head]
        self.met[2 * self.n + 2 + u] += np.add.reduceat(np.where(order < len(t), 1, len(t) / NOISE), head)
        move(self.target, self.target_sum, u, np.add.reduceat(np.concatenate([real[:, None] * x, noise.T @ x])[order], head, axis=0))
        g = np.add.reduceat(np.concatenate([real, noise.sum(0)])[order], head)
        self.bias_sum[u] += g * g
        self.bias[u] -= RATE * g / np.sqrt(self.bias_sum[u])

    def learn(self, symbol: np.ndarray, first: np.ndarray, rng: np.random.Generator) -> None:
        """All tokens of some texts, once for each distance."""
        for far, before in enumerate(contexts(symbol, first, self.n)):
            for a in range(0, len(symbol), STEP):
                self.step(far, before[a : a + STEP], symbol[a : a + STEP], rng)

    def packed(self) -> np.ndarray:
        """A row for each context, then each target: the vector and the bias."""
        none = np.zeros((2 * self.n + 2, 1), np.float32)
        return np.concatenate([np.hstack([self.context, none]), np.hstack([self.target, self.bias[:, None]])])

    def moved(self, at: np.ndarray, by: np.ndarray) -> None:
        all_ = self.packed()
        all_[at] += by
        a, b = all_[: 2 * self.n + 2], all_[2 * self.n + 2 :]
        self.context, self.target, self.bias = (np.ascontiguousarray(x) for x in (a[:, :DIM], b[:, :DIM], b[:, DIM]))

    def log_p(self, far: int, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of symbols after the symbols `before`."""
        c, t = far * (self.n + 1) + before, far * self.n + symbol
        return np.einsum("ij,ij->i", self.context[c], self.target[t]) + self.bias[t] - self.logz[c]

    def normaliser(self, context: np.ndarray) -> np.ndarray:
        """Log of the sum over all targets for contexts of one distance."""
        far = slice(self.n, 2 * self.n) if context[0] > self.n else slice(0, self.n)
        logits = self.context[context] @ self.target[far].T + self.bias[far]
        top = logits.max(1, keepdims=True)
        logits -= top
        return top[:, 0] + np.log(np.exp(logits, out=logits).sum(1, dtype=np.float64))


def move(rows_: np.ndarray, sums: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
    sums[at] += np.einsum("ij,ij->i", grad, grad) / DIM
    rows_[at] -= grad * (RATE / np.sqrt(sums[at]))[:, None]


def slices(batches, column: int = 0):
    """(data, offsets) of the texts of batches, a slice at a time."""
    for batch in batches:
        data, offsets = textvec.utf8(batch.column(column))
        for a, b in textvec.slices(offsets):
            yield data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]


def train(texts: DataFrame, symbols, noise: np.ndarray) -> Model:
    """A model of all texts (first column), each passed over once.

    There are twice as many learners as cores, each with a part of the texts; the moves of a row are then averaged,
    weighted by how often the learners met it.
    """
    spark = texts.sparkSession
    model = Model(noise)
    shared = spark.sparkContext.broadcast(model)
    wide, height = DIM + 1, 4 * model.n + 2
    kind = "id int, met double, moved array<float>"

    def given(at, met, moved):
        for a in range(0, len(at), GIVEN):
            b = min(a + GIVEN, len(at))
            yield pa.RecordBatch.from_arrays([pa.array(at[a:b].astype(np.int32)), pa.array(met[a:b]), rows.lists(np.full(b - a, wide), pa.array(moved[a:b].astype(np.float32).ravel()))], names=["id", "met", "moved"])

    def learn(batches):
        mine = None
        for data, offsets in slices(batches):
            h, first = tokens(data, offsets)
            mine = mine or shared.value.own()
            mine.learn(symbols.value.find(h)[0], first, np.random.default_rng([0, int(h[0] >> np.uint64(1))]))
        if mine:
            at = np.flatnonzero(mine.met)
            yield from given(at, mine.met[at], mine.packed()[at] - shared.value.packed()[at])

    def merge(batches):
        slot, met, moved = np.full(height, -1), np.zeros(0), np.zeros((0, wide))
        for batch in batches:
            i, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.unique(i[slot[i] < 0])
            slot[new] = len(met) + np.arange(len(new))
            met, moved = np.append(met, np.zeros(len(new))), np.append(moved, np.zeros((len(new), wide)), 0)
            np.add.at(met, slot[i], m)
            np.add.at(moved, slot[i], batch.column(2).flatten().to_numpy().reshape(-1, wide) * m[:, None])
        at = np.flatnonzero(slot >= 0)
        yield from given(at, met[slot[at]], moved[slot[at]] / met[slot[at], None])

    learners = texts.coalesce(2 * spark.sparkContext.defaultParallelism)
    found = learners.mapInArrow(learn, kind).repartition("id").mapInArrow(merge, kind).select("id", "moved").toArrow()
    if len(found):
        model.moved(found.column("id").to_numpy(), found.column("moved").combine_chunks().flatten().to_numpy().reshape(-1, wide))
    shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    step = max(1, min(1024, (1 << 24) // model.n))
    parts, n = -(-(model.n + 1) // step), model.n

    def normalise(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                far, k = divmod(k, parts)
                i = far * (n + 1) + np.arange(k * step, min((k + 1) * step, n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(shared.value.normaliser(i))], names=["id", "logz"])

    found = spark.range(2 * parts).mapInArrow(normalise, "id int, logz double").toArrow()
    model.logz[found.column("id").to_numpy()] = found.column("logz").to_numpy()
    shared.unpersist()
    return model


def chances(model: Model, unigram: np.ndarray, symbol: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Probabilities of all tokens by the unigram and by each distance's model."""
    out = [unigram[symbol]]
    for k, before in enumerate(contexts(symbol, first, model.n)):
        log = model.log_p(k, before, symbol)
        out.append(np.exp(log, out=log))
    return out


def parts_of(texts: DataFrame, symbols, shared) -> np.ndarray:
    """The parts of the mixture, in tenths, that make texts (first column) likeliest."""
    grid = np.array([(a, b, 10 - a - b) for a in range(1, 11) for b in range(11 - a)]) / 10

    def run(batches):
        sums = np.zeros(len(grid))
        for data, offsets in slices(batches):
            h, first = tokens(data, offsets)
            p = np.stack(chances(shared.value[2], shared.value[0], symbols.value.find(h)[0], first))
            sums += [np.log(g @ p).sum() for g in grid]
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(sums)], names=["k", "sum"])

    found = texts.mapInArrow(run, "k long, sum double").groupBy("k").agg(F.sum("sum").alias("sum")).collect()
    return grid[max(found, key=lambda r: (r["sum"], -r["k"]))["k"]] if found else np.array(MIX)


def score(docs: DataFrame, training: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry), n_tokens, n_known, train_tokens, base_score and score; `training` tells which rows are learnt from."""
    spark = docs.sparkSession
    value = F.col(f"`{text}`").cast("string")
    texts = docs.where(training).select(value.alias("text"))
    fitting = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(FITTED)) == 0, F.lit(False))
    table = store.written(counts(texts), "counts")
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    limit = max(OWN, int(3 * n**0.5))
    # the lowest count that at most `held_most` words reach
    held, least, held_most = 0, 1 << 62, max(TABLE, limit)
    for c, of in table.groupBy("c").count().orderBy(F.desc("c")).limit(held_most).collect():
        if held + of > held_most:
            break
        held, least = held + of, c
    top = table.where(F.col("c") >= least).toArrow()
    word, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    own = min(limit, int((c >= LEAST).sum()))
    classes = 1 << max(6, (own // 4).bit_length())
    known = Symbols(word, c, own, classes)
    symbols = spark.sparkContext.broadcast(known)
    rare = table.where(F.col("c") < least)
    # tokens and types of each symbol
    seen, kinds = np.zeros((2, known.n))
    symbol = known.find(word)[0]
    np.add.at(seen, symbol, c)
    np.add.at(kinds, symbol, 1)
    for i, of, v_ in rare.groupBy(F.col("word").bitwiseAND(F.lit(classes - 1).cast("long"))).agg(F.sum("c"), F.count("*")).collect():
        seen[own + i] += of
        kinds[own + i] += v_
    unigram = (seen + 1) / (seen + 1).sum()
    model = train(texts.where(~fitting), symbols, unigram)
    share = np.where(np.arange(known.n) >= own, np.log10(seen + kinds + 1), 0)
    shared = spark.sparkContext.broadcast((unigram, share, model))
    mix = parts_of(texts.where(fitting), symbols, shared)

    def make():
        find = symbols.value
        uni, share, model = shared.value

        def work(data, offsets):
            h, first = tokens(data, offsets)
            symbol, at = find.find(h)
            counted = find.log[at]
            p = sum(m * x for m, x in zip(mix, chances(model, uni, symbol, first), strict=True))
            modelled = np.log10(p) - share[symbol]
            modelled += np.where(symbol >= find.own, counted, 0)
            n = np.diff(first)
            rest = at < 0
            late = np.add.reduceat(rest, first[:-1], dtype=np.int64)
            sums = [np.add.reduceat(x, first[:-1]) for x in (counted, modelled)]
            return [pa.array(n), pa.array(n - late), *map(pa.array, sums), rows.lists(late, pa.array(h[rest].view(np.int64)))]

        return work

    scored = store.written(rows.with_result(docs, text, PARTS, make, carry=carry).withColumn("key", F.monotonically_increasing_id()), "scored")
    late = scored.select("key", F.explode("res.rest").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n")).join(rare, "word").groupBy("key").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("late"))
    both = scored.join(late, "key", "left")
    late = F.coalesce("late", F.lit(0.0))
    return both.select(
        "row",
        F.col("res.n_tokens").alias("n_tokens"),
        (F.col("res.n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("res.counted") + late - F.col("res.n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("res.model") + late).alias("score"),
    )
