"""Labelled rows for the text classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import store


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """Columns text and y (0 or 1) of at most `limit` rows of each label, those whose ids hash lowest.

    Only ids that `allowed` takes are looked at; an id labelled twice counts once, with its larger
    label. The sample is bounded, so its ids are broadcast and no text is shuffled.
    """
    one = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "y")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin (one more at the end)."""
    column = column.combine_chunks()
    cut = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), cut


def order(y: np.ndarray, cut: np.ndarray, *values: np.ndarray) -> list[int]:
    """The rows in an order of their content alone: by length, a hash of their values, and label."""
    key = lambda i: (int(cut[i + 1] - cut[i]), *(xxhash.xxh3_64_intdigest(np.ascontiguousarray(v[cut[i] : cut[i + 1]])) for v in values), int(y[i]))
    return sorted(range(len(y)), key=key)


def fitted(sample: DataFrame, fit: Callable[[pa.Table, int], object], times: int = 1) -> list:
    """What fit(rows of the sample, k) gives for k in range(times), each in a task of its own that holds the bounded sample.

    Fitting in tasks keeps the driver small, and a lost executor's fit is done again.
    """
    table = store.written(sample, "sample")
    names = table.columns
    dealt = table.select("*", F.explode(F.array(*[F.lit(k) for k in range(times)])).alias("fit")).repartition("fit")

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        held = pa.Table.from_batches(batches)
        which = held.column("fit").to_numpy()
        for k in np.unique(which):
            model = fit(held.filter(pa.array(which == k)).select(names).combine_chunks(), int(k))
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], names=["fit", "model"])

    return [pickle.loads(r.model) for r in sorted(dealt.mapInArrow(run, "fit int, model binary").collect(), key=lambda r: r.fit)]
