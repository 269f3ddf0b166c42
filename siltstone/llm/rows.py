"""Row-wise operators: each row of the input, whatever its columns, comes out with one result struct beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import store, textvec

KINDS = {"string": T.StringType(), "binary": T.BinaryType()}


class Carried:
    """What Python gets of a table: the text once, and of the other columns those that come out again.

    source has the columns kept (a struct), text and those of `more`; carry names the columns wanted of the
    input, all where None. Python gives back what `again` takes of its batches, and row() is made of that.
    """

    def __init__(self, docs: DataFrame, text: str, kind: str = "string", carry: list[str] | None = None, **more: Column):
        store.small_batches(docs.sparkSession)
        self.names, self.text = docs.columns if carry is None else carry, text
        # the text itself comes back only where it is carried and is what Python gets
        self.back = text in self.names and docs.schema[text].dataType == KINDS[kind]
        kept = [F.col(f"`{c}`") for c in self.names if not (self.back and c == text)]
        kept = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
        self.source = docs.select(kept.alias("kept"), F.col(f"`{text}`").cast(kind).alias("text"), *[c.alias(n) for n, c in more.items()])
        self.shape = [self.source.schema["kept"], *([T.StructField("text", KINDS[kind])] if self.back else [])]

    def row(self) -> Column:
        return F.struct(*[(F.col("text") if self.back and c == self.text else F.col(f"kept.`{c}`")).alias(c) for c in self.names]).alias("row")


def again(batch: pa.RecordBatch, back: bool, a: int, b: int, **more: pa.Array) -> pa.RecordBatch:
    """Rows a to b of a batch of Carried.source as it wants them back, with further columns."""
    names = ["kept", "text"][: 1 + back]
    return pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(names))), *more.values()], names=[*names, *more])


def with_result(docs: DataFrame, text: str, result: T.StructType, fn: Callable[[], Callable[[np.ndarray, np.ndarray], list[pa.Array]]], kind: str = "string", carry: list[str] | None = None) -> DataFrame:
    """Columns row (all of docs, or those of carry) and res (fn's result) for each row.

    fn() is called once a task and gives a function from (bytes, offsets) of a slice of texts to
    one Arrow array for each field of result. Nothing is shuffled and rows keep their columns, so
    names that clash can't do harm.
    """
    held = Carried(docs, text, kind, carry)
    kinds, names, back = [to_arrow_type(f.dataType) for f in result.fields], result.fieldNames(), held.back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or fn()
            data, offsets = textvec.utf8(batch.column(1))
            for a, b in textvec.slices(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                cols = [c if c.type == k else c.cast(k) for c, k in zip(work(data[lo:hi], offsets[a : b + 1] - lo), kinds, strict=True)]
                yield again(batch, back, a, b, res=pa.StructArray.from_arrays(cols, fields=[pa.field(n, k) for n, k in zip(names, kinds, strict=True)]))

    return held.source.mapInArrow(run, T.StructType([*held.shape, T.StructField("res", result)])).select(held.row(), "res")


def lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array from the length of each list and all values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
