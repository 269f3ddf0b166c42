"""Rows that come from the driver, from a web service or from a rule, and nested rows laid flat."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def from_rows(spark: SparkSession, rows: Iterable, schema: str | list[str] | None = None) -> DataFrame:
    """A frame of dicts (columns in the order they first come, missing ones null), tuples, Rows or a pandas frame."""
    if not isinstance(rows, (list, tuple)):
        rows = rows if hasattr(rows, "columns") else list(rows)
    if not hasattr(rows, "columns") and len(rows) and all(type(r) is dict for r in rows):
        names = list(dict.fromkeys(k for r in rows for k in r))
        rows, schema = [tuple(r.get(n) for n in names) for r in rows], schema or names
    return spark.createDataFrame(rows, schema)


def fetch_json(url: str, timeout: float = 30) -> object:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.load(answer)


def from_rest(spark: SparkSession, url: str, schema: str, fetch: Callable[[str], object] = fetch_json, records: str | None = None) -> DataFrame:
    """A service's JSON answer, a list of objects or one with such a list under `records`, as rows of a schema; unknown fields are dropped."""
    found = fetch(url)
    found = found if records is None else found[records]
    if not isinstance(found, list):
        raise ValueError(f"{url} gave no list of records")
    lines = spark.createDataFrame([(json.dumps(r),) for r in found], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def flattened(df: DataFrame) -> DataFrame:
    """Fields of structs, however deep, as columns with dotted names; arrays and maps stay."""

    def leaves(kind: T.StructType, at: Column | None, names: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            out += leaves(f.dataType, here, (*names, f.name)) if isinstance(f.dataType, T.StructType) else [here.alias(".".join((*names, f.name)))]
        return out

    return df.select(*leaves(df.schema, None, ()))


def events(spark: SparkSession, n: int, kinds: tuple[str, ...] = ("click", "purchase", "login", "logout"), users: int = 1000, files: int | None = None, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """n events a second apart, the same in every run: event_id, event_type, user_id and timestamp follow from the number alone."""
    spread = F.pmod(F.col("id") * 7919 + 104729, F.lit(1_000_003))
    found = spark.range(n) if files is None else spark.range(0, n, 1, files)
    return found.select(
        F.col("id").cast("int").alias("event_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(spread, F.lit(len(kinds))) + 1).cast("int")).alias("event_type"),
        (F.pmod(spread, F.lit(users)) + 1).cast("int").alias("user_id"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
    )
