"""Filters, splits, keep-first rules and contracts, all narrow or one shuffle on the key. Columns of any name may be there: helpers stand outside the row's struct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F


class ContractViolation(ValueError):
    """A frame's columns are not those agreed on."""


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in `order`. Spark cuts each partition to its firsts before the shuffle, so a hot key is no large group."""
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    return df.select(F.struct("*").alias("row"), rank.alias("rank")).where("rank = 1").select("row.*")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is largest by some columns, nulls last; ties go to the smallest in the other columns."""
    rest = [c for c in df.columns if c not in {*keys, *by}]
    return keep_first(df, keys, [*[F.col(f"`{c}`").desc_nulls_last() for c in by], *[F.col(f"`{c}`").asc_nulls_last() for c in rest]])


def split(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(quarantined, clean): together exactly df; an unknown condition is not bad."""
    bad = F.coalesce(bad, F.lit(False))
    return df.where(bad), df.where(~bad)


def reasoned(df: DataFrame, reasons: list[tuple[str, Column]], column: str = "rejection_reason") -> DataFrame:
    """Rows that break a rule, with the first broken rule's name."""
    first = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in reasons])
    return df.withColumn(column, first).where(F.col(column).isNotNull())


def quarantined(df: DataFrame, reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that break a rule, with rejection_reason and quarantined_at; all other rows)."""
    any_ = reduce(lambda a, b: a | b, (F.coalesce(bad, F.lit(False)) for _, bad in reasons))
    return reasoned(df, reasons).withColumn("quarantined_at", F.current_timestamp()), df.where(~any_)


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that keep every rule (expect or drop); unknown counts as broken."""
    return df.where(reduce(lambda a, b: a & b, (F.coalesce(r, F.lit(False)) for r in rules.values()), F.lit(True)))


def observed(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df, whose next action also counts its rows (`rows`) and those that break each rule, in the same pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()]), seen


def check_contract(df: DataFrame, expected: dict[str, str] | list[str], name: str = "frame") -> DataFrame:
    """df itself, if its columns (and types, where given) are the expected ones; else all that differs is told at once. Runs no job."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    unexpected, missing = sorted(set(have) - set(expected)), sorted(set(expected) - set(have))
    types = {c: (k, have[c]) for c, k in expected.items() if c in have and have[c] != k} if isinstance(expected, dict) else {}
    if unexpected or missing or types:
        raise ContractViolation(f"{name}: unexpected {unexpected}, missing {missing}, other types {types}")
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total_rows, and the nulls of each column as null_<column>."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns])
