"""Column expressions that the layers share; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def typed(df: DataFrame, kinds: dict[str, str], keep_raw: tuple[str, ...] = ()) -> DataFrame:
    """Columns cast where they can be, null where not; `keep_raw` stay beside them as raw_<name>. Others stay as they are."""
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").alias(f"raw_{c}") for c in keep_raw])


def epoch_timestamp(text: Column) -> Column:
    """Seconds since 1970 as text, whole or not, as a timestamp; null for anything else."""
    return F.timestamp_seconds(text.try_cast("double").try_cast("bigint"))


def code(text: Column) -> Column:
    """A name that is compared: trimmed and in capitals, null where nothing is left."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def title(text: Column) -> Column:
    """A name that is shown: trimmed, each word with a capital."""
    return F.initcap(F.trim(text))


def blank(text: Column) -> Column:
    """Null or empty."""
    return text.isNull() | (text == "")


def money(amount: Column) -> Column:
    """An exact sum, whatever the order of rows."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def line_revenue(price: Column, quantity: Column) -> Column:
    return F.round(price * quantity, 2)
