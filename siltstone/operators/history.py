"""Merges and slowly changing dimensions as declarative joins: no driver loops, one shuffle of each side on the key.

Keys are compared null-safely, so a null key is a key. A source that repeats a key makes the job fail. The functions over
frames give frames; those over tables commit to them, write again only the files that hold changed keys, and commit
nothing where nothing changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.folders import Folder, working
from ..sources.lake import LakeTable, same


def once(source: DataFrame, keys: list[str]) -> DataFrame:
    """source, which fails when run if a key occurs twice."""
    named = source.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.struct("*").alias("row"))
    found = named.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"), F.any_value("row").alias("row"))
    return found.where(F.assert_true(F.col("n") == 1, f"the merge source repeats a key of {keys}").isNull()).select("row.*")


def changed(columns: list[str], a: str, b: str) -> Column:
    """Whether any column differs, null-safely."""
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns), F.lit(False))


def joined(target: DataFrame, source: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Structs t and s of the rows that meet on the keys; a side that is missing is null."""
    return target.select(F.struct("*").alias("t")).join(once(source, keys).select(F.struct("*").alias("s")), same("t", "s", keys), how)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Type 1: source rows replace target rows of their key, others are added."""
    both = joined(target, source, keys, "full_outer")
    return both.select(*[F.when(F.col("s").isNotNull(), F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) for c in target.columns])


def snapshot(history: DataFrame, source: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Type 2 in a single pass: history has version and is_current; changed keys are closed and reopened, new keys opened."""
    both = history.select(F.struct("*").alias("t")).join(once(source, keys).select(F.struct("*").alias("s")), same("t", "s", keys) & F.col("t.is_current"), "full_outer")
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    moved = has_t & has_s & changed(tracked, "t", "s")
    columns = [*keys, *tracked]
    old = F.struct(*[F.col(f"t.`{c}`").alias(c) for c in columns], F.col("t.version").alias("version"), (F.col("t.is_current") & ~moved).alias("is_current"))
    new = F.struct(*[F.col(f"s.`{c}`").alias(c) for c in columns], (F.coalesce("t.version", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_current"))
    rows = F.array_compact(F.array(F.when(has_t, old), F.when(has_s & (moved | ~has_t), new)))
    return both.select(F.explode(rows).alias("row")).select("row.*")


#: Rows of one key that a window takes; keys with more are cut into parts of the sequence, CUTS at most.
MOST, CUTS = 4_000_000, 256


def from_changes(feed: DataFrame, keys: list[str], tracked: list[str], sequence: list[str], at: str, start: str = "start_at", end: str = "end_at", most: int = MOST) -> DataFrame:
    """Type 2 from a change feed in any order: a row for each real change, open until the next one.

    Of a key with more than `most` rows, windows see parts of its sequence (by percentiles of the first sequence column, a
    number or time), and what lies before and after a part is joined from a table of one row a part.
    """
    key = [F.col(f"row.`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    names, order = [f"k{i}" for i in range(len(keys))], F.struct(*[F.col(f"row.`{c}`") for c in sequence])
    values = F.struct(*[F.col(f"row.`{c}`").alias(f"v{i}") for i, c in enumerate(tracked)])
    rows = feed.select(F.struct("*").alias("row"))
    rows = rows.select(*key, order.alias("at"), values.alias("value"), F.col(f"row.`{at}`").alias("time"))
    hot = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*[F.col(n).alias(f"h{n}") for n in names])
    if hot.isEmpty():
        parts, rows = names, rows.withColumn("part", F.lit(0))
    else:
        # hot keys are no more than rows / most
        meets = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"h{n}")) for n in names))
        first = F.col("at").getField(sequence[0])
        cuts = rows.join(F.broadcast(hot), meets, "left_semi").groupBy(*[F.col(n).alias(f"h{n}") for n in names]).agg(F.percentile_approx(first, [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts"))
        part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < first)) + 1)
        rows = rows.join(F.broadcast(cuts), meets, "left").select(*names, "at", "value", "time", part.alias("part"))
        parts = [*names, "part"]
    w = Window.partitionBy(*parts).orderBy("at")
    rows = rows.withColumns({"nth": F.row_number().over(w), "before": F.lag("value").over(w)})
    if parts != names:
        rows = beside(rows, names, F.max_by("value", "at"), F.lag, "before", F.col("nth") == 1)
    seen = rows.where(F.col("before").isNull() | ~F.col("value").eqNullSafe(F.col("before")))
    seen = seen.withColumn("until", F.lead("time").over(w))
    if parts != names:
        seen = beside(seen.withColumn("last", F.lead(F.lit(1)).over(w).isNull()), names, F.min_by("time", "at"), F.lead, "until", F.col("last"))
    return seen.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[F.col(f"value.v{i}").alias(c) for i, c in enumerate(tracked)], F.col("time").alias(start), F.col("until").alias(end))


def beside(rows: DataFrame, names: list[str], value: Column, step, column: str, where: Column) -> DataFrame:
    """rows whose `column`, `where` a part of a hot key begins or ends, is the neighbouring part's value."""
    one = rows.where("part > 0").groupBy(*names, "part").agg(value.alias("value"))
    near = one.select(*[F.col(n).alias(f"h{n}") for n in names], F.col("part").alias("hpart"), step("value").over(Window.partitionBy(*names).orderBy("part")).alias("near"))
    meets = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"h{n}")) for n in (*names, "part")))
    return rows.join(F.broadcast(near), meets, "left").withColumn(column, F.when(where & (F.col("part") > 0), F.col("near")).otherwise(F.col(column))).drop("near", *[f"h{n}" for n in (*names, "part")])


class Staged:
    """Rows that a merge reads several times, written to the shared folder meanwhile."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.path = working(spark, "merge")
        df.write.parquet(self.path)
        self.rows = spark.read.schema(df.schema).parquet(self.path)
        self.spark = spark

    def __enter__(self) -> DataFrame:
        return self.rows

    def __exit__(self, *_) -> None:
        Folder(self.spark, self.path).delete()


def merge_scd1(table: LakeTable, source: DataFrame, keys: list[str], audit: dict[str, Column] | None = None, only_changed: bool = True) -> dict[str, int]:
    """Source rows replace target rows of their key or are added; `audit` columns (such as an update time) are set on every row written."""
    audit, base = audit or {}, table.state()
    columns = base.schema
    given = [c for c in columns if c in source.columns and c not in audit]
    source = source.select(*[F.col(f"`{c}`").cast(columns[c]).alias(c) for c in given])
    both = table.read(base.version).select(F.struct("*").alias("t")).join(once(source, keys).select(F.struct("*").alias("s")), same("t", "s", keys), "right")
    new = F.col("t").isNull()
    if only_changed:
        both = both.where(new | changed([c for c in given if c not in keys], "t", "s"))
    value = lambda c: audit[c].cast(columns[c]) if c in audit else F.col(f"s.`{c}`") if c in given else F.col(f"t.`{c}`")
    with Staged(table.spark, both.select(F.struct(*[value(c).alias(c) for c in columns]).alias("row"), new.alias("new"))) as rows:
        inserted, updated = rows.agg(F.count_if(F.col("new")), F.count_if(~F.col("new"))).first()
        metrics = {"numTargetRowsInserted": inserted, "numTargetRowsUpdated": updated}
        if inserted + updated:
            touched = rows.where("NOT new").select(*[F.col(f"row.`{k}`").alias(k) for k in keys])
            table.replace_keys(keys, touched, rows.select("row.*"), "MERGE", metrics, base)
    return metrics


def merge_scd2(table: LakeTable, source: DataFrame, keys: list[str], tracked: list[str], at: Column, close_missing: bool = False) -> dict[str, int]:
    """A snapshot against a table with effective_start, effective_end and is_current: `at`, one time for all rows, ends the open row of a changed key and starts the new one."""
    base = table.state()
    columns = base.schema
    own = {"effective_start", "effective_end", "is_current"}
    given = [c for c in columns if c in source.columns and c not in own]
    source = once(source.select(*[F.col(f"`{c}`").cast(columns[c]).alias(c) for c in given]), keys)
    history = table.read(base.version)
    both = history.where("is_current").select(F.struct("*").alias("t")).join(source.select(F.struct("*").alias("s")), same("t", "s", keys), "full_outer" if close_missing else "right")
    old, here = F.col("t").isNotNull(), F.col("s").isNotNull()
    both = both.where(~old | ~here | changed(tracked, "t", "s"))
    key = F.struct(*[F.when(here, F.col(f"s.`{k}`")).otherwise(F.col(f"t.`{k}`")).alias(k) for k in keys])
    with Staged(table.spark, both.select(key.alias("key"), F.col("s").alias("row"), old.alias("old"))) as found:
        inserted, updated, closed = found.agg(F.count_if(~F.col("old")), F.count_if(F.col("old") & F.col("row").isNotNull()), F.count_if(F.col("row").isNull())).first()
        metrics = {"numTargetRowsInserted": inserted + updated, "numTargetRowsUpdated": updated + closed}
        if inserted + updated + closed:
            touched = found.where("old").select("key.*")
            kept = history.alias("t").join(touched.alias("s"), same("t", "s", keys), "left_semi")
            ended = kept.withColumns({"effective_end": F.when(F.col("is_current"), at.cast(columns["effective_end"])).otherwise(F.col("effective_end")), "is_current": F.lit(False)})
            value = {"effective_start": at, "effective_end": F.lit(None), "is_current": F.lit(True)}
            opened = found.where("row IS NOT NULL").select(*[(value[c] if c in own else F.col(f"row.`{c}`") if c in given else F.lit(None)).cast(k).alias(c) for c, k in columns.items()])
            table.replace_keys(keys, touched, ended.select(*columns).unionByName(opened), "MERGE", metrics, base)
    return metrics


def merge_changes(feed: LakeTable, table: LakeTable, changes: DataFrame, keys: list[str], tracked: list[str], sequence: str) -> dict[str, int]:
    """Type 2 from a change feed that comes in parts and in any order. `feed` keeps every change once; the histories of its new keys are built again.

    feed has the keys, tracked columns and the sequence; table has keys and tracked columns, __START_AT and __END_AT.
    Of changes of one key and sequence the largest row counts. A null sequence makes the job fail.
    """
    columns = [*keys, *tracked, sequence]
    state = feed.state()
    new = changes.select(*[F.col(f"`{c}`").cast(state.schema[c]).alias(c) for c in columns]).distinct()
    new = new.where(F.assert_true(F.col(f"`{sequence}`").isNotNull(), "a change has no sequence").isNull())
    known = feed.read(state.version)
    late = new.alias("t").join(known.alias("s"), same("t", "s", columns), "left_anti")
    feed.append(late)
    # all that came since the table was last built, so that a run that died in between is made up for
    base = table.state()
    rows, version = feed.changes(base.streams.get("feed", -1))
    touched = rows.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    whole = feed.read(version).alias("t").join(touched.alias("s"), same("t", "s", keys), "left_semi")
    last = whole.groupBy(*[F.col(f"`{c}`") for c in (*keys, sequence)]).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in tracked])).alias("row"))
    one = last.select(*[F.col(f"`{c}`") for c in (*keys, sequence)], "row.*")
    built = from_changes(one, keys, tracked, [sequence], sequence, "__START_AT", "__END_AT")
    built = built.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in base.schema.items()])
    with Staged(table.spark, built) as rows:
        n = rows.count()
        if n:
            table.replace_keys(keys, touched, rows, "MERGE", {"numTargetRowsInserted": n}, base, {"feed": version})
    return {"numTargetRowsInserted": n}
