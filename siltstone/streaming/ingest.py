"""Incremental file ingestion with a schema log and rescued data, and streams into versioned tables.

Files are read as lines by Structured Streaming, so each is taken in once for a checkpoint. Columns of the schema are
cast with try_cast; a value that does not cast, a key that the schema does not have and a line that is no JSON object are
kept in `_rescued_data`, so that no row and no value is lost. In the mode add_new_columns an unknown key
is first recorded in the schema log, beside the checkpoint, and then ends the run with SchemaEvolved; the next run, in this
object or another, takes it in. Batches are appended to a LakeTable under (stream, batch): one that is repeated is
skipped. The stream's name is kept in the checkpoint, so a deleted checkpoint takes everything in again, as new rows.
"""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.folders import Folder
from ..sources.lake import LakeTable, types_of

RESCUED = "_rescued_data"
#: New keys that one batch may bring; more are no schema.
MOST_KEYS = 10_000


class SchemaEvolved(Exception):
    """Unknown keys were added to the schema; run again."""


class SchemaLog:
    """Versions of a schema, in files that are created once each."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def read(self) -> dict[str, str] | None:
        found = [n for n, _, _ in self.folder.files() if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.folder.read(found[-1])) if found else None

    def grow(self, schema: dict[str, str]) -> dict[str, str]:
        """Adds columns; what another run added meanwhile is kept."""
        while True:
            files = [n for n, _, _ in self.folder.files() if n.endswith(".json") and not n.startswith(".")]
            now = (json.loads(self.folder.read(files[-1])) if files else {}) | {}
            grown = now | {c: k for c, k in schema.items() if c not in now}
            if grown == now or self.folder.write_new(f"{len(files):010d}.json", json.dumps(grown)):
                return grown


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to; a new checkpoint gets a new one."""
    folder = Folder(spark, checkpoint)
    folder.write_new("stream-name", uuid.uuid4().hex)
    return folder.read("stream-name")


def cast(value: Column, kind: str) -> Column:
    """A text as a column of some type, null where it is none; structs, arrays and maps are read as JSON."""
    return F.from_json(value, kind) if kind.startswith(("struct", "array", "map")) else value.try_cast(kind)


def parsed(rows: DataFrame, found: Column, line: Column, schema: dict[str, str]) -> DataFrame:
    """Typed columns and _rescued_data of rows whose text values are the map `found`, null where `line` couldn't be read."""
    value = lambda c: F.try_element_at(found, F.lit(c))
    known = F.map_filter(found, lambda k, v: v.isNotNull() & ~k.isin(list(schema)))
    bad = [F.when(value(c).isNotNull() & cast(value(c), k).isNull(), F.create_map(F.lit(c), value(c))) for c, k in schema.items()]
    lost = F.map_concat(F.coalesce(known, F.create_map().cast("map<string,string>")), *[F.coalesce(b, F.create_map().cast("map<string,string>")) for b in bad])
    rescued = F.when(found.isNull(), F.to_json(F.create_map(F.lit("_malformed"), line))).when(F.size(lost) > 0, F.to_json(lost))
    return rows.select(*[cast(value(c), k).alias(c) for c, k in schema.items()], rescued.alias(RESCUED), *[c for c in rows.columns if c.startswith("source_")])


@dataclass
class FileIngest:
    """A folder (or glob) of files into a table. Without a schema the first batch gives it: all strings, or inferred types with infer_types."""

    spark: SparkSession
    source: str
    target: str
    checkpoint: str
    schema: dict[str, str] = field(default_factory=dict)
    fmt: str = "json"
    infer_types: bool = False
    add_new_columns: bool = False
    #: Whether source_filename, ingestion_timestamp and load_date are added.
    metadata: bool = False
    files_per_batch: int | None = None

    def __post_init__(self):
        if self.fmt not in ("json", "csv"):
            raise ValueError(f"no format {self.fmt}")
        self.log = SchemaLog(self.spark, f"{self.checkpoint.rstrip('/')}-schema")
        self.table = LakeTable(self.spark, self.target)

    # a batch

    def _paths(self, lines: DataFrame) -> list[str]:
        """A row a file of the batch."""
        return sorted(r[0] for r in lines.select("path").distinct().collect())

    def _csv(self, lines: DataFrame) -> dict[tuple[str, ...], list[str]]:
        """The files of a batch by the columns that their first line names."""
        first = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "at").alias("head"))
        groups: dict[tuple[str, ...], list[str]] = {}
        for path, head in first.collect():
            groups.setdefault(tuple(next(csv.reader([head]), ())), []).append(path)
        return groups

    def _keys(self, lines: DataFrame, known: dict[str, str]) -> list[str]:
        if self.fmt == "csv":
            return sorted({c for names in self._csv(lines) for c in names} - set(known))
        found = lines.select(F.explode(F.json_object_keys("value")).alias("key")).where(~F.col("key").isin(list(known))).distinct().limit(MOST_KEYS + 1).collect()
        if len(found) > MOST_KEYS:
            raise ValueError(f"a batch brings more than {MOST_KEYS} new keys")
        return sorted(r[0] for r in found)

    def _kinds(self, lines: DataFrame, keys: list[str]) -> dict[str, str]:
        if not self.infer_types or not keys:
            return dict.fromkeys(keys, "string")
        paths = self._paths(lines)
        if self.fmt == "csv":
            kinds: dict[str, str] = {}
            for files in self._csv(lines).values():
                kinds |= types_of(self.spark.read.csv(files, header=True, inferSchema=True, escape="\""))
        else:
            try:
                kinds = types_of(self.spark.read.json(paths))
            except AnalysisException:  # an object repeats a key
                kinds = {}
        return {c: kinds.get(c, "string") for c in keys}

    def _rows(self, lines: DataFrame, schema: dict[str, str]) -> DataFrame:
        if self.fmt == "json":
            return parsed(lines.withColumnRenamed("path", "source_filename"), F.from_json("value", "map<string,string>"), F.col("value"), schema)
        out = None
        for names, files in self._csv(lines).items():
            # by position: names that repeat don't clash
            read = self.spark.read.schema(", ".join(f"c{i} string" for i in range(len(names))) + ", _bad string").csv(files, header=True, enforceSchema=True, escape="\"", columnNameOfCorruptRecord="_bad", mode="PERMISSIVE")
            cells = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"c{i}").alias("v")) for i, c in enumerate(names) if c not in names[:i]]))
            read = read.select("*", F.col("_metadata.file_path").alias("source_filename"))
            extra = F.when(F.col("_bad").isNotNull(), F.to_json(F.create_map(F.lit("_malformed"), F.col("_bad"))))
            part = parsed(read.select(cells.alias("cells"), extra.alias("extra"), "source_filename").withColumnRenamed("extra", "source_extra"), F.col("cells"), F.lit(None), schema)
            part = part.withColumn(RESCUED, F.coalesce("source_extra", RESCUED)).drop("source_extra")
            out = part if out is None else out.unionByName(part)
        return out

    def _batch(self, stream: str) -> Callable[[DataFrame, int], None]:
        def batch(lines: DataFrame, number: int) -> None:
            schema = self.log.read()
            if schema is None:
                schema = self.log.grow(self.schema or self._kinds(lines, self._keys(lines, {})))
            elif self.add_new_columns and (new := self._keys(lines, schema)):
                self.log.grow(self._kinds(lines, new))
                raise SchemaEvolved(", ".join(new))
            if self.add_new_columns and self.schema and (new := self._keys(lines, schema)):
                self.log.grow(self._kinds(lines, new))
                raise SchemaEvolved(", ".join(new))
            rows = self._rows(lines, schema)
            if self.metadata:
                rows = rows.withColumns({"ingestion_timestamp": F.current_timestamp(), "load_date": F.current_date()})
            else:
                rows = rows.drop("source_filename")
            self.table.create(rows.schema, if_not_exists=True)
            self.table.append(rows, merge_schema=True, stream=(stream, number))

        return batch

    # runs

    def run_once(self, trigger: dict | None = None, wait: float | None = None) -> list[dict]:
        """Takes in all files that are not in yet and stops; or runs by another trigger for `wait` seconds. Gives the progress of each batch."""
        reader = self.spark.readStream.format("text")
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        lines = reader.load(self.source).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        return run_stream(lines, self._batch(stream_name(self.spark, self.checkpoint)), self.checkpoint, trigger, wait)

    def run(self, attempts: int = 2, **how) -> DataFrame:
        """run_once, and again after the schema has grown, up to `attempts` times; any other failure is raised at once."""
        for k in range(attempts):
            try:
                self.run_once(**how)
                break
            except StreamingQueryException as e:
                if "SchemaEvolved" not in str(e) or k + 1 == attempts:
                    raise
        return self.read()

    def read(self) -> DataFrame:
        if not self.table.exists():
            columns = self.log.read() or self.schema
            return self.spark.createDataFrame([], T.StructType.fromDDL(", ".join([*[f"`{c}` {k}" for c, k in columns.items()], f"{RESCUED} string"])))
        return self.table.read()


def JsonIngest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: dict[str, str] | None = None, add_new_columns: bool = False) -> FileIngest:
    return FileIngest(spark, source, target, checkpoint, schema or {}, add_new_columns=add_new_columns)


def progress(query: StreamingQuery) -> list[dict]:
    return [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress]


def run_stream(frame: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, wait: float | None = None, output_mode: str = "append") -> list[dict]:
    """Runs a stream to its end, or for `wait` seconds and until the batch at hand is done; its batches' progress."""
    query = frame.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start()
    try:
        if wait is None:
            query.awaitTermination()
        elif not query.awaitTermination(wait):
            query.processAllAvailable()
    finally:
        query.stop()
    return progress(query)


def into_table(frame: DataFrame, table: LakeTable, checkpoint: str, trigger: dict | None = None, wait: float | None = None, merge_schema: bool = False) -> list[dict]:
    """A stream appended to a table, each batch once."""
    spark = table.spark
    name = stream_name(spark, checkpoint)
    table.create(frame.schema, if_not_exists=True)
    return run_stream(frame, lambda df, number: table.append(df, merge_schema, (name, number)) and None, checkpoint, trigger, wait)


def deduplicated(spark: SparkSession, source: str, schema: str, keys: list[str], event_time: str, delay: str, target: str, checkpoint: str) -> DataFrame:
    """A Parquet stream without repeated keys within the watermark, appended to a table and read back; rows later than the watermark are dropped."""
    stream = spark.readStream.schema(schema).parquet(source).withWatermark(event_time, delay).dropDuplicates(keys)
    table = LakeTable(spark, target)
    into_table(stream, table, checkpoint)
    return table.read()
