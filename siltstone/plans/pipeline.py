"""Declared datasets: functions that give frames, read each other by name, and are run in the order of these reads.

A streaming table takes in what its sources got since its last run, each once; a materialized view is computed anew.
Expectations drop, fail or only count rows; auto CDC keeps a history from a change feed. Datasets are LakeTables below one
folder. `run` refreshes all of them, or those asked for and what they read; a full refresh drops streaming tables,
with their checkpoints, and builds them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.history import merge_changes
from ..operators.rows import observed
from ..sources.folders import Folder
from ..sources.lake import LakeTable
from ..streaming.ingest import FileIngest


@dataclass
class Dataset:
    name: str
    kind: str  # streaming, view or cdc
    make: Callable | None = None
    comment: str = ""
    #: rule -> (condition, what becomes of rows that break it: warn, drop or fail)
    rules: dict[str, tuple[str, str]] = field(default_factory=dict)
    cdc: dict = field(default_factory=dict)


class Pipeline:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.datasets: dict[str, Dataset] = {}
        self.edges: dict[str, set[str]] = {}
        self.counts: list[tuple[str, str, int, int]] = []
        self._order: list[str] = []
        self._running: list[str] = []
        self._read: dict[str, int] = {}
        self._full = False

    # declaration

    def _add(self, dataset: Dataset) -> None:
        if dataset.name in self.datasets:
            raise ValueError(f"{dataset.name} is declared twice")
        self.datasets[dataset.name] = dataset

    def _decorator(self, kind: str, name: str | None, comment: str):
        def wrap(f: Callable):
            self._add(Dataset(name or f.__name__, kind, f, comment, dict(getattr(f, "rules", {}))))
            return f

        return wrap

    def table(self, name: str | None = None, comment: str = ""):
        """A streaming table: its function reads with read_stream, or gives a FileIngest made with `files`."""
        return self._decorator("streaming", name, comment)

    def materialized_view(self, name: str | None = None, comment: str = ""):
        return self._decorator("view", name, comment)

    @staticmethod
    def _rule(name: str, condition: str, action: str):
        def wrap(f: Callable):
            f.rules = {name: (condition, action)} | getattr(f, "rules", {})
            return f

        return wrap

    def expect(self, name: str, condition: str):
        return self._rule(name, condition, "warn")

    def expect_or_drop(self, name: str, condition: str):
        return self._rule(name, condition, "drop")

    def expect_or_fail(self, name: str, condition: str):
        return self._rule(name, condition, "fail")

    def create_streaming_table(self, name: str, comment: str = "") -> None:
        self._add(Dataset(name, "cdc", None, comment))

    def create_auto_cdc_flow(self, target: str, source: str, keys: list[str], sequence_by: str, except_columns: tuple[str, ...] = (), track_columns: list[str] | None = None) -> None:
        """Type 2 history of a source; tracked columns are those given, else all but keys, sequence and except_columns."""
        if target not in self.datasets or self.datasets[target].kind != "cdc":
            raise ValueError(f"{target} is no streaming table made for a flow")
        self.datasets[target].cdc = {"source": source, "keys": list(keys), "sequence": sequence_by, "except": set(except_columns), "tracked": track_columns}

    # reads

    def lake(self, name: str) -> LakeTable:
        return LakeTable(self.spark, f"{self.path}/{name}")

    def _source(self, name: str) -> LakeTable:
        if name not in self.datasets:
            raise KeyError(f"no dataset {name}")
        if self._running:
            self.edges.setdefault(self._running[-1], set()).add(name)
        self._refresh(name)
        return self.lake(name)

    def read(self, name: str) -> DataFrame:
        """All rows of a dataset, which is refreshed first."""
        return self._source(name).read()

    def read_stream(self, name: str) -> DataFrame:
        """The rows that a dataset got since the running one last read it."""
        lake = self._source(name)
        mine = self.lake(self._running[-1])
        seen = mine.state().streams.get(name, -1) if mine.exists() else -1
        rows, self._read[name] = lake.changes(seen)
        return rows

    def files(self, source: str, **options) -> FileIngest:
        name = self._running[-1]
        return FileIngest(self.spark, source, f"{self.path}/{name}", f"{self.path}/_checkpoints/{name}", **options)

    # runs

    def run(self, *names: str, full_refresh: bool = False) -> list[str]:
        """Refreshes datasets, each after what it reads; gives their order."""
        self._order, self.edges, self._full = [], {}, full_refresh
        for name in names or list(self.datasets):
            self._refresh(name)
        return self._order

    def _refresh(self, name: str) -> None:
        if name in self._order:
            return
        if name in self._running:
            raise ValueError(f"datasets read each other: {' -> '.join([*self._running, name])}")
        dataset, read = self.datasets[name], self._read
        self._running.append(name)
        self._read = {}
        try:
            if self._full and dataset.kind != "view":
                for gone in (name, f"{name}__feed", f"_checkpoints/{name}", f"_checkpoints/{name}-schema"):
                    Folder(self.spark, f"{self.path}/{gone}").delete()
            {"streaming": self._stream, "view": self._view, "cdc": self._history}[dataset.kind](dataset)
        finally:
            self._running.pop()
            self._read = read
        self._order.append(name)

    def _checked(self, dataset: Dataset, df: DataFrame):
        """df without the rows to drop, and what is to be done after it was written."""
        if not dataset.rules:
            return df, lambda: None
        df, seen = observed(df, {n: F.expr(c) for n, (c, _) in dataset.rules.items()})
        for n, (c, action) in dataset.rules.items():
            kept = F.coalesce(F.expr(c), F.lit(False))
            if action == "drop":
                df = df.where(kept)
            elif action == "fail":
                df = df.where(F.assert_true(kept, f"{dataset.name}: {n}").isNull())

        def count():
            got = seen.get
            self.counts += [(dataset.name, n, got["rows"] - got[n], got[n]) for n in dataset.rules]

        return df, count

    def _stream(self, dataset: Dataset) -> None:
        found = dataset.make()
        if isinstance(found, FileIngest):
            if dataset.rules:
                raise ValueError(f"{dataset.name} takes in files and can't have expectations: declare them where it is read")
            found.run()
            found.table.create(found.read().schema, if_not_exists=True)
            return
        df, count = self._checked(dataset, found)
        lake = self.lake(dataset.name).create(df.schema, if_not_exists=True)
        base = lake.state()
        if any(v > base.streams.get(n, -1) for n, v in self._read.items()):
            state, df, meta = lake._fit(base, df, True)
            add, n = lake._write(state, df)
            lake.commit(base, "STREAMING UPDATE", add, metrics={"numOutputRows": n}, streams=dict(self._read), **meta)
            count()

    def _view(self, dataset: Dataset) -> None:
        df, count = self._checked(dataset, dataset.make())
        lake = self.lake(dataset.name)
        lake.create(df.schema, if_not_exists=True)
        lake.overwrite(df, replace_schema=True)
        count()

    def _history(self, dataset: Dataset) -> None:
        flow = dataset.cdc
        rows = self.read_stream(flow["source"])
        version = self._read[flow["source"]]
        tracked = flow["tracked"] or [c for c in rows.columns if c not in {*flow["keys"], flow["sequence"], *flow["except"]}]
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        columns = [T.StructField(c, kinds[c]) for c in (*flow["keys"], *tracked)]
        time = kinds[flow["sequence"]]
        lake = self.lake(dataset.name).create(T.StructType([*columns, T.StructField("__START_AT", time), T.StructField("__END_AT", time)]), if_not_exists=True)
        feed = self.lake(f"{dataset.name}__feed").create(T.StructType([*columns, T.StructField(flow["sequence"], time)]), if_not_exists=True)
        merge_changes(feed, lake, rows, flow["keys"], tracked, flow["sequence"])
        base = lake.state()
        if base.streams.get(flow["source"], -1) < version:
            lake.commit(base, "STREAMING UPDATE", streams={flow["source"]: version})

    # what is known of it

    def lineage(self) -> DataFrame:
        """A row for each dataset that reads another."""
        return self.spark.createDataFrame([(s, t) for t, found in self.edges.items() for s in found], "source string, target string")

    def expectations(self) -> DataFrame:
        return self.spark.createDataFrame(self.counts, "dataset string, expectation string, passed long, failed long")


