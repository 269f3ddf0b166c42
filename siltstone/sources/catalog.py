"""Schemas, volumes and named tables below one folder of a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .folders import Folder
from .lake import LakeTable


class Catalog:
    """Tables are `<schema>/tables/<name>`, volumes of files `<schema>/volumes/<name>`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def create_schema(self, name: str, if_not_exists: bool = True) -> None:
        if self.folder.exists(name) and not if_not_exists:
            raise FileExistsError(name)
        self.folder.make(f"{name}/tables")
        self.folder.make(f"{name}/volumes")

    def create_volume(self, name: str, if_not_exists: bool = True) -> Folder:
        """The folder of `schema.volume`."""
        schema, volume = self._split(name)
        at = f"{schema}/volumes/{volume}"
        if self.folder.exists(at) and not if_not_exists:
            raise FileExistsError(name)
        self.folder.make(at)
        return Folder(self.spark, f"{self.path}/{at}")

    def drop_schema(self, name: str, if_exists: bool = True) -> None:
        if not self.folder.delete(name) and not if_exists:
            raise FileNotFoundError(name)

    def _split(self, name: str) -> tuple[str, str]:
        schema, _, rest = name.partition(".")
        if not rest or not self.folder.exists(schema):
            raise FileNotFoundError(f"no schema of {name}")
        return schema, rest

    def table(self, name: str) -> LakeTable:
        """`schema.table`, whether or not it has been created."""
        schema, table = self._split(name)
        return LakeTable(self.spark, f"{self.path}/{schema}/tables/{table}")

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def tables(self, schema: str) -> list[str]:
        return [t for t in self.folder.children(f"{schema}/tables") if self.table(f"{schema}.{t}").exists()]
