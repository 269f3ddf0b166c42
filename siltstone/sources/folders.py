"""Files that driver and executors share, on whatever file system their path names."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_temporary: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; where neither is set, a temporary one if all runs on this machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if sc.applicationId not in _temporary:
            _temporary[sc.applicationId] = tempfile.mkdtemp(prefix="siltstone-")
        found = _temporary[sc.applicationId]
    return found.rstrip("/")


def working(spark: SparkSession, name: str) -> str:
    """A new folder for one purpose; all of one application's lie below one folder."""
    return f"{root(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder on a Hadoop file system; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file whole, unless there is one of that name: then False."""
        draft, files = f".draft-{uuid.uuid4().hex}", self.jvm.org.apache.hadoop.fs
        self.write(draft, text)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        self.fs.mkdirs(self._path(name).getParent())
        try:
            files.FileContext.getFileContext(self._path("").toUri() if ":" in self.path else self.fs.getUri(), self.conf).rename(self._path(draft), self._path(name), options)
        except Py4JJavaError as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def files(self, name: str = "") -> list[tuple[str, int, int]]:
        """(name, bytes, time of change in ms) of all files below."""
        if not self.exists(name):
            return []
        root = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        out, found = [], self.fs.listFiles(self._path(name), True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toUri().getPath()[len(root) + 1 :], f.getLen(), f.getModificationTime()))
        return sorted(out)

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def children(self, name: str = "") -> list[str]:
        """Names of the files and folders right below."""
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(name)))

    def copy(self, name: str, to: str) -> None:
        """A file or folder, within this folder."""
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), self.fs, self._path(to), False, self.conf)
