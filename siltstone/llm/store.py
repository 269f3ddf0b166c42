"""Tables written between stages, in the folder that all machines of the cluster share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..sources import folders

#: Bytes of an Arrow batch. Spark's own 64 MB, with buffers that double as they grow and copies on both sides, take hundreds
#: of MB outside the heap of an executor, for texts that are then handled a slice at a time.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit for Arrow batches, unless it has one that is not Spark's own."""
    if spark.conf.get(BATCH[0], "67108864b") in ("67108864b", "67108864", "64MB"):
        spark.conf.set(BATCH[0], BATCH[1])


def trim_jvm(spark: SparkSession) -> None:
    """Has the driver's JVM give back what malloc holds free for it, where it can (HotSpot on glibc, from 17.0.9 on): the arenas of
    hundreds of threads that plan, compile and compress for a long chain of jobs hold hundreds of MB outside the heap."""
    gateway, of = spark.sparkContext._gateway, spark._jvm.java.lang
    try:
        bean = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given, kinds = gateway.new_array(of.Object, 1), gateway.new_array(of.String, 1)
        given[0], kinds[0] = gateway.new_array(of.String, 0), "[Ljava.lang.String;"
        call = gateway.new_array(of.Object, 4)
        for k, x in enumerate((bean, "systemTrimNativeHeap", given, kinds)):
            call[k] = x
        # the server's own class isn't open to calls from outside
        invoke = next(m for m in of.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(of.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # a JVM without the command
        pass


def spared(spark: SparkSession) -> None:
    """Gives memory of the driver back: what is free of its Python's and of its JVM's outside the heap, and the heap's garbage
    where the heap takes over half of its limit. The plans and task reports of a long chain of jobs would else fill the heap
    before they are collected."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim_jvm(spark)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet and read again: later plans start from the files, which a lost executor can't take along."""
    small_batches(df.sparkSession)
    path = folders.working(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    spared(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that no later plan reads."""
    folders.Folder(df.sparkSession, df.written_at).delete()
