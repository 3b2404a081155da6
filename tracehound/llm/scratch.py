"""Intermediate tables under the session's shared checkpoint folder, removed after use."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_table_path


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast whose classes travel with it, so that executors need no copy of the package."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


@contextmanager
def lent(spark: SparkSession, value: Any) -> Iterator[Callable[[], Any]]:
    """As :func:`shared`, for the actions in here: its blocks and the driver's file go with their end."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    try:
        yield lambda: pickle.loads(data.value)
    finally:
        data.destroy()


def map_rows(docs: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: Spark sees them by number, ``run`` by name."""
    names, inner = docs.columns, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, inner.names)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(numbered, inner).toDF(*schema.names)


def trim(spark: SparkSession, command: str = "systemTrimNativeHeap") -> str:
    """Have both of the driver's processes give freed native memory back; the JVM's answer.  glibc keeps what
    its many threads have freed, so that the JVM's share outside its heap grows from step to step.  Where the
    platform has no such call, nothing is done."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    jvm = spark._jvm
    try:
        # by the method of the public interface: the server's own class is not open to calls
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # a JVM without this command
        return ""


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage.  Plans, broadcasts and shuffle files of finished steps go
    with the last references to them, which the JVM finds late while its heap is still free to grow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    trim(spark)


@contextmanager
def exchanges_released(spark: SparkSession) -> Iterator[None]:
    """Frames made in here give up their shuffle files as soon as an action on them ends, whenever the
    driver's garbage is collected (an action on the same frame again computes them anew)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to cut lineage: ``keep`` writes one and reads it back, ``drop`` removes
    all but those named (a lazy result still reads its own)."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_table_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        old = self.paths.get(name)
        if old:
            self._remove(old)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: str) -> None:
        for name in [n for n in self.paths if n not in but]:
            self._remove(self.paths.pop(name))

    def release(self) -> None:
        release(self.spark)

    def _remove(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
