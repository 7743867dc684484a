"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch sent to a Python worker. Texts may be long, so batches stay short.
ARROW_ROWS = 512

_WRITTEN: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows (the session default of 10,000 is meant for narrow rows)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local one in a session of one process (tests)
    and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strayframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/strayframe/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`stored` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already, or this one table cannot be deleted
            continue


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. A lost executor costs only
    the tasks that were still running, and every later read sees the same rows. Compressed by zstd, whose buffers are on the
    heap; those of lz4 and snappy are not and go unfreed until the heap is collected."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    trim_driver(spark)
    return out


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM return what it has freed outside its heap (compilers, codecs): the C library keeps it in an arena a thread, which
    adds up over many plans. False where the JVM has no such command."""
    jvm, java = spark.sparkContext._jvm, spark.sparkContext._jvm.java.lang

    def array(kind: JavaClass, *items: object) -> JavaObject:
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    texts = "[Ljava.lang.String;"
    kinds = array(java.Class, *map(java.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", texts)))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = array(java.Object, command, "systemTrimNativeHeap", array(java.Object, array(java.String)), array(java.String, texts))
    try:  # by the interface, as the class behind it is not open to others
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and have Spark drop the shuffle files of finished plans now, and the
    driver the memory of its plans; both would stay until the driver's heap happens to fill, which grows meanwhile."""
    for table in tables:
        remove(spark, table._stored_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


#: What Python workers keep from task to task, by owner: how it is dropped.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    _KEPT[owner] = forget


def given_back() -> None:
    """Return freed memory to the system: a worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_kept() -> None:
    """Drop what a worker keeps from the tasks before: workers outlive a stage, and what they keep would be held beside all that the
    stages after need."""
    for forget in _KEPT.values():
        forget()
    given_back()


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
