"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_GIVEN: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir, deleted when the process ends. Where that is unset, a local folder in a session of
    one process (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strayframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _GIVEN.append((spark, path))
    return path


@atexit.register
def _delete() -> None:
    for spark, path in _GIVEN:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue
