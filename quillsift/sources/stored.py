"""Folders that a session's tables are kept in, under the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session on one machine gets a new local folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Folder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self._jpath(f"{self.path}/{below}" if below else self.path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def has(self, name: str) -> bool:
        return bool(self._fs.exists(self._jpath(f"{self.path}/{name}")))

    def mark(self, name: str) -> None:
        """An empty folder, whose name is all that it says."""
        self._fs.mkdirs(self._jpath(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._jpath(f"{self.path}/{name}"), True)

    def changed(self) -> int:
        """When the folder or file was last written; 0 where there is none."""
        at = self._jpath(self.path)
        return int(self._fs.getFileStatus(at).getModificationTime()) if self._fs.exists(at) else 0


def session_folder(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/quillsift/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of the session: what reads it knows nothing of how they were made."""
    path = session_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_MADE: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], None]) -> str:
    """The path of what `build` has written from the sources, built once for a session and each state of its sources."""
    key = (os.getpid(), spark.sparkContext.applicationId, shared_folder(spark), name, *((s, Folder(spark, s).changed()) for s in sources))
    if key not in _MADE:
        path = session_folder(spark, name)
        build(path)
        _MADE[key] = path
    return _MADE[key]


def stored(spark: SparkSession, name: str, sources: list[str], rows: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once for a session and read from then on, so that filters reach its scan."""
    return spark.read.parquet(once(spark, name, sources, lambda path: rows().write.parquet(path)))
