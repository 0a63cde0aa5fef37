"""Stored intermediate tables, keyed by all their parameters."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint directory.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="lexicade-")
    return _local_folders[app]


class Store:
    """Parquet tables under one folder; a table is built only if it is missing.

    Every parameter that shapes a table is part of its path, so a changed
    parameter never meets a stale table. A store opened without a folder starts
    empty.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self._own = folder is None
        self._guard = threading.Lock()
        self._locks: dict[str, threading.RLock] = {}

    def drop(self) -> None:
        """Delete the tables of a store that was opened without a folder."""
        if self._own:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def path(self, kind: str, /, **params: object) -> str:
        text = json.dumps(params, sort_keys=True, default=str)
        return f"{self.folder}/{kind}/{hashlib.sha256(text.encode()).hexdigest()[:24]}"

    def exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def table(self, build: Callable[[], DataFrame], kind: str, /, **params: object) -> DataFrame:
        """Read the table, after building and writing it if it is missing.

        Threads that ask for the same table wait for the one that builds it.
        """
        path = self.path(kind, **params)
        with self._guard:
            lock = self._locks.setdefault(path, threading.RLock())
        with lock:
            if self.exists(path):
                return self.spark.read.parquet(path)
            built = build()
            built.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(built.schema).parquet(path)


def save_best(best: DataFrame, path: str) -> None:
    """The best configuration: one nested row as JSON."""
    best.write.mode("overwrite").json(path)
