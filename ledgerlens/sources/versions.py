"""Tables that are appended to and read at any time, folded now and then into a version of bounded size."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class FoldedTable:
    """A folder with a log of appended frames and versions into which the log is folded.

    ``fold`` makes the table from rows of any origin, and must give the same from folded rows and new ones as from all rows at once
    (the newest rows of each key, for example). A version counts from the moment the list of the log entries it holds is
    written, which is its last file, so readers always see a whole one. Appends and reads need no lock; compactions are made one
    at a time. What a compaction replaces is deleted by the next one, so a reader has as long to finish.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.fold = spark, path.rstrip("/"), schema, fold

    def _files(self, folder: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _complete(self, folder: str, mark: str = "_SUCCESS") -> list[str]:
        """Entries of a folder whose last file is there, in ascending order."""
        fs, where = self._files(folder)
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(n for n in names if fs.exists(self._files(f"{folder}/{n}/{mark}")[1]))

    def _newest(self) -> tuple[str | None, set[str]]:
        """The newest version and the log entries it holds."""
        versions = self._complete("versions", "folded/_SUCCESS")
        if not versions:
            return None, set()
        held = self.spark.read.text(f"{self.path}/versions/{versions[-1]}/folded")
        return versions[-1], {r.value for r in held.collect() if r.value}  # entries of one or two compactions

    def append(self, df: DataFrame, name: str | None = None) -> None:
        """Add rows; an entry written again under its own name (by a repeated batch) replaces itself."""
        name = name or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/{name}")

    def _rows(self, version: str | None, entries: list[str]) -> DataFrame:
        paths = [f"{self.path}/log/{name}" for name in entries]
        paths += [f"{self.path}/versions/{version}/rows"] if version else []
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.fold(self.spark.read.schema(self.schema).parquet(*paths))

    def pending(self) -> int:
        """Entries that are in no version yet."""
        held = self._newest()[1]
        return sum(name not in held for name in self._complete("log"))

    def read(self) -> DataFrame:
        version, held = self._newest()
        return self._rows(version, [name for name in self._complete("log") if name not in held])

    def compact(self) -> None:
        """Fold what was appended since into a new version, and delete what the version before had replaced."""
        version, held = self._newest()
        present = self._complete("log")
        new = [name for name in present if name not in held]
        if not new:
            return
        number = 1 + int(version.split("-")[0]) if version else 1
        name = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        self._rows(version, new).write.parquet(f"{self.path}/versions/{name}/rows")
        listed = self.spark.createDataFrame([(n,) for n in sorted({*new, *(held & set(present))})], "value string")
        listed.coalesce(1).write.text(f"{self.path}/versions/{name}/folded")
        for entry in held & set(present):
            fs, where = self._files(f"log/{entry}")
            fs.delete(where, True)
        for old in self._complete("versions", "folded/_SUCCESS")[:-2]:
            fs, where = self._files(f"versions/{old}")
            fs.delete(where, True)
