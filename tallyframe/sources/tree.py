"""File trees and file digests.  Every executor must see the path: local mode, or a shared mount.

Spark's file index leaves out names that begin with a dot or an underscore; this one doesn't.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyframe.config import DEFAULT, Layout
from tallyframe.functions.versions import version_in, version_in_file
from tallyframe.schema import TREE


def _kind(mode: int) -> str:
    return "file" if stat.S_ISREG(mode) else "directory" if stat.S_ISDIR(mode) else "link" if stat.S_ISLNK(mode) else "other"


#: Folders from which on each is a partition of its own, entries that the driver lists at most to get
#: there, and rows in a batch.
FOLDERS, LISTED, ROWS = 64, 10_000, 4096


class _Part(InputPartition):
    def __init__(self, names: list[str], deep: bool) -> None:
        super().__init__(names)
        self.names, self.deep = names, deep


class _Reader(DataSourceReader):
    """The driver lists folders level by level until there are enough for partitions of their own; what
    it has listed is read in partitions as well."""

    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self):
        listed: list[str] = []
        todo = deque([""])
        while todo and len(todo) < FOLDERS and len(listed) < LISTED:
            folder = todo.popleft()
            for raw, is_dir in self._entries(folder):
                listed.append(raw)
                if is_dir:
                    todo.append(raw)
        return [*(_Part(listed[i : i + ROWS], False) for i in range(0, len(listed), ROWS)), *(_Part([folder], True) for folder in todo)]

    def _entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            for e in found:
                yield f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False)

    def _row(self, raw: str):
        full = os.path.join(self.root, raw)
        own = os.lstat(full)
        try:
            target = os.stat(full)
        except OSError:
            target = None
        return raw.replace("\\", "/"), raw, _kind(own.st_mode), _kind(target.st_mode) if target else "missing", (target or own).st_size

    def _names(self, partition: _Part) -> Iterator[str]:
        if not partition.deep:
            yield from partition.names
            return
        todo = list(partition.names)
        while todo:
            for raw, is_dir in self._entries(todo.pop()):
                yield raw
                if is_dir:
                    todo.append(raw)

    def read(self, partition):
        names = self._names(partition)
        schema = pa.schema([(f.name, pa.int64() if f.name == "size" else pa.string()) for f in TREE.fields])
        while rows := [self._row(raw) for raw in islice(names, ROWS)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class TreeSource(DataSource):
    """format("tree"): option path, the root folder."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return _Reader(self.options["path"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).load()


def file_md5(path: str, block: int = DEFAULT.block) -> bytes:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.digest()


def hashed(files: DataFrame, root: str, parallel: int = 0, moved: Accumulator | None = None, done: Accumulator | None = None) -> DataFrame:
    """files (path) -> the same with md5; contents are read in blocks, so their size doesn't matter.
    What is read adds to the accumulators."""

    def run(batches):
        for batch in batches:
            sums = []
            for p in batch.column(0).to_pylist():
                full = os.path.join(root, p)
                sums.append(file_md5(full))
                if moved is not None:
                    moved.add(os.path.getsize(full))
                if done is not None:
                    done.add(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], names=["path", "md5"])

    spread = files.select("path").repartition(parallel or files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "path string, md5 binary")


def asset_versions(files: DataFrame, root: str, layout: Layout = DEFAULT) -> DataFrame:
    """files (path) -> (path, version, whole): the version that an asset names, found over windows, and
    in the asset as a whole (null over the asset limit).  Both are null where there is none."""

    def run(batches):
        for batch in batches:
            found: list[tuple[str | None, str | None]] = []
            for p in batch.column(0).to_pylist():
                full = os.path.join(root, p)
                with open(full, "rb") as f:
                    windowed = version_in_file(f, layout)
                whole = None
                if os.path.getsize(full) <= layout.asset_limit:
                    with open(full, "rb") as f:
                        whole = version_in(f.read(), layout)
                found.append((windowed, whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], names=["path", "version", "whole"])

    return files.select("path").mapInArrow(run, "path string, version string, whole string")


def disk_state(tree_rows: DataFrame) -> DataFrame:
    """What verification sees: links count as what they point to."""
    return tree_rows.where("target_kind <> 'missing'").select("path", F.col("target_kind").alias("kind"), "size")
