"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.shared import shared_folder

#: Characters that separate words, for Java and RE2 regular expressions.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder.  It is deleted when the program ends, or earlier by
    drop_tables()."""
    path = f"{shared_folder(spark)}/tallyframe/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders[path] = spark
    return path


_folders: dict[str, SparkSession] = {}


@atexit.register
def drop_tables() -> None:
    """Deletes all intermediate tables of this program; frames that read them can't be used any more."""
    for path, spark in list(_folders.items()):
        with contextlib.suppress(Exception):  # a session that has ended may have lost its files or its JVM
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        del _folders[path]


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps neither
    recompute it nor depend on the executors that made it, and the planner knows its size."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int):
    """What is computed inside sends batches of at most so many rows and bytes to Python; afterwards the
    session's settings are as before."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded(run, rows: int = 1000, size: int = 16 << 20):
    """run, a function for mapInArrow, on parts of the batches that hold about so many rows and bytes at
    most.  The batches themselves are bounded by the session's settings (64 MB unless changed)."""

    def parts(batches):
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)

    return lambda batches: run(parts(batches))


def gathered(run, rows: int = 50_000, size: int = 16 << 20):
    """run, a function for mapInArrow, on batches put together until they hold so many rows or bytes."""

    def wholes(batches):
        held, n, held_bytes = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
            if n >= rows or held_bytes >= size:
                yield pa.concat_batches(held)
                held, n, held_bytes = [], 0, 0
        if n:
            yield pa.concat_batches(held)

    return lambda batches: run(wholes(batches))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: bound as the element of a one-element array."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
