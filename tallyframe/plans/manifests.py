"""Plans over manifests, trees and archive members: DataFrames in, DataFrames out, nothing read or
written.  Paths are the only join key and are unique within a manifest; every join is an equi-join that
the planner sends by hash or broadcast as the sizes say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT, Layout
from tallyframe.functions.paths import first_part, is_protected, may_be_stale


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that old lacks or has otherwise, with change 'added' or 'modified'."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("md5").alias("o_md5"), F.lit(True).alias("there"))
    differs = F.col("there").isNull() | (F.col("o_size") != F.col("size")) | (F.col("o_md5") != F.col("md5"))
    tag = F.when(F.col("there").isNull(), "added").otherwise("modified").alias("change")
    return new.join(o, "path", "left").where(differs).select(*new.columns, tag)


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same rows as a set difference."""
    key = ["path", "size", "md5"]
    return new.select(*key).join(old.select(*key), key, "left_anti").distinct()


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by path in which first wins silently."""
    return first.unionByName(second.join(first.select("path"), "path", "left_anti").select(*first.columns))


def stale(tree: DataFrame, manifest: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Files under the marker that the manifest doesn't list; manifests in the root stay."""
    path = F.col("path")
    candidates = tree.where((F.col("kind") == "file") & may_be_stale(path, layout) & ~is_protected(path, layout))
    return candidates.join(manifest.select("path"), "path", "left_anti")


def package_status(members: DataFrame, manifest: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Each member but the manifest itself: 'ok', 'ZipEntryNotInManifest' or 'ZipEntrySizeMismatch'."""
    m = manifest.select("path", F.col("size").alias("m_size"))
    status = F.when(F.col("m_size").isNull(), "ZipEntryNotInManifest").when(F.col("m_size") != F.col("size"), "ZipEntrySizeMismatch").otherwise("ok")
    return members.where(F.col("path") != layout.root_manifest).join(m, "path", "left").withColumn("status", status).drop("m_size")


def _reason(hashes: bool) -> Column:
    out = F.when(F.col("d_kind").isNull(), "missing").when(F.col("d_kind") != "file", "not_file").when(F.col("d_size") != F.col("size"), "size_mismatch")
    return (out.when(F.col("d_md5") != F.col("md5"), "hash_mismatch") if hashes else out).otherwise("ok")


def verify(manifest: DataFrame, disk: DataFrame, hashes: bool = False) -> DataFrame:
    """manifest's rows with status and actual_size.  disk has path, kind, size and, for hashes, md5;
    its digests are only needed where the size agrees (see sizes_agree)."""
    d = disk.select("path", F.col("kind").alias("d_kind"), F.col("size").alias("d_size"), *([F.col("md5").alias("d_md5")] if hashes else []))
    actual = F.when(F.col("d_kind") == "file", F.col("d_size")).alias("actual_size")
    return manifest.join(d, "path", "left").select(*manifest.columns, _reason(hashes).alias("status"), actual)


def sizes_agree(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """The files whose content is worth hashing."""
    d = disk.where("kind = 'file'").select("path", F.col("size").alias("d_size"))
    return manifest.join(d, "path").where(F.col("size") == F.col("d_size")).select("path", "size", "md5")


def failures(verified: DataFrame) -> DataFrame:
    return verified.where("status <> 'ok'")


def first_failure(verified: DataFrame, order: str = "line_no") -> DataFrame:
    return failures(verified).orderBy(order).limit(1)


def failure_line(path: Column, reason: Column, expected: Column, actual: Column) -> Column:
    """One line of text for each failure."""
    sizes = F.concat(F.lit(" (expected "), expected.cast("string"), F.lit(", found "), actual.cast("string"), F.lit(")"))
    return F.concat(F.replace(reason, F.lit("_"), F.lit(" ")), F.lit(": "), path, F.when(reason == "size_mismatch", sizes).otherwise(""))


def total_size(rows: DataFrame, column: str = "size") -> DataFrame:
    """(n, total) of a relation of files."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def duplicates(rows: DataFrame, key: str = "path") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c")).where("c > 1")


def first_duplicate(rows: DataFrame) -> DataFrame:
    """The first line whose path an earlier line has."""
    again = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) > 1
    return rows.withColumn("again", again).where("again").orderBy("line_no").limit(1).drop("again")


def managed_roots(rows: DataFrame) -> DataFrame:
    return rows.select(first_part(F.col("path")).alias("root")).where("root IS NOT NULL").distinct()


def lookup(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("path") == path)


def already_applied(current_version: Column, new_version: Column, current: Column, new: Column) -> Column:
    """Versions and manifests (or their digests) both known and both equal."""
    return F.coalesce((current_version == new_version) & (current == new), F.lit(False))


def archive_sources(new_manifest: bytes | tuple[int, bytes], changed: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """What goes into an update, in order: the manifest, from memory or, by its size and digest, from its file,
    then the changed files."""
    spark = changed.sparkSession
    size, md5, inline = (len(new_manifest), None, bytearray(new_manifest)) if isinstance(new_manifest, bytes) else (new_manifest[0], bytearray(new_manifest[1]), None)
    head = spark.createDataFrame([(0, layout.root_manifest, size, md5, inline)], "ordinal long, path string, size long, md5 binary, inline_bytes binary")
    rest = changed.select((F.col("line_no") + 1).alias("ordinal"), "path", F.col("size").cast("long").alias("size"), "md5", F.lit(None).cast("binary").alias("inline_bytes"))
    return head.unionByName(rest)
