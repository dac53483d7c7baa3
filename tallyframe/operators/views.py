"""Manifest-shaped views over the document tables, for queries that need no files.

Each view has a row for every document.  Some documents go by another name in one view (a letter before
their number), so that they are missing in the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "Game_Data/StreamingAssets/"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _path(letter: str, renamed: Column) -> Column:
    return F.concat(F.lit(ROOT), F.col("lang"), F.lit("/"), F.when(renamed, letter).otherwise(""), F.col("doc_id").cast("string")).alias("path")


def number(path: str = "path") -> Column:
    """The document's number in a path."""
    return F.regexp_extract(path, "([0-9]+)$", 1).cast("long")


def old_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(_path("o", F.col("doc_id") % 7 == 0), F.col("n_chars").alias("size"), F.md5("text").alias("md5"))


def new_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return _docs(spark, sf_dir).select(_path("n", F.col("doc_id") % 11 == 0), size.alias("size"), F.md5(text).alias("md5"))


def audio_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(_path("a", F.col("doc_id") % 2 == 1), F.lit(999).cast("long").alias("size"), F.md5(F.lit("aud")).alias("md5"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return d.unionByName(b.select(F.concat(F.lit(ROOT + "Audio/"), F.col("item_id").cast("string")).alias("path"), F.lit(5).cast("long").alias("size"), F.md5("text").alias("md5")))


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    size = F.col("n_chars") + F.when(i % 17 == 0, 2).when(i % 3 == 0, 1).otherwise(0)
    text = F.when(i % 19 == 0, F.concat("text", F.lit("!"))).when(i % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    d = _docs(spark, sf_dir).select(_path("d", i % 13 == 0), size.alias("size"), F.md5(text).alias("md5"), F.when(i % 23 == 0, "directory").otherwise("file").alias("kind"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = lambda head: pages.select(F.concat(F.lit(head), F.col("page_id").cast("string")).alias("path"), F.col("page_id").alias("size"), F.md5("html").alias("md5"), F.lit("file").alias("kind"))
    one = spark.range(1).select(F.lit("Audio_En_pkg_version").alias("path"), F.lit(10).cast("long").alias("size"), F.md5(F.lit("a")).alias("md5"), F.lit("file").alias("kind"))
    return d.unionByName(page("Game_Data/sTREAMINGassets/pages/")).unionByName(page("Other/")).unionByName(one)


#: The same views in SQL.
SQL = """WITH m_old AS (SELECT concat('Game_Data/StreamingAssets/', lang, '/', CASE WHEN doc_id % 7 = 0 THEN 'o' ELSE '' END, CAST(doc_id AS VARCHAR)) path, n_chars size, md5(text) md5 FROM documents),
m_new AS (SELECT concat('Game_Data/StreamingAssets/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN 'n' ELSE '' END, CAST(doc_id AS VARCHAR)) path, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END size,
                 md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, 'x') ELSE text END) md5 FROM documents),
disk AS (SELECT concat('Game_Data/StreamingAssets/', lang, '/', CASE WHEN doc_id % 13 = 0 THEN 'd' ELSE '' END, CAST(doc_id AS VARCHAR)) path, n_chars + CASE WHEN doc_id % 17 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END size,
                md5(CASE WHEN doc_id % 19 = 0 THEN concat(text, '!') WHEN doc_id % 5 = 0 THEN concat(text, 'x') ELSE text END) md5,
                CASE WHEN doc_id % 23 = 0 THEN 'directory' ELSE 'file' END kind FROM documents
         UNION ALL SELECT concat('Game_Data/sTREAMINGassets/pages/', CAST(page_id AS VARCHAR)), page_id, md5(html), 'file' FROM pages
         UNION ALL SELECT concat('Other/', CAST(page_id AS VARCHAR)), page_id, md5(html), 'file' FROM pages
         UNION ALL SELECT 'Audio_En_pkg_version', 10, md5('a'), 'file'),
audio AS (SELECT concat('Game_Data/StreamingAssets/', lang, '/', CASE WHEN doc_id % 2 = 1 THEN 'a' ELSE '' END, CAST(doc_id AS VARCHAR)) path, 999 size, md5('aud') md5 FROM documents
          UNION ALL SELECT concat('Game_Data/StreamingAssets/Audio/', CAST(item_id AS VARCHAR)), 5, md5(text) FROM benchmark)
"""
