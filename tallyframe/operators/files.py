"""Queries over files: documents are written out as an install, and read, packed, extracted and deleted by
the engine's sources and sinks.  They need a shared folder that executors can open as local files."""

from __future__ import annotations

import io
import os
import shutil
import uuid
from dataclasses import replace
from functools import cache

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT
from tallyframe.functions import sizes
from tallyframe.operators import views
from tallyframe.ops import Engine
from tallyframe.plans import manifests as plans
from tallyframe.shared import shared_folder
from tallyframe.sinks.files import delete_files, extract_archive, write_archive
from tallyframe.sources import archive as zips
from tallyframe.sources import manifest as sources
from tallyframe.sources.tree import asset_versions, hashed, tree

MANIFEST = b'{"remoteName":"a","md5":"0cc175b9c0f1b6a831c399e269772661","fileSize":1}\n'


#: A query's manifest has a line for each document, however many there are.
LAYOUT = replace(DEFAULT, manifest_limit=(1 << 63) - 1)


def _folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/tallyframe-files/{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _write(rows: DataFrame, root: str) -> None:
    """rows (path, data): a file for each."""

    def run(part):
        for row in part:
            target = os.path.join(root, row.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(bytes(row.data))

    rows.select("path", "data").foreachPartition(run)


def _write_lines(lines: DataFrame, target: str, end: bytes) -> None:
    """lines (line) as one file: a part for each task, put one behind the other."""
    folder = _folder(lines.sparkSession)

    def run(part):
        tmp = os.path.join(folder, f"tmp-{uuid.uuid4().hex}")
        with open(tmp, "wb") as f:
            for row in part:
                f.write(row.line.encode() + end)
        os.replace(tmp, os.path.join(folder, f"{TaskContext.get().partitionId():09}"))

    lines.foreachPartition(run)
    with open(target, "wb") as out:
        for name in sorted(n for n in os.listdir(folder) if n.isdigit()):
            with open(os.path.join(folder, name), "rb") as f:
                shutil.copyfileobj(f, out, DEFAULT.block)
    shutil.rmtree(folder)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _path() -> Column:
    """Names that begin with an underscore or a dot are among them."""
    i = F.col("doc_id") % 4
    return F.concat(F.lit(views.ROOT), F.col("lang"), F.lit("/"), F.when(i == 0, "_").when(i == 1, ".").otherwise(""), F.col("doc_id").cast("string"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    return _docs(spark, sf_dir).select("doc_id", _path().alias("path"), data.alias("data"))


@cache
def _install(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files, written once a session; only read afterwards."""
    root = _folder(spark)
    _write(_files(spark, sf_dir), root)
    return root


@cache
def _archive(spark: SparkSession, sf_dir: str) -> str:
    """All documents packed behind a manifest, in the order of their ids."""
    out = f"{_folder(spark)}/update.zip"
    write_archive(_sources(spark, sf_dir), _install(spark, sf_dir), out)
    return out


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _files(spark, sf_dir).select(F.col("doc_id").alias("line_no"), "path", F.octet_length("data").alias("size"), F.unhex(F.md5("data")).alias("md5"))
    return plans.archive_sources(MANIFEST, changed)


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree(spark, _install(spark, sf_dir))
    return found.select("path", "kind", F.when(F.col("kind") == "file", F.col("size")).otherwise(F.lit(-1)).alias("size"))


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _install(spark, sf_dir)
    return hashed(tree(spark, root).where("kind = 'file'"), root).select("path", _hex("md5"))


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main manifest and two audio manifests, written as lines and read as one."""
    root = _folder(spark)
    line = F.to_json(F.struct(F.col("path").alias("remoteName"), "md5", F.col("size").alias("fileSize"), F.lit(1).alias("more")))

    def written(rows: DataFrame, name: str) -> None:
        _write_lines(rows.select(line.alias("line")), os.path.join(root, name), b" \r\n\n")

    written(views.new_manifest(spark, sf_dir), "pkg_version")
    audio = views.audio_manifest(spark, sf_dir)
    written(audio.where("size = 999"), "Audio_A_pkg_version")
    written(audio.where("size <> 999"), "Audio_B_pkg_version")
    return sources.load_all(spark, root, LAYOUT).select("path", F.col("size").cast("long").alias("size"), _hex("md5"))


def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 9
    md5 = F.md5(F.coalesce("text", F.lit("")))
    row = lambda path, md5, size, end="": F.concat(F.lit('{"remoteName":"'), path, F.lit('","md5":"'), md5, F.lit('","fileSize":'), size, F.lit("}" + end + "\r\n"))
    plain = row(i, md5, i)
    made = [plain, row(i, md5, i, "x"), row(F.concat(F.lit("a//"), i), F.lit("no digest"), i), row(i, F.substring(md5, 1, 31), i), F.concat(plain, F.lit("\n"), plain),
            F.lit(" \n\r\n\t"), row(i, md5, F.concat(F.lit("-1"), i)), row(i, F.upper(md5), F.concat(F.lit('"'), i, F.lit('"'))), row(i, md5, F.concat(i, F.lit(',"md5":""')))]
    data = F.coalesce(*[F.when(kind == k, x) for k, x in enumerate(made)])
    return sources.verdicts(_docs(spark, sf_dir).select("doc_id", data.cast("binary").alias("data")))


def archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes into an update, and from where."""
    return _sources(spark, sf_dir).select("ordinal", "path", "size", F.lower(F.hex("md5")).alias("md5"), F.md5("inline_bytes").alias("inline_md5"))


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zips.archive(spark, _archive(spark, sf_dir)).select("ordinal", "path", "method", "compressed_size", "uncompressed_size")


def zip_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _archive(spark, sf_dir)
    return zips.member_digests(zips.archive(spark, path).repartition(spark.sparkContext.defaultParallelism), path).select("path", _hex("md5"), "n_bytes")


def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _archive(spark, sf_dir)
    member = zips.find(path, "pkg_version")
    return spark.createDataFrame([(member[1], bytearray(zips.read_member(path, member, 1 << 20)))], "path string, data binary").select("path", F.md5("data").alias("md5"))


def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _archive(spark, sf_dir), _folder(spark)
    extract_archive(zips.archive(spark, path).repartition(spark.sparkContext.defaultParallelism), path, root)
    return hashed(tree(spark, root).where("kind = 'file'"), root).select("path", _hex("md5"))


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an install after its stale files are gone: its manifest has all documents, but
    none by a name with an underscore or a dot."""
    root = _folder(spark)
    _write(_files(spark, sf_dir), root)
    manifest = _docs(spark, sf_dir).select(F.concat(F.lit(views.ROOT), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    delete_files(plans.stale(tree(spark, root), manifest), root)
    return tree(spark, root).where("kind = 'file'").select("path", "size")


def scan_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    of = lambda head, tail: F.concat(F.lit(head), i, F.lit(tail))
    made = [of('app_version {"DispatchVersion":"OSA1.4.', '"}'), of('app_version {"x":"DispatchVersion","DispatchVersion":"OSB2.', '"}'), of('app_version {"DispatchVersion":5,"y":{"DispatchVersion" : "OSC3.', '"}}'),
            of('{"DispatchVersion":"OSN', '"}'), of('app_version {"a": app_version {"DispatchVersion":"OSD4.', '"}'), of('app_version {"DispatchVersion":"OS\\u0041', '"}'),
            of('app_version no object app_version[{"b":[{"DispatchVersion":\n"OSF6.', '"}]}'), of('app_version {"s":"}{\\"","DispatchVersion":"OSE5.', '"}}')]
    root = _folder(spark)
    data = F.concat(F.coalesce("text", F.lit("")), F.lit("\0"), F.coalesce(*[F.when(kind == k, x) for k, x in enumerate(made)]), F.lit("\0rest"))
    assets = _docs(spark, sf_dir).select(i.alias("path"), data.cast("binary").alias("data"))
    _write(assets.withColumn("path", F.concat(F.lit("assets/"), "path")), root)
    found = asset_versions(assets.select(F.concat(F.lit("assets/"), "path").alias("path")), root)
    return found.select(F.split_part("path", F.lit("/"), F.lit(2)).cast("long").alias("doc_id"), "version", "whole")


def _game(spark: SparkSession, sf_dir: str, new: bool = False) -> str:
    """An install of all documents with its manifest and version.  In the new one every eleventh document
    has another name and every fifth another text."""
    root = _folder(spark)
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    letter = F.when(F.lit(new) & (i % 11 == 0), "n").otherwise("")
    data = F.when(F.lit(new) & (i % 5 == 0), F.concat(text, F.lit("x"))).otherwise(text)
    path = F.concat(F.lit(views.ROOT), F.col("lang"), F.lit("/"), letter, i.cast("string"))
    rows = _docs(spark, sf_dir).select(path.alias("path"), data.cast("binary").alias("data"))
    asset = f'app_version {{"{DEFAULT.version_field}":"OSTest1.{5 if new else 4}.0"}}'
    rows = rows.unionByName(spark.range(1).select(F.lit(DEFAULT.version_assets[1]).alias("path"), F.lit(asset).cast("binary").alias("data")))
    _write(rows, root)
    line = F.to_json(F.struct(F.col("path").alias("remoteName"), F.md5("data").alias("md5"), F.octet_length("data").alias("fileSize")))
    _write_lines(rows.select(line.alias("line")), os.path.join(root, DEFAULT.root_manifest), b"\n")
    return root


def _state(spark: SparkSession, root: str) -> DataFrame:
    return hashed(tree(spark, root).where((F.col("kind") == "file") & (F.col("path") != DEFAULT.root_manifest)), root).select("path", _hex("md5"))


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, LAYOUT, out=io.StringIO(), assume_yes=True)


def make_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of an update between two installs, but for its manifest."""
    path = _engine(spark).make(_game(spark, sf_dir), _game(spark, sf_dir, True), f"{_folder(spark)}/update.zip")
    return zips.member_digests(zips.archive(spark, path), path).where(F.col("path") != DEFAULT.root_manifest).select("path", _hex("md5"))


def apply_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An install after the update: changed files are there, stale ones gone, and doing it again does nothing."""
    old, new = _game(spark, sf_dir), _game(spark, sf_dir, True)
    path = _engine(spark).make(old, new, f"{_folder(spark)}/update.zip")
    first, again = _engine(spark).apply(path, old, True), _engine(spark).apply(path, old)
    return _state(spark, old).select("path", "md5", F.lit(first).alias("applied"), F.lit(again).alias("again"))


def clean_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An install with stale files beside each document, after it is cleaned."""
    root = _game(spark, sf_dir)
    stale = _files(spark, sf_dir).select(F.concat("path", F.lit(".old")).alias("path"), "data")
    _write(stale, root)
    removed = _engine(spark).clean(root, True)
    return _state(spark, root).select("path", "md5", F.lit(removed).cast("long").alias("removed"))


def first_repeated_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of two manifests, one behind the other, whose path an earlier line has."""
    i = views.number()
    both = views.new_manifest(spark, sf_dir).withColumn("line_no", i * 2).unionByName(views.old_manifest(spark, sf_dir).withColumn("line_no", i * 2 + 1))
    return plans.first_duplicate(both).select("line_no", "path")


def speed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 40_961).alias("n"))
    return o.select("o_orderkey", sizes.format_speed(F.col("n")).alias("txt"))


QUERIES = {f.__name__: f for f in (tree_scan, file_digests, manifest_parse, manifest_errors, archive_order, zip_members, zip_contents, archive_lookup, extracted_files, deleted_files, make_update, apply_update, clean_install, scan_version, first_repeated_path, speed_text)}

_NAME = "concat('Game_Data/StreamingAssets/', lang, '/', CASE doc_id % 4 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END, CAST(doc_id AS VARCHAR))"
_D = f"(SELECT doc_id, lang, coalesce(text, '') t, {_NAME} path FROM documents) d"
_HEAD = MANIFEST.decode().strip()
_NEW = f"""(SELECT doc_id, concat('Game_Data/StreamingAssets/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN 'n' ELSE '' END, CAST(doc_id AS VARCHAR)) path,
  md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) md5 FROM documents
  UNION ALL SELECT 0, '{DEFAULT.version_assets[1]}', md5('app_version {{"{DEFAULT.version_field}":"OSTest1.5.0"}}')) d"""
ORACLE_SQL = {
    "tree_scan": f"""SELECT path, 'file' kind, strlen(t)::BIGINT size FROM {_D}
UNION ALL SELECT DISTINCT unnest(['Game_Data', 'Game_Data/StreamingAssets', 'Game_Data/StreamingAssets/' || lang]), 'directory', -1 FROM documents""",
    "file_digests": f"SELECT path, md5(t) md5 FROM {_D}",
    "manifest_parse": views.SQL + "SELECT path, size, md5 FROM m_new UNION ALL SELECT a.path, a.size, a.md5 FROM audio a WHERE NOT EXISTS (SELECT 1 FROM m_new m WHERE m.path = a.path)",
    "manifest_errors": """SELECT doc_id, ['ok', 'InvalidManifestJson', 'UnsafePath', 'InvalidMd5', 'DuplicateManifestPath', 'EmptyManifest', 'InvalidManifestJson', 'ok', 'InvalidManifestJson'][doc_id % 9 + 1] verdict FROM documents""",
    "archive_order": f"""SELECT 0 ordinal, 'pkg_version' path, {len(MANIFEST)} size, NULL md5, md5('{_HEAD}' || chr(10)) inline_md5
UNION ALL SELECT doc_id + 1, path, strlen(t), md5(t), NULL FROM {_D}""",
    "zip_members": f"""SELECT 0 ordinal, 'pkg_version' path, 0 AS method, {len(MANIFEST)} compressed_size, {len(MANIFEST)} uncompressed_size
UNION ALL SELECT row_number() OVER (ORDER BY doc_id), path, 0, strlen(t), strlen(t) FROM {_D}""",
    "zip_contents": f"SELECT 'pkg_version' path, md5('{_HEAD}' || chr(10)) md5, {len(MANIFEST)} n_bytes UNION ALL SELECT path, md5(t), strlen(t) FROM {_D}",
    "archive_lookup": f"SELECT 'pkg_version' path, md5('{_HEAD}' || chr(10)) md5",
    "extracted_files": f"SELECT 'pkg_version' path, md5('{_HEAD}' || chr(10)) md5 UNION ALL SELECT path, md5(t) FROM {_D}",
    "deleted_files": f"SELECT path, strlen(t)::BIGINT size FROM {_D} WHERE doc_id % 4 > 1",
    "make_update": f"SELECT path, md5 FROM {_NEW} WHERE doc_id % 11 = 0 OR doc_id % 5 = 0",
    "apply_update": f"SELECT path, md5, true applied, false AS again FROM {_NEW}",
    "clean_install": f"""SELECT concat('Game_Data/StreamingAssets/', lang, '/', CAST(doc_id AS VARCHAR)) path, md5(coalesce(text, '')) md5, (SELECT count(*) FROM documents) removed FROM documents
UNION ALL SELECT '{DEFAULT.version_assets[1]}', md5('app_version {{"{DEFAULT.version_field}":"OSTest1.4.0"}}'), (SELECT count(*) FROM documents)""",
    "scan_version": """SELECT doc_id, v AS version, v AS whole FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'OSA1.4.' || doc_id WHEN 1 THEN 'OSB2.' || doc_id WHEN 2 THEN 'OSC3.' || doc_id
  WHEN 4 THEN 'OSD4.' || doc_id WHEN 6 THEN 'OSF6.' || doc_id WHEN 7 THEN 'OSE5.' || doc_id END v FROM documents) q""",
    "first_repeated_path": views.SQL + """SELECT line_no, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) n FROM (
  SELECT CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) * 2 line_no, path FROM m_new UNION ALL SELECT CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) * 2 + 1, path FROM m_old) u) v WHERE n > 1 ORDER BY line_no LIMIT 1""",
    "speed_text": """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B/s' WHEN n < 1048576 THEN printf('%d.%02d KiB/s', n * 100 // 1024 // 100, n * 100 // 1024 % 100)
  WHEN n < 1073741824 THEN printf('%d.%02d MiB/s', n * 100 // 1048576 // 100, n * 100 // 1048576 % 100) ELSE printf('%d.%02d GiB/s', n * 100 // 1073741824 // 100, n * 100 // 1073741824 % 100) END txt
FROM (SELECT o_orderkey, o_orderkey * 40961 n FROM orders) q""",
}
