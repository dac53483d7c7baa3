"""Queries over the manifest plans, one for each operator that tables can express, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import paths, sizes, versions
from tallyframe.operators import files, views
from tallyframe.plans import manifests as plans


def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.changes(views.old_manifest(spark, sf_dir), views.new_manifest(spark, sf_dir))


def plan_changes_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.changed_rows(views.old_manifest(spark, sf_dir), views.new_manifest(spark, sf_dir))


def stale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.stale(views.disk(spark, sf_dir), views.new_manifest(spark, sf_dir)).select("path", "size")


def stale_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plans.total_size(stale_plan(spark, sf_dir))
    return got.select("n", F.col("total").cast("long").alias("total"))


def combine_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.combine(views.new_manifest(spark, sf_dir), views.audio_manifest(spark, sf_dir))


def package_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.package_status(views.old_manifest(spark, sf_dir), views.new_manifest(spark, sf_dir)).select("path", "status")


def _verified(spark: SparkSession, sf_dir: str, hashes: bool) -> DataFrame:
    return plans.verify(views.new_manifest(spark, sf_dir), views.disk(spark, sf_dir), hashes)


def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir, True).select("path", F.col("size").alias("expected_size"), "status")


def verify_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.failures(_verified(spark, sf_dir, False)).select("path", F.col("size").alias("expected_size"), F.coalesce("actual_size", F.lit(-1)).alias("actual_size"), F.col("status").alias("reason"))


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir, True).groupBy("status").agg(F.count("*").alias("c"))


def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _verified(spark, sf_dir, False).withColumn("line_no", views.number())
    return plans.first_failure(numbered).select("path", F.col("status").alias("reason"))


def first_hash_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _verified(spark, sf_dir, True).withColumn("line_no", views.number())
    return plans.first_failure(numbered).select("path", F.col("status").alias("reason"))


def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = plans.failures(_verified(spark, sf_dir, True))
    return bad.select(plans.failure_line(F.col("path"), F.col("status"), F.col("size"), F.col("actual_size")).alias("line"))


def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plans.total_size(views.new_manifest(spark, sf_dir))
    return got.select("n", F.col("total").cast("long").alias("total"))


def managed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.managed_roots(views.disk(spark, sf_dir))


def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.duplicates(views.new_manifest(spark, sf_dir), "md5")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.lookup(views.new_manifest(spark, sf_dir), views.ROOT + "en/1")


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("doc_id").cast("string"), F.col("doc_id") % 11
    back = F.lit("\\")
    made = [F.lit(""), F.concat(F.lit("/"), i), F.concat(back, i), F.concat(F.lit("C:/"), i), F.concat(F.lit("é:"), i), F.concat(F.lit("a"), back, i), F.concat(F.lit("a//"), i),
            F.concat(F.lit("a/../"), i), F.concat(i, F.lit("/")), F.concat(i, F.repeat(F.lit("b"), 65_536)), F.concat(F.lit("ok/.."), i)]
    p = F.coalesce(*[F.when(d == k, x) for k, x in enumerate(made)])
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(p.alias("p")).select("p", paths.verdict(F.col("p")).alias("verdict"))


def protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["pkg_version", "x_pkg_version", "sub/pkg_version", "sub/x_pkg_version", "pkg_versions", "Audio_En_pkg_version", "a/streamingASSETS/b"]
    p = F.array(*map(F.lit, names))[(F.col("doc_id") % len(names)).cast("int")]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", p.alias("p"))
    return rows.select("doc_id", paths.is_protected(F.col("p")).alias("protected"), paths.is_audio_manifest(F.col("p")).alias("audio"), paths.may_be_stale(F.col("p")).alias("marked"))


def split_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "OSPRODWin").otherwise("CNBeta")
    tail = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat((F.col("doc_id") % 3).cast("string"), F.lit("."), F.col("doc_id").cast("string")))
    v = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(head, tail).alias("v"))
    s = versions.split_version(F.col("v"))
    return v.select("v", F.coalesce(s["prefix"], F.lit("")).alias("prefix"), F.coalesce(s["number"], F.lit("")).alias("number"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = lambda a, b: F.concat((F.col("p_size") % a).cast("string"), F.lit("."), (F.col("p_partkey") % b).cast("string"))
    a = F.concat(dotted(5, 13), F.when(F.col("p_partkey") % 3 == 0, ".0").otherwise(""))
    c = versions.compare_versions(a, dotted(4, 11))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(c < 0, "lt").when(c > 0, "gt").otherwise("eq").alias("ord"))
    return part.groupBy("ord").agg(F.count("*").alias("c"), F.sum("p_partkey").alias("k"))


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("n_chars")
    n = d.select((F.col("n_chars") % 1024).alias("n"))
    for k in (31, 9973, 4_999_993):
        n = n.unionByName(d.select((F.col("n_chars") * k).alias("n")))
    return n.select("n", sizes.format_bytes(F.col("n")).alias("txt"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    done, total = F.col("o_custkey") * 37 % 5000, F.col("o_orderkey") * 11 % 4000
    speed = sizes.speed(done * 1_000_000, F.col("o_orderkey") * 1_000_003)
    return o.select("o_orderkey", sizes.percent(done, total, F.col("o_custkey") % 7, F.col("o_orderkey") % 9).alias("pct"), speed.cast("long").alias("bytes_s"))


def md5_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    m = F.md5("text")
    text = F.when(i == 0, m).when(i == 1, F.upper(m)).when(i == 2, F.substring(m, 1, 31)).when(i == 3, F.concat(m, F.lit("0"))).otherwise(F.concat(F.lit("g"), F.substring(m, 2, 31)))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("t"))
    return d.select("doc_id", F.lower(F.hex(sizes.parse_md5(F.col("t")))).alias("digest"))


def already_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal versions and equal digests; null on either side is no."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 4), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2)
    return d.select("doc_id", plans.already_applied(a, b, F.md5("text"), F.md5("text")).alias("applied"))


QUERIES = {f.__name__: f for f in (
    plan_changes, plan_changes_except, stale_plan, stale_total, combine_first_wins, package_fk, verify_status, verify_sizes, verify_summary, first_failure, first_hash_failure, failure_lines,
    total_size, managed_roots, dup_keys, point_lookup, path_rules, protected_paths, split_version, version_order, format_bytes, progress, md5_parse, already_applied)} | files.QUERIES

_STATUS = "CASE WHEN d.path IS NULL THEN 'missing' WHEN d.kind <> 'file' THEN 'not_file' WHEN d.size <> m.size THEN 'size_mismatch' {hash} ELSE 'ok' END"
_SIZES, _HASHES = _STATUS.format(hash=""), _STATUS.format(hash="WHEN d.md5 <> m.md5 THEN 'hash_mismatch'")
_STALE = """FROM disk d WHERE d.kind = 'file' AND NOT (instr(d.path, '/') = 0 AND (d.path = 'pkg_version' OR right(d.path, 12) = '_pkg_version'))
  AND instr(lower(d.path), 'streamingassets') > 0 AND NOT EXISTS (SELECT 1 FROM m_new m WHERE m.path = d.path)"""
_OVER_VIEWS = {
    "plan_changes": """SELECT n.path, n.size, n.md5, CASE WHEN o.path IS NULL THEN 'added' ELSE 'modified' END change
FROM m_new n LEFT JOIN m_old o ON n.path = o.path WHERE o.path IS NULL OR o.size <> n.size OR o.md5 <> n.md5""",
    "plan_changes_except": "SELECT path, size, md5 FROM m_new EXCEPT SELECT path, size, md5 FROM m_old",
    "stale_plan": f"SELECT d.path, d.size {_STALE}",
    "stale_total": f"SELECT count(*) n, CAST(coalesce(sum(d.size), 0) AS BIGINT) total {_STALE}",
    "combine_first_wins": "SELECT path, size, md5 FROM m_new UNION ALL SELECT a.path, a.size, a.md5 FROM audio a WHERE NOT EXISTS (SELECT 1 FROM m_new m WHERE m.path = a.path)",
    "package_fk": "SELECT z.path, CASE WHEN m.path IS NULL THEN 'ZipEntryNotInManifest' WHEN m.size <> z.size THEN 'ZipEntrySizeMismatch' ELSE 'ok' END status FROM m_old z LEFT JOIN m_new m ON m.path = z.path",
    "verify_status": f"SELECT m.path, m.size expected_size, {_HASHES} status FROM m_new m LEFT JOIN disk d ON m.path = d.path",
    "verify_sizes": f"SELECT * FROM (SELECT m.path, m.size expected_size, coalesce(CASE WHEN d.kind = 'file' THEN d.size END, -1) actual_size, {_SIZES} reason FROM m_new m LEFT JOIN disk d ON m.path = d.path) x WHERE reason <> 'ok'",
    "verify_summary": f"SELECT status, count(*) c FROM (SELECT {_HASHES} status FROM m_new m LEFT JOIN disk d ON m.path = d.path) x GROUP BY status",
    "first_failure": f"SELECT path, reason FROM (SELECT m.path, {_SIZES} reason FROM m_new m LEFT JOIN disk d ON m.path = d.path) x WHERE reason <> 'ok' ORDER BY CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) LIMIT 1",
    "first_hash_failure": f"SELECT path, reason FROM (SELECT m.path, {_HASHES} reason FROM m_new m LEFT JOIN disk d ON m.path = d.path) x WHERE reason <> 'ok' ORDER BY CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) LIMIT 1",
    "failure_lines": f"""SELECT replace(status, '_', ' ') || ': ' || path || CASE WHEN status = 'size_mismatch' THEN ' (expected ' || CAST(size AS VARCHAR) || ', found ' || CAST(found AS VARCHAR) || ')' ELSE '' END line
FROM (SELECT m.path, m.size, d.size found, {_HASHES} status FROM m_new m LEFT JOIN disk d ON m.path = d.path) x WHERE status <> 'ok'""",
    "total_size": "SELECT count(*) n, CAST(sum(size) AS BIGINT) total FROM m_new",
    "managed_roots": "SELECT DISTINCT substr(path, 1, instr(path, '/') - 1) root FROM disk WHERE instr(path, '/') > 1",
    "dup_keys": "SELECT md5 k, count(*) c FROM m_new GROUP BY md5 HAVING count(*) > 1",
    "point_lookup": "SELECT path, size, md5 FROM m_new WHERE path = 'Game_Data/StreamingAssets/en/1'",
}
_UNIT = lambda i: f"printf('%d.%02d %s', ((n * 100) // {1024**i}) // 100, ((n * 100) // {1024**i}) % 100, '{('KiB', 'MiB', 'GiB', 'TiB')[i - 1]}')"
ORACLE_SQL = files.ORACLE_SQL | {name: views.SQL + sql for name, sql in _OVER_VIEWS.items()} | {
    "path_rules": """SELECT p, CASE WHEN strlen(p) = 0 OR left(p, 1) = '/' OR left(p, 1) = chr(92) OR (substr(p, 2, 1) = ':' AND strlen(left(p, 1)) = 1) OR contains(p, chr(92)) THEN 'UnsafePath'
  WHEN strlen(p) > 65535 THEN 'PathTooLongForZip' WHEN contains('/' || p || '/', '//') OR contains('/' || p || '/', '/./') OR contains('/' || p || '/', '/../') THEN 'UnsafePath' ELSE 'ok' END verdict
FROM (SELECT CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN '/' || id WHEN 2 THEN chr(92) || id WHEN 3 THEN 'C:/' || id WHEN 4 THEN 'é:' || id WHEN 5 THEN 'a' || chr(92) || id WHEN 6 THEN 'a//' || id
  WHEN 7 THEN 'a/../' || id WHEN 8 THEN id || '/' WHEN 9 THEN id || repeat('b', 65536) ELSE 'ok/..' || id END p FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) id FROM documents) i) q""",
    "protected_paths": """SELECT doc_id, instr(p, '/') = 0 AND (p = 'pkg_version' OR right(p, 12) = '_pkg_version') protected, left(p, 6) = 'Audio_' AND right(p, 12) = '_pkg_version' audio, contains(lower(p), 'streamingassets') marked
FROM (SELECT doc_id, ['pkg_version', 'x_pkg_version', 'sub/pkg_version', 'sub/x_pkg_version', 'pkg_versions', 'Audio_En_pkg_version', 'a/streamingASSETS/b'][doc_id % 7 + 1] p FROM documents) q""",
    "split_version": """SELECT v, regexp_extract(v, '^([^0-9]+)([0-9].*)$', 1) prefix, regexp_extract(v, '^([^0-9]+)([0-9].*)$', 2) number
FROM (SELECT concat(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'OSPRODWin' ELSE 'CNBeta' END, CASE doc_id % 5 WHEN 0 THEN '' ELSE concat(CAST(doc_id % 3 AS VARCHAR), '.', CAST(doc_id AS VARCHAR)) END) v FROM documents) q""",
    "version_order": """SELECT ord, count(*) c, CAST(sum(p_partkey) AS BIGINT) k FROM (SELECT p_partkey, CASE WHEN (p_size % 5, p_partkey % 13) < (p_size % 4, p_partkey % 11) THEN 'lt'
  WHEN (p_size % 5, p_partkey % 13) > (p_size % 4, p_partkey % 11) THEN 'gt' ELSE 'eq' END ord FROM part) z GROUP BY ord""",
    "format_bytes": f"""SELECT n, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < {1024**2} THEN {_UNIT(1)} WHEN n < {1024**3} THEN {_UNIT(2)} WHEN n < {1024**4} THEN {_UNIT(3)} ELSE {_UNIT(4)} END txt
FROM (SELECT n_chars % 1024 n FROM documents UNION ALL SELECT n_chars * 31 FROM documents UNION ALL SELECT n_chars * 9973 FROM documents UNION ALL SELECT n_chars * 4999993 FROM documents) q""",
    "progress": """SELECT o_orderkey, CAST(CASE WHEN total > 0 THEN least(done, total) * 100 // total WHEN o_orderkey % 9 > 0 THEN least(o_custkey % 7, o_orderkey % 9) * 100 // (o_orderkey % 9) ELSE 100 END AS INT) pct,
  CASE WHEN o_orderkey > 0 THEN CAST((CAST(done AS HUGEINT) * 1000000 * 1000000000) // (CAST(o_orderkey AS HUGEINT) * 1000003) AS BIGINT) ELSE 0 END bytes_s
FROM (SELECT o_orderkey, o_custkey, o_custkey * 37 % 5000 done, o_orderkey * 11 % 4000 total FROM orders) q""",
    "md5_parse": "SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN md5(text) END digest FROM documents",
    "already_applied": "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 END = CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 END, false) applied FROM documents",
}
