"""Query: all documents without their repeated strings of 400 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .substrings import CORE, GRAM, LENGTH, SHARED, SPREAD, without_repeats


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op5_substrings": op5_substrings}
_STEP, _PRIME, _BASE = 0x9E3779B1, (1 << 61) - 1, 1_000_003


def _sql() -> str:
    """The same byte by byte: strings are told apart by a polynomial modulo a prime of 61 bits, from
    running sums, for texts of up to 1,048,576 bytes."""
    power = lambda at: f"(high[({at}) // 1024 + 1] * low[({at}) % 1024 + 1] % {_PRIME})"
    digest = lambda n: f"((lead(h, {n - 1}) OVER w - h + v * p) % {_PRIME}) * q % {_PRIME}"
    gram = " + ".join(f"lead(x, {k}) OVER w * {pow(_STEP, GRAM - 1 - k, 1 << 32)}::HUGEINT % 4294967296" for k in range(GRAM))
    return f"""
WITH RECURSIVE pw(k, x, y) AS (
  SELECT 0, 1::HUGEINT, 1::HUGEINT UNION ALL SELECT k + 1, x * {_BASE} % {_PRIME}, y * {pow(_BASE, 1024, _PRIME)} % {_PRIME} FROM pw WHERE k < 1023
), powers AS (
  SELECT list(x ORDER BY k) AS low, list(y ORDER BY k) AS high FROM pw
), d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents
), bytes AS (
  SELECT r, doc_id, n, i, hx, ('0x' || hx)::BIGINT AS v FROM (
    SELECT r, doc_id, strlen(t) // 2 AS n, unnest(regexp_extract_all(t, '..')) AS hx, unnest(range(strlen(t) // 2)) AS i FROM d) u
), s AS (
  SELECT *, sum(v * p) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS h, xor((v + 1) * {_STEP} % 4294967296, ((v + 1) * {_STEP} % 4294967296) >> 15) AS x
  FROM (SELECT bytes.*, {power("i")} AS p, {power("1048575 - i")} AS q FROM bytes, powers) z
), g AS (
  SELECT r, doc_id, n, i, hx, {digest(LENGTH)} AS g, {digest(CORE)} AS core, CAST(({gram}) % 4294967296 AS BIGINT) AS m FROM s WINDOW w AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS twice, xor(m, m >> 15)::HUGEINT * 2246822507 % 4294967296 AS m2 FROM g
), gone AS (
  SELECT r, doc_id, n, i, hx, core, coalesce(i - max(CASE WHEN twice THEN i END) OVER w < {LENGTH}, false) AS gone,
         min(xor(m2::BIGINT, m2::BIGINT >> 13)::HUGEINT * 4294967296 + i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPREAD - 1} FOLLOWING) % 4294967296 AS t
  FROM twice WINDOW w AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS first FROM gone
), kept AS (
  SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, coalesce(string_agg(hx, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM spans GROUP BY r
), triggers AS (
  SELECT DISTINCT r, coalesce(doc_id, -9223372036854775807) AS id, t FROM gone WHERE i <= n - {SHARED}
), cores AS (
  SELECT triggers.r, count(*) OVER (PARTITION BY core) AS c, min(id) OVER (PARTITION BY core) <> max(id) OVER (PARTITION BY core) AS across FROM triggers JOIN gone ON triggers.r = gone.r AND triggers.t = gone.i
), shared AS (
  SELECT r, count(*) AS n_shared FROM cores WHERE across GROUP BY r
)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM d LEFT JOIN kept ON d.r = kept.r LEFT JOIN shared ON d.r = shared.r
"""


ORACLE_SQL: dict[str, str] = {"op5_substrings": _sql()}
