"""Query: the mix of all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import mix


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / greatest(0.05::DOUBLE, 1 - CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>!]+', '', 'g')) AS DOUBLE) / greatest(length(t), 1)) AS key
  FROM d
), s0 AS (
  SELECT source, sum(size) AS source_size FROM k GROUP BY source
), s1 AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s0
), s2 AS (
  SELECT *, most / weight AS ratio, sum(most) OVER w AS fl,
         sum(weight) OVER () - sum(weight) OVER w AS open_weight,
         lead(most / weight) OVER (ORDER BY most / weight, source NULLS LAST) AS next_ratio
  FROM s1 WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), s3 AS (
  SELECT *, CASE WHEN open_weight > 0 AND (budget - fl) / open_weight BETWEEN ratio AND next_ratio THEN (budget - fl) / open_weight END AS lv FROM s2
), s4 AS (
  SELECT source, source_size,
         least(most, coalesce(CASE WHEN budget / sum(weight) OVER () <= min(ratio) OVER () THEN budget / sum(weight) OVER ()
                                   ELSE min(lv) OVER () END * weight, most)) AS target
  FROM s3
), p AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS epochs,
         target - floor(target / greatest(source_size, 1)) * source_size AS budget FROM s4
), r AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
ORACLE_SQL = {"op7_mixing": _SQL}
