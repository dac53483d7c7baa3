"""Query: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_text import main_text


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
#: What stands between article tags, by plain patterns: right for pages that mark their article so and
#: write headings and paragraphs in it.
ORACLE_SQL: dict[str, str] = {"op2_html": r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '<br[^>]*>', ' ', 'g') AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1|div)(\s[^>]*)?>'), lambda x:
    regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g')) AS blocks FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""}
