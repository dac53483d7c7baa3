"""Query: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import WORD, table
from .quality import BLANKS, CLASSES, CODE, COMMON, LOUD, MAX_CHAR_DISTANCE, MAX_ODD, MAX_REPEATED, MAX_UPPER, MAX_WORD_DISTANCE, MIN_CHARS_COMPARED, MIN_REFERENCE, MIN_WORDS, MIN_WORDS_COMPARED, OTHER, SYMBOLS, UPPER, assess


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_divergence": op9_quality_divergence}


def _sql() -> str:
    """The same by exploding windows, for engines that aren't asked to do it row by row."""
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in CLASSES)
    listed = " ".join(f"WHEN '{code}' THEN [{', '.join(repr(w) for w in words.split())}]" for code, words in COMMON.items())
    share = lambda x: f"list_transform({x}, lambda v: v::DOUBLE / greatest(list_sum({x})::DOUBLE, 1))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: ({part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')}) / 2))))"
    total = lambda x, n: "[" + ", ".join(f"coalesce(sum({x}[{i + 1}]), 0)::BIGINT" for i in range(n)) + "]"
    most = max(len(x.split()) for x in COMMON.values()) + 1
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN regexp_matches(lang, '{CODE}') THEN lang ELSE '{OTHER}' END AS lg FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls,
         [{classes}] AS cs, CASE lg {listed} ELSE []::VARCHAR[] END AS ms FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) x
), n AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) x, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r
), m AS (
  SELECT w.r, doc_id, lg, len(ws)::BIGINT AS n_words, (length(t) - cs[{BLANKS + 1}])::BIGINT AS word_chars, cs[{SYMBOLS + 1}]::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ws) < {MIN_WORDS} OR coalesce(n_repeat_words, 0) > {MAX_REPEATED} * len(ws) AS base_failed, length(t) AS chars,
         list_append(cs, length(t) - list_sum(cs)) AS cs, ms, list_transform(ms, lambda k: len(list_filter(ws, lambda x: lower(x) = k))) AS ks
  FROM w LEFT JOIN n ON w.r = n.r
), h AS (
  SELECT * REPLACE (list_append(ks, n_words - coalesce(list_sum(ks), 0)) AS ks) FROM m
), refs AS (
  SELECT lg AS ref_lg, {total("cs", len(CLASSES) + 1)} AS rc, ({total("ks", most)})[1:max(len(ks))] AS rk
  FROM h WHERE NOT base_failed AND cs[{SYMBOLS + 1}] + cs[{LOUD + 1}] <= {MAX_ODD} * list_sum(cs) AND cs[{UPPER + 1}] <= {MAX_UPPER} * (cs[1] + cs[{UPPER + 1}]) AND lg <> '{OTHER}' GROUP BY lg HAVING sum(list_sum(cs)) >= {MIN_REFERENCE}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(chars >= {MIN_CHARS_COMPARED} AND {js("cs", "rc")} > {MAX_CHAR_DISTANCE}, false)
       AND NOT coalesce(n_words >= {MIN_WORDS_COMPARED} AND len(ks) > 1 AND {js("ks", "rk")} > {MAX_WORD_DISTANCE}, false) AS kept
FROM h LEFT JOIN refs ON lg = ref_lg
"""


ORACLE_SQL: dict[str, str] = {"op9_quality_divergence": _sql()}
