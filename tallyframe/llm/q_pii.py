"""Query: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii import _BEFORE, _CUES, _GAZETTEER, _LENGTHS, KINDS, find


def _listed(found: Column) -> Column:
    kind = lambda k: F.array(*map(F.lit, KINDS))[k]
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    of = lambda k: lambda x: x["base"] & (x["k"] == k)
    counts = [F.size(F.filter("found", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


QUERIES = {"op1_pii": op1_pii}
# The patterns as the contract writes them, and the fifth kind's.
_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]", r"[A-Za-z0-9_-]{24,}")


def _sql() -> str:
    """The same in SQL: votes by plain patterns, and both trainings as recursions over lists."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
    by_kind = lambda of: "CASE k " + " ".join(f"WHEN {i} THEN {of(kind)}" for i, kind in enumerate(KINDS)) + " END"
    matches = lambda value, patterns: by_kind(lambda kind: f"regexp_matches({value}, '{patterns[kind]}')")
    found = " UNION ALL ".join(f"SELECT r, t, {i} AS k, regexp_extract_all(t, '{x}') AS vs, string_split_regex(t, '{x}') AS gs FROM d" for i, x in enumerate(_PATTERNS))
    total = lambda what: f"list_sum(list_transform(range(1, len(c) + 1), lambda i: {what}))"
    rate = lambda j, sign, side: f"(1 + {total(f'CASE WHEN v{j}[i] > 0 THEN c[i] * {side} ELSE 0 END')}) / (2 + {total(f'CASE WHEN v{j}[i] <> 0 THEN c[i] * {side} ELSE 0 END')}) AS {sign}{j}"
    rates = ", ".join(rate(j, sign, side) for j in range(4) for sign, side in (("a", "post[i]"), ("b", "(1 - post[i])")))
    capped = ", ".join(f"least(0.99::DOUBLE, a{j}) AS a{j}, greatest(0.01::DOUBLE, least(0.99::DOUBLE, b{j})) AS b{j}" for j in range(4))
    prior = ", ".join(f"(1 + {total(f'CASE WHEN ks[i] = {k} THEN c[i] * post[i] ELSE 0 END')}) / (2 + {total(f'CASE WHEN ks[i] = {k} THEN c[i] ELSE 0 END')})" for k in range(len(KINDS)))
    odds = " + ".join(f"CASE WHEN v{j}[i] > 0 THEN ln(a{j} / b{j}) WHEN v{j}[i] < 0 THEN ln((1 - a{j}) / (1 - b{j})) ELSE 0 END" for j in range(4))
    features = "[ks[i] + 1, " + ", ".join(f"{7 + 3 * j} + v{j}[i]" for j in range(4)) + ", 18 + ls[i]]"
    vote = lambda j: f"list(CASE substr(key, {j + 2}, 1) WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END ORDER BY key) AS v{j}"
    name = "[" + ", ".join(map(repr, KINDS)) + "][k + 1]"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), listed AS (
  {found}
), parts AS (
  SELECT r, t, k, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g, unnest(range(len(vs))) AS i FROM listed
), placed AS (
  SELECT r, t, k, v, sum(length(g) + length(v)) OVER (PARTITION BY r, k ORDER BY i) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM parts
), candidates AS (
  SELECT *, e - length(v) AS s, lag(e) OVER (PARTITION BY r, k ORDER BY e) AS last FROM placed WHERE k <> 2 OR length(digits) >= 12
), contexts AS (
  SELECT r, k, v, s, e, digits, substr(t, (greatest(coalesce(last - 1, 0), s - {_BEFORE}) + 1)::BIGINT, (s - greatest(coalesce(last - 1, 0), s - {_BEFORE}))::BIGINT) AS before, substr(t, (e + 1)::BIGINT, 1) AS after,
         CASE k WHEN 0 THEN true WHEN 1 THEN regexp_full_match(v, '{octet}\\.{octet}\\.{octet}\\.{octet}')
           WHEN 2 THEN length(digits) <= 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[length(digits) + 1 - i]::INT
             WHEN digits[length(digits) + 1 - i]::INT > 4 THEN 2 * digits[length(digits) + 1 - i]::INT - 9 ELSE 2 * digits[length(digits) + 1 - i]::INT END)) % 10 = 0
           WHEN 3 THEN length(digits) BETWEEN 9 AND 15 ELSE length(digits) >= 4 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 END AS ok FROM candidates
), voted AS (
  SELECT r, k, s, e, ok AND k < 4 AS base, k || CASE WHEN ok THEN '+' ELSE '-' END || CASE WHEN {matches("v", _GAZETTEER)} THEN '+' ELSE '-' END || CASE WHEN {matches("before", _CUES)} THEN '+' ELSE '0' END
         || CASE WHEN regexp_matches(before, '[\\p{{L}}\\p{{N}}]\\z') OR regexp_matches(after, '^[\\p{{L}}\\p{{N}}]') THEN '-' ELSE '+' END || ({" + ".join(f"(length(v) > {n})::INT" for n in _LENGTHS)}) AS key FROM contexts
), counts AS (
  SELECT key, count(*)::DOUBLE AS n FROM voted GROUP BY key
), lists AS (
  SELECT list(key ORDER BY key) AS keys, list(n ORDER BY key) AS c, list(substr(key, 1, 1)::INT ORDER BY key) AS ks, {", ".join(map(vote, range(4)))}, list(substr(key, 6, 1)::INT ORDER BY key) AS ls FROM counts
), em(round, post) AS (
  SELECT 0, list_transform(range(1, len(c) + 1), lambda i: least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.5::DOUBLE + 0.2::DOUBLE * (v0[i] + v1[i] + v2[i] + v3[i])))) FROM lists
  UNION ALL
  SELECT round + 1, list_transform(range(1, len(c) + 1), lambda i: 1 / (1 + exp(-greatest(-30, least(30, ln(prior[ks[i] + 1] / (1 - prior[ks[i] + 1])) + {odds})))))
  FROM (SELECT * REPLACE ({capped}) FROM (SELECT round, lists.*, {rates}, [{prior}] AS prior FROM em, lists WHERE round < 50) x) y
), labels AS (
  SELECT post, list_transform(c, lambda x: ln(1 + x)) AS weight, list_transform(range(1, len(c) + 1), lambda i: {features}) AS fs FROM em, lists WHERE round = 50
), fit(round, w) AS (
  SELECT 0, list_transform(range(21), lambda t: 0::DOUBLE)
  UNION ALL
  SELECT round + 1, list_transform(range(1, 22), lambda t: w[t] * 0.999::DOUBLE + 2 * list_sum(list_transform(range(1, len(fs) + 1), lambda i: CASE WHEN list_contains(fs[i], t) THEN slope[i] ELSE 0 END)) / (1e-9::DOUBLE + list_sum(weight)))
  FROM (SELECT round, w, fs, weight, list_transform(range(1, len(fs) + 1), lambda i: weight[i] * (post[i] - 1 / (1 + exp(-list_sum(list_transform(fs[i], lambda f: w[f])))))) AS slope FROM fit, labels WHERE round < 400) x
), accepted AS (
  SELECT unnest(keys) AS key, unnest(list_transform(fs, lambda f: list_sum(list_transform(f, lambda j: w[j])) > 0)) AS yes FROM lists, labels, fit WHERE round = 400
), kept AS (
  SELECT r, k, s, base, {name} || ':' || s || ':' || e AS span FROM voted JOIN accepted USING (key) WHERE base OR yes
)
SELECT doc_id, {", ".join(f"count(*) FILTER (base AND k = {i}) AS n_{KINDS[i]}" for i in range(4))},
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans, count(span) AS n_spans
FROM d LEFT JOIN kept ON d.r = kept.r GROUP BY d.r, doc_id
"""


ORACLE_SQL: dict[str, str] = {"op1_pii": _sql()}
