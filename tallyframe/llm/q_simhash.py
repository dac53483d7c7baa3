"""Query: SimHash fingerprints and components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .simhash import SEED, SHINGLE, near_duplicates


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_neardup": op8_simhash_neardup}
# The primes of XXH64.
_PRIMES = (0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _sql() -> str:
    """The same in SQL: XXH64 over whole numbers modulo 2^64, all pairs of distinct fingerprints, and
    what links reach."""
    p = [f"{x}::UHUGEINT" for x in _PRIMES]
    mod = "18446744073709551616::UHUGEINT"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    times = lambda a, b: f"({a}) * ({b}) % {mod}"
    left = lambda x, r: let(x, "z", f"z * {1 << r}::UHUGEINT % {mod} + z // {1 << 64 - r}::UHUGEINT")
    mixed = lambda a, x: times(left(f"(({a}) + {times(x, p[2])}) % {mod}", 31), p[1])
    fold = lambda start, items, body: f"list_reduce(list_prepend({start}, {items}), lambda a, x: {body})"
    start = [(SEED + _PRIMES[1] + _PRIMES[2]) % 2**64, (SEED + _PRIMES[2]) % 2**64, SEED, (SEED - _PRIMES[1]) % 2**64]
    lane = lambda k: fold(f"{start[k]}::UHUGEINT", f"list_transform(range(n // 32), lambda i: longs[i * 4 + {k + 1}])", mixed("a", "x"))
    whole = " + ".join(left(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))
    after_lanes = fold(f"({whole}) % {mod}", "[v0, v1, v2, v3]", f"({times(f'xor(a, {mixed("0::UHUGEINT", "x")})', p[1])} + {p[4]}) % {mod}")
    after_longs = fold("h1", "list_transform(range(n // 32 * 4, n // 8), lambda i: longs[i + 1])", f"({times(left(f'xor(a, {mixed("0::UHUGEINT", "x")})', 27), p[1])} + {p[4]}) % {mod}")
    after_int = fold("h2", "ints", f"({times(left(f'xor(a, {times("x", p[1])})', 23), p[2])} + {p[3]}) % {mod}")
    after_bytes = fold("h3", "octets", times(left(f"xor(a, {times('x', p[5])})", 11), p[1]))
    last = "h4"
    for shift, factor in ((33, p[2]), (29, p[3]), (32, "1::UHUGEINT")):
        last = let(last, "y", times(f"xor(y, y // {1 << shift}::UHUGEINT)", factor))
    number = lambda at, n: f"('0x' || {' || '.join(f'substr(hx, {at} + {2 * k + 1}, 2)' for k in reversed(range(n)))})::UBIGINT::UHUGEINT"
    bits = ", ".join(f"sum(c * (h // {1 << b}::UHUGEINT % 2)::INT) AS b{b}" for b in range(64))
    value = " + ".join(f"CASE WHEN 2 * b{b} > total THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT r, s, count(*) AS c FROM (
    SELECT r, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: {joined}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d) u GROUP BY r, s
), texts AS (
  SELECT s, hex(encode(s)) AS hx, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles) u
), parsed AS (
  SELECT s, n, list_transform(range(n // 8), lambda i: {number("i * 16", 8)}) AS longs,
         CASE WHEN n % 8 >= 4 THEN [{number("n // 8 * 16", 4)}] ELSE [] END AS ints,
         list_transform(range(n // 8 * 8 + CASE WHEN n % 8 >= 4 THEN 4 ELSE 0 END, n), lambda i: {number("i * 2", 1)}) AS octets FROM texts
), lanes AS (
  SELECT *, {", ".join(f"{lane(k)} AS v{k}" for k in range(4))} FROM parsed
), h1 AS (
  SELECT *, (CASE WHEN n >= 32 THEN {after_lanes} ELSE {(SEED + _PRIMES[5]) % 2**64}::UHUGEINT END + n::UHUGEINT) % {mod} AS h1 FROM lanes
), h2 AS (
  SELECT *, {after_longs} AS h2 FROM h1
), h3 AS (
  SELECT *, {after_int} AS h3 FROM h2
), h4 AS (
  SELECT *, {after_bytes} AS h4 FROM h3
), hashed AS (
  SELECT s, {last} AS h FROM h4
), votes AS (
  SELECT r, sum(c) AS total, {bits} FROM shingles JOIN hashed USING (s) GROUP BY r
), prints AS (
  SELECT d.r, doc_id, coalesce(({value}), 0)::UBIGINT AS fp FROM d LEFT JOIN votes ON d.r = votes.r
), points AS (
  SELECT fp, min(doc_id) AS first_id FROM prints GROUP BY fp
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM points a JOIN points b ON bit_count(xor(a.fp, b.fp)) BETWEEN 1 AND 2
), reached(fp, other) AS (
  SELECT fp, fp FROM points UNION SELECT reached.fp, links.b FROM reached JOIN links ON reached.other = links.a
), classes AS (
  SELECT reached.fp, min(first_id) AS component_id FROM reached JOIN points ON reached.other = points.fp GROUP BY reached.fp
)
SELECT doc_id, lpad(lower(hex(prints.fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN classes ON prints.fp = classes.fp
"""


ORACLE_SQL: dict[str, str] = {"op8_simhash_neardup": _sql()}
