"""Query: all documents as JPEG media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jpeg import HASH_SIDE, UNIT, media_columns


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("average_hash"), F.lit(":"), F.col("thumbnail_sha256"))
    return media_columns(table(spark, sf_dir, "documents")).withColumn("feature", feature)


QUERIES = {"op3_jpeg": op3_jpeg}
# The markers of a baseline file with three components, one quantiser of ones, and one code
# of one bit for category 8; what changes from file to file stands between these parts.
_START, _COMMENT = "ffd8ffe000104a46494600010100000100010000fffe", "payload "
_BEFORE_SIZE = "ffdb004300" + "01" * 64 + "ffc0001108"
_AFTER_SIZE = "03011100021100031100" + "ffc4002600" + "01" + "00" * 15 + "08" + "10" + "01" + "00" * 15 + "08" + "ffdd00040001" + "ffda000c03010002000300003f00"


def _sql() -> str:
    """The same in SQL: the file as hexadecimal text, nine bytes for each eight of the payload."""
    side = HASH_SIDE
    low = lambda k, n: f"({k}) * {n} // {side}"
    high = lambda k, n: f"greatest((({k}) + 1) * {n} // {side}, {low(k, n)} + 1)"
    i, j = f"k // {side}", f"k % {side}"
    level = f"list_sum(flatten(list_transform(range({low(i, 'tall')}, {high(i, 'tall')}), lambda y: list_transform(range({low(j, 'wide')}, {high(j, 'wide')}), lambda x: pixels[y * wide + x + 1]))))"
    digit = "substr('0123456789abcdef', {} + 1, 1)".format
    shifts = " ".join(f"WHEN {x} THEN ((p[q // 9 * 8 + {x}] & {2**x - 1}) << {8 - x}) | (p[q // 9 * 8 + {x + 1}] >> {x + 1})" for x in range(1, 8))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), sized AS (
  SELECT r, doc_id, octet_length(b) AS n, hex(b) AS h, greatest(1, (octet_length(b) + {UNIT - 1}) // {UNIT}) AS units, floor(sqrt(greatest(0, (octet_length(b) + {UNIT - 1}) // {UNIT} - 1)))::BIGINT + 1 AS wide FROM d
), shaped AS (
  SELECT *, (units + wide - 1) // wide AS tall, lower(h) || repeat('20', units * {UNIT} - n) AS payload FROM sized
), bytes AS (
  SELECT *, list_transform(regexp_extract_all(payload || repeat('20', (wide * tall - units) * {UNIT}), '..'), lambda x: ('0x' || x)::INT) AS p FROM shaped
), packed AS (
  SELECT *, list_transform(range(wide * tall * {UNIT * 9 // 8}), lambda q: CASE q % 9 WHEN 0 THEN p[q // 9 * 8 + 1] >> 1 {shifts} ELSE p[q // 9 * 8 + 8] END) AS scan,
         list_transform(range(wide * tall), lambda u: (CASE WHEN p[u * {UNIT} + 1] < 128 THEN p[u * {UNIT} + 1] - 255 ELSE p[u * {UNIT} + 1] END + 1028) // 8) AS pixels FROM bytes
), files AS (
  SELECT *, '{_START}' || printf('%04x', {len(_COMMENT) + 2} + length((units * {UNIT})::VARCHAR)) || lower(hex(encode('{_COMMENT}' || units * {UNIT}))) || '{_BEFORE_SIZE}' || printf('%04x%04x', tall * 8, wide * 8) || '{_AFTER_SIZE}'
         || array_to_string(list_transform(scan, lambda v, q: {digit("v // 16")} || {digit("v % 16")} || CASE WHEN v = 255 THEN '00' ELSE '' END
            || CASE WHEN q % {UNIT * 9 // 8} = 0 AND q < len(scan) THEN 'ffd' || (q // {UNIT * 9 // 8} - 1) % 8 ELSE '' END), '') || 'ffd9' AS media,
         list_transform(range({side * side}), lambda k: {level} // (({high(i, "tall")} - {low(i, "tall")}) * ({high(j, "wide")} - {low(j, "wide")}))) AS cells FROM packed
), hashed AS (
  SELECT *, array_to_string(list_transform(range({side * side // 4}), lambda m: {digit(" + ".join(f"{8 >> t} * (cells[m * 4 + {t + 1}] * {side * side} > list_sum(cells))::INT" for t in range(4)))}), '') AS average_hash,
         sha256(unhex(array_to_string(list_transform(pixels, lambda v: {digit("v // 16")} || {digit("v % 16")}), ''))) AS thumbnail_sha256 FROM files
)
SELECT doc_id, n::BIGINT AS n_bytes, (units * {UNIT})::BIGINT AS payload_bytes, sha256(unhex(payload)) AS payload_sha256,
       xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(p[units * {UNIT} - 15:units * {UNIT}], lambda v: v::BIGINT)), lambda a, v:
         list_reduce(list_prepend(xor(a, v), range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))::BIGINT AS tail_crc32,
       (strlen(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256, (wide * 8)::BIGINT AS width, (tall * 8)::BIGINT AS height, thumbnail_sha256, average_hash,
       (wide * 8) || 'x' || (tall * 8) || ':' || average_hash || ':' || thumbnail_sha256 AS feature
FROM hashed
"""


ORACLE_SQL: dict[str, str] = {"op3_jpeg": _sql()}
