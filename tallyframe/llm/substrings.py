"""Repeated substrings by prefix-free parsing.

A rolling hash over 16 bytes triggers phrases: the trigger of a string is the smallest hash in its
first 128 positions, so equal strings have equal triggers at equal offsets, whatever surrounds them.
All strings of 400 bytes that share a trigger form a family.  Its phrase is the text that they cover;
it is a dictionary word, from the family's first start to the trigger's end, and the parse's suffix
from the trigger on, spelt out as far as strings of 400 bytes reach.

Phrases are counted first.  Strings of a phrase with two places or more are repeated, all of them, which
settles highly repetitive text without looking at single positions.  A phrase with one place can only
hold repeated strings where another phrase goes on alike for 273 bytes after its trigger; those few
phrases, and one place of each phrase that goes on like one of them, stay open.

For these, two suffix arrays are built as sorted tables, with the common lengths of neighbours:
- of the dictionary: distinct words in the order of their last bytes.  A run of words with d + 16 last
  bytes in common is one suffix of the dictionary, and its number is the rank of its first word;
- of the parse: distinct suffixes of the parse in the order of their first bytes, with runs likewise.
A string that starts d bytes before its trigger has its place in corpus order by the pair of the
dictionary suffix with d bytes before the trigger and the parse's run with 400 - d bytes from it on.
Strings of one such place are equal, and no others are.  Where a neighbour on either side has too
little in common, no string is listed at all.  Sorting is by range over distinct keys, runs that go
on over the bounds of partitions are joined by one small row for each partition, and places are counted
before they are shuffled: a passage in a third of all documents costs no more than its rows.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bounded, cut, text_or_empty

LENGTH, GRAM, SPREAD = 400, 16, 128
#: Bytes from the trigger on that all strings of a family hold.
DEEP = LENGTH - SPREAD + 1
#: Bytes from the trigger on that tell whether another document goes on alike; what two documents
#: share of SHARED bytes or more holds a trigger with so many bytes after it.
CORE = 128
SHARED = SPREAD - 1 + CORE
#: Bytes that are parsed together.
_TOGETHER = 1 << 19
_NO_ID = -(1 << 63)
#: A number for each byte, by a rule: a product, and its high bits over its low ones.
_BYTE32 = (np.arange(1, 257, dtype=np.uint64) * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32)
_BYTE32 ^= _BYTE32 >> np.uint32(15)


def triggers(buf: np.ndarray) -> np.ndarray:
    """For each position, where the smallest hash of the SPREAD grams from it on is; the first of equals."""
    x, step, n = _BYTE32[buf], 0x9E3779B1, 1
    while n < GRAM:
        x = x[:-n] * np.uint32(step) + x[n:]
        step, n = step * step & 0xFFFFFFFF, 2 * n
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    least = x.astype(np.uint64) << np.uint64(32) | np.arange(len(x), dtype=np.uint64)
    n = 1
    while n < SPREAD:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def families(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, trigger, digests of CORE and of DEEP bytes, phrase's digest)
    of each family.  A trigger too near to a text's end for strings of LENGTH has the starts 0 and -1 and
    the digest of CORE alone."""
    from xxhash import xxh3_64_intdigest

    out: list[tuple[np.ndarray, ...]] = []

    def digests(whole: bytes, first: np.ndarray, end: np.ndarray, seed: np.ndarray | None = None) -> np.ndarray:
        seeds = repeat(0) if seed is None else seed.tolist()
        return np.fromiter((xxh3_64_intdigest(whole[a:b], s) for a, b, s in zip(first.tolist(), end.tolist(), seeds, strict=False)), np.uint64, len(first))

    def parse(parts: list[tuple[int, int, bytes, bool]]) -> None:
        whole = b"".join(p for _, _, p, _ in parts)
        at = triggers(np.frombuffer(whole, np.uint8))
        begin = 0
        for number, offset, p, last_part in parts:
            n = max(0, len(p) - LENGTH + 1)
            t = at[begin : begin + n]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]][:n])
            x, y, z, shift = first + begin, np.r_[first[1:], n][: len(first)] - 1 + begin, t[first], offset - begin
            out.append((np.full(len(x), number), x + shift, y + shift, z + shift, digests(whole, z, z + CORE), digests(whole, z, z + DEEP), digests(whole, x, y + LENGTH, z - x)))
            if last_part:
                z = np.unique(at[begin + n : begin + len(p) - SHARED + 1])
                z = z[z != t[-1]] if n else z
                none = np.zeros(len(z), np.int64)
                out.append((none + number, none, none - 1, z + shift, digests(whole, z, z + CORE), none.astype(np.uint64), none.astype(np.uint64)))
            begin += len(p)

    held, size = [], 0
    for number, text in enumerate(texts):
        n = max(1, len(text) - LENGTH + 1)
        for lo in range(0, n if len(text) >= SHARED else 0, _TOGETHER):  # a long text's parts share LENGTH - 1 bytes
            p = text[lo : lo + _TOGETHER + LENGTH - 1]
            held.append((number, lo, p, lo + _TOGETHER >= n))
            size += len(p)
            if size >= _TOGETHER:
                parse(held)
                held, size = [], 0
    if held:
        parse(held)
    columns = zip(*out, strict=True) if out else [()] * 7
    return tuple(np.concatenate([np.zeros(0, np.uint64 if i > 3 else np.int64), *c]) for i, c in enumerate(columns))


def _pack(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The starts and trigger of a family in one number; without starts, the trigger alone, negative."""
    return np.where(y < x, -1 - t, x << 16 | (y - x) << 8 | np.where(y < x, 0, t - x))


def _family_rows(only_cores: bool):
    def run(batches):
        for batch in batches:
            number, x, y, t, core, deep, phrase = families(batch.column(3).to_pylist())
            at, cores = pa.array(number), pa.array(core.view(np.int64))
            if only_cores:
                yield pa.RecordBatch.from_arrays([cores, batch.column(2).take(at)], names=["core", "id"])
            else:
                yield pa.RecordBatch.from_arrays([cores, pa.array(deep.view(np.int64)), pa.array(phrase.view(np.int64)), *(batch.column(i).take(at) for i in range(3)), pa.array(_pack(x, y, t))],
                                                 names=["core", "deep", "phrase", "k1", "k2", "id", "pos"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _row(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    spans = merged(spans)
    digest, at = hashlib.sha256(), 0
    for a, b in spans:
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()


def _span(pos: int) -> tuple[int, int]:
    return pos >> 16, (pos >> 16) + (pos >> 8 & 255) + LENGTH


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long"
_SETTLED = "kind int, " + _RESULT + ", k1 long, k2 long, pos long, content binary, word binary, done array<long>"


def _settled(batches):
    """Documents with what is known of their families -> kind 0: a result; 1: a document that waits
    for single strings; 2 and 3: a phrase that stays open, as partner or with its own strings: its
    dictionary word, backwards, and its suffix of the parse."""
    names = ["kind", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "k1", "k2", "pos", "content", "word", "done"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for doc_id, k1, k2, text, marks, shared in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            done = [m["pos"] for m in marks or () if m["kind"] == 0]
            own = any(m["kind"] == 3 for m in marks or ())
            for m in marks or ():
                if m["kind"] == 3 or m["kind"] == 2 and m["id"] == (_NO_ID if doc_id is None else doc_id):
                    a, b = _span(m["pos"])
                    t = a + (m["pos"] & 255)
                    rows.append((m["kind"], *[None] * 6, k1, k2, m["pos"], text[t:b], text[a : t + GRAM][::-1], None))
            if own:
                rows.append((1, doc_id, *[None] * 4, shared, k1, k2, None, text, None, done))
            else:
                rows.append((0, doc_id, *_row(text, [_span(p) for p in done]), shared, *[None] * 6))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 13, types, strict=True)], names=names)


def common_lengths(keys: list[bytes]) -> np.ndarray:
    """How many first bytes each key has in common with the one before it; 0 for the first."""
    size = np.array([len(k) for k in keys])
    width = int(size.max()) + 1
    b = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(len(keys), width)
    differ = b[1:] != b[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    return np.r_[0, np.minimum(first, np.minimum(size[1:], size[:-1]))]


_RUNS = "key binary, part int, runs array<long>, last binary"


def _runs(base: int):
    """Sorted distinct keys with their numbers of phrases -> for each key the runs that it is in: for
    base, base + 1, ... first bytes in common, the place of the run's first key in this partition.
    Listed are only lengths that another phrase has in common with it.  A last row with no key holds the
    partition's first and last keys and the runs at its end."""

    def run(batches):
        part, place, ends, first = TaskContext.get().partitionId(), 0, np.zeros(SPREAD, np.int64), None
        lengths = base + np.arange(SPREAD)
        held: tuple[bytes, int, int] | None = None  # a key waits for what it has in common with the next one

        def batch(keys, most, starts):
            count = np.clip(np.array(most) - base + 1, 0, SPREAD)
            some = count > 0
            starts, count = starts[some], count[some]
            runs = pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), pa.array(starts[np.arange(SPREAD)[None, :] < count[:, None]]))
            keys = [k for k, s in zip(keys, some.tolist(), strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([part] * len(keys), pa.int32()), runs, pa.array([None] * len(keys), pa.binary())], names=["key", "part", "runs", "last"])

        for rows in batches:
            keys, n = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            if not keys:
                continue
            if held:
                keys, n = [held[0], *keys], [held[1], *n]
            same = common_lengths(keys)
            if held:
                same[0] = held[2]
            else:
                first, same[0] = keys[0], len(keys[0])  # what comes before is in another partition
            at = place + np.arange(len(keys))
            begins = np.where((same[:, None] < lengths[None, :]) & (at[:, None] > 0), at[:, None], 0)
            starts = np.maximum.accumulate(np.maximum(begins, ends[None, :]), 0)
            most = [len(k) if c > 1 else max(s, t) for k, c, s, t in zip(keys[:-1], n, same.tolist(), same[1:].tolist(), strict=False)]
            if most:
                yield batch(keys[:-1], most, starts[:-1])
                ends = starts[-2]
            held, place = (keys[-1], n[-1], int(same[-1])), place + len(keys) - 1
        if held:
            begins = np.where((held[2] < lengths) & (place > 0), place, 0)
            ends = np.maximum(ends, begins)
            yield batch([held[0]], [len(held[0])], ends[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([part], pa.int32()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([len(first).to_bytes(4, "big") + first + held[0]], pa.binary())],
                                             names=["key", "part", "runs", "last"])

    return run


def _bounds(rows: list, base: int) -> dict[int, list[int]]:
    """One row for each partition -> for each partition, the numbers of the runs that its first key is in."""
    out: dict[int, list[int]] = {}
    before, carried = b"", [0] * SPREAD
    for r in sorted(rows, key=lambda r: r.part):
        size = int.from_bytes(r.last[:4], "big")
        first, last = bytes(r.last[4 : 4 + size]), bytes(r.last[4 + size :])
        same = int(common_lengths([before, first])[1]) if out else -1
        own = r.part << 40
        out[r.part] = [carried[i] if base + i <= same else own for i in range(SPREAD)]
        carried = [own + s if s else out[r.part][i] for i, s in enumerate(r.runs)]
        before = last
    return out


def suffix_runs(keys: DataFrame, base: int) -> DataFrame:
    """keys: a column key -> (key, runs): sorted by range, the suffix array's runs that distinct keys are
    in; runs[i] is the number, in the whole order, of the run with base + i first bytes in common.  Keys
    or lengths that no other row shares are left out.

    The driver gets one row of under 2 KB for each partition of the sort."""
    spark = keys.sparkSession
    counted = keys.groupBy("key").agg(F.count("*").alias("n"))
    ranked = cut(counted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(bounded(_runs(base), 5000, 2 << 20), _RUNS))
    fixed = spark.sparkContext.broadcast(_bounds(ranked.where("key IS NULL").collect(), base))

    def numbered(batches):
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            runs = batch.column(2)
            size = runs.value_lengths().to_numpy(zero_copy_only=False)
            values = runs.flatten().to_numpy(zero_copy_only=False).copy()
            row = np.repeat(np.arange(len(part)), size)
            i = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            open_ones = values == 0
            values += part[row].astype(np.int64) << 40
            if open_ones.any():
                values[open_ones] = [fixed.value[p][j] for p, j in zip(part[row[open_ones]].tolist(), i[open_ones].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(values))], names=["key", "runs"])

    return ranked.where("key IS NOT NULL").mapInArrow(bounded(numbered, 5000), "key binary, runs array<long>")


def _places(batches):
    """Open phrases with their runs of both suffix arrays -> (dictionary place, parse place) of each
    string that may be equal to another."""
    for batch in batches:
        kind, k1, k2, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        words, suffixes = batch.column(4), batch.column(5)
        w_size, s_size = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, suffixes))
        w_at, s_at = np.cumsum(w_size) - w_size, np.cumsum(s_size) - s_size
        most = pos & 255
        least = np.maximum(most - (pos >> 8 & 255), LENGTH - DEEP - (s_size - 1))  # LENGTH - d bytes from the trigger on
        count = np.maximum(0, np.minimum(most, w_size - 1) - least + 1)
        row = np.repeat(np.arange(len(pos)), count)
        d = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        in_words = words.flatten().to_numpy(zero_copy_only=False)[w_at[row] + d] << 7 | d
        in_parse = suffixes.flatten().to_numpy(zero_copy_only=False)[s_at[row] + LENGTH - d - DEEP]
        start = (pos >> 16)[row] + most[row] - d
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (in_words, in_parse, kind[row], k1[row], k2[row], start)], names=["a", "b", "kind", "k1", "k2", "p"])


def _finished(batches):
    for batch in batches:
        rows = []
        for doc_id, text, done, shared, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            rows.append((doc_id, *_row(text, [_span(p) for p in done] + [(p, p + LENGTH) for p in found or ()]), shared))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.int64()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared), one row for each input row: what is
    left of its text when each byte goes that a repeated string of 400 bytes covers.  n_shared tells of
    shorter passages, which all stay: how many of the text's phrases go on, for 128 bytes from their
    trigger, as a phrase of another document does.  Whatever has 255 bytes or more in common with
    another document has at least one.

    Null texts are empty.  Repeated rows are places of their own: from 400 bytes on all of their text
    goes (rows of one id count as one document in n_shared).  An empty table gives an empty result; other
    columns are ignored."""
    with arrow_batches(docs.sparkSession, 500, 4 << 20):
        return cut(_without_repeats(docs, id_col, text_col))


def _without_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.crc32("text").alias("k2"), "text")
    parsed = rows.where(F.octet_length("text") >= SHARED).select("k1", "k2", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    cores = parsed.mapInArrow(bounded(_family_rows(True), 500, 1 << 20), "core long, id long").groupBy("core").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"))
    cores = cut(cores.where("n > 1").select("core", F.expr("x <> y").alias("across")))
    kind = "core long, deep long, phrase long, k1 long, k2 long, id long, pos long"
    shared = cut(parsed.mapInArrow(bounded(_family_rows(False), 500, 1 << 20), kind).join(cores, "core").drop("core"))
    dictionary = cut(shared.where("pos >= 0").groupBy("deep", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "id")).alias("one")))
    unsettled = dictionary.groupBy("deep").agg(F.min("n").alias("least"), F.count("*").alias("phrases")).where("least = 1 AND phrases > 1").select("deep")
    often = dictionary.where("n > 1").select("deep", "phrase", F.lit(0).alias("kind"))
    places = shared.dropDuplicates(["k1", "k2", "pos"]).select("deep", "phrase", "k1", "k2", "pos", "across")
    known = places.where("pos >= 0").join(often, ["deep", "phrase"], "left").unionByName(places.where("pos < 0").withColumn("kind", F.lit(None).cast("int")))
    known = known.select("k1", "k2", "pos", F.lit(0).cast("long").alias("id"), "kind", F.col("across").cast("long").alias("shared"))
    todo = dictionary.join(unsettled, "deep").select("one.k1", "one.k2", "one.pos", "one.id", F.when(F.col("n") == 1, 3).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("shared"))
    mark = F.when(F.col("kind").isNotNull(), F.struct("pos", "kind", "id"))
    marks = cut(known.unionByName(todo).groupBy("k1", "k2").agg(F.collect_list(mark).alias("marks"), F.sum("shared").alias("n_shared")))
    joined = rows.join(marks, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "marks", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    states = cut(joined.mapInArrow(bounded(_settled, 500, 2 << 20), _SETTLED))
    opened = states.where("kind > 1").select("kind", "k1", "k2", "pos", "word", F.col("content").alias("suffix"))
    words = cut(suffix_runs(opened.select(F.col("word").alias("key")), GRAM))
    suffixes = cut(suffix_runs(opened.select(F.col("suffix").alias("key")), DEEP).select(*_digest("key"), "runs"))
    placed = opened.select("kind", "k1", "k2", "pos", "word", *_digest("suffix")).join(words.select(F.col("key").alias("word"), F.col("runs").alias("in_words")), "word").drop("word")
    placed = placed.join(suffixes.withColumnRenamed("runs", "in_parse"), ["s1", "s2"]).select("kind", "k1", "k2", "pos", "in_words", "in_parse")
    strings = cut(placed.mapInArrow(bounded(_places, 2000), "a long, b long, kind int, k1 long, k2 long, p long"))
    repeated = strings.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("kind").alias("kind")).where("n > 1 AND kind = 3").select("a", "b")
    found = cut(strings.where("kind = 3").join(repeated, ["a", "b"]).groupBy("k1", "k2").agg(F.collect_list("p").alias("found")))
    waiting = states.where("kind = 1").select("doc_id", "k1", "k2", F.col("content").alias("text"), "done", "n_shared")
    rest = waiting.join(found, ["k1", "k2"], "left").select("doc_id", "text", "done", "n_shared", "found").mapInArrow(bounded(_finished, 500, 2 << 20), _RESULT)
    return states.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared").unionByName(rest)


def _digest(name: str) -> tuple:
    return F.xxhash64(name).alias("s1"), F.xxhash64(F.lit(1), name).alias("s2")
