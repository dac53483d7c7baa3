"""Best-fit packing by the linear grouping scheme (Fernandez de la Vega and Lueker, 1981).

Lengths are whole numbers up to the capacity, so a corpus of any size is planned from one histogram
of at most 2,048 rows.  Large lengths are rounded up to the largest of their group, in groups of equal
cardinality; configurations of those few sizes are optimised as a linear program with columns generated
by a knapsack (Gilmore and Gomory, 1961) and rounded down; actual documents of a group take its places;
what is left, and all small documents, go best-fit into the remaining room.  Bins that are then not
full are opened once more and packed best-fit among themselves.

The plan is a list of ranges: the documents of one length with ranks lo to hi-1 go to bins first,
first+1, ... at one offset.  Only this bounded list is sent to the executors.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, text_or_empty

CAPACITY = 2048
END_ID = 0
#: Lengths over this share of the capacity are large; they form so many groups.
LARGE, GROUPS = 1 / 8, 48
#: A configuration whose actual documents leave more than this share of a bin is given up: its
#: documents are then packed best-fit with the small ones.
TIGHT = 1 / 128
#: Documents of one length are ranked in so many parts, by a hash.
PARTS = 256
#: Words whose ids a worker keeps.
KEPT_WORDS = 800_000
#: Marks that may follow a word and are one run of their own; not the apostrophe, which may join it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space to str.split() and to Python's \s, but tokens of their own to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(rf"[\S{_SEPARATORS}]+")


def _split(text: str) -> list[str]:
    """Words between the tokenizer's white space."""
    return _WORD.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


class _Words(dict):
    """word -> number; new words are noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Token ids of texts.  No token of this vocabulary spans white space, so a text's ids are its
    words' ids one after another, and each distinct word is encoded once.  Words of letters, with or
    without marks after them, are encoded many at a time: each run of letters or marks ends with a
    token that is an end of word, so the ends tell the words apart."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run of letters or marks
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = _Words(), np.zeros(0, np.uint32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _runs(word: str) -> int:
        """1: letters; 2: letters and then marks; 0: anything else."""
        if word.isascii():
            if word.isalpha():
                return 1
            if word[:-1].isalpha() and word[-1] in _MARKS:
                return 2
        core = word.rstrip(_MARKS)
        if not core.isalpha() or not (core.isascii() or normalize("NFC", core).lower().isalpha()):
            return 0
        return 1 + (len(core) < len(word))

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        base = len(self.first)
        first, count, out, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        runs = np.fromiter(map(self._runs, new), np.int64, len(new))
        todo = np.flatnonzero(runs)
        rest = np.flatnonzero(runs == 0).tolist()
        parts = [todo[i : i + 2000] for i in range(0, len(todo), 2000)]
        for p, e in zip(parts, self._encode([" ".join([new[i] for i in q.tolist()]) for q in parts]), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != runs[p].sum():
                rest += p.tolist()
                continue
            ends = ends[np.cumsum(runs[p]) - 1]
            begin = np.r_[0, ends[:-1]]
            first[p], count[p] = size + begin, ends - begin
            out.append(ids)
            size += len(ids)
        for lo in range(0, len(rest), 2000):
            for i, e in zip(rest[lo : lo + 2000], self._encode([new[i] for i in rest[lo : lo + 2000]]), strict=True):
                first[i], count[i] = size, len(e.ids)
                out.append(np.array(e.ids, np.uint32))
                size += len(e.ids)
        self.ids, self.first, self.count = np.concatenate(out), np.r_[self.first, first], np.r_[self.count, count]
        assert len(self.first) == base + len(new)

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > KEPT_WORDS:
            self._forget()
        number = self.words.__getitem__
        at = [np.fromiter(map(number, _split(t)), np.int32) for t in texts]
        if self.words.new:
            self._learn()
        out = []
        for w in at:
            n = self.count[w]
            end = np.cumsum(n)
            out.append(self.ids[np.arange(end[-1] if len(w) else 0) + np.repeat(self.first[w] - end + n, n)])
        return out


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        for batch in batches:
            rows = []
            for k, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
            k, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32).  A null or blank text is the one id that ends it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(bounded(_pieces(tokenizer, capacity), 500), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (how many of each size) and how often, of least total, as a fractional solution."""
    s, k = np.array(sizes), len(sizes)
    basis = np.diag(capacity // s).astype(float)
    x = np.array(demand) / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, used = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(min(sizes), capacity + 1):
            fits = room >= s
            gain = np.where(fits, best[np.maximum(room - s, 0)] + price, -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[room - 1] + 1e-12:
                best[room], used[room] = gain[i], i
            else:
                best[room] = best[room - 1]
        if best[capacity] < 1 + 1e-7:
            break
        pattern, room = np.zeros(k), capacity
        while room > 0:
            if used[room] < 0:
                room -= 1
            else:
                pattern[used[room]] += 1
                room -= sizes[used[room]]
        step = np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
    return [(basis[:, i].astype(int), x[i]) for i in range(k)]


class _Room:
    """Bins by the room they have left; bins of one class hold documents of the same lengths."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.classes: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        self.sizes: list[int] = []  # rooms that may have bins, ascending

    def add(self, lengths: tuple[int, ...], bins: int) -> None:
        if bins:
            room = self.capacity - sum(lengths)
            i = bisect_left(self.sizes, room)
            if i == len(self.sizes) or self.sizes[i] != room:
                self.sizes.insert(i, room)
            self.classes[room].append((lengths, bins))

    def best(self, need: int) -> int:
        i = bisect_left(self.sizes, need)
        while i < len(self.sizes):
            if self.classes[self.sizes[i]]:
                return self.sizes[i]
            del self.sizes[i]
        return 0

    def take(self, room: int, most: int) -> tuple[tuple[int, ...], int]:
        lengths, bins = self.classes[room].pop()
        if bins > most:
            self.classes[room].append((lengths, bins - most))
        return lengths, min(bins, most)

    def fit(self, left: dict[int, int]) -> None:
        """Best-fit, longest first, opening bins where nothing has room."""
        for n in sorted(left, reverse=True):
            while left[n]:
                if room := self.best(n):
                    lengths, bins = self.take(room, max(1, left[n] // (room // n)))
                else:
                    room = self.capacity
                    lengths, bins = (), max(1, left[n] // (room // n))
                each = min(room // n, left[n])
                self.add(lengths + (n,) * each, bins)
                left[n] -= each * bins

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [x for found in self.classes.values() for x in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Length -> how many, to ranges (length, lo, hi, first bin, offset)."""
    left = {n: c for n, c in counts.items() if c > 0}
    assert all(0 < n <= capacity for n in left)
    room = _Room(capacity)
    big = sorted((n for n in left if n > large * capacity), reverse=True)
    members: list[list[int]] = []
    share, so_far = max(1, -(-sum(left[n] for n in big) // groups)), 0
    for n in big:
        if not members or so_far >= share:
            members.append([])
            so_far = 0
        members[-1].append(n)
        so_far += left[n]
    solved = _configurations([m[0] for m in members], [sum(left[n] for n in m) for m in members], capacity) if members else []
    for pattern, times in solved:
        times = min([int(times + 1e-6), *(sum(left[n] for n in members[i]) // p for i, p in enumerate(pattern) if p)])
        if times < 1 or not pattern.any():
            continue
        runs: list[tuple[tuple[int, ...], int]] = [((), times)]
        for k, i in enumerate(i for i, p in enumerate(pattern) for _ in range(p)):
            todo, runs = runs, []
            for lengths, bins in todo:
                while bins:  # long ones meet short ones
                    n = next(n for n in (members[i] if k % 2 else members[i][::-1]) if left[n])
                    m = min(bins, left[n])
                    left[n] -= m
                    bins -= m
                    runs.append(((*lengths, n), m))
        for lengths, bins in runs:
            if capacity - sum(lengths) <= TIGHT * capacity:
                room.add(lengths, bins)
            else:  # too much was rounded up here
                for n in lengths:
                    left[n] += bins
    room.fit(left)
    # Rounding up costs room that small documents may not suffice to fill: bins that are not full are
    # opened again and their documents packed best-fit among themselves.
    full, again, rest = [], _Room(capacity), defaultdict(int)
    for lengths, bins in room.all():
        if sum(lengths) == capacity:
            full.append((lengths, bins))
        for n in lengths if sum(lengths) < capacity else ():
            rest[n] += bins
    again.fit(rest)
    chosen = min(room.all(), full + again.all(), key=lambda found: sum(bins for _, bins in found))
    out, used, first = [], defaultdict(int), 0
    for lengths, bins in chosen:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + bins, first, offset))
            used[n] += bins
            offset += n
        first += bins
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    Only documents over the capacity are cut.  Pieces that fill a sequence have one of their own, with a
    negative number, and need no plan.  Repeated rows are packed as often as they occur; which
    of two equal pieces takes which of their two places is open.  Null ids stay null.  An empty table
    gives an empty result.  Other columns are ignored."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    whole, less = cutted.where(F.col("length") == capacity), cutted.where(F.col("length") < capacity)
    part = F.pmod(F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.xxhash64("doc_id", "piece", "ids_crc32")), F.lit(PARTS)).cast("int")
    salted = less.withColumn("part", part)
    counts = cut(salted.groupBy("length", "part").agg(F.count("*").alias("n")))  # under capacity * PARTS rows, so it may be broadcast
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = plan(histogram, capacity)  # their number follows the lengths and groups, not the documents
    to_here = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("length", "part", (F.sum("n").over(to_here) - F.col("n")).alias("before"))
    table = spark.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(F.broadcast(before), ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = ranked.alias("r").join(F.broadcast(table).alias("t"), (F.col("r.length") == F.col("t.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = at.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    return placed.unionByName(alone)
