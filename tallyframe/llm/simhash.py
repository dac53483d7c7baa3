"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 majority bits of the XXH64 of a text's word shingles.  Two distinct fingerprints
that differ in at most 2 bits are found with a covering code: the perfect binary Golay code [23,12]
has covering radius 3, and the anchors are the pairs of its codewords on bits 0-22 and 23-45 (2^24
anchors).  A fingerprint has one home anchor, within radius 3 on both halves.  It is replicated to
every anchor within covering radius plus threshold: on the halves within 3 + i and 3 + j, i + j <= 2,
about 61 anchors.  If x and y differ in i and j bits on the halves, y is at the home of x.

Exact copies share a fingerprint and are folded before anything is replicated, so a group of copies
of any size costs one row.  Nothing is capped: an anchor that gathers many distinct fingerprints is
answered by probing (2,080 masks on a sorted array), so its cost stays proportional to its rows.
An anchor is one task's; its rows, eight bytes each, are held together.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, text_or_empty
from .graph import components

SHINGLE = 3
SEED = 42
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0b110001110101
_PIECE = 65_536
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """0 for a text without words; of fewer words than a shingle, all of them are the one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    total, ones = 0, np.zeros((8, 256), np.int64)
    hashes = map(xxh64_intdigest, parts, itertools.repeat(SEED))
    while len(h := np.fromiter(itertools.islice(hashes, _PIECE), np.uint64)):
        total += len(h)
        lanes = h.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[i] += np.bincount(lanes[:, i], minlength=256)
    bits = (2 * (ones @ _BITS).reshape(64) > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(bounded(_fingerprints), "doc_id long, fp long")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, list]:
    """Syndromes of the low 12 and the high 11 bits, and for shells 0 (distance <= 3), 1 (4), 2 (5):
    the error patterns by syndrome, as (first, count, patterns)."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    one = np.array([rest(1 << i) for i in range(23)])
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= one[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= one[12 + i]
    shells = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        e = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(23), w)], np.int64)
        s = low[e & 0xFFF] ^ high[e >> 12]
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=2048)
        shells.append((np.cumsum(count) - count, count, e[order]))
    return low, high, shells


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] times: i, and 0, 1, ... count[i]-1."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 fingerprints -> (index, key); key = anchor * 2 + (0 at home, else 1)."""
    low, high, shells = _golay()
    halves = [(fp >> np.uint64(s) & np.uint64(0x7FFFFF)).astype(np.int64) for s in (0, 23)]
    syn = [low[v & 0xFFF] ^ high[v >> 12] for v in halves]
    rows, keys = [], []
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):
        (f1, n1, e1), (f2, n2, e2) = shells[i], shells[j]
        n2s = n2[syn[1]]
        row, k = _ragged(n1[syn[0]] * n2s)
        a, b = k // n2s[row], k % n2s[row]
        c1 = halves[0][row] ^ e1[f1[syn[0][row]] + a]
        c2 = halves[1][row] ^ e2[f2[syn[1][row]] + b]
        rows.append(row)
        keys.append((((c1 >> 11) << 12 | c2 >> 11) << 1) | (i + j > 0))
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches):
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(whole), 10_000):
            fp = whole[lo : lo + 10_000]
            row, key = replicas(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], names=["key", "fp"])


@lru_cache(1)
def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array(one + [a | b for a, b in itertools.combinations(one, 2)], np.uint64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> edges of the same components, one for each node but the root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def links(home: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of `there` that are smaller than, and within 2 bits of, one of `home` at one anchor."""
    a, b = [], []
    if len(home) * len(there) > len(_masks()) * len(home) * 8:
        there = np.sort(there)
        for m in _masks():
            want = home ^ m
            hit = (there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want) & (want < home)
            a.append(home[hit])
            b.append(want[hit])
            if sum(map(len, a)) > 1 << 20:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
    else:
        step = max(1, (1 << 21) // max(1, len(there)))
        for i in range(0, len(home), step):
            h = home[i : i + step]
            p, q = np.nonzero((np.bitwise_count(h[:, None] ^ there[None, :]) <= 2) & (there[None, :] < h[:, None]))
            a.append(h[p])
            b.append(there[q])
            if sum(map(len, a)) > 1 << 20:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
    a, b = np.concatenate(a), np.concatenate(b)
    return _forest(a, b) if len(a) else (a, b)


def _compared(batches):
    """Rows sorted by key: each anchor's homes, then its replicas.  Small anchors of a batch are
    compared together, the others one by one.  Rows of an anchor that goes on are put together once,
    when it ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(key, fp):
        out = []
        anchor = key >> 1
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(key)])
        homes = np.add.reduceat(1 - (key & 1), first)
        large = homes * size > 1 << 16
        n = np.where(large, 0, homes)
        run, k = _ragged(n)
        i = first[run] + k
        at, j = _ragged(size[run])
        for lo in range(0, len(at), 1 << 21):
            x, y = fp[i[at[lo : lo + (1 << 21)]]], fp[first[run[at[lo : lo + (1 << 21)]]] + j[lo : lo + (1 << 21)]]
            hit = (y < x) & (np.bitwise_count(x ^ y) <= 2)
            out.append((x[hit], y[hit]))
        for r in np.flatnonzero(large):
            out.append(links(fp[first[r] : first[r] + homes[r]], fp[first[r] : first[r] + size[r]]))
        for a, b in out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def together():
        return (np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if held[0][0][0] >> 1 != held[-1][0][-1] >> 1:
            key, fp = together()
            end = int(np.searchsorted(key, key[-1] & ~1))
            yield from flush(key[:end], fp[:end])
            held = [(key[end:], fp[end:])]
    if held:
        yield from flush(*together())


def _roots(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root): each with the one that stands for its component."""
    spread = fps.select("fp").repartition("fp").mapInArrow(_replicate, "key int, fp long")
    dealt = spread.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    edges = cut(dealt.mapInArrow(_compared, "a long, b long"))
    root = components(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each input row.  component_id is the smallest
    non-null id among all rows that links of at most 2 differing bits reach (null if none has an id).

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows stay, with
    equal results.  An empty table gives an empty result.  Other columns are ignored."""
    rows = cut(fingerprints(docs, id_col, text_col))
    rooted = _roots(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))))
    of_root = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(rooted.join(of_root, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay when one of each component is kept: that of the smallest id,
    rows without an id last, then of the smallest digest of the text; of rows equal in both, any one."""
    columns = docs.columns
    sums = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_or_empty().cast("binary")).alias("digest"), text_or_empty().cast("binary").alias("text"))

    def marked(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = cut(sums.mapInArrow(bounded(marked), "doc_id long, digest string, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("one")
    of_fp = cut(rows.groupBy("fp").agg(first))
    kept = _roots(of_fp).groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("k_id"), F.col("one.digest").alias("k_digest"))
    often = rows.groupBy("doc_id", "digest").agg((F.count("*") > 1).alias("often"))
    kept = cut(kept.join(often, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_digest") == F.col("digest"))).select("k_id", "k_digest", "often"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.md5(text_or_empty().cast("binary")) == F.col("k_digest"))
    found = docs.join(kept, same)
    return found.where("NOT often").select(*columns).unionByName(found.where("often").dropDuplicates(["k_id", "k_digest"]).select(*columns))
