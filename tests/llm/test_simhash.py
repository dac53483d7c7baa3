import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            label[root(i)] = root(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(fps))]


@given(st.text(alphabet="aB é\n\t x", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_every_pair_within_two_bits_meets_at_a_home():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 3, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    row, key = simhash.replicas(x)
    home = {int(r): int(k) for r, k in zip(row, key, strict=True) if not k & 1}
    assert len(home) == len(x)
    row, key = simhash.replicas(y)
    there = [set() for _ in y]
    for r, k in zip(row, key, strict=True):
        there[r].add(int(k) >> 1)
    assert all(home[i] >> 1 in there[i] for i in range(len(x)))


def test_large_anchors_are_answered_by_probing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(20_000)], np.uint64))
    few = fps[:50]
    a, b = simhash.links(few, fps)  # over the limit of pairwise comparison
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    want_nodes = {int(v) for h in few for v in fps if v < h and (int(h) ^ int(v)).bit_count() <= 2}
    linked = set(got) | set(got.values())
    assert want_nodes <= linked


def test_components_of_a_table(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [words[i] for i in rng.integers(0, 400, 120)]
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.integers(0, len(t))] = "zz"
            rows.append((g * 10 + k, " ".join(t), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " \n\t", None), (None, "a b", "x"), (503, "a b", "x"), (503, "a b", "x"), (504, "q " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t or "") for _, t, _ in rows]
    want = brute_components(fps, [r[0] for r in rows])
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=key) == sorted(zip([r[0] for r in rows], fps, want, strict=True), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
