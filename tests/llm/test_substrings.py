import hashlib
from collections import Counter

import numpy as np

from tallyframe.llm import substrings

K = substrings.LENGTH


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + K] for b in raw for p in range(len(b) - K + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - K + 1):
            if seen[b[p : p + K]] > 1:
                gone[p : p + K] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return "".join(rng.choice(list("abcdefghij klmnop é"), n))


def corpus():
    rng = np.random.default_rng(4)
    passage, other = prose(rng, 700), prose(rng, 401)
    near = prose(rng, 3000)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "x" * 3000, "ab" * 700, "Wher. " * 300, prose(rng, 5000), passage, passage[:399], passage[1:], passage[300:], other[:400], other[1:], near, near, near[:1500] + "Q" + near[1501:], near[:700] + near[900:], prose(rng, 300) + passage + prose(rng, 300) + passage + passage]
    texts += [prose(rng, 200 + 7 * i) + passage[i : i + 420] + prose(rng, 150) for i in range(30)]
    texts += [near[i * 90 : i * 90 + 600] + str(i) for i in range(25)]
    return texts


def test_equal_strings_have_equal_triggers():
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 110, K, np.uint8)
    a = np.concatenate([rng.integers(97, 110, 1000, np.uint8), piece, rng.integers(97, 110, 333, np.uint8)])
    b = np.concatenate([rng.integers(97, 110, 77, np.uint8), piece])
    assert substrings.triggers(a)[1000] - 1000 == substrings.triggers(b)[77] - 77 < substrings.SPREAD


def test_families_cover_each_string_once_even_in_parts(monkeypatch):
    texts = [prose(np.random.default_rng(6), 9000).encode(), b"z" * 5000, b"short"]
    for size in (1 << 21, 1500):
        monkeypatch.setattr(substrings, "_TOGETHER", size)
        found = substrings.families(texts)
        number, x, y, t = (c[found[2] >= found[1]] for c in found[:4])
        for i, text in enumerate(texts):
            starts = [p for a, b in zip(x[number == i], y[number == i], strict=True) for p in range(a, b + 1)]
            assert sorted(starts) == list(range(max(0, len(text) - K + 1)))
        assert ((t >= y) & (t - x < substrings.SPREAD)).all()


def test_removal_matches_brute_force(spark):
    texts = corpus()
    rows = [(i, t, b"") for i, t in enumerate(texts)] + [(9, texts[8], b""), (None, texts[8][:900], b"")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, content binary")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [r[:-1] for r in got]
    want = [(d, *w) for (d, _, _), w in zip(rows, brute([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_of_a_suffix_array_over_many_partitions(spark):
    rng = np.random.default_rng(8)
    keys = [bytes(rng.integers(97, 99, n, np.uint8)) for n in rng.integers(3, 40, 900).tolist()] + [b"a" * n for n in range(20, 60)] + [b"b" * 30] * 3
    table = spark.createDataFrame([(k,) for k in keys], "key binary")
    base = 10
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = {bytes(r.key): r.runs for r in substrings.suffix_runs(table, base).collect()}
            for n in range(base, 60):
                classes, numbers = {}, {}
                for k in keys:
                    classes.setdefault(k[:n], []).append(k) if len(k) >= n else None
                for prefix, members in classes.items():
                    listed = {got.get(m, [])[n - base] if len(got.get(m, [])) > n - base else None for m in members}
                    assert len(members) < 2 or len(listed) == 1 and None not in listed
                    for number in listed - {None}:
                        assert numbers.setdefault(number, prefix) == prefix
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_passages_are_counted_across_documents_only(spark):
    rng = np.random.default_rng(9)
    passage = prose(rng, 300)
    texts = [prose(rng, 700), prose(rng, 50) + passage + prose(rng, 60), passage + prose(rng, 900), "ab" * 700, prose(rng, 200) + passage[:200], passage.encode()[: substrings.SHARED].decode(errors="ignore"), None]
    got = {r.doc_id: r.n_shared for r in substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[3] == got[6] == 0 and got[1] > 0 and got[2] > 0
    brute = lambda a, b: any(a[i : i + substrings.CORE] in b for i in range(len(a) - substrings.CORE + 1))
    raw = [(t or "").encode() for t in texts]
    assert all(not got[i] or any(brute(raw[i], b) for j, b in enumerate(raw) if i != j) for i in range(len(raw)))
