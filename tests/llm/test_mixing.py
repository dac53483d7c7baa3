import re

from tallyframe.llm import mixing


def brute_targets(size, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ones = {}, share * sum(size.values()), set(names)
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if level * weight[s] > limit * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_ones}
            break
        for s in full:
            target[s] = limit * size[s]
            left -= target[s]
        open_ones -= full
    return target


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    want = brute_targets(size)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=key) == sorted(((d, s, words(t)) for d, t, s in rows), key=key)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.copies <= 2 for r in mine)
        taken, most = sum(r.size * r.copies for r in mine), max(r.size for r in mine)
        assert abs(taken - want[s]) <= most / 2 + 1e-6
        assert {r.copies for r in mine if r.size} <= {int(want[s] // size[s]), int(want[s] // size[s]) + 1} if size[s] else True
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixes_meet_their_targets(spark):
    text = lambda i: " ".join(["w#" if i % 9 == 0 else "word"] * (1 + i * 7 % 90)) + " x\x0b"
    check(spark, [(i, text(i), f"s{i % 4}" if i % 3 else "s0") for i in range(300)])
    check(spark, [(i, text(i), s) for i, s in enumerate([None, "é", "z", "a", "Z"] * 20)] + [(3, text(3), "a"), (3, text(3), "a"), (None, "a b", "a"), (None, None, "only null"), (7, "", None)])
    check(spark, [(1, "one source " * 50, "x")])
    check(spark, [(i, "same text here", "x" if i else "tiny") for i in range(50)])
    check(spark, [(1, "long " * 100_000, "x"), (2, "b", "x"), (3, "c " * 90, "y"), (4, "", "z")])


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
