import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import lattice
from tallyframe.llm.q_lattice import pieces as _pieces

PIECES = _pieces()


@pytest.fixture(scope="module")
def model():
    return lattice.Lattice(*lattice.vocabulary(PIECES))


def all_ways(model, word):
    """P(word) by listing every segmentation."""
    s = lattice.SPACE + word

    def ways(i):
        if i == len(s):
            return [[]]
        out = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in model.by_text:
                out += [[model.by_text[s[i:j]], *w] for w in ways(j)]
            elif j == i + 1:
                out += [[*model.byte_ids(s[i]), *w] for w in ways(j)]
        return out

    return ways(0)


def test_forward_equals_the_sum_over_all_segmentations(model):
    words = ["the", "thing", "and,", "été", "ß!x", "日本\x07", "a", "ening", "𝒳y", "x" * 12]
    got = model.log_prob(words)
    for w, g in zip(words, got, strict=True):
        p = sum(math.exp(sum(model.logp[k] for k in way)) for way in all_ways(model, w))
        assert math.isclose(g, math.log(p), rel_tol=1e-9) and math.isclose(model.one(w), g, rel_tol=1e-9)
    long = "abc" * 500
    assert math.isclose(model.log_prob([long])[0], model.one(long), rel_tol=1e-9)


def test_expected_counts_equal_brute_force(model):
    words, counts = ["the", "ening", "été", "日\x07"], np.array([3.0, 1, 2, 5])
    want = np.zeros(model.n + 257)
    for w, c in zip(words, counts, strict=True):
        ways = all_ways(model, w)
        p = np.array([math.exp(sum(model.logp[k] for k in way)) for way in ways])
        for way, x in zip(ways, p / p.sum(), strict=True):
            for k in way:
                want[k] += c * x
    assert np.allclose(model.expected(words, counts), want)


def test_expected_counts_of_long_words_are_those_of_the_whole_word(model, monkeypatch):
    words, counts = ["https://example.org/" + "thing/été?id=日x&" * 20, "x" * 201, "abc" * 150], np.array([3.0, 1, 2])
    got = model.expected(words, counts)
    for block in (7, 100, 203):
        monkeypatch.setattr(lattice, "BLOCK", block, raising=False)
        assert np.allclose(model.expected(words, counts), got, rtol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 1000)  # all at once
    assert np.allclose(got, model.expected(words, counts), rtol=1e-9)
    space = sum(got[i] for i, p in enumerate(model.pieces) if p.startswith(lattice.SPACE))
    mark = got[model.byte_ids(lattice.SPACE)[0]] if lattice.SPACE not in model.by_text else 0
    assert math.isclose(space + mark, counts.sum(), rel_tol=1e-9)  # one space mark a word


def test_scores_of_a_table(spark):
    base = [None, "", "The thing and the thing", "a b c THE", "été ening", "unseen wörds here", "x" * 1000, "the the the"]
    rows = [(i, base[i % len(base)] if i < 40 else f"the w{i} and w{i}", 1) for i in range(80)] + [(3, "a b c THE", 1), (None, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int")
    low = lambda t: bytes(t or "", "utf-8").lower().split()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(w for d, t, _ in rows if not held(d) for w in [*low(t), "end"])
    n, v = sum(c.values()), len(c)
    for head in (3, 1 << 17):
        got = lattice.score(docs, PIECES, head=head).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        want = [(d, held(d), len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), "end"]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*low(t), "end"])) for d, t, _ in rows]
        for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert tuple(g)[:5] == w[:5] and math.isclose(g.base_score, w[5], rel_tol=1e-9) and g.score < 0
    assert lattice.score(docs.limit(0), PIECES).collect() == []


def test_fitting_raises_the_likelihood(spark):
    words = spark.createDataFrame([(b"thening", 50), (b"the", 100), (b"ingthe", 20)], "word binary, c long")
    pieces, first = lattice.vocabulary(PIECES)
    total = lambda prob: sum(c * lattice.Lattice(pieces, prob).one(w) for w, c in (("thening", 50), ("the", 100), ("ingthe", 20)))
    one, three = (lattice.fit(words, PIECES, 10, r)[1] for r in (1, 3))
    assert total(first) < total(one) <= total(three) and abs(three.sum() - 1) < 1e-9
