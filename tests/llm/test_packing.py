import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import packing
from tallyframe.llm.q_packing import tokenizer

TOKENIZER = tokenizer()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_a_plan_places_each_document_once_and_gapless(counts):
    ranges = packing.plan(counts, 64, groups=6)
    placed, bins = Counter(), {}
    ranks = {}
    for n, lo, hi, first, offset in ranges:
        placed[n] += hi - lo
        ranks.setdefault(n, []).extend(range(lo, hi))
        for i in range(hi - lo):
            bins.setdefault(first + i, []).append((offset, n))
    assert placed == Counter(counts)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for found in bins.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 64
    # best fit never needs more than 1.7 times the least, plus one
    assert len(bins) <= 1.7 * -(-sum(n * c for n, c in counts.items()) // 64) + 1


def test_configurations_find_perfect_triples():
    ranges = packing.plan({1024: 300, 700: 100, 674: 200}, groups=8)
    assert len({first + i for _, lo, hi, first, _ in ranges for i in range(hi - lo)}) == 250


@pytest.fixture(scope="module")
def texts():
    return ["", "Hello, world! don't it's X-ray 12,345", "naïve Ünḯ İstanbul ﬁ", "a  b\n\tc d", "Straße ΣΑΣ <|endoftext|> x<|startoftext|>", "wörd " * 3000, "été, 日本語 text。", "'s 't re'll"]


def test_word_by_word_ids_equal_the_tokenizers(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        got = packing.Encoder(TOKENIZER).encode(texts)
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


SEPARATED = ["ab\x1ccd", "\x1c", "a\x1d\x1e b\x1f", "Word,\x1fword. \x1c\n\x85x\u2028y", "é\x1dé", "plain words"]


def test_separators_that_only_python_splits_at_are_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    got = packing.Encoder(TOKENIZER).encode(SEPARATED)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in SEPARATED]
    assert got[0].tolist() == [3937, 472, 4480]


def test_packing_texts_with_separators(spark):
    got = packing.pack(spark.createDataFrame(list(enumerate(SEPARATED)), "doc_id long, text string"), TOKENIZER).collect()
    assert {r.doc_id: r.length for r in got}[0] == 4 and sorted(r.doc_id for r in got) == list(range(len(SEPARATED)))


def test_packing_a_table(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(1, texts[1], 7), (None, None, 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, TOKENIZER).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[(d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []
