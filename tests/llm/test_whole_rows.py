"""Whole rows of queries: against their SQL, over the smallest tables and over a hostile one, and against
plain Python where SQL cannot say it."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tallyframe.llm import chat, lattice, packing, pii, queries
from tallyframe.llm.q_lattice import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    """Null, empty and very long texts, ties, repeated rows, null ids and sources, columns that clash."""
    folder = tmp_path_factory.mktemp("hostile")
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the of and lorem ipsum dolor été straße 1.2.3.4 a@b.io CAPS! # q".split()) for _ in range(n))
    passage, near = prose(90), prose(160)
    texts = [None, "", " \t\n", "one", "two words", "a\x1cb \x0b c", prose(3000) + "\n" + prose(1500), passage, passage, "x " + passage + " y", passage[30:] + prose(20), near, near + " end", near.replace("lorem", "Lorem", 1), near.replace("ipsum", "zz", 1), "ab" * 900, "é" * 450, "line\n" * 80]
    texts += [prose(rng.randint(40, 200)) for _ in range(25)] + [prose(40) + "\n" + passage for _ in range(6)]
    rows = [(i, t, ("en", "de", "fr", None, "xx", "Not a code")[i % 6], ("s1", "é", None, "s1", "z")[i % 5], 0, i, "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[20], (None, passage, "en", "s1", 0, 1, "k"), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, row string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    turns = [(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", "tie <|im_end|>", 1), (1, 1, "assistant", "tie <|im_end|>", 1), (2, 3, "assistant", "<\\|x" * 5, 1), (None, None, None, "é", 1), (2, None, "user", "", 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chars int").coalesce(1).write.parquet(str(folder / "conversations.parquet"))
    pages = [(1, "u", None, 1), (2, None, " ", 1), (None, "v", "<body><nav><a href=1>x</a></nav><article><h1>A &amp;lt; b</h1><p>x <br> <b>y</b>&#39;\n z</p></article>", 1), (3, "w", "<article><p>" + "long, " * 50_000 + "</p></article>", 1)]
    spark.createDataFrame([*pages, pages[2]], "page_id long, url string, html string, text int").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v


@pytest.mark.parametrize("where", ["plain", "hostile"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, hostile, name, where):
    folder = SF if where == "plain" else hostile
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if where == 'hostile' else ''}')")
    columns = sorted(x[0] for x in con.execute(f"DESCRIBE {queries.ORACLE_SQL[name]}").fetchall())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]}) q").fetchall()
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str) == sorted((tuple(map(plain, r)) for r in want), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_the_other_queries_give_a_row_for_each_hostile_document(spark, hostile, name):
    got = queries.QUERIES[name](spark, hostile)
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    if "piece" in got.columns:
        got = got.where("piece = 0")
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": r"[A-Za-z0-9_-]{24,}",
}


def brute_spans(text):
    """(start, kind, end, base, key) of all candidates, by plain patterns and slices of the text."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        end = None
        for m in re.finditer(pattern, text):
            v, digits = m[0], re.sub("[^0-9]", "", m[0])
            if kind == "card" and len(digits) < 12:
                continue
            total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits))))
            ok = {"email": True, "ip": all(int(x) < 256 for x in v.split(".")) if kind == "ip" else False, "card": len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15,
                  "secret": len(digits) >= 4 and len(re.sub("[^A-Za-z]", "", v)) >= 4}[kind]
            before = text[max(0 if end is None else end - 1, m.start() - 24) : m.start()]
            after = text[m.end() : m.end() + 1]
            bounded = not (before and before[-1].isalnum()) and not after[:1].isalnum()
            key = f"{k}{'+' if ok else '-'}{'+' if re.search(pii._GAZETTEER[kind], v, re.A) else '-'}{'+' if re.search(pii._CUES[kind].replace(r"\z", r"\Z"), before, re.A) else '0'}{'+' if bounded else '-'}{sum(len(v) > n for n in pii._LENGTHS)}"
            out.append((m.start(), k, m.end(), ok and kind != "secret", key))
            end = m.end()
    return out


def test_all_spans_equal_plain_patterns_and_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: brute_spans(r.text or "") for r in docs.collect()}
    counts = Counter(key for spans in found.values() for *_, key in spans)
    w = pii.classifier(counts)
    yes = {k for k in counts if sum(w[i] for i in pii._features(k)) > 0}
    listed = lambda spans, kept: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, base, key in sorted(spans) if kept(base, key))
    for r in queries.QUERIES["op1_pii"](spark, SF).collect():
        spans = found[r.doc_id]
        assert r.spans == listed(spans, lambda base, key: base or key in yes)
        assert r.base_sha256 == hashlib.sha256(listed(spans, lambda base, _: base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i and base for _, k, _, base, _ in spans) for i in range(4))
        assert r.n_spans == (r.spans.count(",") + 1 if r.spans else 0)


def test_scores_equal_the_plain_recursion(spark, hostile):
    docs = spark.read.parquet(f"{hostile}/documents.parquet").select("doc_id", "text")
    rows = lattice.score(docs, pieces()).collect()
    train = Counter(w for d, t in docs.collect() if not _held(d) for w in (t or "").encode().lower().split())
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in train.items()], "word binary, c long")
    found, prob = lattice.fit(counts, pieces(), sum(not _held(d) for d, _ in docs.collect()))
    model = lattice.Lattice(found, prob)
    one = {}
    want = []
    for d, t in docs.collect():
        words = [w.decode("utf-8", "replace") for w in (t or "").encode().lower().split()]
        for w in set(words) - set(one):
            one[w] = model.one(w)
        want.append((str(d), sum(one[w] for w in words) / math.log(10) + math.log10(prob[-1])))
    for (d, s), (e, x) in zip(sorted((str(r.doc_id), r.score) for r in rows), sorted(want), strict=True):
        assert d == e and math.isclose(s, x, rel_tol=1e-8)


def _held(doc_id):
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def test_a_very_long_turn_is_read_back(spark):
    text = "<|im_end|>é<\\|" * 300_000 + "<"
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = chat.formatted(turns).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_turns == 3
    assert r.turns_sha256 == hashlib.sha256(f"user\nq\nassistant\n{text}\nassistant\n\n".encode()).hexdigest()


def least_bins(sizes, room):
    """The least number of bins, by trying all ways."""
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= room and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


def test_plans_are_near_the_least():
    rng = random.Random(8)
    used = lambda ranges: len({first + i for _, lo, hi, first, _ in ranges for i in range(hi - lo)})
    over = 0
    for _ in range(60):
        sizes = sorted((rng.randint(3, 30) for _ in range(rng.randint(1, 11))), reverse=True)
        over += used(packing.plan(dict(Counter(sizes)), 32, groups=6)) - least_bins(sizes, 32)
    assert over <= 3
    for shape in (lambda: int(rng.lognormvariate(5.6, 1.1)) + 1, lambda: rng.randint(1, 2047), lambda: rng.choice((700, 690, 650, 40, 9))):
        sizes = [min(2047, shape()) for _ in range(20_000)]
        bound = -(-sum(sizes) // 2048)
        assert used(packing.plan(dict(Counter(sizes)))) <= bound * 1.04 + 2


def test_brute_helpers():
    assert least_bins([6, 5, 5, 4, 4, 4, 2], 10) == 3 and list(itertools.islice(brute_spans("a@b.io"), 1))[0][:3] == (0, 0, 6)
