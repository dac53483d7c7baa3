import re

from tallyframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def test_base_counts_match_brute_force(spark):
    long_repeat = " ".join(f"w{i % 300}" for i in range(5000))
    mixed = " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"w{i}" for i in range(100)) + " é\x85 x 𝒳"
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "a a a a a", long_repeat, mixed, "x\n\nx\ny\n x\nx", "a # b|c <d>\x0b\x0c\r$%&*", "ab c ab c ab c"]
    rows = [(i, t, l) for i, t in enumerate(texts) for l in ("en", None)] + [(None, "a b c", "xx"), (3, "a", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, m int")
    got = quality.assess(docs).collect()
    key = lambda t: tuple((v is None, v) for v in t)
    want = sorted(((i, *brute(t).values()) for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(1)
    made = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("tion", "ing", "ly", "ble", "ent", "ou")]
    common = quality.COMMON["en"].split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(made) for _ in range(n)) + "."

    clean = [prose(rng.randrange(60, 400)) for _ in range(60)]
    junk = [prose(200).upper().replace(" ", "!! ") for _ in range(5)] + [prose(200).replace(" ", "%%% ") for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.assess(docs).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 70))
    more = docs.selectExpr("*", "doc_id AS m", "'x' AS kept", "1 AS ref_lang")
    stay = quality.kept(more).collect()
    assert sorted(r.doc_id for r in stay) == list(range(60)) and all(r.m == r.doc_id and r.kept == "x" for r in stay)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.assess(docs).collect() == [] and quality.kept(docs).collect() == []
