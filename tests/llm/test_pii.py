import hashlib
import random
import re
import time

from tallyframe.llm import pii
from tallyframe.llm.q_pii import _listed
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


TEXTS = [
    None, "", "mail a.b+c@d-e.fr, x@y.z%q@w.v.u; @a.b a@b@c.d a@b. a@b.c.", "é𝒳 1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1.2.3 999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 123456789012345678901234567890", "+1 (921) 555-8394 +12 +1234567890123456 ++49 30 1234567 +4-",
    "token = \"9f14ac8514dfe98aba92898d323168b34b1f9a7d\" end", "a." * 3000 + "@" + "b." * 3000 + "c", "1" * 30_000 + " " + "1 " * 20_000 + "1." * 10_000, "x%" * 5000 + "y@z.com",
    " ".join(f"{i}.1.1.1" for i in range(700)), "5500-0000-0000-0004+1 (921) 555-8394", "a_b@c.d_e@f.g",
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], 1), (2, TEXTS[2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = pii.find(docs).select("doc_id", F.filter("found", lambda x: x["base"]).alias("b"), _listed(F.col("found")).alias("l")).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(((r.doc_id, [(x.s, x.k, x.e) for x in r.b]) for r in got), key=key) == sorted(((i, brute(t)) for i, t, _ in rows), key=key)
    assert next(r.l for r in got if r.doc_id == 6) == "secret:9:49"
    assert hashlib.sha256(b"").hexdigest()  # the digest of no spans


def test_expectation_maximisation_recovers_reliable_labelers():
    counts = {}
    for true in (0, 1):
        for shape in (0, 1):
            for gaz in (0, 1):
                for cue in (0, 1):
                    for edge in (0, 1):
                        p = 1.0
                        for v, acc in ((shape, 0.95), (gaz, 0.8), (edge, 0.7)):
                            p *= acc if v == true else 1 - acc
                        p *= (0.6 if cue else 0.4) if true else (0.02 if cue else 0.98)
                        key = "4" + "-+"[shape] + "-+"[gaz] + "0+"[cue] + "-+"[edge] + "2"
                        counts[key] = counts.get(key, 0) + round(10_000 * p)
    post, rates = pii.reliabilities(counts)
    assert rates[0][0] > 0.85 and rates[0][1] < 0.2 and post["4++++2"] > 0.95 and post["4--0-2"] < 0.05
    w = pii.classifier(counts)
    assert sum(w[i] for i in pii._features("4++++2")) > 0 > sum(w[i] for i in pii._features("4--0-2"))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.com and 1.2.3.4!", 5), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert got == {1: "é <email> and <ip>!", 2: None, 3: "clean"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(docs).collect() == [] and pii.redacted(docs).collect() == []


def _brute_replaced(text, spans):
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{pii.KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_replacing_spans_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for n in (0, 1, 5, 40, 700, 9000, 30_000):
        text = "".join(rng.choice("ab é😀\n") for _ in range(n))
        for m in (0, 1, 3, 600):
            spans = []
            for _ in range(m if n else 0):
                s = rng.randrange(n)
                spans.append((s, rng.randrange(5), min(n, s + rng.choice((1, 2, 9, 60, 5000)))))
            rows.append((text, sorted(spans)))
    frame = spark.createDataFrame([(t, [(s, k, e, True) for s, k, e in x]) for t, x in rows], "t string, f array<struct<s:int,k:int,e:int,base:boolean>>")
    got = [r.r for r in frame.select(pii._replaced(F.col("t"), F.col("f")).alias("r")).collect()]
    assert got == [_brute_replaced(t, x) for t, x in rows]


def test_a_long_text_with_many_spans_takes_seconds(spark):
    text = "".join(f"Write to user{i}@mail{i % 97}.example.org or call +49 30 {1_000_000 + i} " + "lorem ipsum " * 4 for i in range(25_000))
    docs = spark.createDataFrame([(1, text, "a"), (None, None, "b"), (2, "", "c")], "doc_id long, text string, c string")
    began = time.monotonic()
    rows = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert time.monotonic() - began < 60
    assert rows[1].text.count("<email>") == rows[1].text.count("<phone>") == 25_000 and "@" not in rows[1].text
    assert rows[None].text is None and rows[2].text == "" and [rows[i].c for i in (1, None, 2)] == ["a", "b", "c"]
    found = pii.find(docs).where("doc_id = 1").first().found
    assert len(found) == 50_000 and all(text[x.s : x.e].startswith("user" if x.k == 0 else "+49") for x in found)
