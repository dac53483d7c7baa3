"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from patterns.  Labelers vote on each (-1, 0, 1): its shape (regular expression
and checksums), a gazetteer, cue words before it, and how it is bounded.  Votes are counted by pattern
over the whole corpus - a table of at most 5 kinds * 3^4 votes * 4 lengths - and from that table
expectation-maximisation estimates the labelers' reliabilities, and a logistic span classifier is
trained on the posterior labels.  Base spans always stay; the classifier adds spans of any kind.

Patterns are linear: they start only at the head of a run and use possessive quantifiers, which Java
runs as loops, so digit runs or dotted names of any length neither backtrack nor overflow the stack.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, let, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns, rewritten without backtracking, and the fifth kind's.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
# Gazetteers and cue words by kind.
_GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|dev|de|fr|es|uk|eu|ch|at|it|nl|us|ca)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:3[4-9]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[0-9a-f]+|[0-9A-F]+|(?:sk|pk|ghp|gho|xox[bp]|AKIA|eyJ)[A-Za-z0-9_-]+)$",
}
_CUES = {
    "email": r"(?i)(?:e-?mail|contact|write to|mailto)\W{0,4}\z",
    "ip": r"(?i)(?:\bip|address|host|server|client)\W{0,4}\z",
    "card": r"(?i)(?:card|visa|mastercard|credit|payment|pan)\W{0,4}\z",
    "phone": r"(?i)(?:phone|tel|telephone|call|fax|mobile)\W{0,4}\z",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|api_?key|key|bearer)\W{0,5}\z",
}
_BEFORE = 24
#: Lengths of an added span up to which it falls in buckets 0, 1, 2; longer ones in 3.
_LENGTHS = (16, 32, 64)
_BLOCK, _CHUNK = 256, 4096


def _before(n: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array, all elements before it put together by plus, from 0 on; in
    blocks, so that no long array is copied for each element."""
    zero = F.lit(0)

    def running(x: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(x, start, lambda a, v: F.struct(plus(a["sum"], v).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))["all"]

    def spread(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, plus))
        return let(running(sums), lambda s: F.flatten(F.transform(blocks, lambda b, i: let(F.get(s, i), lambda o: F.transform(running(b), lambda v: plus(v, o))))))

    blocks = F.transform(F.sequence(zero, F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda i: F.slice(n, i * _BLOCK + 1, _BLOCK))
    return F.when(F.size(n) == 0, n).otherwise(let(blocks, spread))


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, v, before, after>>: the matches of a pattern that is never empty, with code point
    offsets.  before is what lies between the match before and this one, with that match's last
    character, at most _BEFORE; after is the next character.  All are taken from the parts that the
    matches divide the text into, so no part is walked more than once."""
    nothing = F.lit("")

    def located(values: Column) -> Column:
        def at(gaps: Column) -> Column:
            def match(v: Column, i: Column, b: Column) -> Column:
                last = F.coalesce(F.right(F.get(values, i - 1), F.lit(1)), nothing)
                after = F.get(gaps, i + 1)
                return F.struct((F.get(b, i) + F.length(F.get(gaps, i))).alias("s"), v.alias("v"), F.right(F.concat(last, F.get(gaps, i)), F.lit(_BEFORE)).alias("before"),
                                F.when(after != "", F.substring(after, 1, 1)).otherwise(F.coalesce(F.substring(F.get(values, i + 1), 1, 1), nothing)).alias("after"))

            both = F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))
            return let(_before(both, lambda a, v: a + v), lambda b: F.transform(values, lambda v, i: match(v, i, b)))

        return let(F.split(text, pattern, -1), at)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _luhn(v: Column) -> Column:
    def total(d: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: let(F.substr(d, F.length(d) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    n = lambda d: F.length(d).between(12, 19)
    return let(_digits(v), lambda d: F.when(n(d), total(d)).otherwise(F.lit(False)))


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return (F.length(_digits(v)) >= 4) & (F.length(F.regexp_replace(v, "[^A-Za-z]+", "")) >= 4)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """array<struct<s, e, k, base, key>>: start, end, kind's number, whether a base span, and the
    votes and length bucket as text."""
    gate = {
        "email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}"), "secret": F.lit(True),
    }
    none = "array<struct<s:int,e:int,k:int,base:boolean,key:string>>"

    def judged(kind: str, x: Column) -> Column:
        v, s = x["v"], x["s"]
        e = s + F.length(v)
        yes = lambda c: F.when(c, F.lit("+")).otherwise(F.lit("-"))
        before, after = x["before"], x["after"]
        length = F.lit("0")
        for i, most in enumerate(_LENGTHS):
            length = F.when(F.length(v) > most, F.lit(str(i + 1))).otherwise(length)
        edges = yes(~before.rlike(r"[\p{L}\p{N}]\z") & ~after.rlike(r"^[\p{L}\p{N}]"))

        def made(ok: Column) -> Column:
            key = F.concat(F.lit(str(KINDS.index(kind))), yes(ok), yes(v.rlike(_GAZETTEER[kind])), F.when(before.rlike(_CUES[kind]), F.lit("+")).otherwise(F.lit("0")), edges, length)
            return F.struct(s.alias("s"), e.alias("e"), F.lit(KINDS.index(kind)).alias("k"), (ok & (kind != "secret")).alias("base"), key.alias("key"))

        return let(_valid(kind, v), made)

    patterns = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE, _SECRET), strict=True))
    each = lambda kind: lambda x: judged(kind, x)
    return F.concat(*[F.when(gate[k], F.transform(_found(text, p), each(k))).otherwise(F.array().cast(none)) for k, p in patterns.items()])


def _vote(key: str) -> tuple[int, tuple[int, ...], int]:
    return int(key[0]), tuple({"+": 1, "-": -1, "0": 0}[c] for c in key[1:5]), int(key[5])


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Expectation-maximisation over counted votes: the posterior of each key, and each labeler's
    chance to vote + on true and on false spans."""
    keys = sorted(counts)
    post = {k: min(0.95, max(0.05, 0.5 + 0.2 * sum(_vote(k)[1]))) for k in keys}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        rates, prior = [], {}
        for j in range(4):
            hit, of = [1.0, 1.0], [2.0, 2.0]
            for k in keys:
                if v := _vote(k)[1][j]:
                    for side, p in enumerate((post[k], 1 - post[k])):
                        of[side] += counts[k] * p
                        hit[side] += counts[k] * p * (v > 0)
            rates.append((min(0.99, hit[0] / of[0]), max(0.01, min(0.99, hit[1] / of[1]))))
        for kind in range(len(KINDS)):
            mine = [k for k in keys if _vote(k)[0] == kind]
            prior[kind] = (1 + sum(counts[k] * post[k] for k in mine)) / (2 + sum(counts[k] for k in mine))
        for k in keys:
            kind, votes, _ = _vote(k)
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for v, (a, b) in zip(votes, rates, strict=True):
                odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b)) if v < 0 else 0.0
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def _features(key: str) -> list[int]:
    kind, votes, length = _vote(key)
    return [kind, *[5 + 3 * j + v + 1 for j, v in enumerate(votes)], 17 + length]


def classifier(counts: dict[str, int], rounds: int = 400) -> list[float]:
    """Logistic weights of 5 kinds, 4 votes of 3 values, 4 lengths, fitted to the posterior labels.
    Counts enter by their logarithm, so that a frequent pattern doesn't silence the rare ones."""
    post, _ = reliabilities(counts)
    w = [0.0] * 21
    for _ in range(rounds):
        slope: dict[int, float] = defaultdict(float)
        total = 1e-9
        for k in sorted(counts):
            weight = math.log1p(counts[k])
            p = 1 / (1 + math.exp(-sum(w[i] for i in _features(k))))
            total += weight
            for i in _features(k):
                slope[i] += weight * (post[k] - p)
        w = [x * 0.999 + 2.0 * slope[i] / total for i, x in enumerate(w)]
    return w


def accepted(found: DataFrame) -> list[str]:
    """found: a column c of candidates() -> the keys whose spans the classifier accepts."""
    rows: list[Row] = found.select(F.explode("c").alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.count("*").alias("n")).collect()
    counts = {r.key: r.n for r in rows}
    w = classifier(counts)
    return sorted(k for k in counts if sum(w[i] for i in _features(k)) > 0)


def _kept(c: Column, keys: list[str]) -> Column:
    listed = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return F.array_sort(F.transform(F.filter(c, lambda x: x["base"] | F.array_contains(listed, x["key"])), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): found is an array<struct<s, k, e, base>> by start and kind, one row for each
    input row.  Null texts count as empty; repeated rows get equal results; an empty table gives an
    empty result; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), let(text_or_empty(text_col), candidates).alias("c"))
    rows = cut(rows)
    return rows.select("doc_id", _kept(F.col("c"), accepted(rows)).alias("found"))


def _slices(text: Column, bounds: Column) -> Column:
    """array<string>: the parts (a, b) of the text, by code points.  The text is cut into chunks once, so
    that a part is reached without walking to it."""

    def part(chunks: Column, x: Column) -> Column:
        first, last = F.floor(x["a"] / _CHUNK).cast("int"), F.floor((x["b"] - 1) / _CHUNK).cast("int")
        head = F.get(chunks, first)
        across = F.concat(F.substr(head, x["a"] - first * _CHUNK + 1), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(F.get(chunks, last), F.lit(1), x["b"] - last * _CHUNK))
        return F.when(x["b"] <= x["a"], "").when(first == last, F.substr(head, x["a"] - first * _CHUNK + 1, x["b"] - x["a"])).otherwise(across)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), lambda chunks: F.transform(bounds, lambda x: part(chunks, x)))


def _replaced(text: Column, found: Column) -> Column:
    """The text with found spans replaced by their kinds; of overlapping spans the first stands for all."""

    def cuts(ends: Column) -> Column:
        each = F.transform(found, lambda x, i: F.struct(F.get(ends, i).alias("a"), x["s"].alias("b"), x["k"].alias("k")))
        tail = F.struct(F.array_max(F.transform(found, lambda x: x["e"])).alias("a"), F.length(text).alias("b"), F.lit(None).cast("int").alias("k"))
        return F.concat(F.filter(each, lambda c: c["b"] >= c["a"]), F.array(tail))

    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: let(_slices(text, c), lambda parts: F.array_join(F.zip_with(parts, c, lambda p, x: F.concat(p, F.coalesce(F.concat(F.lit("<"), F.get(names, x["k"]), F.lit(">")), F.lit("")))), ""))
    ends = _before(F.transform(found, lambda x: x["e"]), lambda a, v: F.greatest(a, v))
    return F.when(F.size(found) == 0, text).otherwise(let(ends, lambda e: let(cuts(e), joined)))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in angle brackets, in the columns that docs has.

    Null texts stay null.  Of overlapping spans the first stands for the union.  Repeated rows change
    alike, and an empty table stays empty.  Candidates are found once: a copy of the rows is written with
    them, from which the classifier is trained and the texts are changed."""
    found = let(text_or_empty(text_col), candidates)
    rows = cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), found.alias("c")))
    row, keys = F.col("row"), accepted(rows)
    new = let(F.coalesce(row.getField(text_col), F.lit("")), lambda t: let(_kept(F.col("c"), keys), lambda found: _replaced(t, found)))
    changed = F.when(row.getField(text_col).isNotNull(), new)
    return rows.select(*[(changed if c == text_col else row.getField(c)).alias(c) for c in docs.columns])
