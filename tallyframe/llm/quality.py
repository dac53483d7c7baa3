"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram over character classes and its histogram over its language's most common
words are compared with the language's own, by Jensen-Shannon distance (the root of the divergence
in bits).  The references are counts over all documents of the language that pass the base rules and
are not plainly shouted or strewn with symbols.
Histograms of few characters or words are noise, so each comparison has a least length below which
it does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, cut, let, text_or_empty

# Frequent function words of the four languages, and the character classes.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf",
    "en": "the of and to in is it that for on was with",
    "es": "de la que el en y los se del las un por",
    "fr": "de la le et les des en un du une que est",
}
#: In this order each class takes what those before it have left; what remains is the last class.
#: Digits count as lower-case letters: numbers and tokens say nothing about the prose around them.
CLASSES = (r"[\p{Ll}\p{Nd}]+", r"\p{Lu}+", BLANK + "+", r"[#*$%&|<>]+", r"[!?]+", r"[.,;:'\x22()-]+")
UPPER, BLANKS, SYMBOLS, LOUD = 1, 2, 3, 4
#: Documents with more symbols, or with more of their letters upper-case, don't enter the references.
MAX_ODD, MAX_UPPER = 0.02, 0.2
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: Greatest distances that are kept, and least lengths for a comparison.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.15, 0.28
MIN_CHARS_COMPARED, MIN_WORDS_COMPARED = 200, 100
#: Language codes, what stands for all else, and the least characters of a reference.
CODE, OTHER, MIN_REFERENCE = "^[a-z]{2,3}$", "other", 10_000
#: Up to so many repeated windows are looked up by a scan; more are all sorted.
_FEW = 64


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+", -1))


def class_counts(text: Column) -> Column:
    """array<long>: code points of the text in each class."""

    def rest(left: Column, counts: list[Column], todo: tuple[str, ...]) -> Column:
        if not todo:
            return F.array(*[c.cast("long") for c in [*counts, F.length(left)]])
        return let(F.regexp_replace(left, todo[0], ""), lambda r: rest(r, [*counts, F.length(left) - F.length(r)], todo[1:]))

    return let(text, lambda t: rest(t, [], CLASSES))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array w.

    Hashes of the windows are sorted as plain longs; windows whose hash recurs are the candidates,
    and only those are compared as text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def recurring(cand: Column) -> Column:
        hit = F.filter(cand, lambda x, j: F.coalesce(F.when(j > 0, F.get(cand, j - 1)["g"] == x["g"]), F.lit(False)) | F.coalesce(F.get(cand, j + 1)["g"] == x["g"], F.lit(False)))
        return let(F.array_sort(F.transform(hit, lambda x: x["i"])), covered)

    def exact(w: Column, h: Column, twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        cand = F.when(F.size(twice) <= _FEW, F.filter(at, lambda x: F.array_contains(twice, x["h"]))).otherwise(at)
        text = F.transform(cand, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["i"] + 1, 3)).alias("g"), x["i"].alias("i")))
        return let(F.sort_array(text), recurring)

    def hashed(w: Column) -> Column:
        h = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda h: let(F.sort_array(h), lambda s: let(F.array_distinct(F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1) == x, F.lit(False)))),
                                                                  lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(exact(w, h, t)))))

    return hashed(w)


def common_counts(w: Column, lang: Column) -> Column:
    """array<long>: occurrences of each of the language's common words, then of all others."""
    none = F.array().cast("array<string>")
    mine = none
    for code, listed in COMMON.items():
        mine = F.when(lang == code, F.array(*map(F.lit, listed.split()))).otherwise(mine)

    def counts(m: Column) -> Column:
        return let(F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: F.array_contains(m, x)), lambda c: F.concat(
            F.transform(m, lambda k: F.size(F.filter(c, lambda y: y == k)).cast("long")), F.array((F.size(w) - F.size(c)).cast("long"))))

    return let(mine, counts)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length."""

    def plus(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def share(x: Column, n: Column) -> Column:
        return F.transform(x, lambda v: v / F.greatest(n, F.lit(1.0)))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = lambda a, b: F.zip_with(a, b, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return let(share(p, plus(p)), lambda a: let(share(q, plus(q)), lambda b: F.sqrt(F.greatest(F.lit(0.0), plus(terms(a, b))))))


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with one more column, m: the base counts and both histograms.  To be written before it is
    filtered by, for a filter would compute it anew for each use."""

    def of(text: Column, lang: Column) -> Column:
        return let(text, lambda t: let(words(t), lambda w: let(class_counts(t), lambda c: let(repeated_words(w), lambda r: F.struct(
            lang.alias("lang"), F.size(w).cast("long").alias("n_words"), (F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - c[BLANKS]).alias("word_chars"),
            c[SYMBOLS].alias("n_symbols"), duplicate_lines(t).alias("n_dup_lines"), r.alias("n_repeat_words"),
            ((F.size(w) < MIN_WORDS) | (r > MAX_REPEATED * F.size(w))).alias("base_failed"), c.alias("chars"), common_counts(w, lang).alias("common"))))))

    lang = F.when(F.col(lang_col).rlike(CODE), F.col(lang_col)).otherwise(F.lit(OTHER))
    return docs.withColumn("m", of(text_or_empty(text_col), lang))


def references(rows: DataFrame) -> DataFrame:
    """m.* -> one row for each language code that has enough text: at most 26^2 + 26^3 rows."""
    n = lambda *at: sum((F.get("m.chars", F.lit(i)) for i in at), F.lit(0))
    plain = (n(SYMBOLS, LOUD) <= MAX_ODD * n(*range(len(CLASSES) + 1))) & (n(UPPER) <= MAX_UPPER * n(0, UPPER))
    n_common = max(len(x.split()) for x in COMMON.values()) + 1
    total = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(F.col(c), F.lit(i))), F.lit(0)).cast("long") for i in range(n)])
    return (rows.where(~F.col("m.base_failed") & plain & (F.col("m.lang") != OTHER)).groupBy(F.col("m.lang").alias("ref_lang"))
            .agg(total("m.chars", len(CLASSES) + 1).alias("ref_chars"), F.slice(total("m.common", n_common), F.lit(1), F.max(F.size("m.common"))).alias("ref_common"))
            .where(F.aggregate("ref_chars", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_REFERENCE))


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with m -> the same with char_distance, word_distance (null if not compared) and kept.
    refs is bounded by the number of language codes, 18,252 small rows, so it is broadcast."""
    n_chars = F.aggregate("m.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    out = rows.join(F.broadcast(refs), F.col("m.lang") == F.col("ref_lang"), "left")
    out = out.withColumns({
        "char_distance": F.when(n_chars >= MIN_CHARS_COMPARED, distance(F.col("m.chars"), F.col("ref_chars"))),
        "word_distance": F.when((F.col("m.n_words") >= MIN_WORDS_COMPARED) & (F.size("m.common") > 1), distance(F.col("m.common"), F.col("ref_common"))),
    }).drop("ref_lang", "ref_chars", "ref_common")
    over = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    return out.withColumn("kept", ~F.col("m.base_failed") & ~over("char_distance", MAX_CHAR_DISTANCE) & ~over("word_distance", MAX_WORD_DISTANCE))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept), one row for each input row.

    Null texts have no words and fail.  Languages other than those of COMMON are compared by character
    classes only, each with itself; documents without a code of two or three letters, or of a language
    with under 10,000 characters of plain text, are judged by the base rules alone.  Repeated rows get equal results.  An empty table gives an empty result.  Columns
    other than the three named are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = cut(measured(rows).select("doc_id", "m"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged(rows, references(rows)).select("doc_id", *[f"m.{c}" for c in base], "char_distance", "word_distance", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of documents that assess() keeps, with their columns as they are, whatever their names.

    Null texts go, as they fail; null languages are judged by the base rules alone.  Equal rows are kept
    or go together; an empty table stays empty.  A copy of the rows is written with their measures, so
    that texts are measured once."""
    rows = cut(measured(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), "row.text", "row.lang"))
    return judged(rows, references(rows)).where("kept").select("row.*")
