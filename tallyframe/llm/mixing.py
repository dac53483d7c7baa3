"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by complete epochs of all its documents and then a fractional selection:
each document draws an exponential key -ln(u) / quality, u from a digest of its id and text, and the
documents with the smallest keys are taken while their running size stays nearest the budget.

Running sums over a source that may hold a third of all rows are not made in one task: sizes are
summed for bins of the key, the one bin that the budget cuts is found from those sums, bins below it
are taken whole, and only the rows of the cut bin are sorted.  Bins are 1,024 steps for each doubling of
the key: whatever the documents' weights are, a bin expects under 1 in 3,900 of a source's documents,
and a source has under 65,536 bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words in the mix, and the most a source may give, as multiples of what there is.
SHARE, LIMIT = 1.5, 2.0
#: Bins for each doubling of the key.
STEPS = 1024


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """Document weight in [0.05, 1]: the share of characters that are not symbols."""
    n = F.length(text)
    odd = n - F.length(F.regexp_replace(text, r"[#*$%&|<>!]+", ""))
    return F.greatest(F.lit(0.05), 1 - odd / F.greatest(n, F.lit(1)))


def keys(doc_id: Column, text: Column) -> Column:
    """The smaller, the earlier a document is taken; a digest, so reruns agree."""
    hex48 = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))), 1, 12)
    u = (F.conv(hex48, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / quality(text)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> the same, target.  Water-filling: target = min(limit * size, level *
    weight) with the level at which the targets add up to the whole budget.  One row for each source
    is all that is sorted here, in one task: meant for up to some ten million sources."""
    by_source, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    up = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    to_here = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({
        "budget": share * F.sum("source_size").over(whole),
        "full": F.coalesce(F.sum("most").over(to_here), F.lit(0.0)),
        "open_weight": F.sum("weight").over(whole) - F.sum("weight").over(to_here),
    })
    # With the sources up to this one full, the others share what is left; the level is the first
    # at which the next one isn't full.
    level_next = (F.col("budget") - F.col("full")) / F.nullif(F.col("open_weight"), F.lit(0.0))
    ratio_next = F.lead(F.col("most") / F.col("weight")).over(up)
    fits = (level_next >= F.col("most") / F.col("weight")) & (level_next <= ratio_next)
    s = s.withColumn("level", F.when(fits, level_next))
    first = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none_full = F.max("budget").over(whole) / F.sum("weight").over(whole)
    s = s.withColumn("level", F.when(none_full <= F.min(F.col("most") / F.col("weight")).over(whole), none_full).otherwise(F.min("level").over(first)))
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, *keep): one row for each input row; copies is how often
    the mix takes it.  A source's taken words miss its target by at most half of one document.

    Null texts have no words; null sources form one source, the last.  Repeated rows draw equal
    keys and are told apart by order alone, so the result is the same multiset on every run.  Empty
    tables give empty results; columns other than those named are ignored."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       words(text).alias("size"), keys(F.col(id_col), text).alias("key"), *keep)
    rows = cut(rows.withColumn("bin", F.floor(STEPS * F.log2("key")).cast("int")))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    plan = targets(bins.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, share, limit)
    plan = cut(plan.withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
               .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    below = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bin")
    summed = bins.withColumn("below", below)
    match = F.col("p.source").eqNullSafe(F.col("r.source"))
    at = (summed.alias("r").join(plan.alias("p"), match).where("budget > below AND budget < below + in_bin")
          .select("r.source", F.col("bin").alias("cut_bin"), F.col("below").alias("before")))
    plan = cut(plan.alias("p").join(at.alias("r"), match, "left").select("p.*", "cut_bin", "before"))
    got = rows.alias("r").join(plan.alias("p"), match).select("r.*", "source_size", "target", "epochs", "budget", "cut_bin", "before",
                                                             (F.col("bin") == F.col("cut_bin")).alias("cut"))
    out = ["doc_id", "source", "size", "source_size", "target"]
    # Without a cut bin the budget falls between bins: those that begin below it are taken.
    edges = cut(summed.alias("r").join(plan.where("cut_bin IS NULL").alias("p"), match).where("below < budget")
                .groupBy("r.source").agg(F.max("bin").alias("last_bin")))
    whole = (got.where("NOT coalesce(cut, false)").alias("r").join(edges.alias("p"), match, "left")
             .select(*[f"r.{c}" for c in out], (F.col("epochs") + F.coalesce(F.col("bin") < F.col("cut_bin"), F.col("bin") <= F.col("last_bin"), F.lit(False)).cast("long")).alias("copies"),
                     *[f"r.{c}" for c in keep]))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.col("before")
    part = got.where("cut").select(*out, (F.col("epochs") + (before + F.col("size") / 2 <= F.col("budget")).cast("long")).alias("copies"), *keep)
    return whole.unionByName(part)
