"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import before, numbered, ranged
from .common import Scratch, join_spread, prefix, source_key, text_of, words_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words at most so often.
MOST = 3
#: 13 hexadecimal digits of an MD5 as a number in (0, 1).
SPREAD = float(2**52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, n_docs) with target: shares by weight, none above most times its size, the excess reshared.

    The level at which the shares come to rest is found in one pass: sources are taken by the level at which they
    fill up, and the first level that the next source can still bear is the one. The table has a row a source; it is
    numbered and summed by ranges, so that sources as many as hosts are no single task.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    df = numbered(sizes, ["skey"], "_rank").withColumn("_w", w).withColumn("_full", most * F.col("source_size") / F.col("_w"))
    df = ranged(df, "_full", "skey")
    cells = df.groupBy("_range").agg(F.sum("source_size").alias("_s"), F.sum("_w").alias("_v"))  # a row a partition
    everything = before([]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(c).over(before([])), F.lit(0)).alias(f"_before{c}") for c in ("_s", "_v")] + [F.sum(c).over(everything).alias(f"_all{c}") for c in ("_s", "_v")]
    df = df.join(F.broadcast(cells.select("_range", *sums)), "_range")
    above = Window.partitionBy("_range").orderBy("_full", "skey").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, sum_: F.col(f"_before{sum_}") + F.coalesce(F.sum(c).over(above), F.lit(0))
    df = df.withColumn("_level", (F.col("_all_s") - most * upto("source_size", "_s")) / (F.col("_all_v") - upto("_w", "_v")))
    stop = df.where(F.col("_level") <= F.col("_full")).agg(F.min(F.struct("_full", "skey", "_level"))["_level"]).first()[0]
    full = F.col("_full") <= F.lit(stop) if stop is not None else F.lit(True)
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.least(F.col("_full"), F.lit(stop)) * F.col("_w"))
    return df.select(*sizes.columns, target.alias("target"))


def mix(docs: DataFrame, scratch: Scratch | None = None, quality: Column | None = None, columns: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, most: int = MOST, size: Column | None = None) -> DataFrame:
    """columns of docs with size, source_size, target, copies and taken, a row for each row of docs.

    Whole epochs of a source come first. What is left of its target is filled in the order of -ln(u) / quality,
    u from a hash of doc_id, as far as the running sum stays within it; documents behind the cut that fit the gap
    follow in the same way, and the one document that comes nearest to the rest joins if it narrows it. quality is a
    positive column; without one, it is the share of distinct words among a document's words, and a quarter. size is the
    number of words; with both given, no text is read. Null text
    has size 0, null source is a source of its own, null doc_id hashes as empty; very long texts are rows like others.
    Equal rows are told apart by their rank only, so reruns agree as sets of rows. An empty table gives an empty result;
    columns that aren't named in `columns` are not read, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    words = words_of(text_of()) if size is None or quality is None else None
    size = F.size(words).cast("long") if size is None else size
    unit = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / SPREAD
    rows = docs.select(*[c for c in docs.columns if c in columns], source_key(F.col("source")).alias("skey"), size.alias("size"), unit.alias("_u"), (0.25 + F.size(F.array_distinct(words)) / F.greatest(size, F.lit(1)) if quality is None else quality).alias("_q"))
    rows = scratch.save(rows.withColumn("_e", -F.log("_u") / F.col("_q")), "sizes")
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("_q").alias("_mean"))
    goals = scratch.save(targets(sizes, weights, most), "targets")
    goals = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    order = ["_e", *[c for c in columns if c in ("doc_id",)], "size"]
    goals = scratch.save(goals, "goals")
    ranked = join_spread(rows, goals, ["skey"], "n_docs").withColumns({"_unit": 1 - F.exp(-F.col("_e") * F.col("_mean")), "_one": F.lit(1).cast("long")})
    ranked = prefix(ranked, ["skey"], "_unit", "n_docs", order, {"_sum": "size", "_n": "_one"})
    ranked = scratch.save(ranked.withColumn("_in", F.col("_sum") <= F.col("_budget")).drop("_sum"), "filled1")

    def gap(filled: DataFrame, name: str) -> DataFrame:
        got = filled.groupBy("skey").agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0)).alias("_got"), F.count("*").alias("_all"))
        return join_spread(filled, scratch.save(got, name), ["skey"], "_all").withColumn("_gap", F.col("_budget") - F.col("_got")).drop("_got", "_all")

    # the document at the cut may be a long one: those behind it that still fit follow in the same order
    ranked = gap(ranked, "got1").withColumn("_fits", F.when(~F.col("_in") & (F.col("size") <= F.col("_gap")), F.col("size")).otherwise(0))
    ranked = prefix(ranked, ["skey"], "_unit", "n_docs", order, {"_sum": "_fits"})
    ranked = ranked.withColumn("_in", F.col("_in") | ((F.col("_fits") > 0) & (F.col("_sum") <= F.col("_gap")))).drop("_sum", "_fits", "_gap")
    out = gap(scratch.save(ranked, "filled2"), "got2")
    near = F.abs(F.col("size") - F.col("_gap"))
    best = out.where(~F.col("_in") & (near < F.col("_gap"))).groupBy("skey").agg(F.min(F.struct(near, F.col("_n"))).getField("_n").alias("_best"))
    best = scratch.save(goals.select("skey", F.col("n_docs").alias("_all")).join(best, "skey", "left"), "best")
    out = join_spread(out, best, ["skey"], "_all")
    copies = F.col("_epochs") + F.when(F.col("_in") | F.coalesce(F.col("_n") == F.col("_best"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return out.select(*[c for c in docs.columns if c in columns], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
