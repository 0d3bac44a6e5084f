"""Proportional stratified interleaving into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import Scratch, join_spread, prefix, source_key, text_of


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, scratch: Scratch | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs with size, text_crc32, law, shard, slot and grown_shard: the law `rows`.

    Rows of a source are ranked in a seeded hash order; row r of n stands at (r - 1/2) / n, all sources are sorted
    together by that fraction, and the sequence is cut into shards of N / shards rows, at most one apart, each with
    every source's share. Both ranks come from counts over ranges, so no task sees a whole source, nor all of many
    sources of a row or two, whose fractions are the same. Equal texts are rows like others and may part: a group may be larger than a shard. Null text is empty, a null source is a source
    of its own; equal rows may take each other's places, so reruns agree as sets of rows. Texts of any length are one row; an empty
    table gives an empty result; columns that aren't named in `columns` are not read, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = text_of()
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text)))
    rows = docs.select(
        *[c for c in docs.columns if c in columns],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        source_key(F.col("source")).alias("skey"),
        (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(2**52)).alias("_u"),
        F.lit(1).cast("long").alias("_one"),
    )
    rows = scratch.save(rows, "rows")
    total = rows.count()
    counts = scratch.save(rows.groupBy("skey").agg(F.count("*").alias("_rows")), "counts")
    inside = prefix(join_spread(rows, counts, ["skey"], "_rows"), ["skey"], "_u", "_rows", ["doc_id", "text_crc32", "size"], {"_rank": "_one"})
    inside = scratch.save(inside.withColumn("_f", (F.col("_rank") - 0.5) / F.col("_rows")), "inside")
    placed = numbered(inside, ["_f", "skey"], "_at")
    at = F.col("_at")
    where = F.floor(at * shards / F.lit(max(total, 1)))
    first = F.ceil(where * F.lit(total) / shards)
    return placed.select(
        *[c for c in docs.columns if c in columns], "size", "text_crc32", F.lit("rows").alias("law"),
        where.cast("int").alias("shard"), (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
