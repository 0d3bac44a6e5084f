"""Exact quantiles of groups of any size: order statistics by range, without a task that sees all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import SMALL, before, checkpointed, ranged


def same(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, q): for each group the number of values and an array of quantiles, interpolated between neighbours.

    The quantile of share s lies at place s * (n - 1) of the sorted values. Nulls don't count, NaN is the largest value, a
    null in by is a group, a group without values has n 0 and null quantiles. Equal values are counted together before
    they move. Ranges of (by, value) are counted, the ranges that hold a wanted place are found from these counts, and only
    their values are looked at again: a task holds a range, however large the group. Without by, an empty table gives one row.
    """
    by = list(by)
    if not shares or min(shares) < 0 or max(shares) > 1:
        raise ValueError("shares lie between 0 and 1")
    value = F.col(column).cast("double").alias("_v")
    cells = ranged(df.select(*by, value).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n")), *by, "_v")
    per = cells.groupBy(*by, "_range").agg(F.sum("_n").alias("_m"))  # a row a range and group in it
    per = per.withColumn("_before", F.coalesce(F.sum("_m").over(before(by)), F.lit(0)))
    totals = per.groupBy(*by).agg(F.sum("_m").alias("n"))
    at = [(i, float(s) * (F.col("n") - 1)) for i, s in enumerate(shares)]
    ends = [F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(p) if up else F.floor(p)).alias("place")) for i, p in at for up in (False, True)]
    wanted = totals.select(*by, F.explode(F.array(*ends)).alias("w")).select(*by, "w.*")
    inside = (F.col("w.place") >= F.col("p._before")) & (F.col("w.place") < F.col("p._before") + F.col("p._m"))
    wanted = wanted.alias("w").join(per.alias("p"), [*same("w", "p", by), inside] if by else inside).select("w.*", "p._range", F.col("p._before"))
    wanted = checkpointed(wanted)  # two rows a group and share
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    found = cells.alias("c").join(few.alias("w"), [*same("c", "w", by), F.col("c._range") == F.col("w._range")])
    found = found.select("w.*", "c._v", "c._n")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_range", "i", "up").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_upto", F.col("_before") + upto).where("place < _upto")
    found = found.groupBy(*by, "i").agg(F.min(F.when(~F.col("up"), F.col("_v"))).alias("low"), F.min(F.when(F.col("up"), F.col("_v"))).alias("high"))
    out = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("low", "high").alias("x")))).alias("found"))  # an entry a share
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).toDF("_one")
    groups = groups.alias("g")
    for side in (totals, out):
        side = side.alias("s")
        keep = [f"s.{c}" for c in side.columns if c not in by]
        groups = groups.join(side, same("g", "s", by) if by else F.lit(True), "left").select("g.*", *keep).alias("g")
    low, high = ([F.col("found")[i][end] for i, _ in at] for end in ("low", "high"))
    part = [p - F.floor(p) for _, p in at]
    q = [F.when(f == 0, a).otherwise(a * (1 - f) + b * f) for a, b, f in zip(low, high, part, strict=True)]
    return groups.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.array(*q).alias("q"))
