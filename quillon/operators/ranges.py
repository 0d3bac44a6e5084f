"""Order over a whole table without a task that sorts all of it: Spark's range partitions are the mechanism."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .contracts import ContractError

#: Rows of a key table up to which it is broadcast; above, both sides are shuffled.
SMALL = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir, so that its rows, their partitions and their order are settled and no lineage is left.

    Where the setting is absent, a temporary folder stands in on one machine (tests); on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ContractError("spark.checkpoint.dir must name a folder that all executors share")
        if not shared:
            import tempfile

            shared = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def with_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined to a settled table of a row a key, which is broadcast only if its rows, counted, are few."""
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, list(keys), how)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with _range, which never falls as the columns `order` rise (nulls first); rows with equal columns share a range.

    The ranges are Spark's: cut at sampled keys, as many as there are shuffle partitions, small ones put together.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def before(by: Sequence[str]):
    """The window of all earlier ranges, over a table of a row a range."""
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[str], name: str = "_r", by: Sequence[str] = ()) -> DataFrame:
    """df with name: the row's number from 0 in the order of the columns `order`, within each value of by (never null).

    Rows are dealt by ranges of (by, order), sorted in their range, and numbered where they lie; a row's place in the
    table is its place in the range and the rows of the ranges before, and the least place of a value of by is taken
    off. A value of by that holds most of the rows is cut like any other stretch of keys, so no task gets all of it;
    only rows that agree in all of by and order must share a range. An empty table stays empty.
    """
    key = [*by, *order]
    rows = checkpointed(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_range": F.shiftright("_m", 33), name: F.col("_m").bitwiseAND(F.lit(2**33 - 1))}).drop("_m")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a partition
    rows = rows.join(F.broadcast(counts.select("_range", F.coalesce(F.sum("_n").over(before([])), F.lit(0)).alias("_before"))), "_range")
    rows = rows.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
    if by:
        first = checkpointed(rows.groupBy(*by).agg(F.min(name).alias("_first")))
        rows = with_small(rows, first, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return rows.select(*df.columns, name)
