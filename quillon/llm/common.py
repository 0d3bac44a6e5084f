"""What the operators of this package share: words, scratch tables, ranks and components without large tasks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII blanks; a word is a longest run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"


#: Bytes of a file that Spark reads in one task.
SPLIT = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. One of fewer files than cores, and not large, is dealt out, since a file of one row group is one task."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    df, cores = spark.read.parquet(path.toString()), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if max(held.getFileCount(), held.getLength() // SPLIT) < cores else df


def text_of(col: str | Column = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Where it is known, Spark deletes the shuffle files of a write when the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written below spark.checkpoint.dir, which every executor sees, so that a lost executor costs no lineage.

    A step that has been written needs its shuffle files no more, so they go with it. Where the setting is absent, a
    temporary folder stands in on one machine (tests); on a cluster that is an error, since executors would each
    write to a disk of their own. close() deletes all that was written; results are read from there, so it comes last.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = base.get() if base.isDefined() else None
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
            spark.sparkContext.setCheckpointDir(base)
        self.root = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        if before is not None:
            conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(compression="zstd", **options).parquet(self.path(name))
        finally:
            if before is not None:
                conf.set(CLEANUP, before)
        return self.load(df, name)

    def load(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def source_key(source: Column) -> Column:
    """Sorts sources by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def prefix(df: DataFrame, keys: list[str], unit: str, rows: str | int, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums in the order (unit, *order) within keys, with no task that holds a whole key.

    unit is a column in [0, 1), spread about evenly; rows is the number of rows of the key (a column or a
    number). A key of n rows is cut into about sqrt(n) ranges of unit: their sums are accumulated over a table of
    sqrt(n) rows, and rows are summed only inside their own range. sums maps new columns to the columns that
    are summed, inclusive of the row itself.
    """
    n = F.col(rows) if isinstance(rows, str) else F.lit(rows)
    cut = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))))
    df = df.withColumn("_bin", F.least(F.floor(F.col(unit) * cut), cut - 1).cast("long"))
    bins = df.groupBy(*keys, "_bin").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_bin").orderBy(unit, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.sum(v).over(inside).alias(k) for k, v in sums.items()])
    df = df.join(bins, [*keys, "_bin"])
    return df.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_bin", *[f"_{k}" for k in sums])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v): root is the least node that it reaches.

    Each round hooks every node to its least neighbour, shortens the chains, and contracts the edges; the least
    node of a component never moves, so it is what remains. Only aggregates and joins are used, no list of a
    node's neighbours, and each round is written out, so lineage stays short.
    """
    edges = edges.where("u <> v").select("u", "v")
    cur = scratch.save(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-e0")
    mapping, turn = None, 0
    while not cur.isEmpty():
        turn += 1
        up = cur.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = scratch.save(up, f"{name}-a{turn}")
        for hop in range(2):
            high = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = scratch.save(up.join(high, "p").select("u", F.col("q").alias("p")), f"{name}-b{turn}-{hop}")
        if mapping is None:
            mapping = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = up.select(F.col("u").alias("root"), "p")
            mapping = mapping.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        mapping = scratch.save(mapping, f"{name}-m{turn}")
        left = up.select("u", F.col("p").alias("pu"))
        right = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = cur.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        cur = scratch.save(moved.distinct(), f"{name}-e{turn}")
        scratch.drop(f"{name}-e{turn - 1}", f"{name}-a{turn}", f"{name}-b{turn}-0", f"{name}-m{turn - 1}")
    if mapping is None:
        mapping = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return mapping


def buckets(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


#: Rows of a key table up to which it is broadcast; above, both sides are shuffled.
SMALL = 200_000


def join_checked(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined to a written table, broadcast only if its rows, counted, are few."""
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, keys, how)


#: A key with more than this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 0.001


def join_spread(df: DataFrame, small: DataFrame, keys: list[str], rows: str, few: int = SMALL) -> DataFrame:
    """df joined to a written table of a row a key, which has the key's number of rows; no task gets a whole hot key.

    A table of `few` rows at most is broadcast; with few = 0 the plan is the same at every size. Of a long one only the hot keys are, fewer than 1 / HOT; the rest is shuffled.
    """
    if small.count() <= few:
        return df.join(F.broadcast(small), keys)
    total = small.agg(F.sum(rows)).first()[0] or 0
    hot, rest = F.broadcast(small.where(F.col(rows) > HOT * total)), small if few else small.hint("merge")
    return df.join(hot, keys).unionByName(df.join(hot.select(*keys), keys, "left_anti").join(rest, keys).select(*df.join(hot, keys).columns))
