"""Sources. Text tables arrive as strings with '' for empty; types come with the contracts."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from itertools import chain, groupby, islice
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    import pyarrow as pa


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with every column a string, empty as ''. The header alone gives the schema."""
    names = spark.read.option("header", True).option("sep", sep).csv(path, inferSchema=False).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_typed_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


#: Bytes up to which a labelled file travels as one value; the lines of a longer one are streamed.
WHOLE = 8 << 20
#: Stands for a carriage return within a field while it is parsed: half of a surrogate pair, which no decoded text holds.
_RETURN = "\udc0d"


def read_labelled(spark: SparkSession, root: str, sep: str | None, columns: list[str]) -> DataFrame:
    """The columns of all *_labeled_data.csv below root, with source_file and row_number (0-based, by file).

    Without sep each file has its own: the one of , ; tab and | that its header holds most often. Columns are found by
    their names in each file's header, others are left out, and a missing one is an error. Quoted fields may hold separators,
    quotes and line ends; the first line end of a file is its kind. A file is read by one task, in its order, as Python's csv
    module has it. The folder is listed once (twice if a file is longer than WHOLE) and no file is named to the driver: tasks look at
    headers first, and what reaches the driver is one that lacks a column.
    """
    from ..operators.contracts import ContractError

    marks = [sep] if sep else [",", ";", "\t", "|"]
    below = {"recursiveFileLookup": True, "pathGlobFilter": "*_labeled_data.csv"}
    size = F.col("_metadata.file_size")
    files = spark.read.format("binaryFile").options(**below).load(root)
    tasks = 16 * spark.sparkContext.defaultParallelism  # Spark deals out 32 small files a task; tasks stream, so many don't hold more
    short = files.where(size <= WHOLE).coalesce(tasks).select("path", F.col("content").alias("text"))
    heads = short.select("path", F.regexp_extract(F.col("text").cast("string"), r"\A[ \r\n]*([^\r\n]*)", 1).alias("head"))
    long = None
    if not files.where(size > WHOLE).select("path").isEmpty():
        lines = spark.read.options(**below, lineSep="\n").text(root).where(size > WHOLE)
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("name"), F.col("value").alias("text"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")).alias("place"))
        first = lines.where(F.trim(F.translate("text", "\r", "")) != "").groupBy("path").agg(F.min_by("text", "place").alias("text"))
        heads = heads.unionByName(first.select("path", F.regexp_extract("text", r"\A[ \r]*([^\r]*)", 1).alias("head")))
        long = lines.repartition("path").sortWithinPartitions("path", "place").select("path", "name", F.concat("text", F.lit("\n")).cast("binary").alias("text"))

    def lacking(batches):
        import pyarrow as pa

        for b in batches:
            found = [(p, sorted(set(columns) - set(header(h, marks)[1]))) for p, h in zip(b.column("path").to_pylist(), b.column("head").to_pylist(), strict=True) if h]
            found = [(p, str(missing)) for p, missing in found if missing]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([p for p, _ in found], [m for _, m in found])], ["path", "missing"])

    bad = heads.mapInArrow(lacking, "path string, missing string").agg(F.min(F.struct("path", "missing")).alias("f")).first()["f"]
    if bad:
        raise ContractError(f"{bad['path']} lacks {bad['missing']}")

    def parsed(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "name", "text")), strict=True))
        for (_, name), pieces in groupby(rows, lambda r: r[:2]):
            yield from labelled_rows((t.decode(errors="replace") for _, _, t in pieces), name, marks, columns)

    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in [*columns, "source_file"]], T.StructField("row_number", T.LongType())])
    out = short.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "text").mapInArrow(parsed, schema)
    return out if long is None else out.unionByName(long.mapInArrow(parsed, schema))


def header(head: str, marks: list[str]) -> tuple[str, list[str]]:
    """The separator that a header's line holds most often, and the names in it."""
    mark = max(marks, key=lambda m: (head.count(m), -marks.index(m)))
    return mark, [n.strip().strip('"') for n in head.lstrip("\ufeff").split(mark)]


def labelled_rows(pieces: Iterator[str], name: str, marks: list[str], columns: list[str], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The columns, source_file and row_number of one file, given whole or as lines."""
    import pyarrow as pa

    csv.field_size_limit(sys.maxsize)

    def plain_lines():
        end = None
        for piece in pieces:
            end = end or (re.search(r"\r\n?|\n", piece) or ["\n"])[0]
            yield from io.StringIO(piece.replace(end, "\n").replace("\r", _RETURN), newline="\n")

    lines = plain_lines()
    head = next((x for x in lines if x.strip(" \n" + _RETURN)), None)
    if head is None:
        return
    mark, names = header(head.rstrip("\n"), marks)
    at = [names.index(c) for c in columns]
    records = filter(None, csv.reader(chain([head], lines), delimiter=mark))
    next(records)
    n = 0
    while chunk := list(islice(records, rows)):
        fields = [pa.array([r[i].replace(_RETURN, "\r") if i < len(r) else "" for r in chunk], pa.string()) for i in at]
        yield pa.RecordBatch.from_arrays([*fields, pa.array([name] * len(chunk), pa.string()), pa.array(range(n, n + len(chunk)), pa.int64())], [*columns, "source_file", "row_number"])
        n += len(chunk)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record a line; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_config(path: str, overrides: dict | None = None) -> dict:
    """JSON, with overrides such as those of the environment on top."""
    import json

    with open(path) as f:
        return json.load(f) | (overrides or {})


DISH = ("record_id", "total_calories", "total_mass_g", "total_fat_g", "total_carb_g", "total_protein_g")
PART = ("ingredient_id", "ingredient_name", "mass_g", "calories", "fat_g", "carb_g", "protein_g")


def parse_dishes(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(dishes, ingredients) of rows with 6 fields and then blocks of 7, before which their number may stand.

    Any other shape is an error. Fields hold no quoted commas.
    """
    cells = F.split(column, ",")
    rows = lines.where((F.length(F.trim(column)) > 0) & ~F.startswith(column, F.lit("dish_id"))).select(cells.alias("c"))
    n, seventh = F.size("c"), F.get("c", 6)
    plain = (n >= 6) & ((n - 6) % 7 == 0) & ((n == 6) | F.startswith(F.coalesce(seventh, F.lit("")), F.lit("ingr_")))
    counted = (n >= 7) & ((n - 7) % 7 == 0) & F.coalesce(seventh.try_cast("int") == (n - 7) / 7, F.lit(False))
    skip = F.when(plain, 6).when(counted, 7).otherwise(F.raise_error(F.lit("unexpected dish row")).cast("int"))
    rows = rows.withColumn("skip", skip)
    dishes = rows.where("skip > 0").select(*[F.get("c", i).alias(name) for i, name in enumerate(DISH)])
    block = F.explode(F.when(F.size("c") > F.col("skip"), F.sequence(F.col("skip"), F.size("c") - 7, F.lit(7))))
    parts = rows.select("c", F.col("c")[0].alias("record_id"), block.alias("i"))
    good = F.when(F.startswith(F.get("c", F.col("i")), F.lit("ingr_")), F.get("c", F.col("i"))).otherwise(F.raise_error(F.lit("malformed ingredient")).cast("string"))
    return dishes, parts.select("record_id", good.alias(PART[0]), *[F.get("c", F.col("i") + k).alias(PART[k]) for k in range(1, 7)])


def map_ingredients(ingredients: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Ingredients with the reviewed target, and whether there is one."""
    from ..operators.contracts import join_checked

    return join_checked(ingredients, crosswalk.where("length(target) > 0").select("ingredient_name", "target"), ["ingredient_name"]).withColumn("mapped", F.col("target").isNotNull())


def cached_products(cache: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Cached snapshots by barcode; fetching is not the engine's."""
    from ..functions.scalars import is_barcode

    return barcodes.where(is_barcode(F.col("barcode"))).join(cache, "barcode", "left").withColumn("cached", F.col("snapshot").isNotNull())


def extract_zip(archive: str, destination: str) -> list[str]:
    """Unpacks after checks: space, CRC, no absolute or parent paths, no links."""
    import os
    import shutil
    import zipfile

    with zipfile.ZipFile(archive) as z:
        infos = z.infolist()
        os.makedirs(destination, exist_ok=True)
        if sum(i.file_size for i in infos) > shutil.disk_usage(destination).free:
            raise ValueError("not enough space")
        root = os.path.realpath(destination)
        for i in infos:
            if (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"link in archive: {i.filename}")
            if not os.path.realpath(os.path.join(root, i.filename)).startswith(root + os.sep):
                raise ValueError(f"path leaves the folder: {i.filename}")
        if z.testzip():
            raise ValueError("archive is damaged")
        z.extractall(destination)
        return [i.filename for i in infos]


def fixture(spark: SparkSession, groups: int = 32) -> DataFrame:
    """Synthetic records: two domains a group, colours by group, a reviewed recipe for two groups in three, disputed for each eleventh."""
    g = (F.col("id") / 2).cast("int")
    domain = F.when(F.col("id") % 2 == 0, "meal").otherwise("product")
    return spark.range(2 * groups).select(
        F.concat_ws("_", F.lit("r"), g, F.col("id") % 2).alias("record_id"), F.concat(F.lit("g"), g).alias("group_id"), domain.alias("domain"),
        F.when(g % 2 == 0, "red").otherwise("green").alias("truth"), (g % 7 == 0).alias("disagrees"), (g % 3 != 0).alias("documented"), (g % 11 == 0).alias("disputed"),
    )
