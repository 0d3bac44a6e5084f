"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, packing, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, neardup, packing, quality, secrets
from quillon.llm.common import Scratch, join_checked, table


#: Two hashes of a row, which name it together.
KEYS = ("_k", "_k2")


def held(docs: DataFrame) -> DataFrame:
    """What the operators read, and beside it the whole row as one column, so that no name can clash."""
    return docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts are rejected; equal rows meet the same end. Texts of any length
    are judged whole; an empty table stays empty."""
    return quality.quality_rules(held(docs), columns=("_doc",)).where("kept").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; of rows with equal id and text, one.

    Texts of one id are numbered, so that another text of the id of a duplicate is judged by itself. Rows without an
    id and blank texts are no duplicates; of those with equal text (and id), one stays. Texts are told apart by hashes of
    128 bits and read whole, whatever their length; an empty table stays empty.
    """
    scratch, own_tables = Scratch(spark), Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = held(docs).withColumns({"_h": F.md5(text), "_row": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text))})
    names = scratch.save(rows.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("_h").alias("_h"), F.count("*").alias("_n")), "names")  # no texts
    several = names.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("_h").alias("_first")).where("_n > 1")
    several = scratch.save(several.select("doc_id", "_first"), "several")
    rows = join_checked(rows, several, ["doc_id"], "left")
    # an id is as good as any other, as long as the order of ids holds where it is known: further texts of an id come last
    own = F.when(F.col("_first").isNull() | (F.col("_first") == F.col("_h")), F.col("doc_id")).otherwise(F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("doc_id", "_h"), 2))
    rows = rows.withColumn("_own", own)
    judged = neardup.near_duplicates(rows.select(F.col("_own").alias("doc_id"), "text"), scratch=own_tables)
    gone = scratch.save(judged.where("not kept").select(F.col("doc_id").alias("_own")).distinct(), "gone")
    own_tables.close()
    rows = join_checked(rows, gone, ["_own"], "left_anti").select("_row", "_doc")
    repeated = scratch.save(names.where("_n > 1").select("_row"), "repeated")
    once = join_checked(rows, repeated, ["_row"], "left_anti").unionByName(join_checked(rows, repeated, ["_row"], "left_semi").dropDuplicates(["_row"]))
    return once.select("_doc.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Every row stays; null texts stay null. Texts are read and
    rewritten whole; an empty table stays empty."""
    found = secrets.scan(held(docs), columns=("_doc",)).withColumn("_hit", F.size("spans") > 0)
    text = F.when(F.col("_hit"), secrets.redact(F.col("_doc.text"), F.col("spans"))).otherwise(F.col("_doc.text"))
    columns = {"text": text, "n_chars": F.when(F.col("_hit"), F.length(text).cast("long")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[columns.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; the keys are scaled by the posterior of the quality rules.

    Equal rows (by hashes of 128 bits) are one document, which stands for as many copies as all of them together were taken.
    Texts of any length are one row; an empty table stays empty.
    """
    scratch, own_tables = Scratch(spark), Scratch(spark)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    rows = held(docs).withColumns({k: F.xxhash64(F.lit(salt), *[F.col("_doc").getField(c) for c in plain]) for salt, k in enumerate(KEYS)})
    judged = quality.quality_rules(rows, scratch, columns=("doc_id", "source", *KEYS))  # written without texts
    taken = mixing.mix(judged, own_tables, quality=F.col("quality") + 0.01, columns=("doc_id", *KEYS), size=F.col("n_words"))
    copies = scratch.save(taken.groupBy(*KEYS).agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0"), "copies")
    own_tables.close()
    rows = rows.select("_doc", *KEYS)
    repeated = scratch.save(copies.where("_rows > 1"), "repeated")
    out = rows.join(copies.where("_rows = 1"), list(KEYS)).unionByName(join_checked(rows, repeated, list(KEYS)).dropDuplicates(list(KEYS)))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null text is its closing id alone; texts of any length are
    cut into pieces; an empty table has none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Near-duplicates, EM and the tokenizer have no SQL; tests/llm/test_pipeline_stages.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
