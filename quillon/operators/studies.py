"""Pilot, user and assay studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_bool, number_or_null
from .contracts import ContractError, require_none, require_unique, unmatched
from .entities import leaks
from .quantiles import exact_quantiles


def pilot_quality(records: DataFrame, reviews: DataFrame) -> DataFrame:
    require_none(unmatched(reviews, records, ["record_id"]).select("record_id"), "review of no record")
    cells = reviews.groupBy("record_id", "attribute").agg(F.count_distinct("reviewer_id").alias("r"), F.count_distinct("value").alias("v"))
    a = cells.agg(F.min("r").alias("minimum_reviewers_per_attribute"), F.avg(F.when(F.col("v") > 1, 1.0).otherwise(0.0)).alias("disagreement_fraction"))
    m = number_or_null(F.col("minutes"))
    middle = exact_quantiles(reviews.select(m.alias("m")), "m", [0.5]).select(F.col("q")[0].alias("median_review_minutes"))
    b = reviews.agg(F.sum(m).alias("total_review_minutes")).crossJoin(middle)
    c = records.agg(F.count("*").alias("records"), F.count_distinct("collection_group_id").alias("groups"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def participant_means(df: DataFrame) -> DataFrame:
    require_none(leaks(df, "participant_id", "arm"), "participant in two arms")
    for c in ("comprehension_correct", "appropriate_reliance"):
        require_none(df.where(~F.coalesce(F.col(c).between(0, 1), F.lit(False))).select("participant_id"), f"{c} outside [0, 1]")
    return df.groupBy("participant_id", "arm").agg(*[F.avg(c).alias(c) for c in ("comprehension_correct", "appropriate_reliance", "elapsed_seconds")])


def assay_qc(df: DataFrame) -> DataFrame:
    """One row of counts. Null limits pass; a limit below 0, loq below lod, an uncensored row without concentration, two units or a repeated (specimen, analyte) are errors."""
    require_unique(df, ["specimen_id", "analyte"])
    lod, loq, c = (number_or_null(F.col(x)) for x in ("lod", "loq", "concentration"))
    censored = lenient_bool(F.col("censored"))
    require_none(df.where(F.coalesce((lod < 0) | (loq < lod), F.lit(False))).select("specimen_id"), "invalid limits")
    require_none(df.where(~censored & c.isNull()).select("specimen_id"), "no concentration")
    if df.select("units").distinct().limit(2).count() != 1:
        raise ContractError("one unit only")
    return df.agg(F.count_distinct("specimen_id").alias("specimens"), F.count_distinct("analyte").alias("analytes"), F.count_distinct("batch_id").alias("batches"), F.count_if(censored).alias("censored_rows"), F.count_if(~lenient_bool(F.col("qc_pass"))).alias("qc_failed"))


def dataset_audit(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Counts of a data set, rows that share an image hash included."""
    same = records.groupBy("sha256").agg(F.count("*").alias("n"))
    return (
        records.agg(F.count("*").alias("images"), F.count_distinct("participant_id").alias("participants"))
        .crossJoin(annotations.agg(F.count("*").alias("annotations"), F.count_distinct("reviewer_id").alias("reviewers")))
        .crossJoin(same.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows")))
    )


def clarification_summary(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("policy").agg(F.avg(F.when(F.col("support_status") == "supported", 1.0).otherwise(0.0)).alias("supported_share"), F.avg("question_count").alias("mean_actions"), F.avg("elapsed_seconds").alias("mean_seconds"))


def latency(df: DataFrame, column: str = "ms") -> DataFrame:
    q = F.col("q")
    return exact_quantiles(df, column, [0.5, 0.95]).select(q[0].alias("p50"), q[1].alias("p95"))
