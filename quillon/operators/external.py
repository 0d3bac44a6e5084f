"""External cohorts: an addendum that leaves the main study as it is, and predictions under frozen thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contracts, entities


def addendum(main: DataFrame, external: DataFrame, locked_at: str) -> DataFrame:
    """The external records with root, group_id and split 'external'.

    All are of the external cohort and captured after the lock; their ids are new, and no component of shared keys holds
    records of both sides.
    """
    contracts.require_columns(external, ("record_id", "cohort", "captured_at"), "external records")
    late = F.col("captured_at").cast("timestamp") > F.to_timestamp(F.lit(locked_at))
    contracts.require_rows(external, {"cohort": F.col("cohort") == "external", "captured_at": late})
    contracts.require_disjoint(main, external, ["record_id"])
    both = main.withColumn("_side", F.lit("main")).unionByName(external.withColumn("_side", F.lit("external")), allowMissingColumns=True)
    grouped = entities.build_components(both)
    contracts.require_none(entities.leaks(grouped, "group_id", "_side"), "external records share a group with the main study")
    return grouped.where("_side = 'external'").drop("_side").withColumn("split", F.lit("external"))


def frozen_predictions(candidates: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = ("method", "seed")) -> DataFrame:
    """candidates with accepted, by the locked threshold of each run; a run without one is an error. Runs are a grid's: few."""
    contracts.require_unique(thresholds, by, "thresholds")
    contracts.require_none(contracts.unmatched(candidates.select(*by).distinct(), thresholds, by), "run without a locked threshold")
    at = F.broadcast(thresholds.select(*by, "threshold"))
    names = [c for c in candidates.columns if c not in ("accepted", "threshold")]
    return candidates.select(*names).join(at, list(by)).withColumn("accepted", F.col("eligible") & F.col("informative") & (F.col("score") >= F.col("threshold")))
