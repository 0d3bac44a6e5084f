"""Contracts of tables: what must hold before an operator runs, and joins with a stated cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


# The vocabularies of the study.
SPLITS = {"fit": 0.48, "validation": 0.12, "calibration": 0.20, "test": 0.20}
COHORTS = ("pilot", "main", "external")
DOMAINS = ("meal", "product")
MIXTURE = {"meal": 0.6, "product": 0.4}
STATUSES = ("supported", "contradicted", "unverifiable", "noninformative", "abstained")
VISUAL_SCOPES = ("record_presence", "focal_crop", "single_item")
ACTIONS = ("barcode_lookup", "ingredient_panel", "component_identity", "preparation_detail")
HIDDEN = ("ground_truth", "reference_labels", "support_status", "y_support")
DOCUMENTED = ("record_id", "domain", "collection_group_id", "image_path", "rights_id", "reference_status", "cohort")


def require_columns(df: DataFrame, names: Sequence[str], table: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{table} lacks {missing}")
    return df


def forbid_columns(df: DataFrame, names: Sequence[str], table: str = "table") -> DataFrame:
    present = sorted(set(names) & set(df.columns))
    if present:
        raise ContractError(f"{table} holds hidden fields {present}")
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], table: str = "table") -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ContractError(f"{table} repeats {list(keys)}")
    return df


def require_none(bad: DataFrame, message: str) -> None:
    rows = bad.take(1)
    if rows:
        raise ContractError(f"{message}: {rows[0].asDict()}")


def require_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each rule must be true in every row; a null counts as broken. One pass for all rules."""
    if rules:
        broken = df.agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(k) for k, c in rules.items()]).first()
        found = [k for k in rules if broken[k]]
        if found:
            raise ContractError(f"rows break {found}")
    return df


def validate_documented(records: DataFrame, allowed_root: str | None = None) -> DataFrame:
    """Domains, cohorts, rights, finished references, unique ids, no hidden fields, images below the allowed root."""
    from ..functions.scalars import is_close_path

    require_columns(records, DOCUMENTED, "records")
    forbid_columns(records, HIDDEN, "records")
    require_unique(records, ["record_id"], "records")
    rules = {
        "domain": F.col("domain").isin(*DOMAINS),
        "cohort": F.col("cohort").isin(*COHORTS),
        "rights_id": F.length("rights_id") > 0,
        "reference_status": F.col("reference_status") == "adjudicated",
    }
    if allowed_root:
        rules["image_path"] = is_close_path(F.col("image_path"), allowed_root)
    return require_rows(records, rules)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def require_disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    require_none(overlap(left, right, keys), "sets meet")


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", cardinality: str = "many_to_one", complete: bool = False) -> DataFrame:
    """A join with pandas' validate: the sides named `one` have unique keys; complete: every left row finds a right one."""
    ones = cardinality.split("_to_")
    if ones[0] == "one":
        require_unique(left, keys, "left side")
    if ones[1] == "one":
        require_unique(right, keys, "right side")
    if complete:
        require_none(unmatched(left, right, keys).select(*keys), "no match")
    return left.join(right, list(keys), how)


def validate_states(records: DataFrame, states: DataFrame) -> DataFrame:
    """States: record_id, focal_field, focal_item_id, visual_scope, sources. Ids known and complete, scopes known, a whole
    record bound to no item, no hidden fields, every source of the focal item and visible."""
    forbid_columns(states, HIDDEN, "states")
    require_columns(states, ("record_id", "focal_field", "focal_item_id", "visual_scope"), "states")
    require_none(unmatched(states, records, ["record_id"]).select("record_id"), "state of no record")
    require_none(unmatched(records, states, ["record_id"]).select("record_id"), "record without state")
    rules = {"visual_scope": F.col("visual_scope").isin(*VISUAL_SCOPES), "binding": (F.col("visual_scope") != "record_presence") | (F.col("focal_item_id") == "__record__")}
    if "sources" in states.columns:
        ours = lambda s: (s["record_id"] == F.col("record_id")) & (s["item_id"] == F.col("focal_item_id"))
        rules["bound sources"] = F.forall("sources", ours)
        rules["visible sources"] = F.forall("sources", lambda s: F.coalesce(s["available_at_inference"] & ~s["reference_only"], F.lit(False)))
    return require_rows(states, rules)


def presence_states(records: DataFrame, focal_field: str = "subcategory") -> DataFrame:
    return records.select("record_id", F.lit(focal_field).alias("focal_field"), F.lit("__record__").alias("focal_item_id"), F.lit("record_presence").alias("visual_scope"))


def missing_images(annotations: DataFrame, images: DataFrame, key: str = "image_name", most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(annotations with an image, ledger of those without); more than `most` distinct missing images are an error."""
    absent = unmatched(annotations.select(key).distinct(), images, [key]).limit(most + 1).collect()
    if len(absent) > most:
        raise ContractError(f"more than {most} images are missing")
    # the missing names are few by contract, so annotations stay where they lie; a null name is a missing one
    few = annotations.sparkSession.createDataFrame(absent, annotations.select(F.col(key).alias("_name")).schema)
    same = F.col(key).eqNullSafe(F.col("_name"))
    return annotations.join(F.broadcast(few), same, "left_anti"), annotations.join(F.broadcast(few), same, "left_semi").withColumn("reason", F.lit("missing_image"))


def focal_annotations(annotations: DataFrame, records: DataFrame) -> DataFrame:
    """Annotations of each record's declared item, all of them where the whole record is the item; every record keeps one."""
    out = join_checked(annotations, records.select("record_id", "focal_item_id"), ["record_id"]).where("focal_item_id = '__record__' or item_id = focal_item_id")
    require_none(unmatched(records, out, ["record_id"]).select("record_id"), "focal item without annotation")
    return out
