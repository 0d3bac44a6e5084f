"""Targets from several reviewers, and measures by label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_key, softplus


def bundles(head: str, fields: Sequence[str]) -> list[tuple[str, ...]]:
    """independent: each field for itself; joint: all fields of an item together."""
    return [(f,) for f in fields] if head == "independent" else [tuple(fields)]


def labelled(annotations: DataFrame, head: str, fields: Sequence[str]) -> DataFrame:
    """(record_id, reviewer_id, item_id, bundle, complete, label), a row for each item and bundle; an item with a blank field is incomplete."""
    parts = []
    for b in bundles(head, fields):
        complete = F.lit(True)
        for f in b:
            complete = complete & (F.coalesce(F.col(f), F.lit("")) != "")
        parts.append(F.struct(F.lit("+".join(b)).alias("bundle"), complete.alias("complete"), label_key({f: F.col(f) for f in b}).alias("label")))
    return annotations.select("record_id", "reviewer_id", "item_id", F.explode(F.array(*parts)).alias("b")).select("record_id", "reviewer_id", "item_id", "b.*")


def vocabulary(annotations: DataFrame, fit_ids: DataFrame, head: str, fields: Sequence[str], min_support: int = 1) -> DataFrame:
    """(bundle, label, n_records, label_id): complete labels of fit records with enough distinct records."""
    rows = labelled(annotations.join(fit_ids.select("record_id"), "record_id", "left_semi"), head, fields).where("complete")
    counted = rows.groupBy("bundle", "label").agg(F.count_distinct("record_id").alias("n_records")).where(F.col("n_records") >= min_support)
    return counted.withColumn("label_id", F.row_number().over(Window.partitionBy("bundle").orderBy("label")) - 1)


def endorsement(annotations: DataFrame, vocab: DataFrame, head: str, fields: Sequence[str]) -> DataFrame:
    """(record_id, bundle, label, y, mask, n_reviewers) for each record that was annotated and each label.

    A reviewer with any incomplete item is left out of the bundle; y is the share of the others whose labels hold it;
    without any, mask is 0 and y is 0.
    """
    rows = labelled(annotations, head, fields)
    panel = rows.groupBy("record_id", "bundle", "reviewer_id").agg(F.bool_and("complete").alias("ok"), F.collect_set("label").alias("labels"))
    counts = panel.groupBy("record_id", "bundle").agg(F.count_if("ok").alias("n_reviewers"), F.flatten(F.collect_list(F.when(F.col("ok"), F.col("labels")))).alias("_votes"))
    # a record's votes travel with it, so that its rows, one for each label, are made where it lies
    out = counts.join(F.broadcast(vocab.select("bundle", "label")), "bundle")
    votes = F.size("_votes") - F.size(F.array_remove("_votes", F.col("label")))
    y = F.when(F.col("n_reviewers") > 0, votes / F.col("n_reviewers")).otherwise(0.0)
    return out.select("record_id", "bundle", "label", y.alias("y"), (F.col("n_reviewers") > 0).cast("int").alias("mask"), "n_reviewers")


def unseen_labels(annotations: DataFrame, vocab: DataFrame, head: str, fields: Sequence[str]) -> DataFrame:
    rows = labelled(annotations, head, fields)
    panel = rows.groupBy("record_id", "bundle", "reviewer_id").agg(F.bool_and("complete").alias("ok")).where("ok")
    rows = rows.join(panel, ["record_id", "bundle", "reviewer_id"], "left_semi")
    return rows.join(vocab, ["bundle", "label"], "left_anti").select("record_id", "reviewer_id", "label").distinct()


def prevalence(long: DataFrame, clip: float | None = None) -> DataFrame:
    """Masked share by label, 0 where nothing was observed."""
    share = F.coalesce(F.sum(F.col("y") * F.col("mask")) / F.nullif(F.sum("mask"), F.lit(0)), F.lit(0.0))
    if clip:
        share = F.least(F.greatest(share, F.lit(clip)), F.lit(1 - clip))
    return long.groupBy("label").agg(share.alias("prevalence"))


def confusion(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By label over observed rows: n_observed, support (y > 0.5), precision, recall, f1; null where undefined."""
    pos, hit = F.col("y") > 0.5, F.col("p") >= threshold
    agg = long.where("mask > 0").groupBy("label").agg(F.count("*").alias("n_observed"), F.count_if(pos).alias("support"), F.count_if(hit).alias("_hit"), F.count_if(pos & hit).alias("_tp"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    f1 = 2 * F.col("_tp") / F.nullif(F.col("_hit") + F.col("support"), F.lit(0))
    return agg.select("label", "n_observed", "support", ratio("_tp", "_hit").alias("precision"), ratio("_tp", "support").alias("recall"), f1.alias("f1"))


def calibration_bins(long: DataFrame, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Sums by equal-width bin of the clipped probability, from which calibration() takes its figures."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = long.where("mask > 0").withColumn("_p", p)
    bin_ = F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)).cast("int")
    y, q = F.col("y"), F.col("_p")
    return rows.groupBy(*by, bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(q).alias("sum_p"), F.sum("y").alias("sum_y"), F.sum((q - y) ** 2).alias("soft"),
        F.sum(y * (1 - q) ** 2 + (1 - y) * q**2).alias("panel"), F.sum(-y * F.log(q) - (1 - y) * F.log1p(-q)).alias("loss"),
    )


def calibration(long: DataFrame, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """n, soft_brier, annotator_brier, log_loss, ece; nothing observed: n 0 and nulls."""
    n = F.sum("n")
    gap = F.sum(F.abs(F.col("sum_p") - F.col("sum_y")))  # n / N * |mean p - mean y|, times N
    return calibration_bins(long, bins, by).groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("n"), (F.sum("soft") / n).alias("soft_brier"), (F.sum("panel") / n).alias("annotator_brier"),
        (F.sum("loss") / n).alias("log_loss"), (gap / n).alias("ece"),
    )


def masked_bce(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    loss = (softplus(F.col("z")) - F.col("y") * F.col("z")) * F.col("mask")
    return long.groupBy(*by).agg((F.sum(loss) / F.nullif(F.sum("mask"), F.lit(0))).alias("bce"))


def top1(long: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean endorsement of each record's likeliest label (the first on ties), over records where it was observed."""
    w = F.col(weight) if weight else F.lit(1.0)
    best = long.withColumn("_w", w).groupBy("record_id").agg(F.max_by(F.struct("y", "mask", "_w"), F.struct("p", -F.col("j"))).alias("b"))
    return best.where("b.mask > 0").agg(F.count("*").alias("n"), (F.sum(F.col("b._w") * F.col("b.y")) / F.nullif(F.sum("b._w"), F.lit(0))).alias("top1"))


def draft_rules(vocab: DataFrame) -> DataFrame:
    """A rule a field: its sorted distinct values over all labels, review pending."""
    pairs = vocab.select(F.explode(F.from_json("label", "map<string,string>")).alias("field", "value"))
    return pairs.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values")).select("field", F.concat(F.lit("claim_"), F.col("field")).alias("claim_id"), F.array("field").alias("fields"), "values", F.array(F.lit("predicted"), F.lit("recorded")).alias("qualifiers"), F.lit(True).alias("documentary_for_recorded"), F.lit(1).alias("specificity"), F.lit("pending").alias("review_status"))


def field_completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("v")) for f in fields])).alias("s")).select("s.*")
    return long.groupBy("field").agg(F.count_if(F.col("v") != "").alias("n_filled"), F.count_distinct(F.when(F.col("v") != "", F.col("v"))).alias("n_values"))
