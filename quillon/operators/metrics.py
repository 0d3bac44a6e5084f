"""Group-equal, domain-standardised weights and metrics; thresholds by coverage; risk against coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import MIXTURE, STATUSES, ContractError, require_none, require_unique
from .ranges import before, checkpointed, numbered, ranged


def share_of(domain: Column, mixture: dict[str, float]) -> Column:
    if abs(sum(mixture.values()) - 1) > 1e-8:
        raise ContractError("mixture must sum to 1")
    out = F.lit(None).cast("double")
    for name, share in mixture.items():
        out = F.coalesce(out, F.when(domain == name, F.lit(float(share))))
    return out


def weights(df: DataFrame, mixture: dict[str, float] = MIXTURE, by: Sequence[str] = (), check: bool = True) -> DataFrame:
    """df with weight: the domain's share over its groups over the group's records in it, within each value of by.

    Checked: ids are unique within by, every domain of the mixture is there, no other is.
    """
    counts = df.groupBy(*by, "domain", "group_id").agg(F.count("*").alias("_n"))
    groups = counts.groupBy(*by, "domain").agg(F.count("*").alias("_g"))
    if check:
        require_unique(df, [*by, "record_id"])
        require_none(df.where(~F.col("domain").isin(*mixture)).select("record_id", "domain"), "domain outside the mixture")
        require_none(groups.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") < len(mixture)), "a domain is absent")
    both = counts.join(F.broadcast(groups), [*by, "domain"])  # a row a domain
    weight = share_of(F.col("domain"), mixture) / F.col("_g") / F.col("_n")
    # a row a group: merged, since a table of groups just below the threshold, broadcast in each of several joins, fills the driver
    return df.join(both.select(*by, "domain", "group_id", weight.alias("weight")).hint("merge"), [*by, "domain", "group_id"])


def assertion_metrics(df: DataFrame, mixture: dict[str, float] = MIXTURE, by: Sequence[str] = (), check: bool = True) -> DataFrame:
    """By `by`: coverage, unsupported, contradicted and unverifiable rates among answers (null without any), supported_yield, counts."""
    if check:
        require_none(df.where(~F.col("support_status").isin(*STATUSES)).select("record_id", "support_status"), "status outside the vocabulary")
        require_none(df.where("accepted and informative and support_status in ('abstained', 'noninformative')").select("record_id"), "answer without rating")
    rows = weights(df, mixture, by, check)
    answered = F.col("accepted") & F.col("informative")
    of = lambda c: F.sum(F.when(answered & c, F.col("weight")).otherwise(0.0))
    status = F.col("support_status")
    coverage = of(F.lit(True))
    rate = lambda c: of(c) / F.nullif(coverage, F.lit(0.0))
    bad = status.isin("contradicted", "unverifiable")
    return rows.groupBy(*by).agg(
        rate(bad).alias("unsupported_rate"), coverage.alias("coverage"), of(~bad).alias("supported_yield"), rate(status == "contradicted").alias("contradicted_rate"),
        rate(status == "unverifiable").alias("unverifiable_rate"), F.count("*").alias("n_records"), F.count_distinct("group_id").alias("n_groups"), F.count_if(answered).alias("n_answered"),
    )


def risk_coverage(df: DataFrame, mixture: dict[str, float] = MIXTURE, by: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Coverage and unsupported rate at each distinct score of eligible rows, ties together.

    Sums by score come first, so the running sum is over distinct scores, not rows.
    """
    rows = weights(df, mixture, by, check).where("eligible")
    bad = F.when(F.col("support_status").isin("contradicted", "unverifiable"), F.col("weight")).otherwise(0.0)
    steps = rows.groupBy(*by, F.col("score").alias("threshold")).agg(F.sum("weight").alias("_w"), F.sum(bad).alias("_b"))
    run = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"coverage": F.sum("_w").over(run), "_bad": F.sum("_b").over(run)})
    return steps.select(*by, "threshold", "coverage", (F.col("_bad") / F.nullif(F.col("coverage"), F.lit(0.0))).alias("unsupported_rate"))


def choose_thresholds(df: DataFrame, targets: Sequence[float] = (0.8,), by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """For each target the threshold whose coverage comes nearest, the largest of equally near ones; 1.000001 answers nothing.

    df: score, eligible. Non-finite scores are an error, and so is an empty table. df is read once: sums by score and
    eligibility are settled first, and all else comes from them.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sums = checkpointed(df.groupBy(*by, F.col("score").alias("threshold"), F.coalesce("eligible", F.lit(False)).alias("_ok")).agg(F.sum(w).alias("_w")))
    if sums.isEmpty():
        raise ContractError("no scores")
    score = F.col("threshold")
    require_none(sums.where(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).select(score.alias("score")), "scores must be finite")
    total = sums.groupBy(*by).agg(F.sum("_w").alias("_all"), F.sum(F.when(F.col("_ok"), F.col("_w")).otherwise(0.0)).alias("_most"))
    steps = sums.where("_ok")
    steps = steps.withColumn("_c", F.sum("_w").over(Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)))
    none = total.select(*by, F.lit(1.000001).alias("threshold"), F.lit(0.0).alias("_c"))
    steps = steps.select(*by, "threshold", "_c").unionByName(none)
    steps = steps.join(total, list(by)) if by else steps.crossJoin(F.broadcast(total))  # total is one row
    steps = steps.withColumns({"coverage": F.col("_c") / F.col("_all"), "max_eligible_coverage": F.col("_most") / F.col("_all"), "target": F.explode(F.array(*[F.lit(float(t)) for t in targets]))})
    steps = steps.withColumn("_e", F.abs(F.col("coverage") - F.col("target")))
    least = F.min("_e").over(Window.partitionBy(*by, "target"))
    near = steps.withColumn("_m", least).where(F.col("_e") - F.col("_m") <= 1e-8 + 1e-5 * F.abs("_m"))
    return near.groupBy(*by, "target").agg(F.max_by(F.struct("threshold", "coverage", "max_eligible_coverage"), "threshold").alias("s")).select(*by, "target", "s.*")


# Each method's score and who may answer.
METHODS = {"M2": ("joint_confidence", False), "M3": ("generic", False), "M6": ("joint_confidence", True), "M7": ("pcsi", True)}


def by_method(scored: DataFrame) -> DataFrame:
    """A row for each candidate and method, with score and eligible."""
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(s).alias("score"), (F.col("informative") & (F.col("gate") if gated else F.lit(True))).alias("eligible")) for m, (s, gated) in METHODS.items()])
    return scored.withColumn("_m", F.explode(rows)).select(*scored.columns, "_m.*")


def policy_thresholds(scored: DataFrame, targets: Sequence[float] = (0.5, 0.7, 0.8, 0.9), mixture: dict[str, float] = MIXTURE) -> DataFrame:
    rows = weights(by_method(scored), mixture, ["method"])
    return choose_thresholds(rows, targets, ["method"], "weight")


def policy_accept(scored: DataFrame, thresholds: DataFrame, target: float = 0.8, seed: int = 0) -> DataFrame:
    """scored by method with accepted; thresholds has a row a method and target (broadcast: methods are four)."""
    at = thresholds.where(F.abs(F.col("target") - target) < 1e-9).select("method", "threshold")
    return by_method(scored).join(F.broadcast(at), "method").withColumn("accepted", F.col("eligible") & (F.col("score") >= F.col("threshold"))).withColumn("seed", F.lit(seed))


def attach_outcomes(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Outcomes by candidate; repeated equal ones are one; a second one, or none, is an error."""
    from .contracts import join_checked

    return join_checked(predictions, ratings.select("candidate_id", "support_status").dropDuplicates(), ["candidate_id"], complete=True)


def holm(df: DataFrame, p: str = "p_value", by: Sequence[str] = ()) -> DataFrame:
    """df with adjusted: running maximum of (n - rank) p, at most 1. Values outside [0, 1] are an error.

    Of tied values the first has the largest product, so distinct values with their counts are all that is sorted.
    """
    require_none(df.where(~F.coalesce(F.col(p).between(0, 1) & ~F.isnan(p), F.lit(False))).select(p), "invalid p-value")
    steps = ranged(df.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "_p")
    cells = steps.groupBy(*by, "_range").agg(F.sum("_n").alias("_m"))
    cells = cells.select(*by, "_range", F.sum("_m").over(Window.partitionBy(*by).orderBy(F.desc("_range"))).alias("_left"))  # those from this range on
    match = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, "_range"]]
    inside = Window.partitionBy(*by, "_range").orderBy("_p")
    steps = steps.alias("a").join(cells.alias("b"), match("a", "b")).select("a.*", "_left")
    steps = steps.withColumn("_s", (F.col("_left") - F.sum("_n").over(inside) + F.col("_n")) * F.col("_p"))
    most = steps.groupBy(*by, "_range").agg(F.max("_s").alias("_most"))
    most = most.select(*by, "_range", F.max("_most").over(before(by)).alias("_most"))
    steps = steps.withColumn("_s", F.max("_s").over(inside)).alias("a").join(most.alias("b"), match("a", "b"))
    steps = steps.select("a.*", F.least(F.greatest("_s", "_most"), F.lit(1.0)).alias("_adjusted"))
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col(f"d.{p}") == F.col("s._p")]
    return df.alias("d").join(steps.alias("s"), keys).select("d.*", F.col("s._adjusted").alias("adjusted"))


def conformal_threshold(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """q, n_groups, rank: the ceil((n + 1)(1 - alpha))-th of the groups' largest nonconformities; null (infinite) beyond n."""
    require_none(df.where(~F.col("y").isin(0, 1)).select("y"), "labels must be 0 or 1")
    most = df.groupBy("group_id").agg(F.max(F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))).alias("s"))
    n = most.count()
    if not n:
        raise ContractError("no calibration groups")
    k = -int(-(n + 1) * (1 - alpha) // 1)
    ranked = numbered(most, ["s", "group_id"])
    return ranked.agg(F.max(F.when(F.col("_r") == k - 1, F.col("s"))).alias("q"), F.lit(n).cast("long").alias("n_groups"), F.lit(k).cast("long").alias("rank"))


def prediction_sets(df: DataFrame, q: Column) -> DataFrame:
    bound = F.coalesce(q, F.lit(float("inf")))
    return df.withColumns({"include_unsupported": F.col("p") <= bound, "include_supported": (1 - F.col("p")) <= bound})
