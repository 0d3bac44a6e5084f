"""Bootstrap over groups from sufficient sums: rows are aggregated once, replicates are joins with a table of draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import MIXTURE, ContractError, require_none
from .metrics import share_of
from .ranges import checkpointed, numbered, with_small


def drawn(n: Column, *what: Column) -> Column:
    """A number from 0 to n - 1 from md5 of what, joined by colons."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *what)), 1, 8), 16, 10).cast("long"), n)


def hashed_draws(groups: DataFrame, replicates: int, seed: int | None = None) -> DataFrame:
    """(b, group_id, m): how often each replicate draws each group, from a hash, on the executors.

    Draw i of replicate b takes the group whose rank is that of md5(b:i), with a seed md5(seed:b:i); SQL can repeat it.
    """
    ranked = numbered(groups.select("group_id").distinct(), ["group_id"])
    n = ranked.count()
    b, i = F.floor(F.col("id") / n).cast("int"), F.col("id") % n
    salt = [] if seed is None else [F.lit(str(seed))]
    picks = groups.sparkSession.range(replicates * n).select(b.alias("b"), drawn(F.lit(n), *salt, b, i).alias("_r"))
    return picks.groupBy("b", "_r").agg(F.count("*").cast("int").alias("m")).join(ranked, "_r").select("b", "group_id", "m")


#: Groups whose counts one task draws at once, for all replicates.
DRAWN = 1024


def range_counts(n: int, which: int, replicates: int, seed: int, width: int = DRAWN) -> np.ndarray:
    """(replicates, groups of the range): how often each replicate of n draws takes each group of range `which`.

    n draws are split over halves of the ranges by binomials, and again, until a range is left: each split is drawn from
    a generator named by the seed and the half, so every task that descends to its range sees the same numbers, and the counts of all
    ranges together are multinomial, as n draws with replacement are.
    """
    low, high = 0, -(-n // width)
    count = np.full(replicates, n, np.int64)
    size = lambda a, b: min(n, b * width) - a * width
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(count, size(low, middle) / size(low, high))
        low, high, count = (low, middle, left) if which < middle else (middle, high, count - left)
    k = size(low, high)
    return np.random.default_rng([seed, low, high, 1]).multinomial(count, np.full(k, 1 / k))


def bootstrap_sums(df: DataFrame, by: Sequence[str], columns: Sequence[str], replicates: int = 1000, seed: int = 0, width: int = DRAWN) -> DataFrame:
    """(b, *by, *columns): sums of the columns of rows (group_id, by, columns) over groups drawn with replacement.

    Groups are numbered in their order and `width` of them at a time meet in a task, which multiplies their counts with
    their sums and returns a row a value of by, with an array over the replicates. So rows grow with the groups, not
    with groups times replicates, and no table of draws is made. A row b, by is missing if no group of it was drawn
    in any replicate; sums of columns are 0 where it was drawn in others. Reruns agree.
    """
    by, columns = list(by), list(columns)
    ids = checkpointed(numbered(df.select("group_id").distinct(), ["group_id"]))
    n = ids.count()
    rows = with_small(df.select("group_id", *by, *[F.col(c).cast("double").alias(c) for c in columns]), ids, ["group_id"]).withColumn("_range", F.floor(F.col("_r") / width))
    arrays = [f"{c} array<double>" for c in columns]
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema] if by else []

    def drawn_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        which = int(pdf["_range"].iloc[0])
        counts = range_counts(n, which, replicates, seed, width).astype(np.float64)
        out = []
        for key, part in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
            at = part["_r"].to_numpy() - which * width
            sums = counts[:, at] @ part[columns].to_numpy(np.float64)
            out.append((*key, *[sums[:, i].tolist() for i in range(len(columns))]))
        return pd.DataFrame(out, columns=[*by, *columns])

    found = rows.groupBy("_range").applyInPandas(drawn_sums, ", ".join([*keys, *arrays]))
    return by_replicate(found, by, columns)


def by_replicate(found: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(b, *by, *columns) added up from rows of (by, an array over the replicates for each column)."""
    zipped = F.posexplode(F.arrays_zip(*columns)).alias("b", "_x")
    return found.select(*by, zipped).select(F.col("b").cast("int").alias("b"), *by, *[F.col("_x")[c].alias(c) for c in columns]).groupBy("b", *by).agg(*[F.sum(c).alias(c) for c in columns])


#: Groups whose hashed draws meet in one task, and draws that a task packs at once. They deal out work; results don't depend on them.
HASHED, PACKED = 4096, 1 << 22


def hashed_sums(df: DataFrame, by: Sequence[str], columns: Sequence[str], replicates: int = 1000, seed: int | None = None, width: int = HASHED) -> DataFrame:
    """As bootstrap_sums, over the groups that hashed_draws takes.

    A draw travels as the two bytes of its group's place in a range of `width` groups, packed with the other draws of its
    replicate and range, so that what is shuffled is small beside a table of (b, group_id, m). A range's draws are
    counted where its groups' sums lie.
    """
    by, columns = list(by), list(columns)
    ids = checkpointed(numbered(df.select("group_id").distinct(), ["group_id"]))
    n = ids.count()
    rows = with_small(df.select("group_id", *by, *[F.col(c).cast("double").alias(c) for c in columns]), ids, ["group_id"]).withColumn("_range", F.floor(F.col("_r") / width)).drop("group_id")
    b, i = F.floor(F.col("id") / n).cast("int"), F.col("id") % n
    salt = [] if seed is None else [F.lit(str(seed))]
    picks = df.sparkSession.range(replicates * n).select(b.alias("b"), drawn(F.lit(n), *salt, b, i).alias("_r"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, at = np.concatenate([k for k, _ in held]), np.concatenate([a for _, a in held])
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            offsets = pa.py_buffer((2 * np.append(first, len(key))).astype(np.int32).tobytes())
            bits = pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(at[order].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(found // replicates, pa.int64()), pa.array(found % replicates, pa.int32()), bits], ["_range", "b", "at"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            r = batch.column("_r").to_numpy()
            held.append((r // width * replicates + batch.column("b").to_numpy(), (r % width).astype("<u2")))
            if sum(len(a) for _, a in held) >= PACKED:
                yield flush()
                held = []
        if held:
            yield flush()

    def counted(groups: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((replicates, width), np.int32)
        for one, at in zip(draws["b"], draws["at"], strict=True):
            counts[one] += np.bincount(np.frombuffer(at, "<u2"), minlength=width)
        out = []
        for key, part in groups.groupby(by, dropna=False, sort=False) if by else [((), groups)]:
            sums = counts[:, (part["_r"] % width).to_numpy()] @ part[columns].to_numpy(np.float64)
            out.append((*key, *[sums[:, k].tolist() for k in range(len(columns))]))
        return pd.DataFrame(out, columns=[*by, *columns])

    arrays = [f"{c} array<double>" for c in columns]
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema] if by else []
    draws = picks.mapInArrow(packed, "_range long, b int, at binary")
    found = rows.groupBy("_range").cogroup(draws.groupBy("_range")).applyInPandas(counted, ", ".join([*keys, *arrays]))
    return by_replicate(found, by, columns)


def group_sums(df: DataFrame) -> DataFrame:
    """By method, seed, domain and group: records, answers and unsupported answers, all that a replicate needs."""
    answered = F.col("accepted") & F.col("informative")
    bad = F.col("support_status").isin("contradicted", "unverifiable")
    return df.groupBy("method", "seed", "domain", "group_id").agg(F.count("*").alias("n"), F.count_if(answered).alias("a"), F.count_if(answered & bad).alias("u"))


def validate_paired(df: DataFrame, a: str, b: str) -> list:
    """The seeds; every method and seed has the same records, groups and domains."""
    rows = df.where(F.col("method").isin(a, b))
    require_none(rows.groupBy("method", "seed", "record_id").count().where("count > 1"), "repeated record")
    cells = rows.select("method", "seed").distinct()
    n = cells.count()
    seeds = sorted(r[0] for r in rows.select("seed").distinct().collect())  # a handful
    if n != 2 * len(seeds):
        raise ContractError("a method lacks a seed")
    require_none(rows.groupBy("record_id", "group_id", "domain").agg(F.count("*").alias("n")).where(F.col("n") != n), "cohorts differ")
    return seeds


def replicate_rates(sums: DataFrame, multiplicities: DataFrame, mixture: dict[str, float] = MIXTURE) -> DataFrame:
    """(b, method, seed, coverage, unsupported_rate): null rates without answers, no row if a domain has lost all groups."""
    at = sums.join(multiplicities, "group_id")
    return rates_of(at.groupBy("b", "method", "seed", "domain").agg(F.sum(F.col("m") * F.col("a") / F.col("n")).alias("a"), F.sum(F.col("m") * F.col("u") / F.col("n")).alias("u"), F.sum("m").alias("m")), mixture)


def rates_of(dom: DataFrame, mixture: dict[str, float]) -> DataFrame:
    """Rates by replicate, method and seed from the sums by domain; a domain of which no group was drawn counts as lost."""
    dom = dom.where("m > 0")
    share = share_of(F.col("domain"), mixture)
    out = dom.groupBy("b", "method", "seed").agg(F.sum(share * F.col("a") / F.col("m")).alias("coverage"), F.sum(share * F.col("u") / F.col("m")).alias("_u"), F.count("*").alias("_d"))
    return out.where(F.col("_d") == len(mixture)).select("b", "method", "seed", "coverage", (F.col("_u") / F.nullif(F.col("coverage"), F.lit(0.0))).alias("unsupported_rate"))


def paired_differences(rates: DataFrame, a: str, b: str) -> DataFrame:
    """(b, risk, coverage): means over seeds of method a less method b; a replicate with an undefined rate is left out."""
    sign = F.when(F.col("method") == a, 1.0).when(F.col("method") == b, -1.0)
    n = F.count_distinct("seed")
    return rates.where(F.col("method").isin(a, b)).groupBy("b").agg((F.sum(sign * F.col("unsupported_rate")) / n).alias("risk"), (F.sum(sign * F.col("coverage")) / n).alias("coverage"), F.count_if(F.col("unsupported_rate").isNull()).alias("_x"), F.count("*").alias("_c"), n.alias("_s")).where("_x = 0 and _c = 2 * _s").select("b", "risk", "coverage")


def paired_bootstrap(df: DataFrame, a: str = "M7", b: str = "M3", mixture: dict[str, float] = MIXTURE, replicates: int = 1000, seed: int = 0, margin: float = 0.05, multiplicities: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """One row: point differences, 95 % intervals (null with too few valid replicates), success. hashed: groups are drawn as hashed_draws draws them without a seed."""
    validate_paired(df, a, b)
    sums = group_sums(df.where(F.col("method").isin(a, b))).persist()
    whole = sums.select("group_id").distinct().select(F.lit(-1).alias("b"), "group_id", F.lit(1).alias("m"))
    if multiplicities is None:
        shares = sums.select("group_id", "method", "seed", "domain", (F.col("a") / F.col("n")).alias("a"), (F.col("u") / F.col("n")).alias("u"), F.lit(1.0).alias("m"))
        sums_of = hashed_sums(shares, ["method", "seed", "domain"], ["a", "u", "m"], replicates) if hashed else bootstrap_sums(shares, ["method", "seed", "domain"], ["a", "u", "m"], replicates, seed)
        rates = rates_of(sums_of, mixture).unionByName(replicate_rates(sums, whole, mixture))
    else:
        rates = replicate_rates(sums, multiplicities.unionByName(whole), mixture)
    diff = paired_differences(rates, a, b)
    rep = F.col("b") >= 0
    cut = lambda c: F.percentile(F.when(rep, F.col(c)), F.array(F.lit(0.025), F.lit(0.975)))
    one = diff.agg(F.max(F.when(~rep, F.col("risk"))).alias("risk_difference"), F.max(F.when(~rep, F.col("coverage"))).alias("coverage_difference"), F.count_if(rep).alias("valid"), cut("risk").alias("r"), cut("coverage").alias("c"))
    enough = F.col("valid") >= max(20, int(0.8 * replicates))
    at = lambda c, i: F.when(enough, F.col(c)[i])
    return one.select("risk_difference", "coverage_difference", F.col("valid").alias("bootstrap_valid"), at("r", 0).alias("risk_lo"), at("r", 1).alias("risk_hi"), at("c", 0).alias("coverage_lo"), at("c", 1).alias("coverage_hi"), F.coalesce(enough & (F.col("r")[1] < 0) & (F.col("c")[0] > -margin), F.lit(False)).alias("success"))


PARTS = ("answer", "assessable", "disagreement", "unassessable")


def foundation_groups(df: DataFrame) -> DataFrame:
    """Group means of answers, assessable answers, their disagreement, unassessable answers."""
    require_none(df.where("observed").where(~F.coalesce(F.col("agreement").between(0, 1) & ~F.isnan("agreement"), F.lit(False))).select("record_id"), "agreement outside [0, 1]")
    a, o = F.col("accepted"), F.col("observed")
    one = lambda c, v=F.lit(1.0): F.avg(F.when(c, v).otherwise(0.0))
    return df.groupBy("group_id").agg(one(a).alias("answer"), one(a & o).alias("assessable"), one(a & o, 1 - F.col("agreement")).alias("disagreement"), one(a & ~o).alias("unassessable"))


def foundation_intervals(df: DataFrame, replicates: int = 1000, seed: int = 0, multiplicities: DataFrame | None = None) -> DataFrame:
    """(metric, estimate, lo, hi, finite): participant-equal means over groups; disagreement among assessable answers."""
    if replicates < 20:
        raise ContractError("at least 20 replicates")
    groups = foundation_groups(df).persist()
    whole = groups.select(F.lit(-1).alias("b"), "group_id", F.lit(1).alias("m"))
    drawn_ = groups.join(whole if multiplicities is None else multiplicities.unionByName(whole), "group_id").groupBy("b").agg(*[F.sum(F.col("m") * F.col(p)).alias(p) for p in PARTS], F.sum("m").cast("double").alias("m"))
    if multiplicities is None:
        drawn_ = drawn_.unionByName(bootstrap_sums(groups.withColumn("m", F.lit(1.0)), [], [*PARTS, "m"], replicates, seed))
    mean = {p: F.col(p) / F.col("m") for p in PARTS}
    rows = drawn_.select("b", mean["answer"].alias("answer_coverage_all_records"), mean["assessable"].alias("assessable_answer_coverage"), (mean["disagreement"] / F.nullif(mean["assessable"], F.lit(0.0))).alias("panel_disagreement_among_assessable_answers"), mean["unassessable"].alias("unassessable_answer_coverage"))
    names = rows.columns[1:]
    long = rows.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("s")).select("b", "s.*")
    n_groups = groups.count()
    out = long.groupBy("metric").agg(F.max(F.when(F.col("b") < 0, F.col("v"))).alias("estimate"), F.percentile(F.when(F.col("b") >= 0, F.col("v")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.when(F.col("b") >= 0, F.col("v"))).alias("finite"))
    enough = (F.col("finite") >= max(20, int(0.8 * replicates))) & F.lit(n_groups >= 2)
    return out.select("metric", "estimate", F.when(enough, F.col("q")[0]).alias("lo"), F.when(enough, F.col("q")[1]).alias("hi"), "finite")


def calibration_bootstrap(long: DataFrame, multiplicities: DataFrame | None = None, bins: int = 15, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(b, log_loss, ece) by replicate from sums by group and bin; no row is copied."""
    from .targets import calibration_bins

    sums, columns = calibration_bins(long, bins, ["group_id"]), ("n", "sum_p", "sum_y", "loss")
    if multiplicities is None:
        cells = bootstrap_sums(sums, ["bin"], columns, replicates, seed)
    else:
        cells = sums.join(multiplicities, "group_id").groupBy("b", "bin").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in columns])
    return cells.groupBy("b").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))) / F.sum("n")).alias("ece"))


def pilot_precision(differences: DataFrame, sizes: tuple[int, ...] = (40, 60, 80, 120), replicates: int = 500, seed: int = 0) -> DataFrame:
    """(n_groups, mean_difference, ci_width): resampled means of pilot differences at planned sizes; under 8 is an error."""
    rows = [r[0] for r in differences.select("risk_difference").collect()]  # a row a pilot group
    if len(rows) < 8 or not np.isfinite(rows).all():
        raise ContractError("at least 8 finite pilot differences")
    rng, spark = np.random.default_rng(seed), differences.sparkSession
    means = [(n, float(m)) for n in sizes for m in rng.choice(np.array(rows), (replicates, n), replace=True).mean(1)]
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return spark.createDataFrame(means, "n_groups int, m double").groupBy("n_groups").agg(F.avg("m").alias("mean_difference"), (q[1] - q[0]).alias("ci_width"))


def two_arms(means: DataFrame, metric: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: difference of arm means with a 95 % interval; participants are drawn within each of exactly two arms."""
    arms = sorted(r[0] for r in means.select("arm").distinct().limit(3).collect())
    if len(arms) != 2:
        raise ContractError("exactly two arms")
    sizes = {r["arm"]: r["n"] for r in means.groupBy("arm").agg(F.count("*").alias("n")).collect()}  # two rows
    if min(sizes.values()) < 3:
        raise ContractError("at least 3 participants an arm")
    picks = None
    for sign, arm in ((1.0, arms[1]), (-1.0, arms[0])):
        n = sizes[arm]
        b, i = F.floor(F.col("id") / n).cast("int"), F.col("id") % n
        part = means.sparkSession.range(replicates * n).select(b.alias("b"), F.lit(arm).alias("arm"), drawn(F.lit(n), F.lit(str(seed)), F.lit(arm), b, i).alias("_r"), F.lit(sign / n).alias("w"))
        picks = part if picks is None else picks.unionByName(part)
    table = picks.groupBy("b", "arm", "_r").agg(F.sum("w").alias("w"))
    ranked = numbered(means, ["participant_id"], by=["arm"])
    reps = ranked.join(table, ["arm", "_r"]).groupBy("b").agg(F.sum(F.col("w") * F.col(metric)).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    point = means.agg((F.avg(F.when(F.col("arm") == arms[1], F.col(metric))) - F.avg(F.when(F.col("arm") == arms[0], F.col(metric)))).alias("difference"))
    return point.crossJoin(reps.agg(q[0].alias("lo"), q[1].alias("hi"))).withColumn("contrast", F.lit(f"{arms[1]}-{arms[0]}"))  # one row each
