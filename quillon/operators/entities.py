"""Entities: components over shared keys, near-duplicate hashes, group-safe splits, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dhash_bands, group_id, hamming
from .contracts import SPLITS, ContractError, require_none, require_unique, unmatched
from .ranges import SMALL, checkpointed, numbered

# Keys that tie records together.
KEYS = ("collection_group_id", "participant_id", "household_pseudonym", "session_id", "batch_id", "focal_product_family_id", "sha256")


def near_hashes(df: DataFrame, distance: int = 3, key: str = "record_id", dhash: str = "dhash") -> DataFrame:
    """All pairs (record_a < record_b) of 64-bit hex hashes at Hamming distance <= distance, exactly.

    distance + 3 bands: two hashes that differ in at most `distance` bits agree in three bands at least, so an equi-join
    on every choice of three finds every pair. At distance 3 that is 20 keys of about 32 bits a hash: chance matches grow
    with n^2 / 2^32, where four single bands of 16 bits would grow with n^2 / 2^16. Equal hashes are one hash until the
    end, so a hash that many records share meets the others once.
    """
    cuts = [round(i * 64 / (distance + 3)) for i in range(distance + 4)]
    records = df.select(F.col(key).alias("r"), F.col(dhash).alias("h")).where("h is not null")
    bits = F.concat(*[F.lpad(F.conv(F.substring("h", 1 + 4 * i, 4), 16, 2), 16, "0") for i in range(4)])
    quarter = dhash_bands(F.col("h"))
    rows = records.select("h").distinct().select("h", *[q.alias(f"q{i}") for i, q in enumerate(quarter)], bits.alias("bits"))
    band = [F.substring("bits", a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    choices = [F.struct(F.lit(n).alias("i"), F.concat(*[band[i] for i in three]).alias("s")) for n, three in enumerate(combinations(range(len(band)), 3))]
    rows = rows.withColumn("band", F.explode(F.array(*choices))).select("h", "q0", "q1", "q2", "q3", F.col("band.i").alias("i"), F.col("band.s").alias("s"))
    other = rows.select(F.col("h").alias("h2"), *[F.col(f"q{i}").alias(f"p{i}") for i in range(4)], "i", "s")
    gap = hamming([F.col(f"q{i}") for i in range(4)], [F.col(f"p{i}") for i in range(4)]).cast("int")
    near = rows.join(other, ["i", "s"]).where("h < h2").select("h", "h2", gap.alias("hamming")).where(F.col("hamming") <= distance).distinct()
    far = records.select(F.col("r").alias("r2"), F.col("h").alias("h2"))
    across = records.join(near, "h").join(far, "h2").select(F.least("r", "r2").alias("record_a"), F.greatest("r", "r2").alias("record_b"), "hamming")
    same = records.join(far.withColumnRenamed("h2", "h"), "h").where("r < r2").select(F.col("r").alias("record_a"), F.col("r2").alias("record_b"), F.lit(0).alias("hamming"))
    return across.where("record_a < record_b").unionByName(same).distinct()


def propose_near_duplicates(df: DataFrame, distance: int = 3) -> DataFrame:
    return near_hashes(df, distance).withColumn("approved", F.lit(False))


def min_labels(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for undirected edges (u, v): hook to the least neighbour, jump, contract, until no edge is left."""
    edges = edges.where("u <> v").select("u", "v")
    cur = checkpointed(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    nodes = cur.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    for _ in range(rounds):
        if cur.isEmpty():
            return nodes
        up = cur.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")).checkpoint()
        nodes = nodes.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")).checkpoint()
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        cur = cur.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct().checkpoint()
    raise ContractError("components did not settle")


def build_components(records: DataFrame, edges: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """records with root (least record_id of the component) and group_id. Records that share a non-blank key, or an approved edge, belong together."""
    require_unique(records, ["record_id"], "records")
    used = [k for k in keys if k in records.columns]
    links = records.select("record_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("x")) for k in used])).alias("s")).where("s.x is not null and s.x <> ''") if used else None
    pairs = records.select(F.col("record_id").alias("u"), F.col("record_id").alias("v")).limit(0)
    if links is not None:
        least = links.groupBy("s").agg(F.min("record_id").alias("v"))
        pairs = links.join(least, "s").select(F.col("record_id").alias("u"), "v")
    if edges is not None:
        for end in ("record_a", "record_b"):
            require_none(unmatched(edges.withColumnRenamed(end, "record_id"), records, ["record_id"]).select("record_id"), "edge to an unknown record")
        good = edges.where(F.lower(F.col("approved").cast("string")).isin("true", "1"))
        pairs = pairs.union(good.select(F.col("record_a").alias("u"), F.col("record_b").alias("v")))
    roots = min_labels(pairs).withColumnRenamed("node", "record_id")
    out = records.join(roots, "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
    return out.withColumn("group_id", group_id(F.col("root").cast("string")))


def split_sizes(n: int, fractions: dict[str, float]) -> dict[str, int]:
    """Largest remainders: floors first, what is left to the largest fractional parts, the earlier on ties."""
    if abs(sum(fractions.values()) - 1) > 1e-8 or min(fractions.values()) <= 0:
        raise ContractError("fractions must be positive and sum to 1")
    if n < max(8, 2 * len(fractions)):
        raise ContractError("too few groups to split")
    exact = {k: f * n for k, f in fractions.items()}
    sizes = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: -(exact[k] - int(exact[k])))[: n - sum(sizes.values())]:
        sizes[k] += 1
    if min(sizes.values()) == 0:
        raise ContractError("an empty split")
    return sizes


def grouped_split(records: DataFrame, fractions: dict[str, float] = SPLITS, seed: int = 0, order: Column | None = None) -> DataFrame:
    """records with split; groups are kept whole, in the order of a seeded hash (md5 of seed and id), cut into ranges."""
    groups = records.select("group_id").distinct()
    sizes = split_sizes(groups.count(), fractions)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string"))) if order is None else order
    split, until = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        until += n
        split = F.coalesce(split, F.when(F.col("_rank") < until, F.lit(name)))
    ranked = numbered(groups.withColumn("_key", order), ["_key", "group_id"], "_rank")
    return records.join(ranked.select("group_id", split.alias("split")), "group_id")


def leaks(df: DataFrame, key: str, within: str = "split") -> DataFrame:
    """Keys, blank ones apart, that occur with several values of within."""
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count_distinct(within).alias("n_" + within)).where(f"n_{within} > 1")


def validate_split(df: DataFrame, keys: Sequence[str] = ("group_id", *KEYS)) -> DataFrame:
    require_unique(df, ["record_id"], "split")
    require_none(df.where("split is null").select("record_id"), "record without split")
    for k in (k for k in keys if k in df.columns):
        require_none(leaks(df, k), f"{k} in several splits")
    return df


def cohort_split(components: DataFrame, fractions: dict[str, float] = SPLITS, seed: int = 0) -> DataFrame:
    """Only the main cohort is split; others keep their cohort as split; a group in two cohorts is an error."""
    require_none(leaks(components, "group_id", "cohort"), "group in several cohorts")
    main = grouped_split(components.where("cohort = 'main'"), fractions, seed)
    rest = components.where("cohort <> 'main'").withColumn("split", F.col("cohort"))
    return main.unionByName(rest, allowMissingColumns=True)


def oof_folds(groups: DataFrame, folds: int = 4, seed: int = 0, inner: float = 0.2) -> DataFrame:
    """(group_id, fold, early_stop): the first n mod folds folds have one group more; of each fold's training groups a
    half-even rounded share stops early, so the pair (group, fold) has a row for each fold that trains on the group."""
    n = groups.distinct().count()
    keyed = groups.distinct().withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string"))))
    ordered = numbered(keyed, ["_key", "group_id"])
    big, size = n % folds, n // folds
    fold = F.when(F.col("_r") < big * (size + 1), F.floor(F.col("_r") / (size + 1))).otherwise(big + F.floor((F.col("_r") - big * (size + 1)) / max(size, 1))).cast("int")
    held = ordered.select("group_id", fold.alias("fold"))
    train = held.withColumn("trains", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))))
    train = train.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:inner:"), F.col("trains").cast("string"), F.lit(":"), F.col("group_id").cast("string"))))
    totals = train.groupBy("trains").agg(F.count("*").alias("_total"))  # a row a fold
    train = numbered(train, ["_key", "group_id"], "_rank", ["trains"]).join(F.broadcast(totals), "trains")
    return train.select("group_id", F.col("fold").alias("held_in"), F.col("trains").alias("fold"), (F.col("_rank") < F.bround(F.col("_total") * inner, 0)).alias("early_stop"))


def validate_oof(ledger: DataFrame) -> DataFrame:
    """Candidates unique and of the fit split; a row's group neither trained nor stopped its own fold."""
    require_unique(ledger, ["candidate_id"], "ledger")
    require_none(ledger.where("split <> 'fit'").select("candidate_id"), "candidate outside fit")
    seen = lambda c: F.array_contains(F.from_json(c, "array<string>"), F.col("group_id").cast("string"))
    require_none(ledger.where(seen("training_group_ids") | seen("early_stop_group_ids")).select("candidate_id"), "out-of-fold leak")
    return ledger


def dealt(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, [(first group, folds in turn)]) of the greedy deal, for sizes with their numbers of groups, largest first.

    Groups of one size s go, one after another, to the lightest fold, so fold f gets its i-th of them when w_f + i s is the
    next number in order. In each stretch of s numbers, every fold that has been reached occurs once, in the order of
    w_f mod s. So the deal is a few repeated patterns, one more each time that a heavier fold is reached.
    """
    weight, out = [0] * folds, []
    for size, count in sizes:
        level, rest = [w // size for w in weight], [w % size for w in weight]
        stretches, done = [], 0
        steps = sorted(set(level))
        for here, beyond in zip(steps, [*steps[1:], None], strict=True):
            turn = sorted((f for f in range(folds) if level[f] <= here), key=lambda f: (rest[f], f))
            take = count - done if beyond is None else min(count - done, (beyond - here) * len(turn))
            if take:
                stretches.append((done, turn))
                for i, f in enumerate(turn):
                    weight[f] += size * (take // len(turn) + (i < take % len(turn)))
                done += take
        out.append((size, stretches))
    return out


def balanced_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """(group_id, n, fold): greedy group k-fold, the largest group first (of equal ones the least id), each into the lightest fold.

    Only the histogram of sizes reaches the driver, a row a distinct size (fewer than sqrt(2 * rows)); a group then finds
    its fold from its number among the groups of its size. With fewer groups than folds there are as many folds as groups.
    """
    groups = checkpointed(rows.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n")))
    sizes = [(r["n"], r["k"]) for r in groups.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()]
    turns = dealt(sizes, max(1, min(folds, sum(k for _, k in sizes))))
    table = rows.sparkSession.createDataFrame(turns, "n long, _turns array<struct<first:long,turn:array<int>>>")
    at = F.element_at(F.filter("_turns", lambda t: t["first"] <= F.col("_j")), -1)
    ranked = numbered(groups, ["group_id"], "_j", ["n"]).join(F.broadcast(table) if len(turns) <= SMALL else table, "n").withColumn("_at", at)
    return ranked.select("group_id", "n", F.get("_at.turn", ((F.col("_j") - F.col("_at.first")) % F.size("_at.turn")).cast("int")).alias("fold"))


def lineage(spark: SparkSession, assets: DataFrame, purpose: str = "research", depth: int = 64) -> DataFrame:
    """(asset_id, ancestor, distance) of a DAG of assets with parent_asset_ids and permitted_<purpose>_use.

    A missing parent, a cycle, or an asset or ancestor without permission is an error.
    """
    edges = checkpointed(assets.select(F.col("asset_id"), F.explode("parent_asset_ids").alias("ancestor")).distinct())
    require_none(unmatched(edges.select(F.col("ancestor").alias("asset_id")), assets.hint("merge"), ["asset_id"]), "unknown parent")
    require_none(assets.where(~F.coalesce(F.col(f"permitted_{purpose}_use"), F.lit(False))).select("asset_id"), f"not permitted for {purpose}")
    require_none(edges.where("asset_id = ancestor").select("asset_id"), "cycle")
    # each step is settled, so that the next reads its rows and not the joins that made them; merged, so that none fills the driver
    reach = frontier = edges.withColumn("distance", F.lit(1))
    for step in range(2, depth):
        nxt = frontier.join(edges.select(F.col("asset_id").alias("ancestor"), F.col("ancestor").alias("far")).hint("merge"), "ancestor").select("asset_id", F.col("far").alias("ancestor"), F.lit(step).alias("distance"))
        frontier = checkpointed(nxt.join(reach.hint("merge"), ["asset_id", "ancestor"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        require_none(frontier.where("asset_id = ancestor").select("asset_id"), "cycle")
        reach = reach.union(frontier)
    return reach
