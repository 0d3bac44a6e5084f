"""Distributed order against sorting in Python; draws, heads and neighbours against plain loops."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import calibrate, entities, metrics, ranges, resample


@pytest.mark.parametrize("n", [0, 1, 19, 700, 5000])
@pytest.mark.parametrize("kind", ["string", "double"])
def test_numbered(spark, n, kind):
    rng = random.Random(n)
    keys = [rng.choice(["", "é", "zz", f"k{rng.random()}"]) if kind == "string" else rng.choice([0.5, float("inf"), rng.gauss(0, 9)]) for _ in range(n)]
    rows = [(g, None if i % 97 == 5 else k, i) for i, k in enumerate(keys) for g in [i % 3]]
    df = spark.createDataFrame(rows, f"g int, k {kind}, i int").repartition(7)
    by_key = lambda r: (r[1] is not None, (r[1].encode() if kind == "string" else r[1]) if r[1] is not None else 0, r[2])
    want = {r[2]: place for place, r in enumerate(sorted(rows, key=by_key))}
    assert {r["i"]: r["_r"] for r in ranges.numbered(df, ["k", "i"]).collect()} == want
    inner = {r[2]: place for g in range(3) for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=by_key))}
    assert {r["i"]: r["at"] for r in ranges.numbered(df, ["k", "i"], "at", ["g"]).collect()} == inner


def test_no_task_holds_much_of_the_table(spark):
    """One value of `by` has most rows, and half of the keys begin alike; the ranges are even all the same."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.lit("")), F.md5(F.col("id").cast("string"))).alias("k"))
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        sizes = [r["count"] for r in ranges.ranged(df, "g", "k").groupBy("_range").count().collect()]
        got = {(r["g"], r["k"]): r["_r"] for r in ranges.numbered(df, ["k"], by=["g"]).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(sizes) == 20 and max(sizes) <= 2 * 5000 / 20
    keys = sorted(got)
    assert all(got[k] == i - next(j for j, x in enumerate(keys) if x[0] == k[0]) for i, k in list(enumerate(keys))[::97])


@pytest.mark.parametrize("by", [(), ("g",)])
def test_holm(spark, by):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.0, 0.001, rng.random() ** 6]), i) for i in range(2000)]
    got = {r["i"]: r["adjusted"] for r in metrics.holm(spark.createDataFrame(rows, "g string, p_value double, i int"), by=by).collect()}
    want = {}
    for g in {r[0] if by else 0 for r in rows}:
        mine, most = sorted((r for r in rows if not by or r[0] == g), key=lambda r: r[1]), 0.0
        for k, r in enumerate(mine):
            most = max(most, (len(mine) - k) * r[1])
            want[r[2]] = min(most, 1.0)
    assert len(got) == len(rows) and all(abs(got[i] - v) < 1e-9 for i, v in want.items())


def test_draws(spark):
    groups = spark.createDataFrame([(f"p{i}",) for i in range(60)], "group_id string")
    one, again, other = ({(r["b"], r["group_id"]): r["m"] for r in resample.hashed_draws(groups, 30, seed).collect()} for seed in (1, 1, 2))
    assert one == again != other
    assert all(sum(m for (b, _), m in one.items() if b == k) == 60 for k in range(30))


def test_linear_head_is_each_label_alone(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-(a * s + b)))), int(rng.random() < 0.8)) for k, s in (("u", 2), ("v", -1)) for a, b in rng.normal(size=(150, 2))]
    long = spark.createDataFrame([*rows, ("unseen", 1.0, 1.0, 1.0, 0)], "label string, a double, b double, y double, mask int")
    heads = calibrate.linear_head(long, ("a", "b"))
    assert sorted(heads) == ["u", "v"]
    for k, head in heads.items():
        alone = calibrate.SoftLogistic(("a", "b")).fit(long.where((F.col("label") == k) & (F.col("mask") > 0)))
        assert np.allclose(head.weights, alone.weights, atol=1e-7) and np.allclose(head.mean, alone.mean)


@pytest.mark.parametrize("distance", [0, 3, 5])
def test_near_hashes(spark, distance):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    for h in hashes[:20]:
        near = h
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            near ^= 1 << bit
        hashes.append(near)
    rows = [(i, f"{h:016x}") for i, h in enumerate(hashes)]
    got = {(r["record_a"], r["record_b"]): r["hamming"] for r in entities.near_hashes(spark.createDataFrame([*rows, (99, None)], "record_id int, dhash string"), distance).collect()}
    want = {(a, b): (x ^ y).bit_count() for (a, x), (b, y) in combinations(enumerate(hashes), 2) if (x ^ y).bit_count() <= distance}
    assert got == want and want
