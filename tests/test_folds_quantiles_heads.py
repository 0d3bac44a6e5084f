"""Exact quantiles, greedy folds and head training against plain Python and numpy."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import calibrate, entities, training
from quillon.operators.contracts import ContractError
from quillon.operators.quantiles import exact_quantiles


def plain_quantile(values, share):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    p = share * (len(values) - 1)
    a, f = int(p), p - int(p)
    return values[a] if f == 0 else values[a] * (1 - f) + values[a + 1] * f


@pytest.mark.parametrize("parts", [1, 11])
def test_quantiles(spark, parts):
    rng = random.Random(parts)
    shares = [0.0, 0.025, 0.5, 0.95, 1.0]
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("tied", float(rng.randint(0, 2))) for _ in range(500)] + [(None, 1.0), (None, 2.0), ("one", 7.0), ("none", None), ("hot", None), ("nan", float("nan")), ("nan", 1.0), ("inf", float("-inf")), ("inf", 0.0)]
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        df = spark.createDataFrame(rows, "g string, x double").repartition(4)
        got = {r["g"]: r for r in exact_quantiles(df, "x", shares, ["g"]).collect()}
        whole = exact_quantiles(df.where("g = 'hot'"), "x", shares).collect()
        empty = exact_quantiles(df.limit(0), "x", [0.5]).collect()
        assert exact_quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    for g in {r[0] for r in rows}:
        want = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(want)
        for q, s in zip(got[g]["q"], shares, strict=True):
            w = plain_quantile(want, s)
            assert q == w or (q is not None and w is not None and ((math.isnan(q) and math.isnan(w)) or abs(q - w) < 1e-12)), (g, s)
    assert len(whole) == 1 and whole[0]["q"] == got["hot"]["q"]
    assert [(r["n"], r["q"]) for r in empty] == [(0, [None])]
    with pytest.raises(ValueError):
        exact_quantiles(df, "x", [1.5])


def greedy(sizes, folds):
    weight, out = [0] * min(folds, max(1, len(sizes))), {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = weight.index(min(weight))
        out[g] = f
        weight[f] += n
    return out


@pytest.mark.parametrize("seed", range(40))
def test_dealt_is_the_greedy_deal(seed):
    rng = random.Random(seed)
    sizes = {f"{i:03d}": rng.choice([1, 1, 1, 2, 3, rng.randint(1, 40), rng.randint(1, 5) * 7]) for i in range(rng.randint(1, 120))}
    folds = min(rng.randint(1, 9), len(sizes))
    by_size = {}
    for g in sorted(sizes):
        by_size.setdefault(sizes[g], []).append(g)
    got = {}
    for n, stretches in entities.dealt([(n, len(by_size[n])) for n in sorted(by_size, reverse=True)], folds):
        for j, g in enumerate(by_size[n]):
            first, turn = [s for s in stretches if s[0] <= j][-1]
            got[g] = turn[(j - first) % len(turn)]
    assert got == greedy(sizes, folds)


def test_balanced_folds(spark):
    rng = random.Random(5)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 2, 5, 9, 300 if i < 2 else 1]) for i in range(150)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)], "group_id string").repartition(5)
    got = entities.balanced_folds(df, 4).collect()
    assert {r["group_id"]: r["fold"] for r in got} == greedy(sizes, 4) and {r["group_id"]: r["n"] for r in got} == sizes
    assert {r["fold"] for r in entities.balanced_folds(df.where("group_id < 'g002'"), 5).collect()} == {0, 1}
    assert entities.balanced_folds(df.limit(0), 4).count() == 0
    with pytest.raises(ContractError):
        calibrate.ridge_cv(df.where("group_id < 'g002'").select("group_id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), {"m": ("x",)}, "y")


def numpy_heads(x, y, mask, valid, rate, epochs, patience, decay):
    """x (n, d); y and mask (n, labels); one AdamW run on all rows at once."""
    train = ~valid
    mean = np.array([x[train & (mask[:, k] > 0)].mean(0) for k in range(y.shape[1])])
    sd = np.array([x[train & (mask[:, k] > 0)].std(0) for k in range(y.shape[1])])
    z = np.stack([np.c_[(x - mean[k]) / sd[k], np.ones(len(x))] for k in range(y.shape[1])])
    p = np.array([y[train & (mask[:, k] > 0), k].mean() for k in range(y.shape[1])])
    w = np.zeros((y.shape[1], x.shape[1] + 1))
    w[:, -1] = np.log(p / (1 - p))
    m, v, best, kept, at = np.zeros_like(w), np.zeros_like(w), np.inf, w, -1
    n = (mask[train] > 0).sum()
    for epoch in range(epochs):
        s = 1 / (1 + np.exp(-np.einsum("kni,ki->nk", z, w)))
        e = (s - y) * (mask > 0) * train[:, None]
        g = np.einsum("nk,kni->ki", e, z) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w * (1 - rate * decay) - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        s = np.einsum("kni,ki->nk", z, w)
        loss = ((np.logaddexp(0, s) - y * s) * (mask > 0))[valid].sum() / (mask[valid] > 0).sum()
        if loss < best - 1e-8:
            best, kept, at = loss, w.copy(), epoch
        elif epoch - at >= patience:
            return best, kept, at, epoch + 1
    return best, kept, at, epochs


def test_heads_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3)) * [1, 5, 0.2] + [0, 2, 1]
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=(3, 2)) + rng.normal(size=(150, 2)) * 2)))
    y[:, 0] = y[:, 0] > 0.5
    mask, valid = (rng.random((150, 2)) < 0.8).astype(int), np.arange(150) % 3 == 0
    rows = [("validation" if valid[i] else "train", f"l{k}", float(y[i, k]), int(mask[i, k]), *map(float, x[i])) for i in range(150) for k in range(2)]
    df = spark.createDataFrame([*rows, ("train", "masked", 1.0, 0, 1.0, 1.0, 1.0)], "split string, label string, y double, mask int, a double, b double, c double")
    rates = (0.5, 0.05, 0.005)
    heads = training.Heads(("a", "b", "c"), rates, epochs=14, patience=3).fit(df)
    lengths = {r["rate"]: r for r in heads.runs(df).collect()}
    for r in rates:
        loss, w, at, ran = numpy_heads(x, y, mask, valid, r, 14, 3, 1e-4)
        assert abs(lengths[r]["loss"] - loss) < 1e-9 and (lengths[r]["best_epoch"], lengths[r]["epochs"]) == (at, ran)
        assert np.allclose([heads.weights[r][f"l{k}"] for k in range(2)], w, atol=1e-9)
    assert len({lengths[r]["epochs"] for r in rates}) > 1  # some stop early
    best = calibrate.grid_best(heads.runs(df).withColumn("head", F.lit("h")), tie="rate").first()
    assert best["rate"] == heads.chosen() == min(rates, key=lambda r: lengths[r]["loss"])
    scored = heads.predict(df)
    assert scored.where("p is null").select("label").distinct().collect()[0]["label"] == "masked" and scored.count() == df.count()
    for bad in (df.where("split = 'train'"), df.where("mask = 0")):
        with pytest.raises(ContractError):
            training.Heads(("a",), (0.1,)).fit(bad)
    with pytest.raises(ContractError):
        training.Heads(("a",), (0.1,)).fit(df.withColumn("y", F.lit(2.0)))


def test_heads_of_many_features_take_seconds(spark):
    """64 features of 10 labels: expressions of that many terms once fell out of code generation, and a fit took minutes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 64))
    y = (x[:, :10] > 0).astype(float)
    rows = [("validation" if i % 4 == 0 else "train", k, float(y[i, k]), 1, *map(float, x[i])) for i in range(200) for k in range(10)]
    names = [f"f{i}" for i in range(64)]
    df = spark.createDataFrame([*rows, ("train", 0, 1.0, 1, None, *[1.0] * 63)], "split string, label int, y double, mask int, " + ", ".join(f"{n} double" for n in names))
    start = time.time()
    heads = training.Heads(names, (0.1,), epochs=4, patience=3).fit(df.where("f0 is not null"))
    assert time.time() - start < 60
    loss, w, _, _ = numpy_heads(x, y, np.ones((200, 10), int), np.arange(200) % 4 == 0, 0.1, 4, 3, 1e-4)
    assert np.allclose([heads.weights[0.1][k] for k in range(10)], w, atol=1e-9) and abs(heads.best[0.1][0] - loss) < 1e-9
    lacking = training.Heads(names, (0.1,), epochs=1).fit(df)  # a row without a feature counts in no gradient
    assert np.isfinite(lacking.weights[0.1][0]).all()
