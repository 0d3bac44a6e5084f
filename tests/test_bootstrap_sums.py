"""Counts of a bootstrap drawn by ranges: they are multinomial, and sums are those of the counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import resample
from quillon.operators.targets import calibration_bins


def counts_of(n, replicates, seed):
    return np.concatenate([resample.range_counts(n, r, replicates, seed, 8) for r in range(-(-n // 8))], 1)


@pytest.mark.parametrize("n", [1, 7, 40, 41])
def test_counts_are_multinomial(n):
    c = counts_of(n, 20_000, 3)
    assert c.shape == (20_000, n) and (c.sum(1) == n).all() and (c >= 0).all()
    if n > 1:
        assert np.abs(c.mean(0) - 1).max() < 0.05 and np.abs(c.var(0) - (1 - 1 / n)).max() < 0.06
        both = np.cov(c.T)
        assert np.abs(both[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.06  # within a range and between ranges alike
    assert (counts_of(n, 50, 3) == counts_of(n, 50, 3)).all() and (n == 1 or (counts_of(n, 50, 3) != counts_of(n, 50, 4)).any())


def test_sums_are_those_of_the_counts(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{g:02d}", k, float(x), 1.0) for g in range(30) for k, x in zip(["a", "b", None], rng.normal(size=3), strict=True) if g % 3 or k]
    df = spark.createDataFrame(rows, "group_id string, k string, x double, m double")
    for parts in (1, 7):
        got = {(r["b"], r["k"]): (r["x"], r["m"]) for r in resample.bootstrap_sums(df.repartition(parts), ["k"], ["x", "m"], 25, 9, 8).collect()}
        c = counts_of(30, 25, 9)
        for b in range(25):
            for k in ("a", "b", None):
                mine = [(c[b, int(g[1:])], x) for g, kk, x, _ in rows if kk == k]
                assert got[b, k] == pytest.approx((sum(w * x for w, x in mine), sum(w for w, _ in mine)))
    whole = {r["b"]: r["m"] for r in resample.bootstrap_sums(df, [], ["m"], 25, 9, 8).collect()}
    assert whole == {b: sum(c[b, int(g[1:])] for g, _, _, _ in rows) for b in range(25)}


def test_intervals_agree_with_a_table_of_draws(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", f"g{i % 60}", bool(rng.random() < 0.8), bool(rng.random() < 0.7), float(rng.random())) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id string, group_id string, accepted boolean, observed boolean, agreement double")
    a = {r["metric"]: r for r in resample.foundation_intervals(df, 400).collect()}
    b = {r["metric"]: r for r in resample.foundation_intervals(df, 400, multiplicities=resample.hashed_draws(df, 400, 0)).collect()}
    for k in a:
        assert a[k]["estimate"] == pytest.approx(b[k]["estimate"]) and abs(a[k]["lo"] - b[k]["lo"]) < 0.02 and abs(a[k]["hi"] - b[k]["hi"]) < 0.02
    long = spark.createDataFrame([(f"g{i % 50}", "l", float(p), float(p > 0.5), 1) for i, p in enumerate(rng.random(300))], "group_id string, label string, p double, y double, mask int")
    assert calibration_bins(long, 15, ["group_id"]).count() > 50
    reps = resample.calibration_bootstrap(long, replicates=200).agg(F.count("*").alias("n"), F.avg("log_loss").alias("m")).first()
    drawn = resample.calibration_bootstrap(long, resample.hashed_draws(long, 200, 0)).agg(F.avg("log_loss").alias("m")).first()
    assert reps["n"] == 200 and reps["m"] == pytest.approx(drawn["m"], abs=0.02)
