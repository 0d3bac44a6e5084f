"""Queries and steps that failed, or differed from their SQL, on larger tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lm, search
from quillon.operators import contracts, entities, metrics, resample, targets
from quillon.operators.contracts import ContractError
from quillon.plans.queries import ORACLES, QUERIES
from tests.conftest import same_rows


def test_best_rows_of_large_keys(spark, tmp_path):
    """Keys beyond 100,000 weigh more than a step of the price, as SQL orders them."""
    rows = spark.createDataFrame([(3_000_000, "a", 900.0), (17, "a", 901.0), (5, "b", 900.0), (6, "b", 900.0)], "p_partkey long, p_brand string, p_retailprice double")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got, want = same_rows(QUERIES["grid_best_row"](spark, str(tmp_path)), ORACLES["grid_best_row"], str(tmp_path))
    assert got == want and len(got) == 2


def test_rating_jobs_beyond_a_million(spark, tmp_path):
    spark.range(1_000_200).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got, want = same_rows(QUERIES["rating_jobs"](spark, str(tmp_path)), ORACLES["rating_jobs"], str(tmp_path))
    assert got == want and len(got) == 1_000_200


def test_lineage_is_settled_step_by_step(spark):
    """The result reads settled tables; it once held the joins of all steps, twice over in each step."""
    assets = spark.createDataFrame([(i, [i // 3] if i else [], True) for i in range(200)], "asset_id long, parent_asset_ids array<long>, permitted_research_use boolean")
    out = entities.lineage(spark, assets)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i in range(1, 200):
        at, n = i, 0
        while at:
            at, n = at // 3, n + 1
            want.add((i, at, n))
    assert {tuple(r) for r in out.collect()} == want
    for links in ([(1, [1], True)], [(1, [2], True), (2, [3], True), (3, [1], True)]):
        with pytest.raises(ContractError, match="cycle"):
            entities.lineage(spark, spark.createDataFrame(links, assets.schema))


def test_thresholds_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a" if i % 2 else "b", i % 50 / 50, i % 3 > 0, 1.0 / (1 + i % 7)) for i in range(700)], "method string, score double, eligible boolean, weight double")
    got = metrics.choose_thresholds(df.mapInArrow(count, df.schema), (0.3, 0.5), ["method"], "weight").collect()
    assert len(got) == 4 and seen.value == 700


def test_hashed_sums_are_those_of_the_table_of_draws(spark):
    df = spark.createDataFrame([(g, "x" if g % 3 else "y", float(g % 5), 1.0) for g in range(60)] + [(7, "y", 2.0, 1.0)], "group_id long, kind string, a double, m double")
    table = resample.hashed_draws(df, 30).join(df.withColumnRenamed("m", "one"), "group_id").groupBy("b", "kind").agg(F.sum(F.col("m") * F.col("a")).alias("a"), F.sum("m").cast("double").alias("m"))
    for width in (7, 64):  # ranges of several groups, and one of all
        got = resample.hashed_sums(df, ["kind"], ["a", "m"], 30, width=width).where("m > 0")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in table.collect()}


def test_paired_bootstrap_shuffles_no_table_of_draws(spark):
    """What the query shuffles for a draw is two bytes; a row a draw was exchanged twice."""
    plan = QUERIES["paired_bootstrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_missing_images_leave_annotations_in_place(spark):
    a = spark.createDataFrame([(i, None if i == 5 else f"n{i % 30}") for i in range(300)], "i int, image_name string")
    images = spark.createDataFrame([(f"n{i}",) for i in range(28)] * 2, "image_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        have, ledger = contracts.missing_images(a, images)
        for out in (have, ledger):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        lost = {i for i in range(300) if i % 30 > 27 or i == 5}
        assert {r["i"] for r in ledger.collect()} == lost and {r["i"] for r in have.collect()} == set(range(300)) - lost
        assert have.columns == a.columns and ledger.columns == [*a.columns, "reason"] and have.count() == 300 - len(lost)
        assert contracts.missing_images(a.where("i < 5"), images)[1].count() == 0
        with pytest.raises(ContractError):
            contracts.missing_images(a, images, most=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_beyond_64_bits_are_ranked_as_they_are(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 1e8]) for i in range(120)]
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=119).collect()}
    for q in (0, 50, 100):
        score = {i: sum(a * b for a, b in zip(whole[q], whole[i], strict=True)) for i in range(120) if i != q}
        for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i)), 1):
            assert got[q, rank] == (i, max(-(2**63), min(2**63 - 1, score[i])))


def test_ngram_partitions_grow_with_the_corpus(spark, monkeypatch):
    """A partition's table of counts is held in memory, so partitions of a fixed number outgrow it; scores don't depend on them."""
    assert lm.gram_parts(10**9, 4, 12) >= 400 and lm.gram_parts(10, 4, 12) == 12 and lm.gram_parts(0, 4, 0) == 1
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 40))) for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, lm.backoff_scores(docs).collect()))
    monkeypatch.setattr(lm, "GRAMS", 64)
    assert sorted(map(tuple, lm.backoff_scores(docs).collect())) == want


def test_endorsement_joins_no_row_a_label(spark):
    """Votes were joined to the product of records and labels, so that all of it was shuffled and sorted."""
    a = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "b", "x"), (1, 1, "c", "y"), (1, 2, "a", "y"), (1, 3, "a", ""), (1, 3, "b", "x"), (2, 1, "a", ""), (3, 1, "a", "z")], "record_id long, reviewer_id long, item_id string, f string")
    vocab = spark.createDataFrame([("f", '{"f":"x"}'), ("f", '{"f":"y"}')], "bundle string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        out = targets.endorsement(a, vocab, "joint", ["f"])
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r["record_id"], r["label"][6]): (r["y"], r["mask"], r["n_reviewers"]) for r in out.collect()}
    assert got == {(1, "x"): (0.5, 1, 2), (1, "y"): (1.0, 1, 2), (2, "x"): (0.0, 0, 0), (2, "y"): (0.0, 0, 0), (3, "x"): (0.0, 1, 1), (3, "y"): (0.0, 1, 1)}
