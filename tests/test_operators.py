"""Semantics and error paths of the study operators."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import contracts, entities, metrics, resample, targets
from quillon.sources import readers


def test_normalize_and_values(spark):
    df = spark.createDataFrame([(None,), (" UNKNOWN ",), ("none",), ("Pan  Fried",)], "s string")
    assert [r[0] for r in df.select(S.normalize(F.col("s"))).collect()] == ["", "", "none", "pan fried"]
    df = spark.createDataFrame([("rice, beans",), ('["a","b"]',), ("['a']",)], "s string")
    assert [len(r[0]) for r in df.select(S.values(F.col("s"))).collect()] == [1, 2, 1]


def test_strict_booleans_fail(spark):
    df = spark.createDataFrame([("TRUE",), ("maybe",)], "s string")
    assert [r[0] for r in df.select(S.lenient_bool(F.col("s"))).collect()] == [True, False]
    with pytest.raises(PySparkException):
        df.select(S.strict_bool(F.col("s"))).collect()


def test_endorsement_of_a_panel(spark):
    rows = [("a", "r1", "i1", "meat", "chicken", "grilled"), ("a", "r1", "i2", "veg", "potato", "boiled"), ("a", "r2", "i1", "meat", "chicken", "fried"), ("b", "r1", "i1", "veg", "unseen", "")]
    ann = spark.createDataFrame(rows, "record_id string, reviewer_id string, item_id string, category string, subcategory string, cooking_style string")
    fields = ("category", "subcategory", "cooking_style")
    vocab = targets.vocabulary(ann, ann.where("record_id = 'a'").select("record_id").distinct(), "joint", fields)
    out = {(r["record_id"], r["label"]): r for r in targets.endorsement(ann, vocab, "joint", fields).collect()}
    assert out[("a", '{"category":"meat","cooking_style":"grilled","subcategory":"chicken"}')]["y"] == 0.5
    assert all(r["mask"] == 0 for (rec, _), r in out.items() if rec == "b")


def test_thresholds(spark):
    def choose(rows, target):
        return metrics.choose_thresholds(spark.createDataFrame(rows, "score double, eligible boolean"), (target,)).first()

    assert choose([(0.9, True), (0.9, True), (0.5, True), (0.1, True)], 0.5)["coverage"] == 0.5
    assert choose([(0.9, True), (0.7, False), (0.4, False), (0.2, False)], 0.8)["max_eligible_coverage"] == 0.25
    assert choose([(0.9, False), (0.8, False)], 0.8)["coverage"] == 0


def test_foundation_intervals(spark):
    df = spark.createDataFrame([("a", "g1", True, True, 1.0), ("b", "g1", True, False, None), ("c", "g2", True, True, 0.0), ("d", "g2", False, True, 1.0)], "record_id string, group_id string, accepted boolean, observed boolean, agreement double")
    out = {r["metric"]: r["estimate"] for r in resample.foundation_intervals(df, 40).collect()}
    assert sorted(round(v, 6) for v in out.values()) == [0.25, 0.5, 0.5, 0.75]


def test_components_and_split(spark):
    df = spark.createDataFrame([(f"r{i}", f"p{i // 2}", "" if i % 3 else "x") for i in range(40)], "record_id string, participant_id string, session_id string")
    out = entities.build_components(df, spark.createDataFrame([("r1", "r2", "true"), ("r4", "r6", "false")], "record_a string, record_b string, approved string"))
    roots = {r["record_id"]: r["root"] for r in out.collect()}
    assert roots["r2"] == roots["r1"] and roots["r0"] == roots["r39"] and roots["r4"] == roots["r5"]
    with pytest.raises(contracts.ContractError):
        entities.split_sizes(4, contracts.SPLITS)
    with pytest.raises(contracts.ContractError):
        entities.build_components(df, spark.createDataFrame([("r1", "nobody", "true")], "record_a string, record_b string, approved string"))


def test_dishes(spark):
    line = "dish_1,10,20,1,2,3,ingr_0000000001,apple,20,10,0,2,0"
    for text in (line, line.replace("3,ingr", "3,1,ingr")):
        dishes, parts = readers.parse_dishes(spark.createDataFrame([(text,)], "value string"))
        assert dishes.count() == 1 and parts.first()["ingredient_name"] == "apple"
    with pytest.raises(PySparkException):
        readers.parse_dishes(spark.createDataFrame([("dish_1,10,20,1,2,3,4,5",)], "value string"))[0].collect()


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n,"x"\n"",1\n')
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("", "x"), ("", "1")]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for call in (lambda: contracts.require_unique(df, ["k"]), lambda: contracts.require_columns(df, ["z"]), lambda: contracts.forbid_columns(df, ["v"]), lambda: contracts.join_checked(df, df.withColumnRenamed("v", "w"), ["k"])):
        with pytest.raises(contracts.ContractError):
            call()
    with pytest.raises(contracts.ContractError):
        metrics.holm(spark.createDataFrame([(1.5,)], "p_value double"))
