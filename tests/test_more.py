"""Error paths and round trips of operators that a query can't show."""

import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import calibrate, entities, external, gate, locks, metrics, resample, studies, training
from quillon.operators.contracts import ContractError
from quillon.sources import readers, writers


def test_wording_outside_the_vocabulary_is_an_error(spark):
    def said(value, reviewed=True):
        cols = [F.lit(x) for x in (reviewed, "qualified_prediction_only", 0.9, 0.5, "predicted", "cancer_risk", value)]
        return spark.range(1).select(gate.render(*cols, F.array(F.lit("red"))).alias("a")).first()["a"]

    assert said("red")["status"] == "answer" and said("0.7", reviewed=False)["status"] == "research_preview_only"
    with pytest.raises(PySparkException):
        said("0.7")


def test_states_are_decoded_strictly(spark):
    good = {"record_id": "r", "item_id": "i", "sources": [{"source_id": "s", "conflict": True}]}
    read = lambda d: spark.createDataFrame([(json.dumps(d),)], "t string").select(gate.strict_state(F.col("t")).alias("s")).first()["s"]
    assert read(good)["sources"][0]["conflict"] is True
    for bad in ({**good, "truth": 1}, {**good, "sources": [{"source_id": "s", "label": "x"}]}, {**good, "sources": [{"source_id": "s", "conflict": "yes"}]}):
        with pytest.raises((PySparkException, Py4JJavaError)):
            read(bad)


def test_external_cohorts_stay_apart(spark):
    cols = "record_id string, cohort string, session_id string, captured_at string"
    main = spark.createDataFrame([("m1", "main", "a", "2026-01-01 00:00:00"), ("m2", "main", "b", None)], cols)
    make = lambda *rows: spark.createDataFrame(list(rows), cols)
    out = external.addendum(main, make(("e1", "external", "c", "2026-10-01 00:00:00"), ("e2", "external", "c", "2026-10-02 00:00:00")), "2026-09-18 00:00:00")
    assert {r["split"] for r in out.collect()} == {"external"} and out.select("group_id").distinct().count() == 1
    for row in (("e1", "external", "a", "2026-10-01 00:00:00"), ("m1", "external", "c", "2026-10-01 00:00:00"), ("e1", "pilot", "c", "2026-10-01 00:00:00"), ("e1", "external", "c", "2026-09-01 00:00:00"), ("e1", "external", "c", None)):
        with pytest.raises(ContractError):
            external.addendum(main, make(row), "2026-09-18 00:00:00").collect()
    with pytest.raises(ContractError):
        external.frozen_predictions(spark.createDataFrame([("A", 1, 0.5, True, True)], "method string, seed int, score double, eligible boolean, informative boolean"), spark.createDataFrame([("A", 0, 0.1)], "method string, seed int, threshold double"))


def test_run_lengths(spark):
    rows = [("a", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 1.0, 1.5, 1.2, 0.5])] + [("b", 0, 1.0)]
    out = {r["run_id"]: tuple(r)[1:] for r in training.run_lengths(spark.createDataFrame(rows, "run_id string, epoch int, validation_loss double"), patience=2).collect()}
    assert out == {"a": (6, 3, 1.0), "b": (1, 0, 1.0)}


def test_separators_are_found_by_file(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a_labeled_data.csv").write_text("id;name\n1;one, two\n2;\n")
    (tmp_path / "b_labeled_data.csv").write_text('id,name\n3,"x; y"\n')
    rows = sorted(tuple(r) for r in readers.read_labelled(spark, str(tmp_path), None, ["id", "name"]).collect())
    assert rows == [("1", "one, two", "a_labeled_data.csv", 0), ("2", "", "a_labeled_data.csv", 1), ("3", "x; y", "b_labeled_data.csv", 0)]


def test_soft_layers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 1 / (1 + np.exp(-3 * np.abs(x[:, 0]) + 2))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").coalesce(1)
    model = calibrate.SoftLayers(("a", "b"), hidden=8, epochs=40, lr=0.05).fit(df)
    again = calibrate.SoftLayers.from_json(json.loads(json.dumps(model.to_json())))
    error = lambda m: df.select(F.avg(F.abs(m.score() - F.col("y")))).first()[0]
    assert error(model) == pytest.approx(error(again)) and error(model) < 0.6 * error(calibrate.SoftLogistic(("a", "b")).fit(df))
    with pytest.raises(ContractError):
        calibrate.SoftLayers(("a", "b")).fit(df.withColumn("y", F.lit(2.0)))


def test_tables_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert locks.save_once(df, str(tmp_path / "t"), ["k"]) == locks.save_once(df.orderBy(F.desc("k")), str(tmp_path / "t"), ["k"])
    with pytest.raises(ContractError):
        locks.save_once(df.limit(1), str(tmp_path / "t"), ["k"])


def test_only_missing_rows_are_appended(spark, tmp_path):
    work, path = spark.range(5).toDF("k"), str(tmp_path / "done")
    writers.append_missing(work, spark.range(2).toDF("k"), ["k"], path)
    writers.append_missing(work, spark.read.parquet(path).union(spark.range(2).toDF("k")), ["k"], path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [2, 3, 4]


def test_leaks_between_folds_and_splits(spark):
    row = lambda g, train: [("c1", g, "fit", json.dumps(train), "[]")]
    cols = "candidate_id string, group_id string, split string, training_group_ids string, early_stop_group_ids string"
    assert entities.validate_oof(spark.createDataFrame(row("g1", ["g2"]), cols)).count() == 1
    with pytest.raises(ContractError):
        entities.validate_oof(spark.createDataFrame(row("g1", ["g1"]), cols))
    with pytest.raises(ContractError):
        entities.validate_split(spark.createDataFrame([(1, "g", "fit"), (2, "g", "test")], "record_id int, group_id string, split string"))
    got = entities.balanced_folds(spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "group_id string"), 2)
    assert {r["group_id"]: r["fold"] for r in got.collect()} == {"a": 0, "b": 1, "c": 1}


def test_ridge_arms_and_precision(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 12}", float(x), float(2 * x + 0.01 * rng.normal())) for i, x in enumerate(rng.normal(size=120))]
    out = calibrate.ridge_cv(spark.createDataFrame(rows, "group_id string, x double, y double").withColumn("one", F.rand(1)), {"good": ("x",), "noise": ("one",)}, "y").collect()
    mae = {r["model"]: r["mae"] for r in out}
    assert mae["good"] < 0.1 < mae["noise"] and all(r["n"] == 120 for r in out)
    means = spark.createDataFrame([(f"p{i}", "a" if i % 2 else "b", float(i % 2)) for i in range(20)], "participant_id string, arm string, score double")
    arms = resample.two_arms(means, "score", replicates=50).first()
    assert [arms["difference"], arms["lo"], arms["hi"]] == pytest.approx([-1.0] * 3) and arms["contrast"] == "b-a"
    widths = {r["n_groups"]: r["ci_width"] for r in resample.pilot_precision(spark.createDataFrame([(float(x),) for x in rng.normal(size=20)], "risk_difference double"), (40, 160)).collect()}
    assert widths[160] < widths[40]
    with pytest.raises(ContractError):
        studies.participant_means(spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0), (1, "b", 1.0, 1.0, 1.0)], "participant_id int, arm string, comprehension_correct double, appropriate_reliance double, elapsed_seconds double"))


def test_four_policies(spark):
    rows = [(f"r{i}", f"g{i}", "meal" if i % 2 else "product", i / 40, 1 - i / 40, 0.5, i / 80, True, True) for i in range(40)]
    cols = "record_id string, group_id string, domain string, " + ", ".join(f"{c} double" for c in sorted({s for s, _ in metrics.METHODS.values()})) + ", gate boolean, informative boolean"
    n = len({s for s, _ in metrics.METHODS.values()})
    scored = spark.createDataFrame([(*r[:3], *r[3 : 3 + n], True, True) for r in rows], cols)
    at = metrics.policy_thresholds(scored, (0.8,))
    assert at.count() == len(metrics.METHODS)
    assert metrics.policy_accept(scored, at).where("accepted").groupBy("method").count().count() == len(metrics.METHODS)
