"""Swaps that are cut off, locks, and queues whose runs die at the worst moment."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import locks
from quillon.operators.contracts import ContractError
from quillon.sources import readers, storage, writers
from quillon.streaming import queue


def failing(n):
    return F.when(F.col("id") == n, F.raise_error(F.lit("cut")).cast("long")).otherwise(F.col("id"))


@pytest.mark.parametrize("sink", [writers.write_table, writers.write_json, writers.write_arrays])
def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path, sink):
    path = str(tmp_path / "t")
    read = {writers.write_table: spark.read.option("header", True).csv, writers.write_json: spark.read.json, writers.write_arrays: spark.read.parquet}[sink]
    sink(spark.range(5), path)
    with pytest.raises(Exception, match="cut"):
        sink(spark.range(2000).repartition(8).select(failing(1999).alias("id")), path)
    assert sorted(int(r["id"]) for r in read(path).collect()) == list(range(5))
    sink(spark.range(7, 9), path)
    assert sorted(int(r["id"]) for r in read(path).collect()) == [7, 8]
    assert os.listdir(tmp_path) == ["t"]


def test_a_swap_that_was_cut_off_is_settled(spark, tmp_path):
    path, old = str(tmp_path / "t"), str(tmp_path / f"{storage.OLD}t")
    writers.write_arrays(spark.range(3), path)
    os.rename(path, old)  # died between the renames
    assert spark.read.parquet(storage.settle(spark, path)).count() == 3 and not os.path.exists(old)
    spark.range(9).write.parquet(old)  # died before the old one was deleted
    assert spark.read.parquet(storage.settle(spark, path)).count() == 3 and not os.path.exists(old)
    assert not storage.create(spark, path, spark.range(1).write.parquet) and spark.read.parquet(path).count() == 3


def test_small_files(spark, tmp_path):
    at = storage.Storage(spark, str(tmp_path / "deep" / "x.json"))
    assert at.put("one") and not at.put("two") and at.text() == "one"
    assert at.put("drei ü", replace=True) and at.text() == "drei ü"
    assert [n for n in os.listdir(tmp_path / "deep") if not n.endswith(".crc")] == ["x.json"]


def test_tables_of_text_come_back_as_they_were(spark, tmp_path):
    odd = ["", " lead", "trail ", 'say "hi"', "a,b", "two\nlines", "back\\slash", "ü", "\\\"", '"']
    writers.write_table(spark.createDataFrame(list(enumerate(odd)), "k int, v string"), str(tmp_path / "t"))
    got = readers.read_table(spark, str(tmp_path / "t"))
    assert {int(r["k"]): r["v"] for r in got.collect()} == dict(enumerate(odd))


def test_labelled_files_hold_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a a_labeled_data.csv").write_text('id;note;more\n1;"one\n2;two";x\n2;"say ""so""";y\n')
    (tmp_path / "b_labeled_data.csv").write_text("note,id\nplain,3\n")
    rows = sorted(tuple(r) for r in readers.read_labelled(spark, str(tmp_path), None, ["id", "note"]).collect())
    assert rows == [("1", "one\n2;two", "a a_labeled_data.csv", 0), ("2", 'say "so"', "a a_labeled_data.csv", 1), ("3", "plain", "b_labeled_data.csv", 0)]
    with pytest.raises(ContractError):
        readers.read_labelled(spark, str(tmp_path), None, ["more"])
    (tmp_path / "none").mkdir()
    assert readers.read_labelled(spark, str(tmp_path / "none"), None, ["id"]).count() == 0


def test_locks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(locks, "FAN", 3)
    (tmp_path / "in").mkdir()
    for i in range(11):
        (tmp_path / "in" / f"{i}.txt").write_text(f"x{i}")
    now = lambda: locks.file_hashes(spark, str(tmp_path / "in"))
    lock = str(tmp_path / "lock")
    known = locks.make_lock(now(), lock, {"k": 1})
    assert locks.make_lock(now(), lock, {"k": 1}) == known == locks.verify_lock(spark, lock, now())["lock_hash"]
    for other in (lambda: locks.make_lock(now(), lock, {"k": 2}), lambda: locks.make_lock(now().limit(0), str(tmp_path / "l2"), {}), lambda: locks.make_lock(now().union(now()), str(tmp_path / "l2"), {})):
        with pytest.raises(ContractError):
            other()
    (tmp_path / "in" / "new.txt").write_text("z")
    assert locks.verify_lock(spark, lock, now()) and [r["status"] for r in locks.lock_changes(spark.read.parquet(lock + "/files"), now()).collect()] == ["added"]
    with pytest.raises(ContractError):
        locks.verify_lock(spark, lock, now(), added=False)
    (tmp_path / "in" / "3.txt").write_text("other")
    (tmp_path / "in" / "4.txt").unlink()
    found = {r["path"].rpartition("/")[2]: r["status"] for r in locks.lock_changes(spark.read.parquet(lock + "/files"), now()).collect()}
    assert found == {"new.txt": "added", "3.txt": "changed", "4.txt": "missing"}
    with pytest.raises(ContractError):
        locks.verify_lock(spark, lock, now())
    record = json.loads((tmp_path / "lock" / "lock.json").read_text())
    storage.Storage(spark, lock + "/lock.json").put(json.dumps({**record, "files": 1}), replace=True)
    with pytest.raises(ContractError):
        locks.read_lock(spark, lock)


def test_roots_tell_leaves_and_places_apart(spark, monkeypatch):
    monkeypatch.setattr(locks, "FAN", 2)
    root = lambda rows: locks.merkle_root(spark.createDataFrame(rows, "k int, v string").repartition(3), "k", F.sha2("v", 256))
    rows = [(i, f"v{i}") for i in range(9)]
    assert root(rows) == root(rows[::-1]) and root(rows)[1] == 9
    assert len({root(rows)[0], root(rows[:-1])[0], root([*rows[:-1], (8, "w")])[0], root([(8 - k, v) for k, v in rows])[0], locks.merkle_root(spark.createDataFrame([], "k int, v string"), "k", F.col("v"))[0]}) == 5
    df = spark.createDataFrame(rows, "k int, v string")
    assert locks.table_hash(df, ["k"]) == locks.table_hash(df.orderBy(F.desc("k")), ["k"]) != locks.table_hash(df.union(df.limit(1)), ["k"])


def test_access_and_gates(spark, tmp_path):
    seen = str(tmp_path / "seen")
    assert locks.record_access(spark, "l1", seen, "c") == locks.record_access(spark, "l1", seen, "c")
    with pytest.raises(ContractError):
        locks.record_access(spark, "l2", seen, "c")
    assert locks.record_access(spark, "l2", seen, "d")["lock"] == "l2"
    gates = str(tmp_path / "gates.json")
    with pytest.raises(ContractError):
        locks.require_gate(spark, gates, "ethics")
    storage.Storage(spark, gates).put(json.dumps({"ethics": {"status": "approved", "reference": "r1"}}), replace=True)
    locks.require_gate(spark, gates, "ethics")


def test_a_run_that_dies_after_its_write_is_not_counted_twice(spark, tmp_path, monkeypatch):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(6).withColumn("v", F.lit(1)).write.parquet(source)
    real, calls = queue.replace, []

    def dies(s, path, write):
        real(s, path, write)
        calls.append(path)
        if len(calls) == 1:
            raise RuntimeError("killed before the checkpoint")

    monkeypatch.setattr(queue, "replace", dies)
    step = lambda df: df.withColumn("v", F.col("v") * 2)
    with pytest.raises(Exception, match="killed"):
        queue.drain(spark, source, "id long, v int", step, sink, mark, ["id"])
    queue.drain(spark, source, "id long, v int", step, sink, mark, ["id"])
    assert calls[0] == calls[1]
    spark.range(4, 9).withColumn("v", F.lit(5)).union(spark.range(8, 9).withColumn("v", F.lit(5))).write.mode("append").parquet(source)
    queue.drain(spark, source, "id long, v int", step, sink, mark, ["id"])
    assert sorted((r["id"], r["v"]) for r in queue.finished(spark, sink).collect()) == [(i, 2 if i < 6 else 10) for i in range(9)]


def test_shards_are_claimed_once_and_again_when_the_lease_is_over(spark, tmp_path):
    now = [0.0]
    a, b = (queue.Shards(spark, str(tmp_path / "q"), w, lease=10, clock=lambda: now[0]) for w in "ab")
    assert a.claim(["s1", "s2"]) == ("s1", 0) and b.claim(["s1", "s2"]) == ("s2", 0) and a.claim(["s1", "s2"]) is None
    assert b.finish("s2", 0, spark.range(3))
    now[0] = 11
    assert b.claim(["s1", "s2"]) == ("s1", 1)  # a has died, or is slow
    assert b.finish("s1", 1, spark.range(5)) and not a.finish("s1", 0, spark.range(5))
    assert sorted((r["shard"], r["id"], r["attempt"]) for r in a.read().collect()) == [*(("s1", i, 1) for i in range(5)), *(("s2", i, 0) for i in range(3))]
    assert a.done() == {"s1", "s2"} and a.claim(["s1", "s2"]) is None
    with pytest.raises(ValueError):
        a.claim(["../x"])
