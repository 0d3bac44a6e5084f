"""Labelled files: many, odd and long ones."""

import pytest

from quillon.operators.contracts import ContractError
from quillon.sources import readers


def test_many_labelled_files_take_few_tasks(spark, tmp_path):
    """Every file was once listed by a task of its own, named to the driver, and scanned twice."""
    for i in range(300):
        (tmp_path / f"{i}_labeled_data.csv").write_text(f"id;note\n{i};a\n{i};b\n" if i % 2 else f"note,id\na,{i}\nb,{i}\n")
    context = spark.sparkContext
    context.setJobGroup("labelled", "labelled")
    try:
        rows = readers.read_labelled(spark, str(tmp_path), None, ["id", "note"]).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in rows) == sorted((str(i), "ab"[k], f"{i}_labeled_data.csv", k) for i in range(300) for k in (0, 1))
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("labelled") for s in seen.getJobInfo(j).stageIds}
    assert 0 < sum(seen.getStageInfo(s).numTasks for s in stages if seen.getStageInfo(s)) < 100


ODD = {
    "a+b": ("id;note\n1;x\n", [("1", "x")]),
    "a[1] {ü}%20": ("note;id\nx;1\n", [("1", "x")]),
    "mark": ("\ufeffid,note\n1,x\n", [("1", "x")]),
    "ends": ('id;note\r\n1;"x\r\n\r\ny"\r\n\r\n2;z\r\n', [("1", "x\n\ny"), ("2", "z")]),
    "returns": ('id;note\n1;a\rb\n2;"c\rd"\n', [("1", "a\rb"), ("2", "c\rd")]),
    "old": ("id;note\r1;x\r2;y\r", [("1", "x"), ("2", "y")]),
    "blank": ("\n  \nid;note\n\n1;x\n\n\n2;y", [("1", "x"), ("2", "y")]),
    "ragged": ('id;more;note\n1\n2;;"";4\n3;;y\n', [("1", ""), ("2", ""), ("3", "y")]),
    "names": ('"note"\t "id" \nx "y" z\t1\n', [("1", 'x "y" z')]),
    "wide": (f"id|note\n1|{'w' * 200_000}\n", [("1", "w" * 200_000)]),
    "head": ("id;note\n", []),
    "spaces": ("\n   \n\n", []),
    "nothing": ("", []),
    "nul": ("id;note\n1;a\0b\n", [("1", "a\0b")]),
    "bytes": (b"id;note;\xff\n1;a\xffb\xc3\n", [("1", "a\ufffdb\ufffd")]),
    "open": ('id;note\n1;"x\n2;y\n', [("1", "x\n2;y\n")]),
}


@pytest.mark.parametrize("whole", [8 << 20, 24, 0])
def test_odd_labelled_files(spark, tmp_path, monkeypatch, whole):
    """Whole or by lines, files give the same rows; the same name may be there in two folders."""
    monkeypatch.setattr(readers, "WHOLE", whole)
    want = []
    for folder in (tmp_path / "in", tmp_path / "in" / "below [2]"):
        folder.mkdir()
        for name, (content, rows) in ODD.items():
            (folder / f"{name}_labeled_data.csv").write_bytes(content if isinstance(content, bytes) else content.encode())
            want += [(*r, f"{name}_labeled_data.csv", k) for k, r in enumerate(rows)]
    (tmp_path / "in" / "other.csv").write_text("id;note\n9;9\n")
    root = (tmp_path / "in").as_uri()
    assert sorted(tuple(r) for r in readers.read_labelled(spark, root, None, ["id", "note"]).collect()) == sorted(want)
    with pytest.raises(ContractError, match=r"_labeled_data.csv lacks \['more'\]"):
        readers.read_labelled(spark, root, None, ["id", "more"])


def test_a_long_labelled_file_keeps_its_order(spark, tmp_path):
    """Longer than WHOLE and than a block of Spark's, with line ends in quotes where blocks may be cut."""
    n = 400_000
    with open(tmp_path / "long_labeled_data.csv", "w") as f:
        f.write("note;id\n")
        f.writelines(f'"a note ""{i}""\n;{i}";{i}\n' for i in range(n))
        assert f.tell() > readers.WHOLE
    (tmp_path / "short_labeled_data.csv").write_text("id,note\n7,x\n")
    rows = readers.read_labelled(spark, str(tmp_path), None, ["id", "note"])
    assert rows.where("source_file like 'short%'").first()[:2] == ("7", "x")
    long = rows.where("source_file like 'long%'")
    assert long.count() == n and long.where("id <> string(row_number) or note <> concat('a note \"', id, '\"\\n;', id)").count() == 0
    assert long.select("row_number").distinct().count() == n
