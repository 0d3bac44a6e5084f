"""Files of batches hold few rows, however much a task reads."""

from pyspark.sql import functions as F

from quillon.llm import lm
from quillon.llm.common import Scratch


def test_files_of_batches_are_short(spark, monkeypatch):
    """A task's batches were one file, and the columnar reader took all of them into memory at once."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 40))) for i in range(60)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, lm.backoff_scores(docs).collect()))
    name, scratch = "spark.sql.execution.arrow.maxRecordsPerBatch", Scratch(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    monkeypatch.setattr(lm, "BATCH", 50)
    try:
        got = sorted(map(tuple, lm.backoff_scores(docs.select("*"), scratch=scratch).collect()))
    finally:
        spark.conf.set(name, before)
    files = [r["count"] for r in spark.read.parquet(scratch.path("batches")).groupBy(F.input_file_name()).count().collect()]
    scratch.close()
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert sum(files) > 2 * lm.TOGETHER >= 2 * max(files)
