"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .storage import replace


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns to null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_table(df: DataFrame, path: str) -> None:
    """Text with a header line. Like all sinks here it replaces what was under path only when all of it is written."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    replace(df.sparkSession, path, lambda aside: df.write.options(**plain).csv(aside))


def write_json(df: DataFrame, path: str, clean: bool = True) -> None:
    """Lines of JSON; undefined numbers as null."""
    out = finite(df) if clean else df
    replace(df.sparkSession, path, lambda aside: out.write.option("ignoreNullFields", False).json(aside))


def write_arrays(df: DataFrame, path: str) -> None:
    replace(df.sparkSession, path, df.write.parquet)


def write_files(df: DataFrame, root: str) -> DataFrame:
    """A file for each row of df (name, content: text or bytes) below root; (name, bytes), which must be acted on to write them.

    Tasks write through the file system that root names (file://, hdfs:// and so on). A repeated task writes the same file again.
    """

    def written(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content"), strict=True):
                with system.open_output_stream(f"{base}/{name.as_py()}") as out:
                    out.write(content.as_py())
            sizes = pa.array([len(c.as_py()) for c in b.column("content")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("name"), sizes], ["name", "bytes"])

    return df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(written, "name string, bytes long")


def rating_jobs(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """Candidates without scores, in a seeded order, with job ids and empty review columns."""
    # What a rater must not see.
    hidden = ("candidate_confidence", "score", "generic", "pcsi", "joint_confidence", "entropy", "eligible", "gate_reason", "accepted", "method")
    keyed = candidates.drop(*hidden).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("candidate_id").cast("string"))))
    out = numbered(keyed, ["_key", "candidate_id"]).withColumn("job_id", F.format_string("J%06d", "_r")).drop("_key", "_r")
    return out.withColumns({c: F.lit("") for c in ("factual_status", "evidential_status", "reviewer_note")})


def append_missing(work: DataFrame, done: DataFrame, keys: list[str], path: str) -> None:
    """Appends the rows of work whose keys are not done yet."""
    work.join(done.select(*keys), keys, "left_anti").write.mode("append").parquet(path)
