"""Work queues that lose nothing and do nothing twice: a stream of files, and shards claimed by workers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import Storage, create, replace


def drain(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Works through the parquet files that have come to source, and ends; a later call takes only what has come since.

    A batch's output is a folder of its own, sink/batch=<number>, swapped in whole. Spark numbers batches in the checkpoint and
    repeats a batch under its number if it didn't see its end, so a run that dies between the write and the checkpoint has its
    folder written again, not another one beside it. With keys, rows whose keys an earlier batch has done are left out, and
    of rows with equal keys in a batch one is done; step keeps the keys.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def work(batch: DataFrame, number: int) -> None:
        if keys:
            done = finished(spark, sink)
            batch = batch.dropDuplicates(list(keys))
            if done is not None:
                batch = batch.join(done.where(F.col("batch") != number).select(*keys), list(keys), "left_anti")
        replace(spark, f"{sink}/batch={number}", step(batch).write.parquet)

    Storage(spark, sink).fs.mkdirs(Storage(spark, sink).path)
    query = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def finished(spark: SparkSession, sink: str) -> DataFrame | None:
    """All rows of a sink with the number of their batch, or None while there are none."""
    at = Storage(spark, sink)
    names = [s.getPath().getName() for s in at.fs.listStatus(at.path)] if at.exists() else []
    return spark.read.option("basePath", sink).parquet(*[f"{sink}/{n}" for n in sorted(names) if n.startswith("batch=")]) if any(n.startswith("batch=") for n in names) else None


class Shards:
    """Shards of work that several drivers share below one folder.

    A worker claims a shard by creating a file that names the attempt; of two that try, one succeeds. A claim holds for
    `lease` seconds, after which another worker may make the next attempt. Output is written aside and renamed to the shard's
    folder only if there is none, so the first attempt to end counts and a late one leaves no row. Shards are few: a
    claim is a small file, while rows stay in Spark.
    """

    def __init__(self, spark: SparkSession, root: str, worker: str, lease: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.worker, self.lease, self.clock = spark, root.rstrip("/"), worker, lease, clock

    def _names(self, folder: str) -> list[str]:
        at = Storage(self.spark, f"{self.root}/{folder}")
        return [s.getPath().getName() for s in at.fs.listStatus(at.path)] if at.exists() else []

    def done(self) -> set[str]:
        return {n.removeprefix("shard=") for n in self._names("out") if n.startswith("shard=")}

    def claim(self, shards: Sequence[str]) -> tuple[str, int] | None:
        """(shard, attempt) of the first shard that is neither done nor claimed by a worker whose lease holds."""
        for bad in (s for s in shards if not re.fullmatch(r"[\w-]+", s)):
            raise ValueError(f"{bad!r} is no name of a shard")
        done, claims = self.done(), {}
        for name in self._names("claims"):
            shard, _, attempt = name.removesuffix(".json").rpartition(".")
            claims[shard] = max(claims.get(shard, -1), int(attempt)) if attempt.isdigit() else claims.get(shard, -1)
        for shard in (s for s in shards if s not in done):
            last = claims.get(shard, -1)
            if last >= 0 and json.loads(Storage(self.spark, f"{self.root}/claims/{shard}.{last}.json").text())["until"] > self.clock():
                continue
            if Storage(self.spark, f"{self.root}/claims/{shard}.{last + 1}.json").put(json.dumps({"worker": self.worker, "until": self.clock() + self.lease})):
                return shard, last + 1
        return None

    def finish(self, shard: str, attempt: int, rows: DataFrame) -> bool:
        """Writes a shard's rows; False if another attempt came first, whose rows stay."""
        return create(self.spark, f"{self.root}/out/shard={shard}", rows.withColumn("attempt", F.lit(attempt)).write.parquet)

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/out").parquet(*[f"{self.root}/out/shard={s}" for s in sorted(self.done())])
