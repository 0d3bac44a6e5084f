"""Approvals, hash-bound locks, write-once tables, run status."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Storage, create
from .contracts import ContractError, require_none, require_unique
from .ranges import checkpointed, numbered

# The gates of a study and what approves one.
GATES = ("supervisor_execution", "dataset_rights", "ethics", "claim_rules", "unblinding", "external_release", "product_use")
APPROVED = ("approved", "not_required_by_recorded_determination")


def require_gate(spark: SparkSession, path: str, gate: str, demo: bool = False) -> None:
    """A missing file is written with all gates pending."""
    if demo:
        return
    at = Storage(spark, path)
    at.put(json.dumps({g: {"status": "pending", "reference": ""} for g in GATES}))
    found = json.loads(at.text()).get(gate, {})
    if found.get("status") not in APPROVED or not found.get("reference"):
        raise ContractError(f"{gate} is not approved")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


#: Hashes that one row of the next level stands for.
FAN = 1024


def merkle_root(df: DataFrame, order: str, leaf: Column) -> tuple[str, int]:
    """(root, rows): a hash of all leaves in the order of a column, and how many there are.

    Leaves are numbered by ranges of the order; FAN of them in a row are hashed together, and so on until one is left. No
    task holds more than FAN hashes of a level, and another leaf anywhere gives another root. Of nothing, the hash is that
    of the empty text. Rows with equal order must have equal leaves.
    """
    rows = checkpointed(numbered(df.select(F.col(order).alias("_o"), leaf.alias("h")), ["_o"], "at").select("at", "h"))
    n = rows.count()
    size = n
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        rows = rows.groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(F.sha2(joined, 256).alias("h"))
        size = -(-size // FAN)
        if size <= 1:
            last = rows.first()
            return (last["h"] if last else hashlib.sha256(b"").hexdigest()), n


def table_hash(df: DataFrame, keys: list[str]) -> str:
    """Hash of a table whatever its row order: the root over its sorted row hashes, with the count, columns and keys."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    root, n = merkle_root(df.select(row.alias("h")), "h", F.col("h"))
    return digest({"rows": n, "root": root, "columns": sorted(df.columns), "keys": keys})


def digest(what: dict) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


def save_once(df: DataFrame, path: str, keys: list[str]) -> str:
    """Writes a table with its hash, whole or not at all; another content under the same path is refused."""
    spark, known = df.sparkSession, table_hash(df, keys)
    if not create(spark, path, df.write.parquet) and table_hash(spark.read.parquet(path), keys) != known:
        raise ContractError(f"{path} holds another table")
    return known


def make_lock(hashes: DataFrame, path: str, protocol: dict) -> str:
    """Binds artefacts (path, sha256) and a protocol: a folder with the table of hashes and a record of its root; the lock's hash.

    The folder appears by one rename when all of it is written. A lock is never overwritten: the same one again is
    accepted, another one is an error, and so is one that binds nothing or an artefact twice.
    """
    spark = hashes.sparkSession
    files = checkpointed(hashes.select("path", "sha256"))
    require_unique(files, ["path"], "artefacts")
    root, n = merkle_root(files, "path", F.sha2(F.concat_ws("\n", "path", "sha256"), 256))
    if not n:
        raise ContractError("a lock must bind something")
    core = {"root": root, "files": n, "protocol": protocol, "protocol_hash": digest(protocol)}
    record = {**core, "lock_hash": digest(core)}

    def write(aside: str) -> None:
        files.write.parquet(f"{aside}/files")
        Storage(spark, f"{aside}/lock.json").put(json.dumps(record, sort_keys=True))

    if not create(spark, path, write) and read_lock(spark, path) != record:
        raise ContractError("another lock exists")
    return record["lock_hash"]


def read_lock(spark: SparkSession, path: str) -> dict:
    """The record of a lock; an altered one is an error."""
    record = json.loads(Storage(spark, f"{path}/lock.json").text())
    if digest({k: v for k, v in record.items() if k != "lock_hash"}) != record["lock_hash"]:
        raise ContractError("the lock's record was altered")
    return record


def lock_changes(locked: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status, locked_sha256, sha256) of all artefacts (path, sha256) that aren't as they were: changed, missing or added."""
    a, b = F.col("a.sha256"), F.col("b.sha256")
    status = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "added").when(~a.eqNullSafe(b), "changed")
    both = locked.alias("a").join(now.alias("b"), F.col("a.path") == F.col("b.path"), "full_outer")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"), a.alias("locked_sha256"), b.alias("sha256")).where("status is not null")


def verify_lock(spark: SparkSession, path: str, hashes: DataFrame, added: bool = True) -> dict:
    """The record, if all artefacts are as they were locked; files that came since are an error only if added is False."""
    record, files = read_lock(spark, path), spark.read.parquet(f"{path}/files")
    root, n = merkle_root(files, "path", F.sha2(F.concat_ws("\n", "path", "sha256"), 256))
    if (root, n) != (record["root"], record["files"]):
        raise ContractError("the lock's table was altered")
    changes = lock_changes(files, hashes)
    require_none((changes.where("status <> 'added'") if added else changes).select("path", "status"), "not as it was locked")
    return record


def record_access(spark: SparkSession, lock_hash: str, path: str, cohort: str) -> dict:
    """The first access to a cohort is kept in a file of its own; one under another lock is refused."""
    at = Storage(spark, f"{path}/{digest({'cohort': cohort})[:32]}.json")
    first = {"cohort": cohort, "lock": lock_hash}
    if not at.put(json.dumps(first)):
        first = json.loads(at.text())
    if first["lock"] != lock_hash:
        raise ContractError("opened under another lock")
    return first


def run_status(grid: DataFrame, registry: DataFrame) -> DataFrame:
    """grid (run_id, signature) against the registry (run_id, signature, complete)."""
    r = registry.select("run_id", F.col("signature").alias("_s"), "complete")
    status = F.when(F.col("_s").isNull(), "not_started").when(F.col("complete") & (F.col("_s") != F.col("signature")), "complete_incompatible").when(F.col("complete"), "complete").otherwise("resumable")
    return grid.join(r, "run_id", "left").select(*grid.columns, status.alias("status"))


def run_grid(spark: SparkSession, seeds: int = 5) -> DataFrame:
    axis = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    grid = axis("backbone", ("resnet50", "convnext_tiny", "dinov2_vits14")).crossJoin(axis("regime", ("frozen", "finetune"))).crossJoin(axis("head", ("independent", "joint"))).crossJoin(spark.range(seeds).select(F.col("id").cast("int").alias("seed")))
    return grid.withColumn("run_id", F.concat_ws("__", "backbone", "regime", "head", F.concat(F.lit("seed"), "seed")))
