"""Files and folders as the cluster's file system has them: what is written is there whole, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: A folder's predecessor stands under its name with this before it while the new one takes its place.
OLD = ".replaced-"


class Storage:
    """The Hadoop file system of a path, seen from the driver; only names and small files pass through it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self._at(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def beside(self, prefix: str) -> str:
        """A name in the same folder; names that begin with a dot are no data to Spark."""
        return self._at(self.path.getParent().toString() + "/" + prefix + self.path.getName()).toString() if self.path.getParent() else prefix + self.path.getName()

    def exists(self, path: str | None = None) -> bool:
        return self.fs.exists(self._at(path) if path else self.path)

    def delete(self, path: str | None = None) -> None:
        self.fs.delete(self._at(path) if path else self.path, True)

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self._at(source), self._at(target)):
            raise OSError(f"{source} can't be moved to {target}")

    def text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, text: str, replace: bool = False) -> bool:
        """Writes a small file; without replace, False if there is one. It appears under its name when all of it is written."""
        if not replace and self.exists():
            return False
        aside = self.beside(f".{uuid.uuid4().hex}-")
        stream = self.fs.create(self._at(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            options = self._jvm.org.apache.hadoop.fs.Options.Rename
            kinds = self._gateway.new_array(options, 1)
            kinds[0] = options.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(self.fs.makeQualified(self._at(aside)), self.fs.makeQualified(self.path), kinds)
            return True
        if self.exists() or not self.fs.rename(self._at(aside), self.path):
            self.delete(aside)
            return False
        return True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which all executors see; on one machine a temporary one stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
    base = base if ":" in base else "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(spark: SparkSession, path: str) -> str:
    """path, after a swap that was cut off has been undone (no folder under the name yet) or finished (both are there)."""
    at = Storage(spark, path)
    old = at.beside(OLD)
    if at.exists(old):
        if at.exists():
            at.delete(old)
        else:
            at.move(old, path)
    return path


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets write() fill a folder beside path, then swaps it in by renames.

    Until all of it is written the folder under path is the one before, whole and readable; a write that fails leaves it
    so. Between the two renames the one before is still there under another name, and settle() brings it back.
    """
    settle(spark, path)
    at = Storage(spark, path)
    aside, old = at.beside(f".{uuid.uuid4().hex}-"), at.beside(OLD)
    try:
        write(aside)
    except BaseException:
        at.delete(aside)
        raise
    if at.exists():
        at.move(path, old)
    try:
        at.move(aside, path)
    except BaseException:
        settle(spark, path)
        at.delete(aside)
        raise
    at.delete(old)


def create(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Lets write() fill a folder beside path and renames it to path, unless there is one: then False, and nothing changes."""
    settle(spark, path)
    at = Storage(spark, path)
    if at.exists():
        return False
    aside = at.beside(f".{uuid.uuid4().hex}-")
    try:
        write(aside)
        if at.exists():  # another one came first
            return False
        at.move(aside, path)
        return True
    finally:
        at.delete(aside)
