"""HTTP sources: downloads that go on where they were cut off, and product records by barcode with a cache.

Both are Python data sources: a partition is a file or a batch of barcodes, so executors fetch side by side, a lost
one's work is taken up by another from the pieces that lie in the shared folder, and what comes out is a DataFrame.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one request asks for.
PIECE = 8 << 20
TRANSIENT = (urllib.error.URLError, http.client.HTTPException, ConnectionError, TimeoutError)
# The fewest seconds between two requests to the product service, and its versions that are known.
PAUSE, VERSIONS = 4.2, ("v3.6", "v2")


class Mismatch(ValueError):
    """What was fetched isn't what was asked for."""


def request(url: str, headers: dict[str, str], retries: int, timeout: float, wait: float) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body); what may pass is tried again after growing pauses, what is refused is an error at once."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                body = r.read()
                length = r.headers.get("Content-Length")
                if length is not None and len(body) != int(length):
                    raise http.client.IncompleteRead(body, int(length) - len(body))
                return r.status, {k.lower(): v for k, v in r.headers.items()}, body
        except TRANSIENT as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 429)
            if refused or attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class Folder:
    """Files below a folder of the file system that its address names."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.base, recursive=True)

    def read(self, name: str) -> bytes | None:
        from pyarrow import fs

        path = f"{self.base}/{name}"
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def write(self, name: str, chunks: Iterator[bytes]) -> None:
        """A file appears under its name when all of it is written."""
        aside = f"{self.base}/.{name}.new"
        with self.fs.open_output_stream(aside) as f:
            for c in chunks:
                f.write(c)
        self.fs.move(aside, f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.base}/{name}").type == fs.FileType.File:
            self.fs.delete_file(f"{self.base}/{name}")


def fetch(url: str, folder: Folder, name: str, sha256: str | None, retries: int = 3, timeout: float = 90.0, wait: float = 1.0, piece: int = PIECE) -> dict:
    """Downloads url to folder/name and returns its provenance, which stands beside it as name.source.json.

    A file is fetched in pieces of some bytes, each kept as a file; a later try asks only for those that are missing, as long
    as the server says that the file is the same (entity tag, date or size). A server that doesn't give pieces gives all at once.
    Another hash than the expected one is an error, and nothing stays. A file whose record and hash agree isn't asked for.
    """
    known = json.loads(folder.read(f"{name}.source.json") or b"{}")
    if known.get("url") == url and sha256 in (None, known.get("sha256")) and (body := folder.read(name)) is not None and hashlib.sha256(body).hexdigest() == known["sha256"]:
        return {**known, "fetched": 0}
    plan = json.loads(folder.read(f"{name}.plan.json") or b"{}")
    fetched, at = 0, 0
    while True:
        part = f"{name}.piece{at // piece:06d}"
        if not (plan and folder.read(part) is not None):
            status, headers, body = request(url, {"Range": f"bytes={at}-{at + piece - 1}"}, retries, timeout, wait)
            total = int(headers["content-range"].rpartition("/")[2]) if status == 206 else len(body)
            mark = {"url": url, "total": total, "whole": status != 206, "version": headers.get("etag") or headers.get("last-modified") or str(total)}
            if plan and mark != plan:  # another file by now: all pieces go
                forget(folder, name, plan, piece)
                plan, at = {}, 0
                continue
            if not plan:
                folder.write(f"{name}.plan.json", iter([json.dumps(mark).encode()]))
                plan = mark
            folder.write(part, iter([body]))
            fetched += len(body)
        at += piece
        if plan["whole"] or at >= plan["total"]:
            break
    sha, size = hashlib.sha256(), 0

    def pieces() -> Iterator[bytes]:
        nonlocal size
        for i in range(1 if plan["whole"] else max(1, -(-plan["total"] // piece))):
            body = folder.read(f"{name}.piece{i:06d}") or b""
            sha.update(body)
            size += len(body)
            yield body

    folder.write(name, pieces())
    forget(folder, name, plan, piece)
    if size != plan["total"] or sha256 not in (None, sha.hexdigest()):
        folder.drop(name)
        raise Mismatch(f"{url}: {size} of {plan['total']} bytes, hash {sha.hexdigest()}")
    record = {"url": url, "sha256": sha.hexdigest(), "bytes": size, "version": plan["version"], "fetched_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    folder.write(f"{name}.source.json", iter([json.dumps(record).encode()]))
    return {**record, "fetched": fetched}


def forget(folder: Folder, name: str, plan: dict, piece: int) -> None:
    for i in range(1 if plan.get("whole") else max(1, -(-plan.get("total", 0) // piece))):
        folder.drop(f"{name}.piece{i:06d}")
    folder.drop(f"{name}.plan.json")


class Items(InputPartition):
    def __init__(self, items: list):
        super().__init__(items)
        self.items = items


class Downloads(DataSource):
    """format("downloads"): options files (JSON: a list of [url, name, sha256 or null]), folder, retries, timeout, wait, piece."""

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def schema(self) -> str:
        return "url string, name string, bytes long, sha256 string, version string, fetched_at string, fetched long"

    def reader(self, schema) -> DataSourceReader:
        return DownloadReader(dict(self.options))


class DownloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [Items([f]) for f in json.loads(self.options["files"])]

    def read(self, partition: Items) -> Iterator[tuple]:
        kinds = {"retries": int, "timeout": float, "wait": float, "piece": int}
        tuning = {k: kind(self.options[k]) for k, kind in kinds.items() if k in self.options}
        for url, name, sha256 in partition.items:
            r = fetch(url, Folder(self.options["folder"]), name, sha256, **tuning)
            yield (url, name, r["bytes"], r["sha256"], r["version"], r["fetched_at"], r["fetched"])


def download(spark: SparkSession, files: Sequence[tuple[str, str, str | None]], folder: str, **options: object) -> DataFrame:
    """(url, name, bytes, sha256, version, fetched_at, fetched) of files (url, name, expected hash or None) below a shared folder."""
    spark.dataSource.register(Downloads)
    return spark.read.format("downloads").options(files=json.dumps(list(files)), folder=folder, **options).load()


class Products(DataSource):
    """format("products"): options barcodes (JSON), service, version, agent, pause, retries, timeout, wait."""

    @classmethod
    def name(cls) -> str:
        return "products"

    def schema(self) -> str:
        return "barcode string, found boolean, snapshot string"

    def reader(self, schema) -> DataSourceReader:
        return ProductReader(dict(self.options))


class ProductReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [Items(json.loads(self.options["barcodes"]))]  # the service bears one request at a time

    def read(self, partition: Items) -> Iterator[tuple]:
        o = self.options
        for i, code in enumerate(partition.items):
            if i:
                time.sleep(float(o.get("pause", PAUSE)))
            url = f"{o['service'].rstrip('/')}/api/{o['version']}/product/{urllib.parse.quote(code)}.json"
            try:
                _, _, body = request(url, {"User-Agent": o["agent"]}, int(o.get("retries", 3)), float(o.get("timeout", 30)), float(o.get("wait", 1)))
                found = json.loads(body)
                yield (code, True, json.dumps(found, sort_keys=True))
            except urllib.error.HTTPError as e:
                if e.code != 404:
                    raise
                yield (code, False, None)


def lookup_products(barcodes: DataFrame, cache: str, service: str, agent: str, version: str = "v3.6", refresh: bool = False, **options: object) -> DataFrame:
    """(barcode, found, snapshot) of distinct valid barcodes: from the cache, a folder of Parquet, or asked for and put there.

    Only barcodes that the cache lacks (all of them with refresh) are asked for, one after another with a pause between
    them, so their number is what the service's pace bears. Codes without a product are kept as such. An agent must be named.
    """
    from ..functions.scalars import is_barcode
    from .storage import Storage

    if version not in VERSIONS or not agent:
        raise ValueError("a known version and an agent are needed")
    spark = barcodes.sparkSession
    spark.dataSource.register(Products)
    wanted = barcodes.where(is_barcode(F.col("barcode"))).select("barcode").distinct()
    there = Storage(spark, cache).exists()
    known = spark.read.parquet(cache) if there else spark.createDataFrame([], "barcode string, found boolean, snapshot string")
    missing = wanted if refresh else wanted.join(known, "barcode", "left_anti")
    codes = [r["barcode"] for r in missing.orderBy("barcode").collect()]  # one request each, seconds apart
    if codes:
        got = spark.read.format("products").options(barcodes=json.dumps(codes), service=service, version=version, agent=agent, **options).load()
        kept = known.join(missing, "barcode", "left_anti") if refresh else known
        from .writers import write_arrays

        write_arrays(kept.unionByName(got), cache)
    return wanted.join(spark.read.parquet(cache) if Storage(spark, cache).exists() else known, "barcode")
