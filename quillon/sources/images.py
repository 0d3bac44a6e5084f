"""Images: a scan with content hash, difference hash and size; a sink for grey pictures.

Files are decoded by Spark's own image source. Pixels never leave the scan: what is joined to the files' hashes is a few
strings an image. The difference hash is that of the usual imaging library: grey by integer weights, a bicubic
reduction to 9 x 8 in fixed-point arithmetic, columns first, and a bit for each pair of neighbours, lowest bit first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import require_unique
from .writers import write_files

PATTERN = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"
#: Size of the reduced picture; bits of its fixed-point weights.
ACROSS, DOWN, BITS = 9, 8, 22
# Shares of red, green and blue in grey, of 2 ** 16; the tag of a picture's orientation.
GREY = (19595, 38470, 7471)
ORIENTATION = 0x0112


def cubic(x: np.ndarray) -> np.ndarray:
    """The bicubic kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@lru_cache(256)
def reduction(size: int, to: int) -> np.ndarray:
    """Weights (to, size) that reduce a line of pixels, as integers of 2 ** BITS; the kernel widens with the reduction."""
    ratio = size / to
    wide = max(ratio, 1.0)
    out = np.zeros((to, size))
    for i in range(to):
        center = (i + 0.5) * ratio
        a, b = max(0, int(center - 2 * wide + 0.5)), min(size, int(center + 2 * wide + 0.5))
        w = cubic((np.arange(a, b) - center + 0.5) / wide)
        out[i, a:b] = w / w.sum()
    return np.trunc(out * 2**BITS + np.where(out < 0, -0.5, 0.5))


def reduced(lines: np.ndarray, to: int) -> np.ndarray:
    """Each line of pixels reduced to `to` pixels; sums stay below 2 ** 53, so doubles are exact."""
    return np.clip((lines @ reduction(lines.shape[1], to).T + 2 ** (BITS - 1)) // 2**BITS, 0, 255)


def difference_hash(grey: np.ndarray) -> str:
    """16 hex digits: bit 8 y + x says whether pixel (x + 1, y) of the reduced picture is lighter than (x, y)."""
    small = reduced(reduced(grey.astype(np.float64), ACROSS).T, DOWN).T
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return f"{int.from_bytes(np.packbits(bits, bitorder='little').tobytes(), 'little'):016x}"


def grey_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey values of a picture as Spark gives it: blue, green, red and perhaps alpha, which is left out."""
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels < 3:
        return p[:, :, 0]
    return (p[:, :, 2] * GREY[0] + p[:, :, 1] * GREY[1] + p[:, :, 0] * GREY[2] + 2**15) >> 16


def turned(grey: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is to be seen: orientations 2 to 4 mirror or turn it, 5 to 8 swap its axes too."""
    if orientation >= 5:
        grey = grey.T
        orientation = {5: 1, 6: 2, 7: 3, 8: 4}[orientation]
    return grey[:: -1 if orientation in (3, 4) else 1, :: -1 if orientation in (2, 3) else 1]


def orientation_of(content: bytes) -> int:
    """The orientation (1 to 8) that a JPEG or PNG states, 1 if it states none."""
    tags = b""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                tags = content[at + 10 : at + 2 + size]
                break
            at += 2 + size
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                tags = content[at + 8 : at + 8 + size]
                break
            at += 12 + size
    order = {b"II": "<", b"MM": ">"}.get(tags[:2])
    if not order or len(tags) < 8:
        return 1
    at = struct.unpack(order + "I", tags[4:8])[0]
    for i in range(struct.unpack(order + "H", tags[at : at + 2])[0] if at + 2 <= len(tags) else 0):
        entry = tags[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == ORIENTATION:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def scan_images(spark: SparkSession, root: str, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """(images, broken): image_name, image_path, sha256, bytes, dhash, width, height of all pictures below root, and
    image_name, image_path, error of files that can't be decoded. A repeated base name is an error.

    Sizes and hashes are those of the picture as its orientation says it is to be seen. Hashes of lossless files are
    exact; decoders of JPEG may differ by a level of grey, which near-duplicate distances allow for. Spark's file sources
    don't see files of no bytes.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    path = F.col("_metadata.file_path").alias("image_path")

    def oriented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = pa.array([orientation_of(c.as_py()) for c in b.column("content")], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_path", "sha256", "bytes")), turns], ["image_path", "sha256", "bytes", "turn"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c) for c in ("data", "height", "width", "nChannels")), strict=True)
            found = []
            for data, height, width, channels in ([x.as_py() for x in r] for r in rows):
                ok = data and min(height, width) > 0
                grey = grey_of(data, height, width, channels) if ok else None
                found.append([difference_hash(turned(grey, t)) for t in range(1, 9)] if ok else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_path", "height", "width")), pa.array(found, pa.list_(pa.string()))], ["image_path", "height", "width", "hashes"])

    listed = spark.read.format("binaryFile").options(**options).load(root)
    name = F.url_decode(F.element_at(F.split("image_path", "/"), -1)).alias("image_name")
    require_unique(listed.select(path).select(name), ["image_name"], "images")  # by names alone: no file is opened for it
    files = listed.select(path, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")
    files = files.mapInArrow(oriented, "image_path string, sha256 string, bytes long, turn int")
    pixels = spark.read.format("image").options(**options).load(root).select(path, "image.height", "image.width", "image.nChannels", "image.data")
    pixels = pixels.mapInArrow(hashed, "image_path string, height int, width int, hashes array<string>")
    rows = files.join(pixels, "image_path", "left").select(name, "*")
    swapped = F.col("turn") >= 5
    good = rows.where("hashes is not null").select(
        "image_name", "image_path", "sha256", "bytes", F.element_at("hashes", F.col("turn")).alias("dhash"), F.when(swapped, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(swapped, F.col("width")).otherwise(F.col("height")).alias("height"),
    )
    return good, rows.where("hashes is null").select("image_name", "image_path", F.lit("not a picture that can be decoded").alias("error"))


def png(pixels: np.ndarray) -> bytes:
    """A grey (height, width) or coloured (height, width, 3) picture of bytes as a PNG file."""
    height, width = pixels.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(df: DataFrame, root: str) -> DataFrame:
    """Writes grey pictures (name, width, pixels: an array of 0 to 255 by lines) below root; (name, bytes), which must be acted on."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [png(np.array(p.as_py(), np.uint8).reshape(-1, w.as_py())) for w, p in zip(b.column("width"), b.column("pixels"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(files, pa.binary())], ["name", "content"])

    rows = df.select("name", "width", "pixels").repartition(4 * df.sparkSession.sparkContext.defaultParallelism)  # a file is work, however few bytes its row has
    return write_files(rows.mapInArrow(encoded, "name string, content binary"), root)
