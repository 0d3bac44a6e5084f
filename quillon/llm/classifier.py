"""A quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .text import LOWER, chunks, word_hashes, words

#: Statistics of a document, all of its text alone.
FEATURES = ("size", "word", "symbols", "capitals", "shouts", "bars", "digits", "stops", "lines", "small", "distinct", "triples")
#: Weight of the pooled covariance in each class's, and what is added to its diagonal.
SHRINK, RIDGE = 0.1, 1e-3
_marks = {
    "symbols": b"#*$%&<>",
    "capitals": bytes(range(65, 91)),
    "shouts": b"!",
    "bars": b"|",
    "digits": b"0123456789",
    "stops": b".,;:?",
    "lines": b"\n",
}


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: logarithms of sizes and of smoothed ratios, so that each statistic is near to a normal one."""
    out = []
    for _, data, offsets in chunks(column):
        n = len(offsets) - 1
        low = LOWER[data]
        starts, ends, first = words(low, offsets)
        h = word_hashes(low, starts, ends)
        h3 = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else np.zeros(0, np.uint64)
        count = np.diff(first).astype(float)
        per = {}
        for name, mark in _marks.items():
            is_mark = np.zeros(256, bool)
            is_mark[list(mark)] = True
            total = np.concatenate([[0], np.cumsum(is_mark[data])])
            per[name] = total[offsets[1:]] - total[offsets[:-1]]
        size = (ends - starts).astype(np.int64)
        small, length = np.concatenate([[0], np.cumsum(size <= 3)]), np.concatenate([[0], np.cumsum(size)])
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)
        triples = np.array([len(np.unique(h3[a : b - 2])) if b - a > 2 else 0 for a, b in zip(first[:-1], first[1:], strict=True)], float)
        ratio = lambda x, of: np.log((x + 0.5) / (of + 1.0))
        rows = np.empty((n, len(FEATURES)))
        letters = (length[first[1:]] - length[first[:-1]]).astype(float)
        rows[:, 0], rows[:, 1] = np.log1p(count), ratio(letters, count)
        for j, name in enumerate(_marks, 2):
            rows[:, j] = ratio(per[name], letters if name == "capitals" else count)
        rows[:, 9], rows[:, 10], rows[:, 11] = ratio(small[first[1:]] - small[first[:-1]], count), ratio(distinct, count), ratio(triples, np.maximum(count - 2, 0))
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Discriminant:
    """Two normal densities with shrunken covariances; the Cholesky factors are kept, not the covariances."""

    def __init__(self, n: list[float], total: list[np.ndarray], square: list[np.ndarray]):
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.parts: list[tuple] = []
        d = len(FEATURES)
        if min(n) < 2:
            return  # one class alone: its share is all that is known
        mean = [t / m for t, m in zip(total, n, strict=True)]
        own = [q / m - np.outer(c, c) for q, m, c in zip(square, n, mean, strict=True)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        for m, c, s in zip(n, mean, own, strict=True):
            weight = max(SHRINK, d / (d + m))
            factor = np.linalg.cholesky((1 - weight) * s + weight * pooled + RIDGE * np.eye(d))
            self.parts.append((c, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for sign, (mean, root, volume) in zip((-1, 1), self.parts, strict=False):
            odds += sign * -0.5 * ((((x - mean) @ root.T) ** 2).sum(1) + volume)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Rows whose crc32 of doc_id as text is divisible by 5 are held out; the others that labels knows train. Only sums of
    products of the statistics leave the executors. Null text is empty and gets a score like any; a null doc_id counts
    as empty text for the fold and has no label; of several labels of an id the least counts, once; with one class alone its
    share is the score. Texts of any length are read whole, about 2 MiB of texts at a time, a longer one by itself. An empty
    table gives an empty result, without labels every score is 1/2. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", *[f"f{i}" for i in range(x.shape[1])]])

    known = scratch.save(docs.mapInArrow(measured, f"doc_id long, {names}"), "features")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    train = known.where(fold != 0).join(marks, "doc_id")
    d = range(len(FEATURES))
    sums_ = [F.sum(f"f{i}").alias(f"s{i}") for i in d] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i in d for j in d if i <= j]
    rows = {r["quality"]: r for r in train.groupBy("quality").agg(F.count("*").alias("n"), *sums_).collect()}  # two rows
    n, total, square = [0.0, 0.0], [np.zeros(len(d))] * 2, [np.zeros((len(d), len(d)))] * 2
    for c, r in rows.items():
        n[c], total[c] = float(r["n"]), np.array([r[f"s{i}"] for i in d])
        square[c] = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in d] for i in d])
    model = Discriminant(n, total, square)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"f{i}").to_numpy() for i in d]) if batch.num_rows else np.zeros((0, len(d)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = known.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
