"""Stupid-backoff scores, relationally: n-gram count tables partitioned by hash, joined to exploded n-grams.

Documents are taken in batches, and a batch lists each of its n-grams once, with its count: a gram that is common
in the corpus costs one row a batch, not one an occurrence. Grams are dealt by hash, summed to the count table and
joined to it where they lie; what goes back to the batches are the counts that they could not know, those of grams
that other batches have too. Slices of the hash space follow one another, so disk holds one slice's shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .text import chunks, mix, word_hashes, words

#: What a step back costs.
BACKOFF = 0.4
#: Parts of the hash space that are counted, and of the batches that are scored, one after the other.
SLICES = 4
#: Listed n-grams of a slice in one partition, about: a table of counts in memory holds no more, however large the corpus.
GRAMS = 1 << 20
#: Words from which on a batch is full; it ends with a document.
BATCH = 500_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Marks that keep the kinds of grams apart: a word, a document, a pair.
WORD, DOCUMENT, PAIR = (_U(x) for x in (0x1F, 0x3B, 0x49))


def gram(kind: np.uint64, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, _U)
    for p in parts:
        h = mix(h * _ODD + p)
    return h


def listed_grams(word: np.ndarray, codes: np.ndarray, first: np.ndarray, keys: np.ndarray, turn: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the grams of some documents that belong to a slice, each once; only pairs of the slice are sorted.

    A word that ends documents is listed once more, with the number of these below zero: it opens no pair there.
    """
    belongs = lambda h: (h >> _U(40)) % _U(slices) == turn
    full = np.flatnonzero(np.diff(first))
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[first[full]] = len(word)
    named, width = np.append(word, _U(0)), len(word) + 1
    mine = belongs((named[before] * _ODD) ^ named[codes])
    pairs, pair_n = np.unique(before[mine] * width + codes[mine], return_counts=True)
    here = belongs(word)
    ends = np.bincount(codes[first[1:][full] - 1], minlength=len(word))
    ended = np.flatnonzero((ends > 0) & here)
    key, same = np.unique(keys[belongs(keys)], return_counts=True)
    parts = [gram(WORD, word[here]), gram(WORD, word[ended]), gram(DOCUMENT, key), gram(PAIR, named[pairs // width], named[pairs % width])]
    counts = [np.bincount(codes, minlength=len(word))[here], -ends[ended], same, pair_n]
    return np.concatenate(parts), np.concatenate(counts).astype(np.int64)


class Batch:
    """The grams of some documents: local words are numbered, and so are local pairs of them."""

    def __init__(self, word: np.ndarray, codes: np.ndarray, first: np.ndarray, keys: np.ndarray):
        self.word, self.codes, self.first, self.keys = word, codes, first, keys
        n = len(codes)
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        before = np.empty(n, np.int64)
        before[1:] = codes[:-1]
        self.full = np.flatnonzero(np.diff(first))  # documents with words
        before[first[self.full]] = len(word)  # the opening mark
        self.before = before
        self.width = len(word) + 1
        self.pairs, self.pair, self.pair_n = np.unique(before * self.width + codes, return_inverse=True, return_counts=True)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of words, documents and pairs, in this order, each once."""
        self.key, self.which, same = np.unique(self.keys, return_inverse=True, return_counts=True)
        named = np.append(self.word, _U(0))
        parts = [gram(WORD, self.word), gram(DOCUMENT, self.key), gram(PAIR, named[self.pairs // self.width], named[self.pairs % self.width])]
        counts = [np.bincount(self.codes, minlength=len(self.word)), same, self.pair_n]
        self.cuts = np.cumsum([len(p) for p in parts])[:-1]
        return np.concatenate(parts), np.concatenate(counts).astype(np.int64)

    def scores(self, known: np.ndarray, others: np.ndarray, ends: np.ndarray, total: int, opened: int, backoff: float) -> np.ndarray:
        """known: hashes of grams that other batches have, sorted; others: how often those have them; ends: how many documents of
        all batches a word ends. total: words of the corpus, opened: documents with words."""
        g, c = self.grams()
        c_end = np.bincount(self.codes[self.first[1:][self.full] - 1], minlength=len(self.word))
        if len(known):
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            there = known[at] == g
            c = c + np.where(there, others[at], 0)
            n = len(self.word)
            c_end = np.where(there[:n], ends[at[:n]], c_end)
        c_w, same, c_pair = np.split(c, self.cuts)
        c_v = np.append(c_w - c_end, opened)
        same = same[self.which][self.row]
        place = self.row.astype(np.int64) * (self.width + 1)

        def own(x: np.ndarray) -> np.ndarray:
            _, back, n = np.unique(place + x, return_inverse=True, return_counts=True)
            return n[back] * same

        rows = np.unique(self.row * len(self.pairs) + self.pair, return_inverse=True, return_counts=True) if len(self.pair) else (None, np.zeros(0, int), np.zeros(0, int))
        left = c_pair[self.pair] - rows[2][rows[1]] * same
        length = np.diff(self.first)
        rest = (total - (length[self.row] * same)).astype(float)
        w = c_w[self.codes] - own(self.codes)
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = np.log(left / (c_v[self.before] - own(self.before)))
            back = np.where(w > 0, np.log(backoff * w / np.maximum(rest, 1)), -np.log(rest + 1))
        return np.bincount(self.row, np.where(left > 0, pair, back), len(length))


#: Batches of one file, and those that go to Python at once: Spark's columnar reader takes up to 4,096 rows of a file into memory, with
#: levels beside the values, and Arrow up to 10,000; here a row is a few megabytes.
TOGETHER = 4


@contextmanager
def few_rows(spark: SparkSession, rows: int = TOGETHER) -> Iterator[None]:
    """What is executed within sends so many rows to Python at once, in place of all that a task reads."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gram_parts(words_in_all: int, slices: int, least: int) -> int:
    """Partitions of a slice's n-grams: a word is listed as one word and one pair at most. At least as many as Spark would take."""
    return max(1, least, -(-2 * words_in_all // (slices * GRAMS)))


def backoff_scores(docs: DataFrame, backoff: float = BACKOFF, scratch: Scratch | None = None, slices: int = SLICES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score: a row for each row of docs.

    The model is of bigrams over the lower-cased words of all documents. A document is scored with its own counts
    taken off, so that it doesn't vouch for itself: each word has c(v w) / c(v) if that is above 0, else backoff times
    c(w) / N, and 1 / (N + 1) for a word that no other document has. The first word follows an opening mark. Words and
    bigrams are known by 64-bit hashes. Null and blank texts score 0 with a null mean; a row is known by its id and
    text, and rows that agree in both get equal scores; a null id is an id. An empty table gives an empty result. A
    text of any length is one row of one batch. Other columns are not read, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text_of()).alias("k"), F.lower(text_of()).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32  # dense numbers pack well
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("k")
            row, hashed, counts = 0, [], []
            for at, data, offsets in chunks(batch.column("text")):
                starts, ends, first = words(data, offsets)
                hashed.append(word_hashes(data, starts, ends))
                counts.append(np.diff(first))
                to = at + len(offsets) - 1
                if sum(map(len, hashed)) < BATCH and to < batch.num_rows:
                    continue
                word, codes = np.unique(np.concatenate(hashed), return_inverse=True)
                first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                lists = [ids.slice(row, to - row), keys.slice(row, to - row), pa.array(first.astype(np.int32)), pa.array(word.view(np.int64)), pa.array(codes.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]], ["batch", "ids", "keys", "first", "word", "codes"])
                name, row, hashed, counts = name + 1, to, [], []

    schema = "batch long, ids array<long>, keys array<long>, first array<int>, word array<long>, codes array<int>"
    held = scratch.save(rows.mapInArrow(read, schema), "batches", maxRecordsPerFile=str(TOGETHER))
    size = held.select(F.size("codes").cast("long").alias("n"), F.aggregate(F.sequence(F.lit(1), F.size("first") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(F.get("first", i) > F.get("first", i - 1), 1).otherwise(0)).alias("o"))
    size = size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
    total, opened = size["n"], size["o"]

    def arrays(table: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        get = lambda c: table.column(c)[i].values.to_numpy(zero_copy_only=False)
        return get("word").view(_U), get("codes").astype(np.int64), get("first").astype(np.int64), get("keys").view(_U)

    def listed(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in batches:
                for i in range(table.num_rows):
                    g, c = listed_grams(*arrays(table, i), turn, slices)
                    g = g.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), table.column("batch")[i].as_py())), pa.array(g), pa.array(c.astype(np.int32))], ["batch", "g", "c"])

        return run

    found = None
    for turn in range(slices):
        grams = held.mapInArrow(listed(turn), "batch long, g long, c int")
        parts = gram_parts(total, slices, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        grams = grams.repartition(parts, "g")  # the count table and the join read this one exchange
        # all columns of the exchange are used on both sides, so that it is read twice and not made twice;
        # keys are hashes, so counts fall evenly over the partitions, and a table of them in memory spares sorting all n-grams
        counted = F.when(F.col("c") > 0, F.col("c"))
        counts = grams.groupBy("g").agg(F.sum(counted).alias("n"), F.sum(F.when(F.col("c") < 0, -F.col("c")).otherwise(0)).alias("ends"), F.count(F.when(F.col("c") > 0, F.col("batch"))).alias("_in")).where("_in > 1").select("g", "n", "ends")
        with few_rows(docs.sparkSession):
            shared = scratch.save(grams.join(counts.hint("shuffle_hash"), "g").select("batch", "g", (F.col("n") - F.col("c")).alias("others"), "ends"), f"shared{turn}")
        found = shared if found is None else found.unionByName(shared)

    def score(batch: pa.Table, counts: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for table in batch.to_batches():
            for i in range(table.num_rows):
                b = Batch(*arrays(table, i))
                g, n, ends = counts.column("g").to_numpy().view(_U), counts.column("others").to_numpy(), counts.column("ends").to_numpy()
                order = np.lexsort((n, g))  # of a word's two rows the one with its own count taken off comes first
                s = b.scores(g[order], n[order], ends[order], total, opened, backoff)
                for column, x in zip(out, (table.column("ids")[i].as_py(), np.diff(b.first).tolist(), s.tolist()), strict=True):
                    column += x
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "n_words", "log_score"])

    scored = None
    for turn in range(slices):
        mine = F.pmod(F.xxhash64("batch"), F.lit(slices)) == turn
        part = held.where(mine).groupBy("batch").cogroup(found.where(mine).groupBy("batch")).applyInArrow(score, "doc_id long, n_words long, log_score double")
        part = scratch.save(part, f"scores{turn}")
        scored = part if scored is None else scored.unionByName(part)
    return scored.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
