"""Repeated strings: distributed prefix doubling, over positions that are sampled so that no repeat is lost.

A suffix array by doubling ranks positions by their first h bytes, then by pairs of ranks at growing offsets, until a
position's rank is unique or h is past the threshold. Here a rank is a 64-bit name, Spark deals out and sorts the
pairs, and a round ranks, instead of every position, one for each window of `least` bytes that may still be repeated:
the one whose name is smallest. Equal windows hold the same one at the same place, so a window whose position has a
unique rank isn't repeated, and leaves. The last round's length is that of the windows, which then stand for themselves,
each a row; that is the largest table, so its ranks are counted and joined in slices, whose shuffle files go one after another.

Positions with equal surroundings (all windows that they stand for) are repeats as a whole: their windows are settled at
once, and of each kind of surroundings one goes on, as a partner for the windows of other kinds.

The first round takes shorter windows, of 3/4 of `least`; their shared ranks mark documents with a common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_checked, join_spread, text_of
from .text import between, chunks, mix, powers, sums

#: Places that are told apart within a stretch of bytes, in the low bits of the names.
PLACE = np.uint64((1 << 21) - 1)
#: Parts, by hash of the rank, in which a round's ranks are counted and joined to its rows.
SLICES = 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, length: int | None = None, step: int = 0, least: int | None = None, run: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, first, last, low, high, around, run): windows first to last of a row are stood for by one position.

    low and high are the position's names at 0 and at step, of length - step bytes each (step 0: one name of all length
    bytes). first and last count from the row's start; around names the bytes of all windows of `least` bytes that begin
    there (last is behind first - 1 only if there are any). run: numbers by place, 0 where no window is looked at; windows
    of different numbers are kept apart. Bytes are taken in stretches that overlap, so that each window is in one.
    """
    length, least = length or window // 2, max(window, least or window)
    room = int(PLACE) + 1
    if room < least:
        raise ValueError(f"PLACE has room for {room} bytes, fewer than the {least} of a window")
    stride = room - least + 1
    found = []
    for at in range(0, max(1, len(data) - window + 1), stride):
        end = len(data) <= at + room
        part = data[at : at + room]
        row, first, last, *rest = _anchors(part, np.clip(offsets - at, 0, len(part)), offsets[1:] - at, window, length, step, least, None if run is None else run[at : at + room], len(part) if end else stride)
        moved = np.maximum(at - offsets[row], 0)
        found.append((row, first + moved, last + moved, *rest))
        if end:
            break
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, window: int, length: int, step: int, least: int, run: np.ndarray | None, stop: int) -> tuple[np.ndarray, ...]:
    """anchors() of one stretch, of windows that begin before stop. ends: of the rows, within the stretch or behind it."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return (none,) * 7
    prefix = sums(data)
    n = len(data) - length + 1
    # the high bits of the rolling hash, then the place: the least is the leftmost of the smallest
    order = (((prefix[length:] - prefix[:n]) * powers(len(prefix))[1][:n]) & ~PLACE) | np.arange(n, dtype=np.uint64)
    best = (sliding_min(order, window - length + 1)[:stop] & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    runs = np.ones(len(best), np.int64) if run is None else run[: len(best)]
    valid = (np.arange(len(best)) + window <= offsets[1:][row]) & (runs > 0)
    change = np.ones(len(best), bool)
    change[1:] = (best[1:] != best[:-1]) | ~valid[:-1] | (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])
    first = np.flatnonzero(change & valid)
    if not len(first):
        return (none,) * 7
    until = np.flatnonzero(np.append(change | ~valid, True))
    last = until[np.searchsorted(until, first, "right")] - 1
    last = np.maximum(np.minimum(last, ends[row[first]] - least), first - 1)
    place = best[first]
    low = between(prefix, place, place + length - step)
    high = between(prefix, place + step, place + length) if step else np.zeros(len(place), np.uint64)
    far = np.where(last >= first, last + least, first)
    around = mix(between(prefix, first, far) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = offsets[row[first]]
    return row[first], first - base, last - base, low.view(np.int64), high.view(np.int64), around.view(np.int64), runs[first]


def packed(first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Both ends of a run of windows in one number."""
    return pa.array(first.astype(np.int64) << 32 | (last + 1).astype(np.int64), pa.int64())


def unpacked(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs >> 32, (runs & 0xFFFFFFFF) - 1


FOUND = "_k long, run long, low long, high long, around long, alone boolean"


def remove_repeats(docs: DataFrame, least: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_passage: a row for each row of docs.

    Every byte covered by a string of `least` UTF-8 bytes that also starts elsewhere, in this or another row, is
    removed; n_spans counts the longest runs of removed bytes. has_passage is true of rows in which 3/4 of `least` bytes
    (300, about 50 words) stand that also start elsewhere, and of no row in which half of these don't. Null text is empty.
    Ids may be null or repeated: a row is known by its id and its text, and equal rows are repeats of each other. Texts of
    any length are taken in stretches of bytes. An empty table gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), text_of().alias("text"))
    docs = docs.withColumn("_k", F.xxhash64("_id", "text"))
    passage = max(2, 3 * least // 4)

    def rows(keys: pa.Array, at: int, found: tuple[np.ndarray, ...], alone: np.ndarray) -> pa.RecordBatch:
        row, first, last, low, high, around, _ = found
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row + at)), packed(first, last), pa.array(low), pa.array(high), pa.array(around), pa.array(alone)], [c.split()[0] for c in FOUND.split(", ")])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                found = anchors(data, offsets, passage, passage // 2, least=least)
                yield rows(batch.column("_k"), at, found, np.ones(len(found[0]), bool))

    def doubled(length: int, step: int):
        """A round over the runs of windows that are left: pairs of ranks of length - step bytes, at 0 and at step."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = batch.column("runs")
                for at, data, offsets in chunks(batch.column("text")):
                    mark, alone = np.zeros(len(data), np.int32), [False]
                    for i in range(len(offsets) - 1):
                        first, last = unpacked(left[at + i].values.field("run").to_numpy())
                        for a, b in zip((first + offsets[i]).tolist(), (last + offsets[i] + 1).tolist(), strict=True):
                            mark[a:b] = len(alone)
                            alone.append(True)
                        alone[len(alone) - len(first) :] = left[at + i].values.field("alone").to_pylist()
                    found = anchors(data, offsets, least, length, step, run=mark)
                    yield rows(batch.column("_k"), at, found, np.array(alone)[found[6]])

        return run

    def shared_rows(found: DataFrame, rows: DataFrame, name: str) -> DataFrame:
        """The rows (some of found) whose rank is shared within found, slice by slice; by one plan, whatever the size."""
        rank, out = ["low", "high"], None
        for i in range(SLICES):
            mine = F.pmod(F.xxhash64(*rank), F.lit(SLICES)) == i
            shared = scratch.save(found.where(mine).groupBy(*rank).agg(F.count("*").alias("n")).where("n > 1"), f"shared-{name}")
            part = scratch.save(join_spread(rows.where(mine), shared, rank, "n", few=0).drop("n"), f"live-{name}/{i}")
            scratch.drop(f"shared-{name}")
            out = part if out is None else out.unionByName(part)
        return out

    def settle(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows of shared rank, those that are repeats as a whole, a row for each kind where a rank has several)."""
        rank = ["low", "high"]
        live = shared_rows(found, found, name)
        kinds = live.where("(run & 4294967295) > shiftright(run, 32)").groupBy(*rank, "around")
        kinds = scratch.save(kinds.agg(F.count("*").alias("n"), F.min("_k").alias("k"), F.min_by("run", "_k").alias("run"), F.min("alone").alias("alone")), f"kinds-{name}")
        twice = scratch.save(kinds.where("n > 1").select(*rank, "around", "n"), f"twice-{name}")
        whole = scratch.save(join_spread(live.where("alone"), twice, [*rank, "around"], "n").select("_k", "run"), f"whole-{name}")
        several = scratch.save(kinds.groupBy(*rank).agg(F.count("*").alias("_n")).where("_n > 1"), f"several-{name}")
        fine = join_spread(kinds, several, rank, "_n").select(F.col("k").alias("_k"), "run", (F.col("alone") & (F.col("n") == 1)).alias("alone"))
        return live, whole, fine

    def grouped(runs: DataFrame, *columns: str | Column) -> DataFrame:
        return runs.groupBy("_k").agg(F.collect_list(F.struct(*columns)).alias("runs"))

    found = scratch.save(docs.select("_k", "text").mapInArrow(begin, FOUND), "found-0")
    live, spans, fine = settle(found, "0")
    again = scratch.save(live.select("_k").distinct(), "again")
    scratch.drop("found-0")
    texts = scratch.save(join_checked(docs.select("_k", "text"), again, ["_k"]), "texts")
    length, turn = passage // 2, 0
    while length < least:
        turn += 1
        step = min(length, least - length)
        left = grouped(fine, "run", "alone")
        found = texts.join(left, "_k").mapInArrow(doubled(length + step, step), FOUND)
        length += step
        if length < least:
            found = scratch.save(found, f"found-{turn}")
            _, whole, fine = settle(found, str(turn))
        else:  # a row is one window, and its rank all that surrounds it: whatever is shared is a repeat as a whole
            found = scratch.save(found.drop("around"), f"found-{turn}")
            whole = shared_rows(found, found.where("alone"), str(turn)).select("_k", "run")
        spans = spans.unionByName(whole)
        scratch.drop(f"found-{turn}", *[f"{t}-{turn - 1}" for t in ("live", "kinds", "twice", "several")])
    spans = scratch.save(grouped(spans, "run"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, runs in zip(*(batch.column(c) for c in ("_k", "text", "runs")), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                first, last = unpacked(runs.values.field("run").to_numpy())
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + least, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((key.as_py(), int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["_k", "_removed", "_spans", "_sha"])

    done = texts.join(spans, "_k").mapInArrow(cut, "_k long, _removed long, _spans long, _sha string").dropDuplicates(["_k"])
    done = scratch.save(again.join(done, "_k", "left").withColumn("has_passage", F.lit(True)), "cut")
    slim = docs.select("doc_id", "_k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_all"))
    out = slim.join(done, "_k", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("_removed", F.lit(0)).alias("n_removed"), F.coalesce("_spans", F.lit(0)).alias("n_spans"), F.coalesce("_sha", "_all").alias("kept_sha256"), F.coalesce("has_passage", F.lit(False)).alias("has_passage"))
