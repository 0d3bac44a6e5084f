"""Packing documents into sequences: best fit, then a local search that swaps documents between underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets
from .text import BLANK, LOWER, chunks, distinct_words, equal_words, give_back, words

#: Pieces that one task packs.
GROUP = 20_000
#: Words whose ids a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """ids of whole texts from the ids of their words, each word asked of the tokenizer once; words are known by their bytes.

    The vocabulary splits texts at blanks and between letters and signs, and is in lower case, so words are told
    apart by ASCII blanks, A-Z is lower-cased, and a final stop or comma behind an ASCII letter is a word of its own.
    The strings of special tokens hold no blanks; they are found before letters are lower-cased, so words with their
    opening signs keep their case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.bytes, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # of each row
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each word; new words are learned, and so is one whose hash another word has, for this once."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        rows, taken = np.full(len(starts), -1, np.int64), np.zeros(len(starts), bool)
        if len(self.hashes):
            taken = self.hashes[place] == hashes
            hit, row = np.flatnonzero(taken), self.row[place[taken]]
            rows[hit] = np.where(equal_words(data, starts[hit], ends[hit], self.bytes, self.at[row], self.at[row + 1]), row, -1)
        new = np.flatnonzero(rows < 0)
        if len(new):
            known, text = len(self.at) - 1, data.tobytes()
            words = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self.learn(words)
            rows[new] = known + np.arange(len(new))
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(ends[new] - starts[new])])
            keep = new[~taken[new]]
            keep = keep[np.unique(hashes[keep], return_index=True)[1]]
            spot = np.searchsorted(self.hashes, hashes[keep])
            self.hashes, self.row = np.insert(self.hashes, spot, hashes[keep]), np.insert(self.row, spot, rows[keep])
        return rows

    def learn(self, words: list[bytes]) -> None:
        flat, counts = [self.flat], []
        for i in range(0, len(words), 1000):  # long texts make the tokenizer slower
            part = [w.decode() for w in words[i : i + 1000]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            flat.append(np.array(found.ids, np.uint32))
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            counts.append(np.diff(np.searchsorted(at, np.cumsum([0, *(len(w) + 1 for w in part)]))))
        self.flat = np.concatenate(flat)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(counts))])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's begin; one more at the end."""
        raw, data = data, LOWER[data]
        stop = np.zeros(len(data) + 1, bool)
        if len(data):
            closes = np.append(BLANK[data[1:]], True)
            closes[offsets[(offsets > 0)] - 1] = True
            letter = (data >= 97) & (data <= 122)
            stop[1:-1] = ((data[1:] == 46) | (data[1:] == 44)) & closes[1:] & letter[:-1]
            stop[offsets] = False
        starts, ends, first = words(data, offsets, stop)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        opening = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))  # <|
        for w in np.unique(np.searchsorted(starts, opening, "right") - 1).tolist() if len(opening) else ():
            data[starts[w] : ends[w]] = raw[starts[w] : ends[w]]
        where, which, hashes = distinct_words(data, starts, ends)
        if len(self.at) + len(where) > REMEMBERED:
            self.clear()
        rows = self.rows(data, starts[where], ends[where], hashes)[which]
        count = self.start[rows + 1] - self.start[rows]
        until = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.start[rows] - until[:-1], count) + np.arange(until[-1])
        return self.flat[place], until[first]


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, limit: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents end with id 0; only those over limit are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            docs = batch.column("doc_id").to_pylist()
            for at, data, offsets in chunks(batch.column("text"), 4 << 20):
                flat, begin = _loaded[path].ids(data, offsets)
                for doc, a, b in zip(docs[at : at + len(begin) - 1], begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    ids = flat[a:b].astype("<u4").tobytes() + b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[start : start + 4 * limit]
                        for column, x in zip(rows, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        _loaded[path].clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenized, schema)


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of indices: the longest first, each into the bin that it leaves least room in."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(int(i))
        else:
            room, b = limit, len(bins)
            bins.append([int(i)])
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


class Rooms:
    """The pieces of underfull bins by what could stand in their place: at most their size and the room of their bin.

    least[c] is the smallest size of a piece whose place, with the room of its bin, holds c; size 0 is a bin's bare room.
    """

    def __init__(self, limit: int):
        self.none = limit + 1
        self.least = np.full(limit + 1, self.none, np.int64)
        self.sizes = [0] * (limit + 1)  # by c: bit m is set if a piece of size m is there
        self.bins: dict[tuple[int, int], dict[int, None]] = {}

    def add(self, b: int, room: int, sizes: set[int]) -> None:
        for m in (0, *sizes):
            self.bins.setdefault((m + room, m), {})[b] = None
            self.sizes[m + room] |= 1 << m
            if m < self.least[m + room]:
                self.least[m + room] = m

    def remove(self, b: int, room: int, sizes: set[int]) -> None:
        for m in (0, *sizes):
            c = m + room
            there = self.bins[c, m]
            del there[b]
            if not there:
                del self.bins[c, m]
                left = self.sizes[c] = self.sizes[c] & ~(1 << m)
                self.least[c] = (left & -left).bit_length() - 1 if left else self.none

    def best(self, options: np.ndarray, room: int) -> tuple[int, int, int, int] | None:
        """(n, c, m, bin) of the largest n - m > 0 for an n among options, n <= c < n + room, m = least[c]; the least such c.

        A giver with that room raises the sum of squared fills by 2 * (n - m) * (n + room - c).
        """
        have, x = 1, np.concatenate([self.least, np.full(room, self.none)])
        while 2 * have <= room:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        low = np.minimum(x[options], x[options + room - have])
        at = int(np.argmax(options - low))
        n, m = int(options[at]), int(low[at])
        if n <= m:
            return None
        c = n + int(np.argmax(self.least[n : n + room] == m))
        return n, c, m, next(iter(self.bins[c, m]))


def improve(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Local search between underfull bins: a document moves, or one or two are exchanged for one, if that raises the
    sum of squared fills; bins that run empty go. The emptiest bin gives as much as it can, then the next one, and so on
    in rounds, until the bins are as few as the total length allows or no bin can give."""
    size = lengths.tolist()
    bins = [list(b) for b in bins if b]
    fill = [sum(size[i] for i in b) for b in bins]
    excess = len(bins) - -(-sum(fill) // limit)
    rooms = Rooms(limit)
    sizes_of = lambda b: {size[i] for i in bins[b]}
    for b in range(len(bins)):
        if fill[b] < limit:
            rooms.add(b, limit - fill[b], sizes_of(b))
    moved = True
    while moved and excess > 0:
        moved = False
        for giver in sorted((b for b in range(len(bins)) if 0 < fill[b] < limit), key=lambda b: fill[b]):
            if excess <= 0:
                break
            if not 0 < fill[giver] < limit:  # emptied or filled since
                continue
            rooms.remove(giver, limit - fill[giver], sizes_of(giver))
            while bins[giver]:
                at: dict[int, list[int]] = {}
                for i in bins[giver]:
                    at.setdefault(size[i], []).append(i)
                kinds = sorted(at)
                two = [j + k for x, j in enumerate(kinds) for k in kinds[x if len(at[j]) > 1 else x + 1 :]]
                found = rooms.best(np.array(kinds + two), limit - fill[giver])
                if found is None:
                    break
                n, c, m, b = found
                if n in at:
                    out = at[n][:1]
                else:
                    one = next(k for k in at if n - k in at and (n != 2 * k or len(at[k]) > 1))
                    out = at[one][:1] + at[n - one][-1:]
                rooms.remove(b, limit - fill[b], sizes_of(b))
                back = [next(i for i in bins[b] if size[i] == m)] if m else []
                bins[giver] = [i for i in bins[giver] if i not in out] + back
                bins[b] = [i for i in bins[b] if i not in back] + out
                fill[giver] -= n - m
                fill[b] += n - m
                if fill[b] < limit:
                    rooms.add(b, limit - fill[b], sizes_of(b))
                moved = True
            if bins[giver]:
                rooms.add(giver, limit - fill[giver], sizes_of(giver))
            else:
                excess -= 1
    return [b for b in bins if b]


def pack(docs: DataFrame, limit: int = 2048, path: str | None = None, scratch: Scratch | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Pieces of full length are sequences of their own. The others are dealt evenly into groups of about `group`
    pieces, whatever their ids, and each group is packed by itself, so a task's memory is bounded and at most a few
    bins a group stay underfull. Null text is empty: id 0 alone. Repeated rows are packed each for itself. Texts of any
    length are read whole, about 4 MiB of texts at a time, a longer one by itself, and cut into full pieces. An empty table
    gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, limit, path or vocabulary()), "pieces")
    alone = cut.where(F.col("length") == limit).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < limit)
    groups = buckets(rest.count(), group)
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins = improve(best_fit(lengths, limit), lengths, limit)
        order = np.array([i for b in bins for i in b], np.int64)
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.concatenate([np.cumsum(lengths[b]) for b in bins])
        rows = rows.iloc[order].reset_index(drop=True)
        rows["sequence_id"] = sequence + rows["_group"] * 2**32
        rows["offset"] = ends - rows["length"].to_numpy()
        return rows.drop(columns="_group")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return alone.select(*[c.split()[0] for c in schema.split(", ")]).unionByName(rest.groupBy("_group").applyInPandas(packed, schema))
