"""Conversation prefix trie: an external mergesort that carries longest common prefixes, and a stack of open paths.

A turn is a digest of 16 bytes. Conversations lie in rows of up to SEGMENT turns, a row's key being the name of all the
turns before it, its digests, and the name of what follows, if anything does. Rows are sorted in runs that carry the
number of units each key shares with the key before it. Runs are dealt by ranges of (key, conv_id), so copies of one
conversation and a first turn that all share are cut like anything else. A task merges its runs with a tree of losers
that compares two keys only from where both are known to differ from the last one, and walks the merged stream with a
stack: a shorter common prefix closes nodes. A task knows the last key before its range and the first one behind it, so
of a node that spans ranges each task returns its own part of the sums, and the parts are added. Rows of later segments
come first, and their sums hang below the node that they go on from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import Scratch, buckets, join_checked, text_of, words_of

#: Turns of a conversation in a row, rows in a sorted run, turns that a task merges. They deal out work; results don't depend on them.
SEGMENT, RUN, RANGE = 1024, 8192, 250_000
#: Bytes of a unit of a key, and the name of what stands before a first turn.
UNIT, ROOT = 16, bytes(16)
#: Conversations whose first turns come from the same one.
SHARED = 20


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Units that two keys have in common, of which some are known."""
    most = min(len(a), len(b)) // UNIT
    while known < most and a[known * UNIT : (known + 1) * UNIT] == b[known * UNIT : (known + 1) * UNIT]:
        known += 1
    return known


class Losers:
    """Merges sorted runs of (key, conv_id, units shared with the one before, ...) by a tree of losers.

    A loser keeps the units that it shares with the key that beat it. When the winner's successor climbs its path, the
    one that shares more with the last winner is the smaller; only equal numbers ask for a comparison, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.tree: list[tuple[int, int]] = [(0, 0)] * self.size  # (run, units shared) of each loser; at 0 the winner
        self.tree[0] = self.play(1)

    def play(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        won, self.tree[node] = self.match(self.play(2 * node), self.play(2 * node + 1))
        return won

    def match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser); both numbers are of units shared with the last winner."""
        x, y = self.head[a[0]], self.head[b[0]]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        n = shared(x[0], y[0], a[1])
        first = x[0][n * UNIT : (n + 1) * UNIT], y[0][n * UNIT : (n + 1) * UNIT]
        smaller = first[0] < first[1] if first[0] != first[1] else x[1] < y[1]
        return (a, (b[0], n)) if smaller else (b, (a[0], n))

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """(row, units it shares with the row before it in the merged order)."""
        while (row := self.head[self.tree[0][0]]) is not None:
            run, units = self.tree[0]
            yield row, units
            self.head[run] = after = next(self.runs[run], None)
            climbing, node = (run, after[2] if after else 0), (run + self.size) // 2
            while node:
                climbing, self.tree[node] = self.match(climbing, self.tree[node])
                node //= 2
            self.tree[0] = climbing


class Node:
    """An open node: what of its subtree lies in this range. Below a node at a segment's end hangs a link to what goes on."""

    __slots__ = ("started", "extended", "link", "words", "n", "least", "children", "leaves", "saved", "ends", "waiting", "opens")

    def __init__(self, started: bool, words: int, link: tuple | None):
        self.started, self.words, self.link = started, words, link
        self.extended, self.n, self.least, self.children, self.leaves, self.saved = False, 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # closed children, until the least member is known
        self.opens: bytes | None = None


#: kind 0 is a whole node, 1 a part of one, 2 the sums of a later segment; up names a parent whose conv_id isn't known here.
_NODES = pa.schema([("kind", pa.int32()), ("id", pa.binary()), ("part", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("up", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("opens", pa.binary())])
NODES = "kind int, id binary, part long, conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, opens binary"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def finished(rows: Iterator[tuple[tuple, int]], before: bytes | None, after: bytes | None, part: int, level: int, segment: int) -> Iterator[tuple]:
    """Rows of NODES from the merged stream of a range, as soon as a node and the least member of its parent are known.

    before and after are the last key in front of the range and the first behind it.
    """
    path: list[Node] = []
    last = b""

    def name(unit: int) -> bytes:
        return last[:UNIT] if level and not unit else hashlib.sha256(last[: (unit + 1) * UNIT]).digest()

    def placed(row: tuple, least: int | None, up: bytes | None) -> tuple:
        return (*row[:5], least, up, *row[7:])

    def close(goes_on: bool) -> Iterator[tuple]:
        """Takes the deepest node off the path; goes_on: the next range has members of it too."""
        unit, node = len(path) - 1, path.pop()
        up = path[-1] if path else None
        if up:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.link:
            if node.started:
                up.children, up.leaves, up.saved = up.children + node.link[1], up.leaves + node.link[2], up.saved + node.link[3]
            up.opens = node.link[0]
            return
        node.saved += (node.n - node.started) * node.words
        node.leaves += not node.extended and not goes_on
        if up:
            up.children, up.leaves, up.saved = up.children + node.started, up.leaves + node.leaves, up.saved + node.saved
        if level and not unit:
            yield from (placed(row, None, name(0)) for row in node.waiting)
            yield (2, name(0), part, None, None, None, None, None, node.children, node.leaves, node.saved, None, None)
            return
        depth, ends, sums = level * segment + unit, ",".join(map(str, node.ends)), (node.n, node.children, node.leaves, node.saved)
        if node.started and not goes_on:
            yield from (placed(row, node.least, None) for row in node.waiting)
            row = (0, None, part, node.least, depth, None, None, *sums, digest(ends), node.opens)
            if up:
                up.waiting.append(row)
            else:
                yield row
        else:
            yield from (placed(row, None, name(unit)) for row in node.waiting)
            yield (1, name(unit), part, node.least, depth, None, name(unit - 1) if unit else None, *sums, ends, node.opens)

    for (key, conv, _, words, link), units in rows:
        first = shared(before, key) if not path and before else 0  # units whose nodes began in an earlier range
        while len(path) > units:
            yield from close(False)
        last = key
        for unit in range(len(path), len(key) // UNIT):
            if path:
                path[-1].extended = True
            beyond = unit == segment + 1
            path.append(Node(unit >= first, words[unit - 1] if unit and not beyond else 0, link if beyond else None))
        top = path[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if not top.link:
            top.ends.append(conv)
    still = shared(last, after) if path and after else 0
    while path:
        yield from close(len(path) <= still)


def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of up to RUN rows with the units that each key shares with the one before."""
    number, held, rows = TaskContext.get().partitionId() << 32, [], 0

    def run() -> pa.RecordBatch:
        nonlocal number
        table = pa.Table.from_batches(held).combine_chunks()
        keys, convs = table.column("key").to_pylist(), table.column("conv_id").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], convs[i]))
        units = [0, *(shared(keys[a], keys[b]) for a, b in zip(order[:-1], order[1:], strict=True))]
        table = table.take(pa.array(order, pa.int64()))
        for column, values in (("run", pa.array([number] * len(order), pa.int64())), ("at", pa.array(range(len(order)), pa.int64())), ("units", pa.array(units, pa.int64()))):
            table = table.append_column(column, values)
        number += 1
        held.clear()
        return table.combine_chunks().to_batches()[0]

    for batch in batches:
        for a in range(0, batch.num_rows, RUN):
            held.append(batch.slice(a, RUN))
            rows += held[-1].num_rows
            if rows >= RUN:
                yield run()
                rows = 0
    if rows:
        yield run()


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from their parts, sorted by node and range; the ends of a node are hashed part by part, never held together."""
    now, sha, sums, out = None, None, [], []
    schema = pa.schema([_NODES.field(i) for i in (1, 3, 4, 6, 7, 8, 9, 10, 11, 12)])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema.types, strict=True)], schema=schema)
        out.clear()
        return made

    def done() -> None:
        if now is not None:
            out.append((now, *sums[:7], sha.hexdigest(), sums[7]))

    for b in batches:
        for node, conv, depth, up, n, children, leaves, saved, ends, opens in zip(*(b.column(f.name).to_pylist() for f in schema), strict=True):
            if node != now:
                done()
                now, sha, empty, sums = node, hashlib.sha256(), True, [conv, depth, up, 0, 0, 0, 0, None]
            sums = [min(sums[0], conv), depth, up, sums[3] + n, sums[4] + children, sums[5] + leaves, sums[6] + saved, sums[7] or opens]
            if ends:
                sha.update(("" if empty else ",").encode() + ends.encode())
                empty = False
        yield batch()
    done()
    yield batch()


def rebuilt(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth (from 0), digest, words, total: the turns of each rebuilt conversation, and one row with depth -1 for one without any."""
    role, text = text_of("role"), text_of()
    turn = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * UNIT))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn.alias("digest"), F.size(words_of(text)).cast("long").alias("words"))
    rows = scratch.save(numbered(rows, ["turn", "digest"], "rank", ["conv_id"]).drop("turn"), "turns")
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("_from"))
    head = rows.where((F.col("conv_id") % SHARED == 0) & (F.col("rank") < 3)).groupBy(F.col("conv_id").alias("_from")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "words"))).alias("head"))
    head = convs.join(head, "_from", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<rank:bigint,digest:binary,words:bigint>>")))
    kept = F.size("head")
    head = scratch.save(head.select("conv_id", "h", "head", (kept - F.col("h")).alias("shift"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "heads")
    first = head.select("conv_id", "total", F.posexplode("head").alias("depth", "t")).select("conv_id", F.col("depth").cast("long").alias("depth"), "t.digest", "t.words", "total")
    own = rows.join(head.drop("head"), "conv_id").where("rank >= h").select("conv_id", (F.col("rank") + F.col("shift")).alias("depth"), "digest", "words", "total")
    none = head.where("total = 0").select("conv_id", F.lit(-1).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"), "total")
    return first.unionByName(own).unionByName(none)


def segments(turns: DataFrame, scratch: Scratch, segment: int) -> DataFrame:
    """conv_id, level, key, words, next: rows of up to `segment` turns; key is the name of the turns before, digests, and next, the name of the turns up to here, if more follow."""
    level = F.greatest(F.floor(F.col("depth") / segment), F.lit(0)).cast("int")
    rows = turns.groupBy("conv_id", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("t"), F.max("total").alias("total"))
    rows = rows.select("conv_id", "level", "total", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("digests"), F.transform("t", lambda x: x["words"]).alias("words"))
    rows = scratch.save(rows, "segments")
    root = F.lit(ROOT)
    short = rows.where(F.col("total") <= segment).select("conv_id", "level", F.concat(root, "digests").alias("key"), "words", F.lit(None).cast("binary").alias("next"))
    name = F.sha2(F.concat(F.col("level").cast("string").cast("binary"), "digests"), 256)
    order = Window.partitionBy("conv_id").orderBy("level")
    earlier = [F.sum(F.conv(F.substring(name, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("string") for i in (0, 1)]
    long = rows.where(F.col("total") > segment).withColumn("_name", F.when(F.col("level") == 0, root).otherwise(F.unhex(F.md5(F.concat_ws(":", "level", *earlier)))))
    long = long.withColumn("next", F.lead("_name").over(order)).select("conv_id", "level", F.concat("_name", "digests", F.coalesce("next", F.lit(b""))).alias("key"), "words", "next")
    return scratch.save(short.unionByName(long), "rows")


def prefix_trie(conversations: DataFrame, scratch: Scratch | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 (all if it has fewer, none if there is no
    such one) and its own turns after its first h, where h is the unsigned crc32 of c in decimal, modulo 4. Turns stand in
    the order of turn, null first; those with equal turn in the order of a SHA-256 of role and text. Null roles and texts are
    empty ones. Each distinct sequence of the first d rebuilt turns (role and text) is a node of depth d, the root has none.
    Its members are the conversations that start with it, which name it by their least id; rows without a conv_id belong
    to none. saved_tokens sums (members - 1) * words of the last text over the subtree, ends_sha256 hashes the ids of
    the members that end at the node. Repeated rows are turns of their own. Conversations, texts and copies may be
    of any number and length. An empty table has no members, so no node, not even the root. Other columns are not read.
    """
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark)
    rows = segments(rebuilt(conversations, scratch), scratch, segment)
    sums = "next binary, n_children long, n_leaves long, saved_tokens long"
    below = spark.createDataFrame([], sums)
    levels = {r["level"]: r["units"] for r in rows.groupBy("level").agg(F.sum(F.length("key") / UNIT).cast("long").alias("units")).collect()}  # a row for each `segment` turns of the longest
    tables = []

    def merged(level: int):
        def nodes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by([("run", "ascending"), ("at", "ascending")])
            column = lambda c: left.column(c).to_pylist()
            links = [(n, *x) if n is not None else None for n, *x in zip(*(column(c) for c in ("next", "n_children", "n_leaves", "saved_tokens")), strict=True)]
            stream = zip(column("key"), column("conv_id"), column("units"), column("words"), links, column("run"), strict=True)
            runs = [iter([row[:5] for row in rows]) for _, rows in groupby(stream, itemgetter(5))]
            before, after = (right.column(c)[0].as_py() for c in ("before", "after"))
            found = list(finished(iter(Losers(runs)), before, after, key[0].as_py(), level, segment))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _NODES.types, strict=True)], schema=_NODES)

        return nodes

    for level in sorted(levels, reverse=True):
        at = rows.where(F.col("level") == level).select("conv_id", "key", "words", "next").join(below, "next", "left").select("conv_id", "key", "words", *below.columns)
        kinds = f"conv_id long, key binary, words array<long>, {sums}, run long, at long, units long"
        n = max(buckets(levels[level], RANGE), min(spark.sparkContext.defaultParallelism, buckets(levels[level], RANGE // 25)))
        ranges = at.mapInArrow(in_runs, kinds).repartitionByRange(n, "key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
        ranges = scratch.save(ranges, f"ranges-{level}")
        ends = ranges.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))  # two keys a range
        places = ends.select("part", F.row_number().over(Window.orderBy("part")).alias("place"))
        ends = scratch.save(ends.join(places, "part"), f"ends-{level}")
        bounds = ends.join(ends.select((F.col("place") + 1).alias("place"), F.col("last").alias("before")), "place", "left")
        bounds = bounds.join(ends.select((F.col("place") - 1).alias("place"), F.col("first").alias("after")), "place", "left").select("part", "before", "after")
        found = scratch.save(ranges.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(merged(level), NODES), f"nodes-{level}")
        tables.append(found)
        below = found.where("kind = 2").groupBy(F.col("id").alias("next")).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        scratch.drop(f"ranges-{level}", f"ends-{level}")
    found = spark.createDataFrame([], NODES)
    for t in tables:
        found = found.unionByName(t)
    columns = ["conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "opens"]
    parts = found.where("kind = 1").select("id", *columns, "part").repartition("id").sortWithinPartitions("id", "part")
    parts = scratch.save(parts.mapInArrow(whole_parts, "id binary, conv_id long, depth long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, opens binary"), "parts")
    nodes = found.where("kind = 0").select(*columns, "parent_conv_id").unionByName(parts.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
    names = parts.select(F.col("id").alias("up"), F.col("conv_id").alias("_parent")).unionByName(nodes.where("opens is not null").select(F.col("opens").alias("up"), F.col("conv_id").alias("_parent")))
    names = scratch.save(names, "names")
    known = nodes.where("up is null").unionByName(join_checked(nodes.where("up is not null").drop("parent_conv_id"), names, ["up"]).withColumnRenamed("_parent", "parent_conv_id").select(*nodes.columns))
    return known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
