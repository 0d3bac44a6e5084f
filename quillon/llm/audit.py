"""Filter interaction audit: what five filters remove in each of their 120 orders, by part.

Documents are dealt by ranges of (fingerprint, doc_id), sorted by fingerprint, full text and doc_id, and compared with
the documents before them; only a range's first texts can have an equal one in another range, and those are settled
from a table of the ranges' edges. A document is then a mask of the filters that it fails, and masks are counts that add.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes up to which a text is split into words at once; longer texts are read word by word.
AT_ONCE = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def failing(text: bytes) -> int:
    """The mask of the filters A to D that a text fails, bit 0 for A."""
    if len(text) <= AT_ONCE:
        words = text.split()
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for hit in _WORD.finditer(text):
            n += 1
            seen.add(hit[0])
        distinct = len(seen)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, _SIGNS)) < len(text)) << 3


_JUDGED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("fp", pa.int64()), ("text", pa.binary())])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of a sorted range. text is given for its edges: the documents of the first fingerprint that no smaller id
    inside the range settles, and, with mask -1, the least document of each text of the last fingerprint."""
    now = text_now = least = None
    mask, ranges, firsts = 0, 0, []
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _JUDGED.types, strict=True)], schema=_JUDGED)
        rows.clear()
        return made

    for b in batches:
        columns = [b.column(c) for c in ("doc_id", "part", "fp", "text")]
        for doc, part, fp, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3], strict=True):
            text = text.as_py()
            if fp != now:
                now, text_now, firsts = fp, None, []
                ranges += 1
            if text != text_now:
                text_now, least, mask = text, None, failing(text)
            if doc is None:
                rows.append((None, part, mask, None, None))
                continue
            if least is None:
                least = doc
                firsts.append((doc, text))
            if doc > least:
                rows.append((doc, part, mask | DUPLICATE, None, None))
            else:
                edge = ranges == 1
                rows.append((doc, part, mask, fp if edge else None, text if edge else None))
        yield batch()
    if ranges > 1:
        rows.extend((doc, None, -1, now, text) for doc, text in firsts)
        yield batch()


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, mask: a row for each row of docs; bit i of mask says that filter i of FILTERS would remove it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.select("doc_id", "part", F.xxhash64("text").alias("fp"), F.col("text").cast("binary").alias("text"))
    dealt = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    judged = scratch.save(dealt.mapInArrow(compared, "doc_id long, part string, mask int, fp long, text binary"), "judged")
    edges = judged.where("text is not null")
    first = edges.groupBy("fp", "text").agg(F.min("doc_id").alias("_least"))
    late = F.when(F.col("doc_id") > F.col("_least"), DUPLICATE).otherwise(0)
    settled = edges.where("mask >= 0").join(first, ["fp", "text"]).select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask"))
    return judged.where("text is null").select("doc_id", "part", "mask").unionByName(settled)


def bits(letters: Column) -> Column:
    """The mask of the filters that a string names."""
    return sum((F.when(F.instr(letters, c) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(FILTERS)), F.lit(0))


def interactions(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each part (source, null as the empty string), order of the five filters and step of it.

    filter_order names the filters in the order in which they are applied, step (1 to 5) points at one of them. Counts of
    documents of the part: kept after this step, removed by it, redundant (it fails them, but they were gone), unique_fails
    (they fail it alone), good_lost and toxic_lost (removed here, with such a label), shapley (removed by this filter,
    summed over all orders).

    Filters remove: A texts of under 200 words; B those with 100 * distinct words < 50 * words; C those with 100 * capitals
    > 2 * code points; D those with one of #$%&*|; E those that are identical to the text of any smaller doc_id. Null texts
    are empty ones, and equal to each other. Rows of the same id don't make each other duplicates, rows without an id
    neither are nor make any, and have no labels. An id is good (toxic) if any label of it says 1. A text of any length is
    read whole. Parts without documents have no rows, so an empty table gives none. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = masks(docs, scratch)
    says = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(f"{c}_") for c in ("quality", "toxic")]
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*says).where("quality_ + toxic_ > 0")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    lost = rows.join(marked, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("quality_").alias("good"), F.sum("toxic_").alias("toxic"))
    counts = counts.unionByName(lost).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 masks at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("part", "c", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit, gone = bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))), bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1))
    steps = steps.select("part", "filter_order", "step", "c", bit.alias("bit"), gone.alias("gone"))

    def total(test, value) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["mask"].bitwiseAND(F.col("bit")) > 0, x["mask"].bitwiseAND(F.col("gone")) > 0, x), value(x)).otherwise(F.lit(0)))

    here = lambda fails, before, x: fails & ~before
    n = lambda x: x["n"]
    return steps.select(
        "part", "filter_order", "step",
        total(lambda fails, before, x: ~fails & ~before, n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda fails, before, x: fails & before, n).alias("redundant"),
        total(lambda fails, before, x: x["mask"] == F.col("bit"), n).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # of 120 orders, a filter comes first among the k that a document fails in 120 / k
        total(lambda fails, before, x: fails, lambda x: x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )
