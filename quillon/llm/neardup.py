"""Near-duplicate documents: SetSketch registers in bands find candidates, whole shingle sets confirm them.

Documents with equal shingle sets are one class. Each class that shares a band with a smaller one is compared with the
least of these, which settles groups of near copies in one pass over their texts. Bands whose classes are then of one
component need no more. The others form clusters: in each, what is outside its largest component is compared, in blocks,
with everything of another component, by the likelihood of the registers, and those pairs that can be links are confirmed on full sets.
Tasks return spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, join_checked
from .text import give_back, mix, shingle_sets

#: Registers of a sketch.
REGISTERS = 240
#: SetSketch's parameters: the base of the scale, the rate, the last step.
SCALE, RATE, LAST = 1.001, 20.0, 2**16 - 2
#: Classes of a cluster that are compared within one task; larger clusters are split into pairs of blocks.
BLOCK = 512
_seeds = mix(np.arange(1, 3 * REGISTERS + 1, dtype=np.uint64)).astype(np.uint32).reshape(3, REGISTERS, 1)
_seeds[1:] |= np.uint32(1)


def band_rows(threshold: int) -> int:
    """Registers in a band, so that a pair at the threshold misses all bands less often than once in 10 ** 8."""
    rows = [r for r in (10, 8, 6, 5, 4, 3, 2, 1) if REGISTERS % r == 0]
    return next((r for r in rows if (1 - (threshold / 100) ** r) ** (REGISTERS // r) < 1e-8), 1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set: the least of its values under each of REGISTERS hash functions, as an exponential variate,
    truncated to a step of an exponential scale. The registers of a union are the larger of each two."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        x = (low[None, i : i + 1024] ^ _seeds[0]) * _seeds[1]
        x ^= x >> np.uint32(15)
        x *= _seeds[2]
        np.minimum(least, x.min(1), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(value / RATE) / np.log(SCALE)), 0, LAST + 1).astype(np.uint16)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    parts = registers.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, j] + np.uint64(1))
    return key.view(np.int64)


def could_link(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: int, slack: float = 12.0) -> np.ndarray:
    """Whether a similarity at or over the threshold is within slack of the likeliest one (in log likelihood).

    above and below count the registers in which the first or the second set's is larger; given the sizes of the
    sets, the joint likelihood of SetSketch depends on the similarity alone.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    same = REGISTERS - above - below

    def log_like(j: np.ndarray) -> np.ndarray:
        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)

        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(np.maximum(up, 1e-9)) + below * np.log(np.maximum(down, 1e-9)) + same * np.log(np.maximum(1 - up - down, 1e-9))

    grid = np.linspace(0, 1, 41)
    best = np.max([log_like(g * most) for g in grid], 0)
    t = threshold / 100
    over = np.max([log_like(np.minimum(g, most)) for g in np.linspace(t, 1, 13)], 0)
    return (most >= t - 1e-12) & (over >= best - slack)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def confirmed(one: set, other: set, threshold: int) -> bool:
    both = len(one & other)
    return 100 * both >= threshold * (len(one) + len(other) - both)


def forest_of_links(sets: list[np.ndarray], block: np.ndarray, threshold: int, root: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that span each component of the sets; with two blocks, links within a block are left to other tasks.

    root: sets of equal root are known to be of one component, and aren't compared.
    """
    n, two = len(sets), len(np.unique(block)) > 1
    root = np.arange(n) if root is None else root
    size = np.array([len(s) for s in sets])
    sketches = np.array([sketch(s) for s in sets])
    as_sets: dict[int, set] = {}
    forest, pairs = Forest(n), []
    first: dict[int, int] = {}
    for i, r in enumerate(root.tolist()):
        forest.join(first.setdefault(r, i), i)
    for a in range(n - 1):
        b = np.arange(a + 1, n)
        b = b[(root[b] != root[a]) & (100 * np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])) & ((block[b] != block[a]) | (not two))]
        if len(b):
            above, below = (sketches[a] > sketches[b]).sum(1), (sketches[a] < sketches[b]).sum(1)
            ok = could_link(above, below, np.full(len(b), size[a]), size[b], threshold)
            pairs += [(above[i] + below[i], a, b[i]) for i in np.flatnonzero(ok)]
    for _, a, b in sorted(pairs):
        if forest.find(a) != forest.find(b):
            for x in (a, b):
                if x not in as_sets:
                    as_sets[x] = set(sets[x].tolist())
            if confirmed(as_sets[a], as_sets[b], threshold):
                forest.join(a, b)
                yield a, b


def star_links(sets: list[np.ndarray], centre: np.ndarray, threshold: int) -> Iterator[int]:
    """The sets that link with the one that is the centre."""
    c = int(np.flatnonzero(centre)[0])
    size, middle, whole = np.array([len(s) for s in sets]), sketch(sets[c]), set(sets[c].tolist())
    rest = np.flatnonzero(~centre & (100 * np.minimum(size, size[c]) >= threshold * np.maximum(size, size[c])))
    if len(rest):
        sketches = np.array([sketch(sets[i]) for i in rest])
        ok = could_link((sketches > middle).sum(1), (sketches < middle).sum(1), size[rest], np.full(len(rest), size[c]), threshold)
        yield from (i for i in rest[ok].tolist() if confirmed(set(sets[i].tolist()), whole, threshold))


def forest_roots(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) with v the root of u, of a table (u, v) of a smaller parent for each node that has one: pointers jump until none moves."""
    cur, turn = scratch.save(parents, f"{name}-0"), 0
    while True:
        turn += 1
        far = cur.join(cur.select(F.col("u").alias("v"), F.col("v").alias("_up")), "v", "left")
        nxt = scratch.save(far.select("u", F.coalesce("_up", "v").alias("v"), F.col("_up").isNotNull().alias("moved")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        cur = nxt.select("u", "v")
        if nxt.where("moved").isEmpty():
            return cur


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Sets are those of whole texts, A-Z lower-cased, of distinct shingles of k words; with fewer words, all of them
    are one shingle, and a null or blank text has none and is linked with nothing. Documents are linked if their
    sets' intersection is threshold percent of their union or more. component_id is the least doc_id that links
    reach. Rows with equal ids and texts are one document; rows with a null id take part in no component
    (component_id null, kept true). Texts of any length are read whole, about 2 MiB of texts at a time, a longer one by itself.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = band_rows(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, keys = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                f1.append(int(mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(bands(sketch(s), rows) if len(s) else np.zeros(0, np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "n_shingles", "f1", "f2", "bands"])
        give_back()

    slim = scratch.save(docs.mapInArrow(sketched, schema), "sketches")
    full = slim.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes, ["f1", "f2"]).where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    reps = scratch.save(reps, "bands")
    stars = reps.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("_most")).where("v < _most").select("key", "v")
    shared = scratch.save(reps.join(stars, "key").select("rep", "key", "v"), "shared")  # bands of two classes or more
    nearest = scratch.save(shared.where("v < rep").groupBy("rep").agg(F.min("v").alias("v")), "nearest")
    known = docs.where("doc_id is not null")
    spread = nearest.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    around = nearest.join(spread, "v").select("v", F.pmod(F.hash("rep"), "n").alias("chunk"), F.col("rep").alias("doc_id"), F.lit(False).alias("centre"))
    around = around.unionByName(spread.select("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"), F.col("v").alias("doc_id"), F.lit(True).alias("centre")))
    around = scratch.save(around, "around")

    def starred(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "text"]).reset_index(drop=True)
        sets, ids, centre = list(shingle_sets(pa.array(group["text"], pa.string()), k)), group["doc_id"].to_numpy(), group["centre"].to_numpy(bool)
        found = [(ids[i], ids[c]) for c in np.flatnonzero(centre) for i in star_links(sets, np.arange(len(ids)) == c, threshold) if not centre[i]]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    near = join_checked(known, around, ["doc_id"]).groupBy("v", "chunk").applyInPandas(starred, "u long, v long")
    settled = forest_roots(near.distinct(), scratch, "near").select(F.col("u").alias("rep"), F.col("v").alias("_root"))
    placed = shared.join(settled, "rep", "left").select("rep", "key", F.coalesce("_root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("rep").alias("v"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key", "v")
    edges = scratch.save(placed.join(mixed, "key").select(F.col("rep").alias("u"), "v", "root").distinct(), "edges")
    scratch.drop("bands", "shared", "nearest")
    clusters = components(edges.where("u <> v").select("u", "v").distinct(), scratch, "clusters").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    clusters = scratch.save(clusters.join(edges.select(F.col("u").alias("doc_id"), "root").distinct(), "doc_id"), "members")
    counts = clusters.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
    large = F.col("all") > BLOCK
    few = F.when(large, F.ceil((F.col("all") - F.col("top.n")) / BLOCK)).otherwise(1).cast("int")
    sizes = sizes.select("cluster", F.col("top.root").alias("top"), few.alias("few"), F.when(large, F.ceil(F.col("top.n") / BLOCK)).otherwise(0).cast("int").alias("many"))
    # blocks 0 to few - 1 hold what is outside the largest component, the many behind them that component (small clusters are one block)
    block = F.when((F.col("many") > 0) & (F.col("root") == F.col("top")), F.col("few") + F.pmod(F.hash("doc_id"), "many")).otherwise(F.pmod(F.hash("doc_id"), "few"))
    members = clusters.join(sizes, "cluster").withColumn("block", block)
    partners = F.sequence(F.lit(0), F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    turns = F.transform(partners, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    members = members.select("doc_id", "block", "cluster", "root", F.explode(turns).alias("t")).select("cluster", "t.i", "t.j", "doc_id", "block", "root")
    members = scratch.save(members, "turns")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "text"]).reset_index(drop=True)
        sets = list(shingle_sets(pa.array(group["text"], pa.string()), k))
        root = group["root"].to_numpy()
        found = [(root[a], root[b]) for a, b in forest_of_links(sets, group["block"].to_numpy(), threshold, root)]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    far = scratch.save(join_checked(known, members, ["doc_id"]).groupBy("cluster", "i", "j").applyInPandas(linked, "u long, v long"), "far")
    roots = components(far, scratch, "components").select(F.col("node").alias("_root"), F.col("root").alias("_last"))
    settled = classes.join(settled, "rep", "left").withColumn("_root", F.coalesce("_root", "rep"))
    named = settled.join(roots, "_root", "left").select("f1", "f2", F.coalesce("_last", "_root").alias("_c"))
    out = slim.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    label = F.when(F.col("n_shingles") > 0, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id"))
    label = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(label)
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))
