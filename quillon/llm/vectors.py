"""Near-duplicate vectors: hierarchical navigable small-world graphs, one a shard, searched by every vector of the label.

Vectors with equal label and components are one class. Classes of a label are dealt into shards; each shard's
graph is built by itself and stored; blocks of queries then meet each shard's graph. All beams of a task are widened
until an audit of some queries against all vectors of the shard is met. A beam that is full of hits goes on along the
graph, from hits to their neighbours, until it meets no more. What the audits found and missed is summed up and written.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, join_spread
from .neardup import Forest

#: Classes in a shard, and queries in a block: a graph travels once for four times its size of queries.
SHARD, QUERIES = 8192, 32768
#: Neighbours of a node above and on the ground level; width of the beam while building and at first while searching.
DEGREE, GROUND, BUILD, SEARCH = 12, 24, 48, 48
#: How far below the threshold a full beam goes on from a node, for each time of the first width.
SLACK = 0.02
#: Queries a task audits, the recall that its beams must meet, and that below which there is no result.
AUDITED, RECALL, LEAST = 256, 0.995, 0.9


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best width nodes met for each query, best first; -1 where there are fewer.

    All queries step together: each opens its best unopened node until its beam has none.
    """
    q, n = len(queries), len(x)
    width = min(width, n)
    nodes, sims = np.full((q, width), -1), np.full((q, width), -np.inf, np.float32)
    opened = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    nodes[:, 0] = entry
    sims[:, 0] = np.einsum("ij,ij->i", queries, x[entry])
    seen[np.arange(q), entry] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live] | (nodes[live] < 0), -np.inf, sims[live])
        best = waiting.argmax(1)
        going = waiting[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        if not len(live):
            break
        opened[live, best] = True
        near = links[nodes[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("ij,ij->i", queries[live[row]], x[near[row, col]])
        all_nodes, all_sims = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1), np.concatenate([sims[live], s], 1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        nodes[live], sims[live], opened[live] = (np.take_along_axis(a, order, 1) for a in (all_nodes, all_sims, all_open))
    return nodes, sims


def spread(x: np.ndarray, center: np.ndarray, nodes: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each row up to degree of its candidates (best first) that are nearer to the center than to one chosen before,
    filled up with the best of the others."""
    chosen = np.full((len(center), degree), -1)
    count = np.zeros(len(center), int)
    nearest = np.full(nodes.shape, -np.inf, np.float32)  # similarity of each candidate to the chosen ones
    left = nodes >= 0
    for turn in range(2):
        for j in range(nodes.shape[1]):
            take = np.flatnonzero(left[:, j] & (count < degree) & ((sims[:, j] > nearest[:, j]) | (turn == 1)))
            if len(take):
                chosen[take, count[take]] = nodes[take, j]
                count[take] += 1
                left[take, j] = False
                if turn == 0:
                    others = x[np.maximum(nodes[take], 0)]
                    nearest[take] = np.maximum(nearest[take], np.einsum("ikd,id->ik", others, x[nodes[take, j]]))
    return chosen


class Graph:
    """x: unit vectors. levels[l]: neighbours on level l, -1 where a node isn't on it."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        n = len(x)
        height = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int), 4)
        if n:
            height[0] = height.max()
        self.entry = 0
        self.levels = [np.full((n, GROUND if lv == 0 else DEGREE), -1) for lv in range((height.max() if n else 0) + 1)]
        done, step = 1, 8
        while done < n:
            new = np.arange(done, min(n, done + step))
            at = np.zeros(len(new), int)
            for lv in range(len(self.levels) - 1, -1, -1):
                on = height[new] >= lv
                width = BUILD if on.any() else 1
                nodes, sims = beam(x[:done], self.levels[lv][:done], x[new], at, width)
                at = nodes[:, 0]
                if on.any():
                    self._insert(lv, new[on], nodes[on], sims[on])
            done += len(new)
            step = min(512, done)

    def _insert(self, lv: int, new: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> None:
        links, x = self.levels[lv], self.x
        mutual = x[new] @ x[new].T  # those of the same step may be each other's neighbours
        np.fill_diagonal(mutual, -np.inf)
        some = min(BUILD, len(new) - 1)
        if some:
            peers = np.argpartition(-mutual, some - 1, 1)[:, :some]
            nodes, sims = np.concatenate([nodes, new[peers]], 1), np.concatenate([sims, np.take_along_axis(mutual, peers, 1)], 1)
        order = np.argsort(-sims, 1, kind="stable")
        nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        degree = links.shape[1]
        links[new] = spread(x, x[new], nodes, sims, degree)
        source = np.repeat(new, degree)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(who), degree + int(count.max(initial=0))), -1)
        wide[:, :degree] = links[who]
        wide[np.repeat(np.arange(len(who)), count), degree + np.arange(len(target)) - np.repeat(first, count)] = source
        s = np.where(wide >= 0, np.einsum("ikd,id->ik", x[np.maximum(wide, 0)], x[who]), -np.inf)
        order = np.argsort(-s, 1, kind="stable")
        wide, s = np.take_along_axis(wide, order, 1), np.take_along_axis(s, order, 1)
        wide[:, 1:][(wide[:, 1:] == wide[:, :-1]) & (wide[:, 1:] >= 0)] = -1
        links[who] = spread(x, x[who], wide, s, degree)

    def flood(self, query: np.ndarray, start: np.ndarray, threshold: float, slack: float) -> np.ndarray:
        """Nodes at or over the threshold that the ground level reaches from start over nodes at most slack below it."""
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        found, front = [], start
        while len(front):
            sims = self.x[front] @ query
            found.append(front[sims >= threshold])
            near = self.levels[0][front[sims >= threshold - slack]].ravel()
            near = near[near >= 0]
            front = np.unique(near[~seen[near]])
            seen[front] = True
        return np.concatenate(found) if found else start

    def within(self, queries: np.ndarray, threshold: float, width: int) -> list[np.ndarray]:
        """Nodes at or over the threshold for each query; a beam that is full of them goes on over the graph."""
        at = np.full(len(queries), self.entry)
        for lv in range(len(self.levels) - 1, 0, -1):
            at = beam(self.x, self.levels[lv], queries, at, 1)[0][:, 0]
        nodes, sims = beam(self.x, self.levels[0], queries, at, width)
        out = []
        for q, node, s in zip(queries, nodes, sims, strict=True):
            hit = node[(s >= threshold) & (node >= 0)]
            more = len(hit) == nodes.shape[1] < len(self.x)
            hit = np.unique(hit)  # a node may have been met over two links at once
            out.append(self.flood(q, hit, threshold, SLACK * width / SEARCH) if more else hit)
        return out

    def search(self, queries: np.ndarray, threshold: float) -> tuple[list[np.ndarray], int, int]:
        """within(), with beams doubled until an audit of some queries against all vectors is met or the beam is as wide as
        the shard; and how many links the audited queries have, found and in truth."""
        sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
        truth = queries[sample] @ self.x.T >= threshold
        width = SEARCH
        while True:
            got = self.within(queries[sample], threshold, width)
            hits = sum(int(truth[i, g].sum()) for i, g in enumerate(got))
            if hits >= RECALL * truth.sum() or width >= len(self.x):
                break
            width *= 2
        out: list[np.ndarray] = []
        for i in range(0, len(queries), 512):
            out += self.within(queries[i : i + 512], threshold, width)
        return out, hits, int(truth.sum())


def near_vectors(rows: DataFrame, threshold: float = 0.93, scratch: Scratch | None = None, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of rows (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null, their lengths agree and their cosine, in double
    precision, is at or over the threshold. Vectors that are null, zero, or hold null or non-finite components link
    with nothing. Equal vectors are linked with each other and count one by one in n_links. A null vec_id is in no
    component (component_id null, kept true). Rows of equal vec_id are vectors of their own, known by label and
    components; rows that agree in all are equal vectors. Vectors may have any number of components. An empty table gives an empty result. Other columns are not
    read. A recall of the audits below LEAST is an error; their sums stay in the table `recall` of the scratch folder.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_ok", sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("_h", F.md5(F.array_join("v", ","))).withColumn("dim", F.size("v"))
    slim = scratch.save(rows.select("vec_id", "label", "_ok", "_h"), "vectors")
    classes = rows.where("_ok").groupBy("label", "_h", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = classes.withColumn("id", F.xxhash64("label", "_h", "dim"))
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("_rows"))
    classes = scratch.save(classes, "classes")
    counts = scratch.save(counts, "counts")
    dealt = join_spread(classes, counts, ["label", "dim"], "_rows").drop("_rows")
    classes = scratch.save(dealt.withColumns({"shard": F.pmod("id", "shards"), "block": F.pmod(F.xxhash64("id"), "blocks")}), "dealt")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        raw = np.stack(group["v"].to_numpy())
        data = pickle.dumps((Graph(unit(raw)), raw, group["id"].to_numpy(), group["n"].to_numpy()))
        return pd.DataFrame({"label": [group["label"].iloc[0]], "dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "blocks": [group["blocks"].iloc[0]], "graph": [data]})

    graphs = scratch.save(classes.groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, shard long, blocks int, graph binary"), "graphs")
    keys = ["label", "dim", "shard", "block"]
    asked = classes.select("label", "dim", "block", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"))
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))

    def search(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}).astype("int64")
        index, raw, others, counts = pickle.loads(graph["graph"].iloc[0])
        raw_q, ids = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy()
        found, hits, truth = index.search(unit(raw_q), threshold - 1e-5)
        place: dict[int, int] = {}
        at = lambda r: place.setdefault(int(r), len(place))
        forest, edges, links = Forest(len(ids) + len(others)), [], []
        norms, own = (np.sqrt((a * a).sum(1)) for a in (raw, raw_q))
        for i, near in enumerate(found):
            near = near[others[near] != ids[i]]
            cosine = (raw[near] * raw_q[i]).sum(1) / (norms[near] * own[i])  # the same from both ends of a pair, in any order
            near = near[cosine >= threshold]
            links.append((0, ids[i], 0, int(counts[near].sum())))
            edges += [(1, ids[i], r, 0) for r in others[near] if forest.join(at(ids[i]), at(r))]
        return pd.DataFrame([*links, *edges, (2, hits, truth, 0)], columns=["kind", "a", "b", "n"]).astype("int64")

    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(search, "kind long, a long, b long, n long")
    found = scratch.save(found, "found")
    audits = found.where("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("found"), F.coalesce(F.sum("b"), F.lit(0)).alias("links"))
    audit = scratch.save(audits, "recall").first()
    if audit["found"] < LEAST * audit["links"]:
        raise RuntimeError(f"the graphs find {audit['found']} of {audit['links']} audited links, fewer than {LEAST}")
    roots = components(found.where("kind = 1 and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "components")
    linked = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("far"))
    named = classes.select("label", "_h", "id", "rep", F.col("n").alias("_n")).join(linked, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = scratch.save(named.withColumn("root", F.coalesce("root", "id")), "named")
    least = scratch.save(named.groupBy("root").agg(F.min("rep").alias("_root"), F.count("*").alias("_rows")), "roots")
    named = join_spread(named, least, ["root"], "_rows").select("label", "_h", (F.coalesce("far", F.lit(0)) + F.col("_n") - 1).alias("_links"), "_root", "_n")
    known = join_spread(slim.where("_ok"), scratch.save(named, "links"), ["label", "_h"], "_n").select("vec_id", "_links", "_root")
    out = known.unionByName(slim.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_root")))
    label = F.when(F.col("vec_id").isNotNull(), F.col("_root"))
    return out.select("vec_id", F.col("_links").cast("long").alias("n_links"), label.alias("component_id"), F.coalesce(F.col("vec_id") == label, F.lit(True)).alias("kept"))
