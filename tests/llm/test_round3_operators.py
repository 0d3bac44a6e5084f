"""Operators 11 to 13 against brute force: ranges, runs, segments and blocks made small, awkward rows, empty tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import audit, search, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spread(spark, n):
    return {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def dealt(spark):
    """Many small partitions, so that groups lie over several."""
    conf = spread(spark, 13)
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


# op11


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    below = {n: [0, 0] for n in members}
    children = dict.fromkeys(members, 0)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        saved = (len(members[n]) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += children[n] == 0
            below[n[:d]][1] += saved
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == n)))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed):
    rng = np.random.default_rng(seed)
    turns = [("user", "one two"), ("assistant", "three"), ("user", ""), (None, "four  five\nsix"), ("system", None), ("user", "Ä ö")]
    rows = []
    for c in [*range(90), 200, 203, 1000, -7, -20]:
        if c == 40:
            continue  # a base that is absent
        n = 1 if c % 7 == 3 else int(rng.integers(1, 9))
        rows += [(c, None if t == 0 and c % 11 == 0 else t, *turns[int(rng.integers(0, 2 if c % 3 else 6))]) for t in range(n)]
    rows += [(c, t, "user", f"w{t}") for c in (301, 302, 303, 309) for t in range(30 if c < 309 else 21)]  # long, and much alike
    rows += [(400 + i, t, *turns[t % 3]) for i in range(40) for t in range(4)]  # copies
    rows += [(501, 1, "user", "twice"), (501, 1, "user", "twice"), (501, 1, "assistant", "tie"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("segment", [2, 5, 1024])
def test_trie(spark, dealt, monkeypatch, segment):
    monkeypatch.setattr(trie, "RANGE", 60)
    rows = conversations(segment)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for extra in ("depth", "key", "rank", "words", "n", "next"):
        df = df.withColumn(extra, F.lit("extra"))
    got = trie.prefix_trie(df, segment=segment).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kinds)).collect() == []
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "user", "gone") for c in turnless]
    got = trie.prefix_trie(spark.createDataFrame(rows, kinds)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain_trie(rows) and len(got) == 1 and got[0]["n_leaves"] == 1


def test_trie_of_long_conversations_with_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 100)
    rows = [(c, t, "user", "word " * (300_000 if t == 5 else 1) + str(t % 3)) for c in (21, 22, 25) for t in range(300 - c % 4)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=64).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain_trie(rows)


def test_losers_merge_and_carry_prefixes():
    rng = np.random.default_rng(2)
    keys = [(b"".join(bytes([int(x)]) * trie.UNIT for x in rng.integers(0, 2, int(rng.integers(0, 6)))), i) for i in range(400)]
    runs = []
    for a in range(0, 400, 57):
        part = sorted(keys[a : a + 57])
        runs.append(iter([(k, c, trie.shared(part[i - 1][0], k) if i else 0) for i, (k, c) in enumerate(part)]))
    merged = list(trie.Losers(runs))
    assert [row[:2] for row, _ in merged] == sorted(keys)
    for (before, _), (row, units) in itertools.pairwise(merged):
        assert units == trie.shared(before[0], row[0])


# op12


def plain_audit(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    judged = []
    for d, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d}
        judged.append((d, part or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in judged}:
        mine = [(d, f) for d, p, f in judged if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                here = [d for d, f in mine if x in f and not f & set(order[:i])]
                removed_by[x] += len(here)
                out[part, "".join(order), i + 1] = [
                    sum(not f & set(order[: i + 1]) for _, f in mine), len(here), sum(x in f and bool(f & set(order[:i])) for _, f in mine), sum(f == {x} for _, f in mine),
                    sum(d in good for d in here), sum(d in toxic for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_audit(spark, dealt, monkeypatch, collide):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 300))
    texts = [None, "", " \t", long, long.upper(), "a b " * 150, "Cap " * 250, long + " #", "x" * 4000, "Wörter  für\nalle " * 80, " ".join(f"q{i}" for i in range(400_000))]
    rows = [(i, texts[int(rng.integers(0, 10))], ["s", None, "", "ü"][i % 4]) for i in range(300)]
    rows += [(i, long, "hot") for i in range(1000, 1400)]  # one text in several ranges
    rows += [(7, long, "s"), (7, long, "s"), (5, "unlike", "s"), (None, long, "s"), (None, "", None), (2000, texts[10], "s"), (2001, texts[10], "s")]
    labels = [(i, int(i % 3 == 0) if i % 5 else None, int(i % 4 == 0)) for i in range(0, 1300, 2)] + [(0, 0, 1), (0, 1, None), (None, 1, 1), (999_999, 1, 1)]
    if collide:
        monkeypatch.setattr(audit.F, "xxhash64", lambda c: F.lit(5).cast("long"))  # every text has the same fingerprint
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for extra in ("part", "mask", "fp", "n", "step", "c"):
        df = df.withColumn(extra, F.lit("extra"))
    got = audit.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(0))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark):
    docs, labels = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    assert audit.interactions(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    got = audit.interactions(spark.createDataFrame([(1, "a", "s")], docs), spark.createDataFrame([], labels))
    assert got.count() == 600 and got.where("filter_order = 'ABCDE' and step = 1").first()["removed"] == 1


# op13


def plain_search(rows, k=5):
    usable = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((at, i, [int(np.floor(np.float64(x) * 256)) for x in v]))
    out = []
    for at, q, v in usable:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), c) for other, c, w in usable if other != at))[:k]
            out += [(q, rank + 1, c, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, c) in enumerate(scores)]
    return sorted(out)


def found(df, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.nearest(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("small", [True, False])
def test_search(spark, monkeypatch, small):
    if small:
        for name, value in (("LEAST", 20), ("MOST", 30), ("QUERIES", 4), ("RISE", 3), ("STEP", 3), ("TOGETHER", 2)):
            monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, rng.normal(size=16) * rng.choice([0.1, 1])))) for i in range(400)]
    rows += [(i, [0.5] * 16) for i in range(1000, 1060)]  # ties
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, [1.0] * 16), (None, [1.0] * 16), (2000, None), (2050, []), (2051, [1.0, None]), (2052, [float("nan")] * 16), (2100, [float("inf")] * 16), (2150, [1.0, 2.0, 3.0]), (2200, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for extra in ("block", "ids", "score", "twin", "rank", "query"):
        df = df.withColumn(extra, F.lit("extra"))
    assert found(df) == plain_search(rows)


def test_search_beyond_double_precision(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(2**21), 2**21, 4)]) for i in range(0, 200, 10)] + [(7, [1e308, 0.0, 0.0, 0.0]), (9, [3.0, 1.0, 1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_search([(i, [min(x, 2.0**60) for x in v]) for i, v in rows])
    assert found(df) == want


def test_search_of_few_and_none(spark):
    kinds = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([], kinds)) == []
    assert found(spark.createDataFrame([(50, [1.0])], kinds)) == []
    assert found(spark.createDataFrame([(50, [1.0]), (51, [-2.0]), (52, [-2.0])], kinds)) == [(50, 1, 51, -(512 * 256)), (50, 2, 52, -(512 * 256))]
    assert found(spark.createDataFrame([(1, [1.0])], kinds)) == []


def test_bounds_drop_candidates(monkeypatch):
    """Components are summed for few candidates beyond the first step where mass lies in front."""
    rng = np.random.default_rng(0)
    columns = np.floor(rng.normal(size=(64, 3000)) * np.linspace(60, 1, 64)[:, None])
    queries = np.floor(rng.normal(size=(5, 64)) * np.linspace(60, 1, 64))
    ids = np.arange(3000)
    got = {i: (at.tolist(), s.tolist()) for i, at, s in search.best_of(queries, np.full(5, np.iinfo(np.int64).min), columns, ids, 6)}
    scores = (queries @ columns).astype(np.int64)
    for i in range(5):
        want = np.lexsort((ids, -scores[i]))[:6]
        assert got[i] == (want.tolist(), scores[i, want].tolist())
    high = np.sort(scores[0])[-6]
    assert [at.tolist() for i, at, _ in search.best_of(queries[:1], np.array([high + 1]), columns, ids, 6)] == [np.lexsort((ids, -scores[0]))[: (scores[0] > high).sum()].tolist()]
