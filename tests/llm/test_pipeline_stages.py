"""Each stage of the pipeline against brute force on what the stage before it kept."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quillon.llm import packing, quality, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = F.concat("text", F.lit(' password: "hunter22abc" '), F.sha2("text", 256))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, told).otherwise(F.col("text")))
    kept = {"documents": docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    return kept


def test_quality_keeps_what_the_posterior_keeps(spark, stages):
    rows = stages["documents"]
    measured = quality.measures(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).withColumn("p", quality.votes()).withColumn("failed", F.expr(quality.BASE_FAILED)).collect()
    prior, odds = quality.believe(collections.Counter(m["p"] for m in measured if not m["failed"]))
    want = {m["doc_id"] for m in measured if not m["failed"] and 1 / (1 + np.exp(-prior - sum(t[v] for t, v in zip(odds, m["p"], strict=True)))) >= 0.6}
    assert sorted(r["doc_id"] for r in stages["quality_rules"]) == sorted(want)


def test_one_document_of_each_group_stays(stages):
    rows = stages["quality_rules"]
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == sorted(d for d in up if find(d) == d)


def test_another_text_of_a_duplicates_id_stays(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(3, base, "a"), (5, base + " end", "a"), (5, " ".join(f"other{i}" for i in range(60)), "a"), (7, None, None), (None, base, "b"), (9, base + " end", "c")]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert sorted(map(tuple, out), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_secrets_go_and_all_else_stays(stages):
    assign = re.compile(secrets.BASE["assign"][0])
    before = {r["doc_id"]: r["text"] for r in stages["near_dedup"]}
    after = {r["doc_id"]: r["text"] for r in stages["secret_scan"]}
    assert before.keys() == after.keys() and any("[SECRET]" in t for t in after.values())
    for d, t in after.items():
        parts = t.split("[SECRET]")
        rest, at = before[d], 0
        for p in parts:  # what stays is what stood between the spans
            at = rest.index(p, at) + len(p)
        assert not any(len(m[2]) >= 6 for m in assign.finditer(t)) and not re.search("[0-9a-f]{24}", t), d


def test_mixture_takes_whole_documents_near_the_targets(stages):
    size, taken = collections.Counter(), collections.Counter()
    texts = {r["doc_id"]: r for r in stages["secret_scan"]}
    for r in texts.values():
        size[r["source"]] += len(WORD.findall(r["text"]))
    times = collections.Counter(r["doc_id"] for r in stages["mixing"])
    for r in stages["mixing"]:
        assert texts[r["doc_id"]] == r
        taken[r["source"]] += len(WORD.findall(r["text"]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free, left, target = set(size), float(sum(size.values())), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    longest = collections.Counter()
    for r in texts.values():
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"])))
    assert max(times.values()) <= 3 and all(abs(taken[s] - target[s]) <= max(60, 0.05 * target[s], longest[s] / 2) for s in size)


def test_packing_holds_every_token_once(stages):
    plain = Tokenizer.from_file(packing.vocabulary())
    want = collections.Counter((r["doc_id"], len(plain.encode(r["text"], add_special_tokens=False).ids) + 1) for r in stages["mixing"])
    total, times = collections.Counter(), collections.Counter()
    for r in stages["packing"]:
        total[r["doc_id"]] += r["length"]
        times[r["doc_id"]] += r["piece"] == 0
    docs = collections.Counter()
    for (d, n), k in want.items():
        docs[d] += n * k
    assert total == docs and times == collections.Counter(r["doc_id"] for r in stages["mixing"])
