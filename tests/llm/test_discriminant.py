"""Scores of the classifier against statistics, moments and densities written out in plain Python and numpy."""

import re
import zlib

import numpy as np
import pytest

from quillon.llm import classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_features(t):
    lower = t.translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    letters = sum(len(x.encode()) for x in w)
    ratio = lambda x, of: np.log((x + 0.5) / (of + 1))
    marks = [(r"[#*$%&<>]", len(w)), (r"[A-Z]", letters), (r"!", len(w)), (r"\|", len(w)), (r"[0-9]", len(w)), (r"[.,;:?]", len(w)), (r"\n", len(w))]
    triples = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return [
        np.log1p(len(w)), ratio(letters, len(w)), *[ratio(len(re.findall(p, t)), of) for p, of in marks], ratio(sum(len(x.encode()) <= 3 for x in w), len(w)), ratio(len(set(w)), len(w)), ratio(len(triples), max(len(w) - 2, 0)),
    ]


def test_scores(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= {9001: "", 9002: "Ä ö! | 12", 9003: "word " * 500_000}
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    labels = [(d, q, 0) for d, q in marks.items()] + [(next(d for d, q in marks.items() if q == 1 and zlib.crc32(str(d).encode()) % 5), 0, 0)]
    marks[labels[-1][0]] = 0  # a contradiction counts as the lesser
    x = {d: np.array(plain_features(t)) for d, t in texts.items()}
    train = [(x[d], marks[d]) for d in texts if d in marks and zlib.crc32(str(d).encode()) % 5]
    sides = [np.array([v for v, q in train if q == c]) for c in (0, 1)]
    own = [np.cov(s.T, bias=True) for s in sides]
    pooled = sum(len(s) * c for s, c in zip(sides, own, strict=True)) / len(train)
    dim = pooled.shape[0]
    density = []
    for s, c in zip(sides, own, strict=True):
        w = max(0.1, dim / (dim + len(s)))
        density.append((s.mean(0), (1 - w) * c + w * pooled + 1e-3 * np.eye(dim)))
    prior = (len(sides[1]) + 1) / (len(train) + 2)

    def score(v):
        logs = [-0.5 * ((v - m) @ np.linalg.solve(c, v - m) + np.linalg.slogdet(c)[1]) for m, c in density]
        return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + logs[1] - logs[0], -40, 40)))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(texts) and min(len(s) for s in sides) >= 2
    for d in texts:
        assert got[d]["score"] == pytest.approx(score(x[d]), abs=1e-6) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
