"""Vectors: dense clusters through the graph, the written recall, repeated ids, clashing columns, an empty table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import vectors
from quillon.llm.common import Scratch


def test_a_dense_cluster_is_found_along_the_graph(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=16) + 0.12 * rng.normal(size=(900, 16)), rng.normal(size=(600, 16))])
    graph = vectors.Graph(vectors.unit(x))
    q = vectors.unit(x[:200])
    found, hits, truth = graph.search(q, 0.93)
    real = q @ graph.x.T >= 0.93
    assert real.sum() > 200 * vectors.SEARCH and sum(int(real[i, g].sum()) for i, g in enumerate(found)) >= 0.99 * real.sum() and hits >= 0.99 * truth > 0


def test_recall_is_written_and_ids_may_repeat(spark, monkeypatch):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (2, [1.0, 0.0, 0.11], 0), (5, a, 0), (5, b, 0), (7, [0.0, 1.0, 0.01], 0), (7, [0.0, 1.0, 0.01], 0), (8, b, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "n", "shard", "root", "rep", "_h")})
    scratch = Scratch(spark)
    out = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, scratch=scratch).collect())
    assert out == [(1, 2, 1, True), (2, 2, 1, False), (5, 2, 1, False), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True)]
    assert spark.read.parquet(scratch.path("recall")).first()["links"] > 0
    assert vectors.near_vectors(df.limit(0)).count() == 0
    monkeypatch.setattr(vectors, "LEAST", 1.5)
    with pytest.raises(RuntimeError):
        vectors.near_vectors(df)
    scratch.close()
