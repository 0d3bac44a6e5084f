"""The operators that SQL can express, against their SQL: on given tables, and on one with planted links and ties."""

import numpy as np
import pandas as pd
import pytest

from quillon.llm.queries import ORACLES, QUERIES
from tests.conftest import same_rows


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("planted"), np.random.default_rng(5)
    names = [f"w{i}" for i in range(300)]
    texts: list = [None, "", " \t\n", "One", "one  two", "ONE two"]
    for _ in range(40):
        words = list(rng.choice(names, 120))
        texts.append(" ".join(words))
        for changes in range(int(rng.integers(0, 4))):
            other = list(words)
            for at in rng.integers(0, 120, changes * 2):
                other[at] = "Other"
            texts.append("\n".join(other))
    texts.append(" ".join(rng.choice(names, 20_000)))
    sources = [None if i % 11 == 0 else ["b", "ä", "C", "a"][i % 4 if i % 3 else 0] for i in range(len(texts))]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": sources}).to_parquet(folder / "documents.parquet")
    vectors: list = [None, [0.0] * 8, [1.0, float("nan")] + [0.0] * 6, [1.0, float("inf")] + [0.0] * 6, [1.0, None] + [0.0] * 6]
    for _ in range(60):
        v = rng.normal(size=8)
        vectors += [list(v + rng.normal(size=8) * s) for s in rng.choice([0, 0.1, 0.2, 0.4], 4)]
    labels = [None if i % 17 == 0 else i // 5 % 4 for i in range(len(vectors))]
    pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors, "label": pd.array(labels, "Int32")}).to_parquet(folder / "embeddings.parquet")
    marks = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, len(texts) + 9, 2)] + [(4, 0, 1)]
    pd.DataFrame(marks, columns=["doc_id", "quality", "toxic"]).to_parquet(folder / "labels.parquet")
    turns = [(c, None if t == 0 and c % 4 == 0 else t, None if t % 5 == 4 else "user", [None, "", "a b", "c"][int(rng.integers(0, 4 if t > 1 else 2))]) for c in [*range(0, 60), 81, 400, -3] for t in range(int(rng.integers(1, 8)))]
    pd.DataFrame(turns + turns[:9], columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}).to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_planted(spark, planted, name):
    got, want = same_rows(QUERIES[name](spark, planted), ORACLES[name], planted)
    assert got == want and want
    kept = {"op1_near_dedup": 2, "op2_embedding_dedup": 1}.get(name)  # columns stand by name
    assert kept is None or sum(not row[kept] for row in want) > 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_given(spark, name):
    sf = "/root/testdata/sf0.001"
    got, want = same_rows(QUERIES[name](spark, sf), ORACLES[name], sf)
    assert got == want and want
