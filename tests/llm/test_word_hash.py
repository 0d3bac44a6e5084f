"""Words are told apart by their bytes: words of the Thue-Morse sequence, which fool polynomial hashes of any base."""

import numpy as np
import pytest

from quillon.llm import lm, neardup, packing, repeats, text


def thue_morse(n, one="a", other="b"):
    return "".join(other if i.bit_count() % 2 else one for i in range(n))


MORSE = [thue_morse(4096), thue_morse(4096, "b", "a")]


def layout(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return data, ends - [len(w.encode()) for w in words], ends


def test_hashes_of_words_differ_and_repeat():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 99, int(n)))) for n in rng.integers(1, 140, 3000)] + MORSE + ["a", "a", "ab", "a" * 64, "a" * 65, "é", "x" * 3_000_000]
    h = text.word_hashes(*layout(words)).tolist()
    assert len(set(h)) == len(set(words)) and len(set(zip(words, h, strict=True))) == len(set(words))
    where, which, hashes = text.distinct_words(*layout(words))
    assert [words[where[i]] for i in which] == words and len(where) == len(set(words)) == len(set(hashes.tolist()))


def test_words_with_one_hash_are_told_apart(monkeypatch):
    words = ["aa", "bb", "aa", "cc" * 50, "cd" * 50, "aa", "c"]
    monkeypatch.setattr(text, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    where, which, _ = text.distinct_words(*layout(words))
    assert [words[where[i]] for i in which] == words and len(where) == 5


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_near_duplicates_and_counts(spark):
    a, b = (f"{m} one two" for m in MORSE)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, [a, b, a]), 3, 85).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    scores = {r["doc_id"]: r["log_score"] for r in lm.backoff_scores(docs(spark, [MORSE[0], MORSE[1], "plain"])).collect()}
    assert scores[0] == scores[1] == pytest.approx(-np.log(3))  # no other document has the word


def test_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    for t in (" ".join(MORSE), " ".join(m + "." for m in MORSE)):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, _ = packing.WordIds(packing.vocabulary()).ids(data, np.array([0, len(data)]))
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_of_words_with_one_hash(monkeypatch):
    """Words of the same hash, in one batch and in later ones, are told apart by their bytes; the memory is cleared in between."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    monkeypatch.setattr(text, "word_hashes", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    ids, rng = packing.WordIds(packing.vocabulary()), np.random.default_rng(1)
    words = ["the", "cat", "sat", "Über", "on", "mats.", "x" * 90, "y" * 90, "42", "hello,", "hello", "<|x", "é", "the."]
    for n in (5, 40, 3, 60, 1, 200):
        rows = [" ".join(rng.choice(words, n)) for _ in range(3)]
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
        flat, begin = ids.ids(data, offsets)
        for r, a, b in zip(rows, begin[:-1], begin[1:], strict=True):
            assert flat[a:b].tolist() == tokenizer.encode(r, add_special_tokens=False).ids


def test_repeats(spark):
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs(spark, [MORSE[0][:1000], "0123456789" * 60 + "x" + "y" * 30])).collect()}
    brute = {}
    for i, t in enumerate([MORSE[0][:1000], "0123456789" * 60 + "x" + "y" * 30]):
        seen, gone = {}, set()
        for at in range(len(t) - 399):
            seen.setdefault(t[at : at + 400], []).append(at)
        for places in seen.values():
            if len(places) > 1:
                gone |= {p + k for p in places for k in range(400)}
        brute[i] = len(gone)
    assert got == brute


def test_slices_hold_each_gram_of_a_batch_once():
    rng = np.random.default_rng(2)
    word = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
    first = np.array([0, 0, 50, 51, 400])
    codes, keys = rng.integers(0, len(word), 400), rng.integers(0, 3, 4).astype(np.uint64) << np.uint64(38)
    g, c = lm.Batch(word, codes, first, keys).grams()
    slices = [lm.listed_grams(word, codes, first, keys, t, 4) for t in range(4)]
    assert sorted(zip(g.tolist(), c.tolist(), strict=True)) == sorted(x for a, b in slices for x in zip(a.tolist(), b.tolist(), strict=True) if x[1] > 0)
    ends = {x for a, b in slices for x in zip(a.tolist(), b.tolist(), strict=True) if x[1] < 0}
    final = codes[[49, 50, 399]]
    assert ends == {(int(lm.gram(lm.WORD, word[[w]])[0]), -int((final == w).sum())) for w in set(final.tolist())}
    assert max(len(a) for a, _ in slices) < 0.4 * len(g)


@pytest.mark.parametrize("batch", [40, 1000])
def test_scores_do_not_depend_on_batches(spark, monkeypatch, batch):
    """Words that end documents of other batches only, words of one batch, repeated rows: many small batches score as one does."""
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(names[: 60 if i % 2 else 20], int(rng.integers(0, 25))))) for i in range(120)] + [(5, "w1 w2 only"), (5, "w1 w2 only"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r["doc_id"], r["n_words"]): r["log_score"] for r in lm.backoff_scores(df.coalesce(1)).collect()}
    monkeypatch.setattr(lm, "BATCH", batch)
    got = {(r["doc_id"], r["n_words"]): r["log_score"] for r in lm.backoff_scores(df.repartition(9)).collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
