"""Texts longer than the places that anchors tell apart."""

import hashlib

import numpy as np

from quillon.llm import repeats


def test_repeats_of_texts_longer_than_places(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACE", np.uint64(1023))
    draw = np.random.Generator(np.random.PCG64(5))
    letters = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    passage, least = letters(450), 400
    texts = {1: letters(9000) + passage + letters(700), 2: letters(130) + passage + letters(60), 3: letters(5000)}
    for a in (624, 625, 900, 1023, 1024, 1248, 1249):  # copies at and across the ends of stretches
        texts[100 + a] = letters(a) + passage + letters(2500)
    rows = repeats.anchors(*(f([t.encode() for t in texts.values()]) for f in (lambda ts: np.frombuffer(b"".join(ts), np.uint8), lambda ts: np.cumsum([0, *map(len, ts)]))), least)
    windows = sorted((r, s) for r, a, b in zip(*(x.tolist() for x in rows[:3]), strict=True) for s in range(a, b + 1))
    assert windows == [(r, s) for r, t in enumerate(texts.values()) for s in range(len(t) - least + 1)]
    texts = ["".join(map(chr, draw.integers(97, 123, n))) for n in ((8 << 20) + 9000, 1000)]
    long, short = texts[0] + passage + texts[1], texts[1][:300] + passage
    df = spark.createDataFrame([(1, long), (2, short)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, least).collect()}
    assert got == {1: (450, 1, hashlib.sha256((texts[0] + texts[1]).encode()).hexdigest()), 2: (450, 1, hashlib.sha256(texts[1][:300].encode()).hexdigest())}


def test_shared_windows_are_joined_in_slices(spark, monkeypatch):
    """The rows of the last round, one a window, were counted and joined at once, and once more by kind, with all their shuffle files on disk."""
    draw = np.random.Generator(np.random.PCG64(6))
    letters = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    passage, least = letters(600), 400
    df = spark.createDataFrame([(i, letters(300 + i) + passage[i : 590 - i] + letters(250)) for i in range(40)], "doc_id long, text string")
    saved, save = {}, repeats.Scratch.save

    def noted(scratch, rows, name, **options):
        out = save(scratch, rows, name, **options)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(repeats.Scratch, "save", noted)
    got = sorted(map(tuple, repeats.remove_repeats(df, least).collect()))
    parts = [saved[f"live-2/{i}"] for i in range(repeats.SLICES)]
    assert sum(parts) > 1000 and max(parts) < 0.5 * sum(parts) and "kinds-2" not in saved
    assert [r[2] > 0 for r in got] == [True] * 40
    monkeypatch.setattr(repeats, "SLICES", 1)
    assert sorted(map(tuple, repeats.remove_repeats(df, least).collect())) == got
