"""The image scan against a reduction written out in plain loops, on pictures made here."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from quillon.operators.contracts import ContractError
from quillon.sources import images


def plain_line(line, to):
    """One line reduced, pixel by pixel, weights in 22 bits."""
    out, n = [], len(line)
    ratio = n / to
    wide = max(1.0, ratio)
    for i in range(to):
        c = (i + 0.5) * ratio
        lo, hi = max(0, int(c - 2 * wide + 0.5)), min(n, int(c + 2 * wide + 0.5))
        weights = []
        for x in range(lo, hi):
            t = abs((x - c + 0.5) / wide)
            weights.append(1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0)
        total = sum(weights)
        whole = [math.floor(w / total * 2**22 + 0.5) if w >= 0 else math.ceil(w / total * 2**22 - 0.5) for w in weights]
        out.append(min(255, max(0, (sum(w * p for w, p in zip(whole, line[lo:hi], strict=True)) + 2**21) >> 22)))
    return out


def plain_hash(grey):
    rows = [plain_line(line, 9) for line in grey]
    columns = [plain_line(col, 8) for col in zip(*rows, strict=True)]
    small = list(zip(*columns, strict=True))
    return f"{sum((small[y][x + 1] > small[y][x]) << (8 * y + x) for y in range(8) for x in range(8)):016x}"


def exif(turn, order):
    e = {"<": b"II*\0", ">": b"MM\0*"}[order]
    return e + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)


def with_turn(body, turn, order):
    tags = exif(turn, order)
    chunk = struct.pack(">I", len(tags)) + b"eXIf" + tags + struct.pack(">I", zlib.crc32(b"eXIf" + tags))
    return body[:33] + chunk + body[33:]


def test_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {}
    for name, shape in {"a.png": (8, 9), "b b%20.png": (40, 30), "c.PNG": (5, 3), "e.png": (1, 1), "f.png": (64, 200)}.items():
        smooth = np.cumsum(np.cumsum(rng.normal(size=shape), 0), 1)
        made[name] = np.uint8(np.clip(128 + 20 * smooth, 0, 255))
    made["g.png"] = np.tile(np.arange(0, 180, 2, dtype=np.uint8), (20, 1))
    colour = rng.integers(0, 256, (30, 21, 3)).astype(np.uint8)
    (tmp_path / "deep").mkdir()
    for name, p in made.items():
        (tmp_path / ("deep" if name == "f.png" else "") / name).write_bytes(images.png(p))
    (tmp_path / "h.png").write_bytes(images.png(colour))
    made["h.png"] = np.array([[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16 for r, g, b in line] for line in colour])
    for turn in range(2, 9):
        (tmp_path / f"turn{turn}.png").write_bytes(with_turn(images.png(made["f.png"]), turn, "<>"[turn % 2]))
    views = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.T, 6: lambda p: np.rot90(p, -1), 7: lambda p: np.rot90(p, 2).T, 8: lambda p: np.rot90(p)}
    made |= {f"turn{t}.png": view(made["f.png"]) for t, view in views.items()}
    (tmp_path / "broken.png").write_bytes(images.png(made["a.png"])[:50])
    (tmp_path / "odd.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "note.txt").write_text("no picture")
    good, broken = images.scan_images(spark, str(tmp_path))
    got = {r["image_name"]: r for r in good.collect()}
    assert set(got) == set(made)
    for name, p in made.items():
        assert (got[name]["width"], got[name]["height"], got[name]["dhash"]) == (p.shape[1], p.shape[0], plain_hash(p.tolist())), name
    assert got["g.png"]["dhash"] == "f" * 16 and got["e.png"]["dhash"] == "0" * 16
    assert {r["image_name"] for r in broken.collect()} == {"broken.png", "odd.jpg"}
    (tmp_path / "deep" / "a.png").write_bytes(b"x")
    with pytest.raises(ContractError):
        images.scan_images(spark, str(tmp_path))


def test_orientations_of_jpeg_heads():
    rng = random.Random(0)
    for turn in range(1, 9):
        tags = b"Exif\0\0" + exif(turn, rng.choice("<>"))
        other = b"\xff\xe0" + struct.pack(">H", 18) + bytes(16)
        assert images.orientation_of(b"\xff\xd8" + other + b"\xff\xe1" + struct.pack(">H", len(tags) + 2) + tags + b"\xff\xda") == turn
    for odd in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\x08Exif\0\0", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe1\0\x10Exif\0\0II*\0\xff\xff\xff\xff", b"GIF89a"):
        assert images.orientation_of(odd) == 1


def test_pictures_are_decoded_once_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Unique names were asked of the joined scans, which read and hashed all files once more; one task wrote all pictures."""
    rows = spark.createDataFrame([(f"{i}.png", 9, list(range(72))) for i in range(40)], "name string, width int, pixels array<int>").coalesce(1)
    written = images.write_images(rows, f"file://{tmp_path}")
    assert "Exchange" in written._jdf.queryExecution().executedPlan().toString()
    assert written.count() == 40
    asked, unique = [], images.require_unique
    monkeypatch.setattr(images, "require_unique", lambda df, *a: asked.append(df._jdf.queryExecution().executedPlan().toString()) or unique(df, *a))
    good, _ = images.scan_images(spark, f"file://{tmp_path}")
    assert len(asked) == 1 and "MapInArrow" not in asked[0] and "content" not in asked[0]
    assert {r["dhash"] for r in good.collect()} == {"f" * 16} and images.reduction(20, 9) is images.reduction(20, 9)


def test_pictures_of_the_query_are_reduced(spark, monkeypatch):
    """All pictures were of 9 x 8 pixels, which a reduction leaves as they are."""
    from quillon.plans.files import image_hashes

    rows = lambda: {r["image_name"]: tuple(r)[1:] for r in image_hashes(spark, "/root/testdata/sf0.001").collect()}
    want = rows()
    assert {r[1:] for r in want.values()} == {(w, h) for w in (9, 12, 15, 18) for h in (8, 13, 18)}

    def unreduced(grey):
        if grey.shape[1] < 9:  # turned
            return ""
        bits = (grey[:8, 1:9] > grey[:8, :8]).reshape(-1)
        return f"{sum(int(b) << i for i, b in enumerate(bits)):016x}"

    monkeypatch.setattr(images, "difference_hash", unreduced)
    got = rows()
    assert {n for n, r in want.items() if r == got[n]} == {n for n, r in want.items() if r[1:] == (9, 8)}
