"""Downloads and lookups against a server on this machine that breaks off, changes its files and counts what is asked."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quillon.sources import http as H

BODY = bytes(range(256)) * 400


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        s = self.server
        s.asked.append((self.path, self.headers.get("Range")))
        if self.path.startswith("/api/"):
            code = self.path.split("/")[-1].removesuffix(".json")
            body = json.dumps({"code": code, "agent": self.headers["User-Agent"]}).encode()
            self.send_response(404 if code.startswith("0000") else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            return
        if s.fail and s.fail.pop(0):
            self.send_response(503)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        body, status = s.files[self.path], 200
        low, high = 0, len(body)
        if self.headers.get("Range") and self.path != "/plain":
            low, high = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            high, status = min(high + 1, len(body)), 206
        part = body[low:high]
        self.send_response(status)
        self.send_header("Content-Length", str(len(part)))
        self.send_header("ETag", s.tag)
        if status == 206:
            self.send_header("Content-Range", f"bytes {low}-{high - 1}/{len(body)}")
        self.end_headers()
        if s.cut and low >= s.cut:
            self.wfile.write(part[: len(part) // 2])
            self.connection.close()
            return
        self.wfile.write(part)


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.files, s.asked, s.fail, s.cut, s.tag = {"/big": BODY, "/plain": BODY[:1000]}, [], [], 0, '"one"'
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


FAST = {"retries": 1, "wait": 0.01, "piece": 10_000, "timeout": 10}
SHA = hashlib.sha256(BODY).hexdigest()


def test_download_goes_on_where_it_was_cut(spark, tmp_path, server):
    folder = f"file://{tmp_path}/d"
    get = lambda sha=SHA: H.download(spark, [(f"{server.url}/big", "big.bin", sha), (f"{server.url}/plain", "plain.bin", None)], folder, **FAST).collect()
    server.cut = 50_000
    with pytest.raises(Exception):
        get()
    assert not (tmp_path / "d" / "big.bin").exists()
    server.cut, server.asked, server.fail = 0, [], [True]
    got = {r["name"]: r for r in get()}
    assert (tmp_path / "d" / "big.bin").read_bytes() == BODY and got["big.bin"]["sha256"] == SHA
    assert got["big.bin"]["fetched"] == len(BODY) - 50_000 and got["plain.bin"]["bytes"] == 1000
    assert json.loads((tmp_path / "d" / "big.bin.source.json").read_text())["url"].endswith("/big")
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["big.bin", "big.bin.source.json", "plain.bin", "plain.bin.source.json"]
    server.asked = []
    assert {r["name"]: r["fetched"] for r in get()} == {"big.bin": 0, "plain.bin": 0} and server.asked == []


def test_another_hash_or_version_is_not_mixed_in(spark, tmp_path, server):
    folder = H.Folder(f"file://{tmp_path}/d")
    tuning = {k: v for k, v in FAST.items()}
    with pytest.raises(H.Mismatch):
        H.fetch(f"{server.url}/big", folder, "x", "0" * 64, **tuning)
    assert list((tmp_path / "d").iterdir()) == []
    server.cut = 50_000
    with pytest.raises(H.TRANSIENT):
        H.fetch(f"{server.url}/big", folder, "x", None, **tuning)
    server.cut, server.tag, server.files["/big"] = 0, '"two"', BODY[::-1]
    assert H.fetch(f"{server.url}/big", folder, "x", None, **tuning)["sha256"] == hashlib.sha256(BODY[::-1]).hexdigest()
    with pytest.raises(H.urllib.error.HTTPError):
        H.fetch(f"{server.url}/api/0000", folder, "y", None, **tuning)


def test_products_are_asked_for_once(spark, tmp_path, server):
    codes = spark.createDataFrame([("4006381333931",), ("4006381333931",), ("00000000",), ("no code",)], "barcode string")
    ask = lambda **o: {r["barcode"]: r for r in H.lookup_products(codes, str(tmp_path / "cache"), server.url, "tests/1.0", pause=0.01, **o).collect()}
    got = ask()
    assert set(got) == {"4006381333931", "00000000"} and json.loads(got["4006381333931"]["snapshot"]) == {"agent": "tests/1.0", "code": "4006381333931"} and not got["00000000"]["found"]
    n = len(server.asked)
    assert n == 2 and ask().keys() == got.keys() and len(server.asked) == n
    ask(refresh=True)
    assert len(server.asked) == 2 * n
    for bad in ({"version": "v9"}, {"agent": ""}):
        with pytest.raises(ValueError):
            H.lookup_products(codes, str(tmp_path / "cache"), server.url, **{"agent": "a", **bad})
