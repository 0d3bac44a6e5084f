"""Links of credentials by the gap between their parts, against brute force, and texts of very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from quillon.llm import secrets


def test_long_parts_link_by_the_gap_between_them(spark):
    key = "Ab1" + "x" * 300
    rows = [(1, f"{key} user=bob77"), (2, f"{key}{' ' * 199}user=bob77"), (3, f"{key}{' ' * 201}user=bob77"), (4, "z" * 60 + "Q" * 20 + "7 login=carol")]
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert spans[1] == "key:0:303,id:304:314" and spans[2].startswith("key:0:303,id:") and spans[3] == ""
    assert "key:0:81" in spans[4]  # the first digit stands behind 80 letters


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    parts = []
    for doc in range(40):
        at = 0
        for _ in range(rng.randrange(1, 30)):
            at += rng.randrange(1, 400)
            parts.append((doc, at, rng.randrange(len(secrets.KINDS)), at + rng.randrange(1, 500)))
    got = {tuple(r) for r in secrets.link(spark.createDataFrame(parts, "doc long, start int, kind int, end int"), ["doc"]).select("doc", "start", "kind", "end").collect()}
    want = set()
    for p in parts:
        near = {secrets.KINDS[q[2]] for q in parts if q[0] == p[0] and q[1] - p[3] <= secrets.SCOPE and p[1] - q[3] <= secrets.SCOPE}
        needs = secrets.WEAK.get(secrets.KINDS[p[2]], (None, None))[1]
        if needs is not None and all(near & set(group) for group in needs):
            want.add(p)
    assert got == want


def test_many_matches_in_one_text(spark):
    text = "token=abcdef123 x " * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = secrets.digest(secrets.scan(df)).first()
    assert row["n_assign"] == 30_000 and time.time() - start < 60
    assert row["spans"].split(",")[-1] == "assign:%d:%d" % [m.span() for m in re.finditer("token=abcdef123", text)][-1]


def plain_redact(text, spans):
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_is_that_of_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.randrange(1, 200)))
        cuts = sorted((a, rng.randrange(a + 1, len(text) + 1)) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 9))))
        rows.append((i, text, [(a, 0, b) for a, b in cuts]))
    rows.append((99, None, []))
    df = spark.createDataFrame(rows, f"i int, t string, s {secrets.SPAN}")
    got = {r["i"]: r["r"] for r in df.select("i", secrets.redact(F.col("t"), F.col("s")).alias("r")).collect()}
    assert got == {i: None if t is None else plain_redact(t, [(a, b) for a, _, b in s]) for i, t, s in rows}


def test_a_long_text_of_many_secrets_is_redacted_in_time(spark):
    text = "token=abcdef123 ü " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    out = secrets.scan(df, columns=("doc_id", "text")).select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert out == "[SECRET] ü " * 100_000 and time.time() - start < 120


def test_mail_hosts_and_addresses_count_only_beside_a_secret(spark):
    secret = 'token = "254ca002228af484f240146ffd26ba4415598ee8"'
    rows = [
        (1, f"write to ann.b@mail.example.com {secret} at 10.2.3.4:8080 now"), (2, "write to ann.b@mail.example.com at 10.2.3.4"), (3, f"{secret} at 10.2.3.4"),
        (4, "see ftp://bob:pw1@files.example.org/x and http://plain.example.org/y"), (5, f"tenant_id=abc-77 {secret}"), (6, "version 1.2.3.4.5 a@b " + secret),
    ]
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: ["mail", "assign", "hex", "address"], 2: [], 3: ["assign", "hex"], 4: ["dsn"], 5: ["id", "assign", "hex"], 6: ["assign", "hex"]}
