"""Verdicts of the quality rules against measures and an EM written out in plain Python."""

import math
import re

from pyspark.sql import functions as F

from quillon.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(set(windows)) < len(windows) else set()
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_digits": len(re.findall("[0-9]", t)), "n_addresses": len(re.findall(r"https?://|www\.|@[A-Za-z]", t)), "n_bare": sum(not any(c.isalpha() for c in x) for x in w), "n_distinct": len(set(w)),
        "n_ended": sum(bool(re.search("[.!?:;)\\]\"'’”…。][\x20\x09-\x0d]*$", x)) for x in lines), "n_small": sum(len(x) <= 3 for x in w),
    }


def holds(rule, m):
    return bool(eval(re.sub(r"(?<![<>=])=(?!=)", "==", rule), {}, m))  # the rules are comparisons of measures


def plain_em(patterns):
    """The likelier of two runs of EM, pattern by pattern and rule by rule."""
    (b0, g0), (b1, g1) = quality.PSEUDO
    n_rules, best = len(quality.RULES), None
    for start in ("doubt", "share"):
        post = {}
        for p in patterns:
            g, b = p.count("g"), p.count("b")
            post[p] = (0.001 if b else 0.999) if start == "doubt" else (g + 1) / (g + b + 2)
        last = -math.inf
        while True:
            good = sum(n * post[p] for p, n in patterns.items())
            pi = (good + quality.DOCS[0]) / (sum(patterns.values()) + sum(quality.DOCS))
            rates = []
            for k in range(n_rules):
                on = [[sum(n * (post[p] if c else 1 - post[p]) for p, n in patterns.items() if p[k] == v) for v in "bg"] for c in (1, 0)]
                on = [(on[0][0] + b0, on[0][1] + g0), (on[1][0] + b1, on[1][1] + g1)]
                r = [b / (b + g) for b, g in on]
                if r[0] > r[1]:
                    r = [(on[0][0] + on[1][0]) / (sum(on[0]) + sum(on[1]))] * 2
                rates.append(r)
            like = quality.DOCS[0] * math.log(pi) + quality.DOCS[1] * math.log(1 - pi)
            like += sum(b * math.log(r[c]) + g * math.log(1 - r[c]) for r in rates for c, (b, g) in enumerate(quality.PSEUDO))
            for p, n in patterns.items():
                a, z = math.log(pi), math.log(1 - pi)
                for k, v in enumerate(p):
                    if v != "a":
                        a += math.log(rates[k][0] if v == "b" else 1 - rates[k][0])
                        z += math.log(rates[k][1] if v == "b" else 1 - rates[k][1])
                top = max(a, z)
                like += n * (top + math.log(math.exp(a - top) + math.exp(z - top)))
                post[p] = 1 / (1 + math.exp(min(700, z - a)))
            if like - last < 1e-10 * (1 + abs(like)):
                break
            last = like
        if best is None or like > best[0]:
            best = (like, post)
    return best[1]


def test_verdicts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = next(t for t in texts.values() if len(WORD.findall(t)) > 300)
    for i in range(40):  # rows on which rules disagree
        words = plain.split(" ")[i : i + 120]
        texts[10_000 + i] = " ".join(words) + (" 1234567890" * 4 if i % 2 else "") + (" https://x.example/a" if i % 3 == 0 else "") + ("\nsame line.\nsame line." if i % 5 == 0 else "")
        if i % 8 == 7:
            texts[10_000 + i] = " ".join(x + " %%%" for x in words)
    m = {d: measured(t) for d, t in texts.items()}
    votes = {d: "".join("b" if holds(bad, x) else "g" if holds(good, x) else "a" for good, bad in quality.RULES.values()) for d, x in m.items()}
    failed = {d: x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for d, x in m.items()}
    patterns: dict[str, int] = {}
    for d, v in votes.items():
        if not failed[d]:
            patterns[v] = patterns.get(v, 0) + 1
    post = plain_em(patterns)
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for d, x in m.items():
        assert {c: got[d][c] for c in x} == x and got[d]["base_failed"] == failed[d]
        if not failed[d]:
            assert abs(got[d]["quality"] - post[votes[d]]) < 1e-4 and got[d]["kept"] == (post[votes[d]] >= 0.6), (d, votes[d])
    overruled = [d for d in m if not failed[d] and "b" in votes[d] and got[d]["kept"]]
    rejected = [d for d in m if not failed[d] and not got[d]["kept"]]
    assert overruled and rejected and all("b" in votes[d] for d in rejected)


def test_every_rule_speaks_against_something_and_texts_of_any_length_are_read(spark):
    rows = [(1, "Word by word it goes. " * 400_000), (2, None), (3, "")]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_words"] == 2_000_000 and got[1]["base_failed"] and got[1]["n_repeat_words"] == 2_000_000
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and not got[2]["kept"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    patterns = quality.measures(docs).select(quality.votes().alias("p"))
    against = patterns.agg(*[F.count_if(F.substring("p", i + 1, 1) == "b").alias(name) for i, name in enumerate(quality.RULES)]).first().asDict()
    assert all(against.values()), against
