"""Quality rules by weak supervision: rules vote or abstain, and EM learns how far each can be believed.

Everything runs on DataFrame functions. Documents meet the driver only as counts of vote patterns, of which there
are at most 3 ** len(RULES), whatever the size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, text_of, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Votes against and for documents that are taken as seen before any, on good and on bad ones, whatever the size of the
#: corpus: rules seldom speak against a good document. So are good and bad documents.
PSEUDO = ((0.01, 100.0), (0.3, 0.7))
DOCS = (9.0, 1.0)
#: name: (good if, bad if); a document between the two gets no vote. Ratios are to the words of the document.
RULES = {
    "symbols": ("n_symbols < 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    "bare_words": ("n_bare <= 0.05 * n_words", "n_bare > 0.2 * n_words"),
    "small_words": ("n_small >= 0.12 * n_words", "n_small < 0.04 * n_words"),
    "variety": ("n_distinct >= 0.6 * n_words", "n_distinct < 0.5 * n_words"),
    "repeats": ("n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    "lines": ("n_dup_lines = 0", "n_dup_lines > 0.1 * n_lines"),
    "line_ends": ("n_ended >= 0.8 * n_lines", "n_ended < 0.5 * n_lines"),
    "long_lines": ("word_chars <= 500 * n_lines", "word_chars > 1000 * n_lines"),
    "digits": ("n_digits <= 0.005 * word_chars", "n_digits > 0.02 * word_chars"),
    "addresses": ("n_addresses = 0", "n_addresses > 0.004 * n_words"),
}


def _windows(words: Column) -> Column:
    """A hash of each window of three words."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.slice(each, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: windows are sorted by hash, equal neighbours kept, spans united."""

    def united(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def twice(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return united(F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"])))

    def counted(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, twice))

    return let(windows, counted)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics that the rules read, one pass over each whole text (null: empty), nothing shuffled."""
    keep = docs.columns
    names = {c.lower() for c in keep}
    clash = names & {"_t", "_w", "_l", *MEASURES}
    if clash:
        raise ValueError(f"documents has columns of the operator's own: {sorted(clash)}")
    every = F.length("_t")
    lacking = lambda pattern: (every - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    df = docs.withColumn("_t", text_of(text)).withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        lacking(r"[#*$%&|<>]+").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(_windows(F.col("_w"))).cast("long").alias("n_repeat_words"),
        lacking("[0-9]+").alias("n_digits"),
        F.regexp_count("_t", F.lit(r"https?://|www\.|@[A-Za-z]")).cast("long").alias("n_addresses"),
        F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;)\]\"'\u2019\u201d\u2026\u3002][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        F.aggregate("_w", F.lit(0), lambda n, w: n + F.when(F.length(w) <= 3, 1).otherwise(0)).cast("long").alias("n_small"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_addresses", "n_bare", "n_distinct", "n_ended", "n_small")
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def votes() -> Column:
    """One letter for each rule: g, b, or a for no vote."""
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("a") for good, bad in RULES.values()])


def believe(patterns: dict[str, int], rounds: int = 2000) -> tuple[float, list[dict[str, float]]]:
    """EM with two accuracies a rule, one on good and one on bad documents: prior log odds, and by rule those of each vote.

    An abstention is no evidence. What is expected (PSEUDO, DOCS) counts as a few documents, so the corpus decides. EM
    ends when the posterior density stops rising; it starts twice, from doubt in every document that a rule speaks
    against and from the share of the votes, and the likelier end counts. A rule never means its opposite: where it
    speaks against good documents as often as against bad ones or more, its votes say nothing. No pattern: prior 0 and
    votes that say nothing.
    """
    if not sum(patterns.values()):
        return 0.0, [{"g": 0.0, "b": 0.0, "a": 0.0} for _ in RULES]
    names = sorted(patterns)  # sums in one order, whatever that of the counts
    n = np.array([patterns[p] for p in names], float)
    votes_ = np.array([list(p) for p in names])
    for_, against = (votes_ == "g").astype(float), (votes_ == "b").astype(float)
    share = (for_.sum(1) + 1) / (for_.sum(1) + against.sum(1) + 2)
    ends = []
    for post in (np.where(against.any(1), 0.001, 0.999), share):
        last = -math.inf
        for _ in range(rounds):
            good, bad = n * post, n * (1 - post)
            pi = (good.sum() + DOCS[0]) / (n.sum() + sum(DOCS))
            said = [(w @ against + b, w @ for_ + g) for w, (b, g) in zip((good, bad), PSEUDO, strict=True)]
            rate = [b / (b + g) for b, g in said]
            pooled = (said[0][0] + said[1][0]) / (sum(said[0]) + sum(said[1]))
            opposite = rate[0] > rate[1]
            on_good, on_bad = (np.where(opposite, pooled, r) for r in rate)
            of_good = math.log(pi) + against @ np.log(on_good) + for_ @ np.log(1 - on_good)
            of_bad = math.log(1 - pi) + against @ np.log(on_bad) + for_ @ np.log(1 - on_bad)
            like = n @ np.logaddexp(of_good, of_bad) + DOCS[0] * math.log(pi) + DOCS[1] * math.log(1 - pi)
            like += sum((b * np.log(r) + g * np.log(1 - r)).sum() for r, (b, g) in zip((on_good, on_bad), PSEUDO, strict=True))
            post = np.exp(of_good - np.logaddexp(of_good, of_bad))
            if like - last < 1e-10 * (1 + abs(like)):
                break
            last = like
        ends.append((float(like), pi, on_good, on_bad))
    _, pi, on_good, on_bad = max(ends, key=lambda e: e[0])
    odds = [{"g": math.log((1 - p) / (1 - q)), "b": math.log(p / q), "a": 0.0} for p, q in zip(on_good.tolist(), on_bad.tolist(), strict=True)]
    return math.log(pi / (1 - pi)), odds


def judge(measured: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds base_failed, quality (posterior probability of a good document) and kept.

    The accuracies are learned on the documents that pass the base rule. measured is read twice, once for the counts
    of patterns: hand in a written table.
    """
    counts = measured.where(~F.expr(BASE_FAILED)).groupBy(votes().alias("p")).count().collect()  # at most 3 ** len(RULES) rows
    prior, odds = believe({r["p"]: r["count"] for r in counts})
    z = F.lit(prior)
    for table, (good, bad) in zip(odds, RULES.values(), strict=True):
        z = z + F.when(F.expr(bad), table["b"]).when(F.expr(good), table["g"]).otherwise(0.0)
    quality = 1 / (1 + F.exp(-z))
    failed = F.expr(BASE_FAILED)
    return measured.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_rules(docs: DataFrame, scratch: Scratch | None = None, columns: tuple[str, ...] = ("doc_id",), threshold: float = 0.6) -> DataFrame:
    """columns of docs with the measures, base_failed, quality and kept, a row for each row of docs.

    Null texts count as empty and, like texts of under 50 words, fail. Repeated rows get equal verdicts. Texts of any
    length are read whole, a row at a time. An empty table gives an empty result. Columns that carry a measure's name are an error.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    carry = [c for c in docs.columns if c in columns or c == "text"]
    measured = measures(docs.select(*carry))
    if "text" not in columns:
        measured = measured.drop("text")
    return judge(scratch.save(measured, "measures"), threshold)
