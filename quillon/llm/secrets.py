"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let, text_of

#: kind: (pattern, least length, whether the length is that of the value after the last quote, blank, : or =)
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
#: Parts that say little alone. kind: (pattern, kinds of which one must stand near, for each of the listed groups). An address
#: that holds user, password and host has all parts in itself, so it needs none.
WEAK = {
    "id": (r"""(?i:client_?id|tenant_?id|account_?id|subscription_?id|project_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}|\bA[KS]IA[A-Z0-9]{8,15}(?![A-Z0-9])""", (("assign", "hex", "key"),)),
    "key": (r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", (("access", "id", "host", "mail"),)),
    "host": (r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+|\b(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", (("access", "id", "mail"), ("assign", "hex", "key"))),
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+", (("assign", "hex", "key"),)),
    "address": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])(?::[0-9]{1,5})?", (("access", "id", "mail"), ("assign", "hex", "key"))),
    "dsn": (r"""\b[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D/:@"'<>]++:[^\x20\x09-\x0D/@"'<>]++@[^\x20\x09-\x0D"'<>]++""", ()),
}
#: What a text must hold for a kind's pattern to be tried at all.
MARKS = {"access": "AKIA", "mail": "@", "dsn": "://"}
KINDS = (*BASE, *WEAK)
#: Code points that may lie between the end of a part of a credential and the start of the next.
SCOPE = 200

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str, kind: int, least: int, value_only: bool) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end): what stands between the matches gives their places.

    The places are running sums of lengths, taken by blocks of about sqrt(n) matches, so no array is copied at each match.
    """

    def spans(gaps: Column, hits: Column, values: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(hits, i)))

        def blocks(s: Column) -> Column:  # sums over blocks of about sqrt(n) lengths, then within each
            wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int"))
            parts = F.transform(F.sequence(F.lit(1), F.size(s), wide), lambda a: F.slice(s, a, wide))
            return let(F.struct(parts.alias("p"), _running(F.transform(parts, _sum)).alias("b")), inside)

        def inside(x: Column) -> Column:
            return F.flatten(F.transform(x["p"], lambda p, j: F.transform(_running(p), lambda e: e + F.when(j > 0, F.get(x["b"], j - 1)).otherwise(0))))

        span = lambda e, i: F.struct((e - F.length(F.get(hits, i))).cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end"), (F.length(F.get(values, i)) >= least).alias("ok"))
        every = F.transform(let(steps, blocks), span)
        return F.transform(F.filter(every, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value_only else None
    parts = F.struct(F.split(text, pattern, -1).alias("g"), hits.alias("h"), *([values.alias("v")] if value_only else []))
    found = let(parts, lambda x: spans(x["g"], x["h"], x["v"] if value_only else x["h"]))
    tried = F.contains(text, F.lit(MARKS[KINDS[kind]])) if KINDS[kind] in MARKS else F.lit(True)
    return F.when(tried & F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, e: a + e)


def _running(x: Column) -> Column:
    """Running sums of a short array: of its first i + 1 numbers at i."""
    return F.transform(x, lambda e, i: _sum(F.slice(x, F.lit(1), i + 1)))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(*[_found(text, p, k, least, name == "assign") for k, (name, (p, least)) in enumerate(BASE.items())]))


def weak_spans(text: Column) -> Column:
    return F.concat(*[_found(text, p, len(BASE) + k, 1, False) for k, (p, _) in enumerate(WEAK.values())])


def link(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak rows of parts (keys, start, kind, end) near which complementary parts of their scope stand.

    The interval join is an ordered one: of each kind, the furthest end of the parts that begin no later and the first
    start of those that begin no earlier are running values, so a text with n parts costs n log n and no pair is made.
    Parts are near if at most scope code points lie between the end of one and the start of the other, however long they are.
    """
    ahead = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    rows = parts.distinct()
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    rows = rows.withColumns({f"_end_{name}": F.max(of(k, "end")).over(ahead) for k, name in enumerate(KINDS)})
    rows = rows.withColumns({f"_start_{name}": F.min(of(k, "start")).over(behind) for k, name in enumerate(KINDS)})
    near = lambda name: F.coalesce(F.col(f"_end_{name}") >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.col(f"_start_{name}") <= F.col("end") + scope, F.lit(False))
    rows = rows.withColumns({f"_near_{name}": near(name) for name in KINDS})
    linked = F.lit(False)
    for name, (_, needs) in WEAK.items():
        whole = F.lit(True)
        for group in needs:
            some = F.lit(False)
            for other in group:
                some = some | F.col(f"_near_{other}")
            whole = whole & some
        linked = linked | ((F.col("kind") == KINDS.index(name)) & whole)
    return rows.where(linked).select(*keys, "start", "kind", "end")


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scratch: Scratch | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs with base and spans (arrays of start, kind, end in code points), a row for each row of docs.

    Weak parts are kept only if they take part in a credential and don't overlap a base span. Null text is empty;
    null and repeated doc_ids are fine, since weak spans are joined by the text's hash and id together. Patterns read
    texts of any length as a whole; an empty table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    carry = [c for c in docs.columns if c in columns]
    text = text_of()
    rows = docs.select(*carry, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"))
    empty = F.array().cast(SPAN)
    rows = rows.select(
        *carry, "_id", "_h",
        base_spans(F.col("_t")).alias("base"),
        weak_spans(F.col("_t")).alias("_weak"),
    )
    rows = scratch.save(rows, "parts")
    parts = rows.where(F.size("_weak") > 0).select("_id", "_h", F.explode(F.concat("base", "_weak")).alias("s")).select("_id", "_h", "s.*")
    found = link(parts, ["_id", "_h"]).groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "kind", "end")).cast(SPAN).alias("_more"))
    out = rows.join(found, ["_id", "_h"], "left").withColumn("_more", F.coalesce("_more", empty))
    apart = F.filter("_more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.select(*carry, "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, a hash of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _highest(x: Column) -> Column:
    """Running maxima of an array, by blocks of about sqrt(n) numbers."""

    def over(s: Column) -> Column:
        here = lambda p, j: F.transform(p, lambda e, i: F.greatest(F.array_max(F.slice(p, F.lit(1), i + 1)), F.when(j > 0, F.array_max(F.slice(s["t"], F.lit(1), j))).otherwise(0)))
        return F.flatten(F.transform(s["p"], here))

    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), wide), lambda a: F.slice(x, a, wide))
    return let(parts, lambda p: let(F.struct(p.alias("p"), F.transform(p, lambda e: F.coalesce(F.array_max(e), F.lit(0))).alias("t")), over))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span (by start), overlapping ones united, replaced by mark.

    The text is cut in UTF-32, where a place is four times its number, so each piece is reached at once; pieces are put
    together once. Null stays null.
    """

    def pieces(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["far"], i - 1)).otherwise(0)
        gap = lambda a, b: F.decode(F.substring(x["u"], 4 * a + 1, F.greatest(4 * (b - a), F.lit(0))), "UTF-32")
        cut = F.transform(x["s"], lambda s, i: F.when(s["start"] < before(i), F.lit("")).otherwise(F.concat(gap(before(i), s["start"]), F.lit(mark))))
        end = F.element_at(x["far"], -1)
        return F.concat(F.array_join(cut, ""), F.decode(F.substring(x["u"], 4 * end + 1, F.octet_length(x["u"])), "UTF-32"))

    ends = F.transform(spans, lambda s: s["end"])
    done = let(F.struct(F.encode(text, "UTF-32").alias("u"), spans.alias("s"), _highest(ends).alias("far")), pieces)
    return F.when(F.size(spans) > 0, done).otherwise(text)
