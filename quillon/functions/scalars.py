"""Scalar functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as no value.
NULL_TOKENS = ("", "nan", "null", "unknown", "not known", "unspecified", "n/a")
UNKNOWN = "__unknown__"


def normalize(c: Column) -> Column:
    """Null to '', ends trimmed of any Unicode blank, folded to lower case (with ß as ss), null tokens to '', runs of blanks to one."""
    s = F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))
    s = F.replace(s, F.lit("ß"), F.lit("ss"))
    return F.when(s.isin(*NULL_TOKENS), F.lit("")).otherwise(F.regexp_replace(s, r"(?U)\s+", " "))


def values(c: Column) -> Column:
    """A text that opens with [ is a list, with either quotes; any other is one value, commas and all."""
    s = F.trim(c)
    listed = F.from_json(s, "array<string>", {"allowSingleQuotes": "true", "mode": "FAILFAST"})
    return F.when(s.startswith("["), listed).otherwise(F.array(c))


def parallel_explode(*lists: Column) -> Column:
    """Structs of the lists' elements side by side; lists of unequal length are an error, which the column carries."""
    sizes = F.array_distinct(F.array(*[F.size(x) for x in lists]))
    return F.when(F.size(sizes) == 1, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("parallel lists of unequal length")))


def label_key(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys, compact."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def label_fields(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def has_field(label: Column, field: str) -> Column:
    return F.map_contains_key(label_fields(label), field)


def participant(path: Column) -> Column:
    """The leading A4F_... part of a name; none is an error."""
    found = F.regexp_extract(path, r"^(A4F_[^_]+)_", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no participant in "), path)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def item_id(labeler: Column, row: Column, item: Column) -> Column:
    return F.format_string("r%s_row%d_i%d", labeler.cast("string"), row.cast("long"), item.cast("long"))


def strict_bool(c: Column) -> Column:
    """true, false, 1, 0 in any case; anything else, null too, is an error."""
    s = F.lower(c.cast("string"))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(F.raise_error(F.lit("invalid boolean value")).cast("boolean"))


def lenient_bool(c: Column) -> Column:
    """true and 1 in any case; anything else is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def number_or_null(c: Column) -> Column:
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def dhash_bands(c: Column) -> list[Column]:
    """Four 16-bit integers of a 16-digit hexadecimal hash."""
    return [F.conv(F.substring(c, 1 + 4 * i, 4), 16, 10).cast("int") for i in range(4)]


def hamming(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q) - F.log1p(-q)


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def mean_entropy(p: Column, eps: float = 1e-8, add: bool = False) -> Column:
    """Mean binary entropy of an array: clipped to [eps, 1 - eps], or with eps added inside the logarithms."""

    def one(x: Column) -> Column:
        if add:
            return -(x * F.log(x + eps) + (1 - x) * F.log(1 - x + eps))
        q = F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps))
        return -(q * F.log(q) + (1 - q) * F.log1p(-q))

    return F.aggregate(F.transform(p, one), F.lit(0.0), lambda a, x: a + x) / F.size(p)


def alternatives(labels: Column, p: Column, floor: float = 0.1) -> Column:
    """Sorted distinct values whose probability is at least floor."""
    both = F.filter(F.arrays_zip(labels.alias("l"), p.alias("p")), lambda x: x["p"] >= floor)
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: x["l"])))


def argmax_first(p: Column) -> Column:
    """0-based place of the largest value, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_k(p: Column, k: int) -> Column:
    """The k largest as (p, j), ties by place."""
    ranked = F.array_sort(F.transform(p, lambda x, j: F.struct((-x).alias("m"), j.alias("j"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["m"]).alias("p"), s["j"].alias("j")))


def age_days(asof: Column, observed: Column) -> Column:
    """Days between two timestamps, 0 at least."""
    return F.greatest((F.unix_micros(asof) - F.unix_micros(observed)) / F.lit(86_400_000_000.0), F.lit(0.0))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def close(a: Column, b: Column | float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def tuple_score(parts: Column) -> Column:
    """Product of the marginals; 0 if one is absent."""
    return F.when(F.exists(parts, lambda x: x.isNull()), F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(1.0), lambda a, x: a * x))


def marginal_gain(supported: Column, unsupported: Column, cost: Column, penalty: float = 1.0, cost_weight: float = 0.05) -> Column:
    return supported - penalty * unsupported - cost_weight * cost


def calibrated(z: Column, kind: str, a: Column | float = 1.0, b: Column | float = 0.0) -> Column:
    """identity: z; temperature: z / a; sigmoid: a z + b."""
    if kind == "identity":
        return z
    if kind == "temperature":
        return z / a
    if kind == "sigmoid":
        return a * z + b
    raise ValueError(f"unknown calibrator {kind}")


def is_barcode(c: Column) -> Column:
    return c.rlike("^[0-9]{8,14}$")


def is_user_agent(c: Column) -> Column:
    return F.contains(c, F.lit("@"))


def is_cohort_id(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$")


def is_close_path(path: Column, root: str) -> Column:
    """Whether a path without .. parts lies below root."""
    inside = F.lit(root.rstrip("/") + "/")
    return F.startswith(path, inside) & ~path.rlike(r"(^|/)\.\.(/|$)")


def digest(*parts: Column, length: int = 64) -> Column:
    """Own canonical form: parts length-prefixed and joined, SHA-256, hex."""
    text = F.concat_ws("|", *[F.concat(F.octet_length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def group_id(root: Column) -> Column:
    """g_ and 16 digits of the SHA-256 of the root as a JSON string (ids of ASCII without escapes)."""
    return F.concat(F.lit("g_"), F.substring(F.sha2(F.concat(F.lit('"'), root, F.lit('"')), 256), 1, 16))


def vlm_items(text: Column, fields: list[str], frozen: dict[str, list[str]] | None = None, most: int = 30) -> Column:
    """The items of a model's JSON answer, or an error: a fence is taken off; only the key items; at most `most`
    objects; only known fields with a text or null; frozen fields only with their values."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    root = F.from_json(body, "map<string,string>", {"mode": "FAILFAST"})
    items = F.from_json(F.element_at(root, "items"), "array<map<string,string>>", {"mode": "FAILFAST"})
    typed = F.from_json(F.element_at(root, "items"), "array<map<string,variant>>")
    is_text = F.forall(typed, lambda m: F.forall(F.map_values(m), lambda v: v.isNull() | F.is_variant_null(v) | F.schema_of_variant(v).isin("STRING", "VOID")))
    known = F.forall(items, lambda m: F.forall(F.map_keys(m), lambda k: k.isin(*fields)))
    good = F.coalesce((F.size(F.map_keys(root)) == 1) & F.map_contains_key(root, "items") & items.isNotNull() & (F.size(items) <= most) & known & is_text, F.lit(False))
    for field, allowed in (frozen or {}).items():
        good = good & F.forall(items, lambda m, f=field, a=allowed: F.coalesce(F.element_at(m, f).isin(*a), F.lit(True)))
    return F.when(good, items).otherwise(F.raise_error(F.lit("answer outside the contract")).cast("array<map<string,string>>"))
