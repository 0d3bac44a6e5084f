"""Provenance sources, candidates and the eligibility gate, as expressions over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNKNOWN, age_days, alternatives, digest, mean_entropy
from .contracts import ACTIONS, join_checked

# Fixed value: documents among the source types.
DOCUMENTS = ("ingredient_panel", "recipe_record", "manufacturer_record", "menu_record", "preparation_log")
SOURCE = "struct<source_id:string,record_id:string,item_id:string,source_type:string,facts:map<string,string>,observed_at:timestamp,available_at_inference:boolean,reference_only:boolean,verification_status:string,conflict:boolean>"


def visible(sources: Column) -> Column:
    return F.filter(sources, lambda s: s["available_at_inference"] & ~s["reference_only"])


def bound_visible(sources: Column, record: Column, item: Column) -> Column:
    """Visible sources; one of another record or item is an error."""
    foreign = F.exists(sources, lambda s: (s["record_id"] != record) | (s["item_id"] != item))
    return F.when(foreign, F.raise_error(F.lit("source of another record or item")).cast(f"array<{SOURCE}>")).otherwise(visible(sources))


def _fact(s: Column, field: Column) -> Column:
    return F.element_at(s["facts"], field)


def relevant(sources: Column, field: Column) -> Column:
    return F.filter(sources, lambda s: F.map_contains_key(s["facts"], field))


def facts(sources: Column, field: Column, reviewed: bool = False, quiet: bool = False) -> Column:
    """Distinct values of the field; of reviewed sources only; of those without conflict only."""
    rows = relevant(sources, field)
    if reviewed:
        rows = F.filter(rows, lambda s: s["verification_status"] == "reviewed")
    if quiet:
        rows = F.filter(rows, lambda s: ~s["conflict"])
    return F.array_sort(F.array_distinct(F.transform(rows, lambda s: _fact(s, field))))


def completions(sources: Column, field: Column, value: Column, others: Column) -> Column:
    """Values that the field may have: reviewed undisputed facts, or the predicted ones and the unknown."""
    known = facts(sources, field, True, True)
    guess = F.array_sort(F.array_union(others, F.array(value, F.lit(UNKNOWN))))
    return F.when(F.size(known) > 0, known).otherwise(guess)


def product(alternatives_by_field: dict[str, Column], most: int = 4096) -> Column:
    """All combinations as maps; more than `most` are an error."""
    out, n = F.array(F.create_map().cast("map<string,string>")), F.lit(1)
    for field, alts in alternatives_by_field.items():
        n = n * F.size(alts)
        out = F.flatten(F.transform(out, lambda m, f=field, a=alts: F.transform(a, lambda v: F.map_concat(m, F.create_map(F.lit(f), v)))))
    return F.when(n > most, F.raise_error(F.lit(f"more than {most} completions")).cast("array<map<string,string>>")).otherwise(out)


def unknown_mass(sources: Column, fields: list[Column]) -> Column:
    missing = F.lit(0)
    for f in fields:
        missing = missing + F.when(F.size(facts(sources, f, True, True)) == 0, 1).otherwise(0)
    return missing / max(len(fields), 1)


def features(sources: Column, field: Column, asof: Column) -> dict[str, Column]:
    """Of visible sources; conflicts count unreviewed facts too, unlike the gate."""
    near = relevant(sources, field)
    ages = F.transform(sources, lambda s: age_days(asof, s["observed_at"]))
    return {
        "n_sources": F.size(sources).cast("double"),
        "has_documentary": F.exists(near, lambda s: s["source_type"].isin(*DOCUMENTS)).cast("double"),
        "source_age_days": F.least(F.coalesce(F.array_max(ages), F.lit(0.0)), F.lit(3650.0)),
        "missing_premises": (F.size(near) == 0).cast("double"),
        "source_conflicts": (F.exists(near, lambda s: s["conflict"]) | (F.size(facts(sources, field)) > 1)).cast("double"),
        "unknown_mass": unknown_mass(sources, [field]),
    }


def gate(field: Column, value: Column, qualifier: Column, confidence: Column, sources: Column, alts: Column, predicted: Column, rule: Column) -> Column:
    """The reason of the first rule that applies; eligible() tells which reasons admit."""
    near = relevant(sources, field)
    disputed = F.exists(near, lambda s: s["conflict"]) | (F.size(facts(sources, field, True)) > 1)
    proof = F.exists(near, lambda s: (s["verification_status"] == "reviewed") & (s["source_type"].isin(*DOCUMENTS) | ((qualifier == "observed") & (s["source_type"] == "reviewed_visual_annotation"))) & (_fact(s, field) == value))
    stated = qualifier.isin("recorded", "observed")
    is_predicted = qualifier == "predicted"
    return (
        F.when(~F.array_contains(rule["values"], value), "value_outside_registered_vocabulary")
        .when(~F.array_contains(rule["qualifiers"], qualifier), "qualifier_not_permitted")
        .when(~F.array_contains(rule["fields"], field), "field_not_permitted")
        .when(F.size(alts) == 0, "empty_completion_set")
        .when(disputed, "critical_source_conflict")
        .when(is_predicted & (F.coalesce(predicted, F.lit(UNKNOWN)) != value), "missing_visual_prediction")
        .when(is_predicted & ~F.coalesce(confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False)), "invalid_confidence")
        .when(is_predicted, "qualified_prediction_only")
        .when(stated & F.coalesce(rule["documentary_for_recorded"], F.lit(True)) & ~proof, "missing_reviewed_premise")
        .when(stated & F.exists(alts, lambda a: a != value), "not_supported_across_completions")
        .when(stated, "supported_by_available_premises")
        .otherwise("non_focal_claim")
    )


def eligible(reason: Column) -> Column:
    return reason.isin("qualified_prediction_only", "supported_by_available_premises")


def candidates(states: DataFrame, rules: DataFrame, mode: str = "multimodal", asof: str = "2026-09-18 00:00:00") -> DataFrame:
    """One claim a record. states: record_id, group_id, domain, split, focal_field, focal_item_id, visual_scope, sources,
    labels (texts of the focal field), probabilities, predicted_joint_marginal_gap; rules: a row a field (broadcast: fields are few)."""
    if mode not in ("image_only", "metadata_only", "multimodal"):
        raise ValueError("unknown input mode")
    rows = join_checked(states, F.broadcast(rules.select(F.col("field").alias("focal_field"), F.struct("claim_id", "fields", "values", "qualifiers", "documentary_for_recorded", "specificity").alias("rule"))), ["focal_field"], "inner")
    field = F.col("focal_field")
    sees = F.lit(mode != "metadata_only") & (F.size("labels") > 0) & (F.col("visual_scope").isin("single_item", "focal_crop") | (F.col("focal_item_id") == "__record__"))
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    no_sources = F.array().cast(f"array<{SOURCE}>")
    rows = rows.withColumns({
        "predicted": F.when(sees, F.element_at("labels", best)),
        "candidate_confidence": F.when(sees, F.array_max("probabilities")).otherwise(0.0),
        "others": F.when(sees, alternatives(F.col("labels"), F.col("probabilities"))).otherwise(F.array().cast("array<string>")),
        "sources": no_sources if mode == "image_only" else bound_visible(F.col("sources"), F.col("record_id").cast("string"), F.col("focal_item_id")),
    })
    written = facts(F.col("sources"), field, True, True)
    rows = rows.withColumn("value", F.when(F.size(written) == 1, written[0]).otherwise(F.coalesce("predicted", F.lit(UNKNOWN)))).withColumn("qualifier", F.when(F.size(written) == 1, "recorded").otherwise("predicted"))
    rows = rows.withColumn("value", F.when(F.array_contains("rule.values", F.col("value")), F.col("value")).otherwise(UNKNOWN))
    rows = rows.withColumn("qualifier", F.when(F.col("value") == UNKNOWN, "recorded").otherwise(F.col("qualifier"))).withColumn("informative", F.col("value") != UNKNOWN)
    rows = rows.withColumn("alts", completions(F.col("sources"), field, F.coalesce("predicted", F.lit(UNKNOWN)), F.col("others")))
    reason = gate(field, F.col("value"), F.col("qualifier"), F.col("candidate_confidence"), F.col("sources"), F.col("alts"), F.col("predicted"), F.col("rule"))
    ids = F.array_join(F.array_sort(F.transform("sources", lambda s: s["source_id"])), ",")
    return rows.withColumns({"gate_reason": reason, "entropy": mean_entropy(F.col("probabilities")), "candidate_id": digest(F.col("record_id"), F.col("focal_item_id"), field, F.col("value"), F.col("qualifier"), F.concat(F.lit(mode + ":"), ids), length=24), **features(F.col("sources"), field, F.to_timestamp(F.lit(asof)))}).withColumns({"eligible": eligible(F.col("gate_reason")), "specificity": F.col("rule.specificity"), "input_mode": F.lit(mode)})


def support_status(factual: Column, evidential: Column, informative: Column) -> Column:
    known = F.coalesce(factual.isin("supported", "unknown", "unverifiable") & evidential.isin("supported", "unknown", "unverifiable", "unsupported"), F.lit(False))
    return (
        F.when(~informative, "noninformative")
        .when(factual == "contradicted", "contradicted")
        .when((factual == "supported") & (evidential == "supported"), "supported")
        .when(known, "unverifiable")
        .otherwise(F.raise_error(F.lit("invalid reference axes")).cast("string"))
    )


def render(reviewed_rule: Column, reason: Column, score: Column, threshold: Column, qualifier: Column, field: Column, value: Column, values: Column) -> Column:
    """struct(status, reason, message). An answer whose value is none of the rule's values is an error."""
    good = eligible(reason)
    name = F.replace(field, F.lit("_"), F.lit(" "))
    # The wordings of answers.
    said = (
        F.when(qualifier == "predicted", F.format_string("The model predicts %s: %s.", name, value))
        .when(qualifier == "recorded", F.format_string("The available record states %s: %s.", name, value))
        .when(qualifier == "observed", F.format_string("The reviewed image records %s: %s.", name, value))
    )
    status = F.when(~reviewed_rule, "research_preview_only").when(~good | (score < threshold), "not_established").otherwise("answer")
    why = F.when(~reviewed_rule, "claim_schema_pending_domain_review").when(good & (score < threshold), "support_score_below_threshold").otherwise(reason)
    said = F.when(F.coalesce(F.array_contains(values, value), F.lit(False)), said).otherwise(F.raise_error(F.lit("value outside the approved wording")).cast("string"))
    silence = F.lit("The available information does not establish this attribute. This is not a safety verdict.")
    return F.struct(status.alias("status"), why.alias("reason"), F.when(status == "answer", said).when(status == "not_established", silence).alias("message"))


def fixture_ratings(candidates: DataFrame) -> DataFrame:
    """Ratings of synthetic candidates (value, truth, eligible, informative), for tests of the software alone."""
    factual = F.when(F.col("value") == F.col("truth"), "supported").otherwise("contradicted")
    evidential = F.when(F.col("eligible"), "supported").otherwise("unknown")
    return candidates.select("candidate_id", factual.alias("factual_status"), evidential.alias("evidential_status"), "informative", F.lit("SYNTHETIC_TEST_ONLY").alias("adjudication_id"))


#: A serialised state: its fields and those of its sources.
STATE = f"struct<record_id:string,item_id:string,alternatives:array<string>,sources:array<{SOURCE}>,predicted:string,unknown_mass:double,reference_only:boolean>"


def strict_state(text: Column) -> Column:
    """A typed state of a JSON object; an unknown field, of the state or of a source, and a value of another type are errors."""
    known = F.array(*[F.lit(x) for x in ("record_id", "item_id", "alternatives", "sources", "predicted", "unknown_mass", "reference_only")])
    known_source = F.array(*[F.lit(x) for x in ("source_id", "record_id", "item_id", "source_type", "facts", "observed_at", "available_at_inference", "reference_only", "verification_status", "conflict")])
    outside = lambda keys, names: F.size(F.array_except(keys, names)) > 0
    sources = F.from_json(F.get_json_object(text, "$.sources"), "array<map<string,string>>")
    bad = outside(F.json_object_keys(text), known) | F.coalesce(F.exists(sources, lambda m: outside(F.map_keys(m), known_source)), F.lit(False))
    state = F.from_json(text, STATE, {"mode": "FAILFAST"})
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("unknown or hidden fields in a state")).cast(STATE)).otherwise(state)


def baseline_action(policy: str, missing_premises: Column, seed: Column | None = None) -> Column:
    if policy == "fixed":
        return F.lit("ingredient_panel")
    if policy == "random":
        return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.pmod(F.xxhash64(seed if seed is not None else F.lit(0)), F.lit(len(ACTIONS))) + 1).cast("int"))
    if policy == "uncertainty":
        return F.when(missing_premises > 0, "ingredient_panel").otherwise("preparation_detail")
    raise ValueError("unknown baseline")


def best_action(scores: Column) -> Column:
    """The action of the largest score of a map, no_action if that isn't above 0."""
    top = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("a"))))
    return F.when(top["s"] > 0, top["a"]).otherwise("no_action")


def answers_for(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (record_id, action_id) with available, source and elapsed_seconds; none documented: not available; an
    available answer without source_id, or two for one action, are errors."""
    known = join_checked(rows, answers.select("record_id", "action_id", "available", "source", "elapsed_seconds"), ["record_id", "action_id"])
    ok = F.coalesce("available", F.lit(False))
    source = F.when(ok & F.col("source.source_id").isNull(), F.raise_error(F.lit("answer without provenance")).cast(SOURCE)).when(ok, F.col("source"))
    return known.withColumns({"available": ok, "source": source, "elapsed_seconds": F.coalesce("elapsed_seconds", F.lit(0.0))})


def replay(rows: DataFrame, answers: DataFrame, asof: str = "2026-09-18 00:00:00") -> DataFrame:
    """Candidates with action_id, gated again with the answer's source added; a single reviewed undisputed document sets the value."""
    field = F.col("focal_field")
    rows = answers_for(rows, answers).withColumn("sources", F.when(F.col("available"), F.array_append("sources", F.col("source"))).otherwise(F.col("sources")))
    rows = rows.withColumn("sources", bound_visible(F.col("sources"), F.col("record_id").cast("string"), F.col("focal_item_id")))
    papers = F.filter("sources", lambda s: s["source_type"].isin(*DOCUMENTS))
    one = facts(papers, field, True, True)
    rows = rows.withColumns({"value": F.when(F.size(one) == 1, one[0]).otherwise(F.col("value")), "qualifier": F.when(F.size(one) == 1, "recorded").otherwise(F.col("qualifier")), "alts": completions(F.col("sources"), field, F.coalesce("predicted", F.lit(UNKNOWN)), F.col("others"))})
    reason = gate(field, F.col("value"), F.col("qualifier"), F.col("candidate_confidence"), F.col("sources"), F.col("alts"), F.col("predicted"), F.col("rule"))
    rows = rows.withColumns({"gate_reason": reason, "before_candidate_id": F.col("candidate_id"), "question_count": (F.col("action_id") != "no_action").cast("int"), "idealised_replay": F.lit(True), **features(F.col("sources"), field, F.to_timestamp(F.lit(asof)))})
    return rows.withColumns({"eligible": eligible(F.col("gate_reason")), "candidate_id": digest(F.col("before_candidate_id"), F.col("value"), F.col("qualifier"), F.array_join(F.transform("sources", lambda s: s["source_id"]), ","), length=24)})


def replay_steps(states: DataFrame, choose, update, evaluate, budget: int = 1) -> DataFrame:
    """Up to two steps: choose(df) gives action_id, update(df) applies it; a repeated action or no_action ends a row's run."""
    if budget not in (0, 1, 2):
        raise ValueError("budget must be 0, 1 or 2")
    df = states.withColumn("before", evaluate(states)).withColumn("actions", F.array().cast("array<string>")).withColumn("_go", F.lit(True))
    for _ in range(budget):
        df = df.withColumn("action_id", choose(df))
        df = df.withColumn("_go", F.col("_go") & (F.col("action_id") != "no_action") & ~F.array_contains("actions", F.col("action_id")))
        df = df.withColumn("actions", F.when(F.col("_go"), F.array_append("actions", F.col("action_id"))).otherwise(F.col("actions")))
        df = update(df)
    return df.withColumn("after", evaluate(df)).withColumn("n_actions", F.size("actions")).drop("_go")


def tuple_swaps(items: DataFrame, field: str = "cooking_style") -> DataFrame:
    """For each pair of a reviewer's items whose field differs, the pair with it exchanged."""
    a, b = items.alias("a"), items.alias("b")
    same = (F.col("a.record_id") == F.col("b.record_id")) & (F.col("a.reviewer_id") == F.col("b.reviewer_id")) & (F.col("a.item_id") < F.col("b.item_id"))
    pairs = a.join(b, same).where(F.col(f"a.{field}") != F.col(f"b.{field}"))
    return pairs.select(F.col("a.record_id").alias("record_id"), F.col("a.reviewer_id").alias("reviewer_id"), F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), F.col(f"b.{field}").alias("swapped_a"), F.col(f"a.{field}").alias("swapped_b"))


def monotone(full: DataFrame, less: DataFrame) -> DataFrame:
    """Claims, predicted ones apart, that less information admits and more does not: must be empty."""
    keep = lambda d: d.where("eligible and qualifier <> 'predicted'").select("record_id")
    return keep(less).join(keep(full), "record_id", "left_anti")
