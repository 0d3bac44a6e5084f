"""Further queries over the driver's tables, for the scalar functions, contracts, joins and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibrate, contracts, entities, external, gate, locks, metrics, resample, studies, targets, training
from ..sources import writers
from . import views as V
from .queries import _DRAWS, query, rounded


@query("select p_partkey, (case p_partkey % 3 when 0 then 2 when 1 then 3 else 1 end)::bigint as n, case p_partkey % 3 when 0 then 'a, b' when 1 then 'x' else p_name end as one from part")
def item_values(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, '["a, b","b"]').when(k == 1, "['x', 'y', 'z']").otherwise(F.col("p_name"))
    return rounded(V.read(spark, d, "part").select("p_partkey", S.values(text).alias("v")).select("p_partkey", F.size("v").alias("n"), F.col("v")[0].alias("one")))


@query("select c_custkey, 'A4F_' || c_custkey as participant from customer")
def participants_of_paths(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", S.participant(F.concat(F.lit("A4F_"), "c_custkey", F.lit("_plate_1.jpg"))).alias("participant"))


@query("select page_id, list_extract(string_split(url, '/'), -1) as name from pages")
def base_names(spark, d):
    return V.read(spark, d, "pages").select("page_id", S.basename(F.col("url")).alias("name"))


@query("select l_orderkey, 'r' || l_suppkey || '_row' || l_linenumber || '_i' || l_partkey as item_id, count(*) as n from lineitem group by all")
def item_ids(spark, d):
    rows = V.read(spark, d, "lineitem").select("l_orderkey", S.item_id(F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("item_id"))
    return rows.groupBy("l_orderkey", "item_id").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderkey % 4 in (0, 2) as strict, o_orderkey % 4 = 0 as lenient, case when o_orderkey % 3 = 0 then o_orderkey::double end as number from orders")
def typed_texts(spark, d):
    k = F.col("o_orderkey")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("TRUE", "0", "1", "False")]), (k % 4 + 1).cast("int"))
    loose = F.when(k % 4 == 0, "True").when(k % 4 == 1, "yes").otherwise(F.lit(None))
    number = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "n/a").otherwise("NaN")
    return V.read(spark, d, "orders").select("o_orderkey", S.strict_bool(flag).alias("strict"), S.lenient_bool(loose).alias("lenient"), S.number_or_null(number).alias("number"))


@query("with " + V.PREDICTIONS + ", q as (select record_id, least(greatest(p, 1e-8), 1 - 1e-8) as q from predictions_v) select record_id, round(avg(-(q * ln(q) + (1 - q) * ln(1 - q))), 6) as entropy from q group by 1")
def mean_entropies(spark, d):
    p = F.transform("embedding", lambda x: 1 / (1 + F.exp(-4 * x.cast("double"))))
    return rounded(V.read(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), S.mean_entropy(p).alias("entropy")))


@query("select o_orderkey, concat_ws(',', case when o_orderkey % 11 >= 2 then 'a' end, case when o_orderkey % 37 >= 4 then 'b' end) as alts, (case when o_orderkey % 37 / 37::double >= o_orderkey % 11 / 11::double then 0 else 1 end)::bigint as best from orders")
def alternatives_at_floor(spark, d):
    k = F.col("o_orderkey")
    p = F.array(k % 37 / F.lit(37.0), k % 11 / F.lit(11.0), F.lit(0.0))
    rows = V.read(spark, d, "orders").select("o_orderkey", p.alias("p"))
    return rounded(rows.select("o_orderkey", F.array_join(S.alternatives(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.col("p")), ",").alias("alts"), S.argmax_first(F.col("p")).alias("best")))


@query("select event_id, round(greatest((epoch_us(timestamp '2024-01-15') - epoch_us(ts)) / 86400000000::double, 0), 6) as age_days from events")
def source_ages(spark, d):
    return rounded(V.read(spark, d, "events").select("event_id", S.age_days(F.to_timestamp(F.lit("2024-01-15 00:00:00")), F.col("ts").cast("timestamp")).alias("age_days")))


@query("""select o_orderkey, round_even(o_orderkey / 2::double, 0) as half_even, abs((o_orderkey % 7) * 4e-6 * o_totalprice) <= 1e-8 + 1e-5 * abs(o_totalprice) as near,
 round(case when o_orderkey % 5 = 0 then 0 else (o_orderkey % 3) * 0.25 * 0.5 end, 6)::double as tuple_score, round(o_orderkey % 5 - o_orderkey % 3 - 0.05 * (o_orderkey % 7), 6)::double as gain from orders""")
def gate_numbers(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    parts = F.array((k % 3) * 0.25, F.when(k % 5 != 0, F.lit(0.5)))
    return V.read(spark, d, "orders").select(
        "o_orderkey", S.half_even(k / 2).cast("double").alias("half_even"), S.close(t * (1 + (k % 7) * 4e-6), t).alias("near"), F.round(S.tuple_score(parts), 6).alias("tuple_score"),
        F.round(S.marginal_gain(k % 5, k % 3, k % 7).cast("double"), 6).alias("gain"),
    )


@query("with " + V.PREDICTIONS + """ select record_id, j::bigint as j, round(1 / (1 + exp(-z)), 6) as as_is, round(1 / (1 + exp(-z / 1.5::double)), 6) as warm, round(1 / (1 + exp(-(0.8::double * z - 0.2::double))), 6) as shaped,
 round(ln(p) - ln(1 - p), 5) as back from predictions_v""")
def calibrated_scores(spark, d):
    z = F.col("z")
    out = V.predictions(spark, d).select("record_id", "j", *[S.sigmoid(S.calibrated(z, kind, *ab)).alias(n) for n, kind, ab in (("as_is", "identity", ()), ("warm", "temperature", (1.5,)), ("shaped", "sigmoid", (0.8, -0.2)))], F.round(S.logit(F.col("p")), 5).alias("back"))
    return rounded(out)


@query("""select c_custkey, length(c_custkey::varchar) + 6 between 8 and 14 as barcode, c_custkey % 2 = 0 as agent, c_custkey % 3 = 0 as cohort, c_custkey % 4 = 0 as inside,
 substr(sha256(strlen(c_name) || ':' || c_name || '|' || strlen(c_custkey::varchar) || ':' || c_custkey), 1, 24) as digest from customer""")
def identifiers(spark, d):
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, "/data/images/a.jpg").when(k % 4 == 1, "/data/images/../a.jpg").when(k % 4 == 2, "/data/images2/a.jpg").otherwise("a.jpg")
    return V.read(spark, d, "customer").select(
        "c_custkey", S.is_barcode(F.concat(F.lit("400000"), k)).alias("barcode"), S.is_user_agent(F.when(k % 2 == 0, "app/1 (a@b.org)").otherwise("app/1")).alias("agent"),
        S.is_cohort_id(F.when(k % 3 == 0, "wave_1-b").when(k % 3 == 1, "a b").otherwise("--")).alias("cohort"), S.is_close_path(path, "/data/images").alias("inside"), S.digest(F.col("c_name"), k, length=24).alias("digest"),
    )


@query("select p_partkey, (1 + p_partkey % 3)::bigint as n, p_brand as category from part")
def model_answers(spark, d):
    item = F.concat(F.lit('{"category":"'), "p_brand", F.lit('","cooking_style":null}'))
    body = F.concat(F.lit('```json\n{"items":['), F.array_join(F.array_repeat(item, (F.col("p_partkey") % 3 + 1).cast("int")), ","), F.lit("]}\n```"))
    rows = V.read(spark, d, "part").select("p_partkey", S.vlm_items(body, ["category", "cooking_style"]).alias("items"))
    return rounded(rows.select("p_partkey", F.size("items").alias("n"), F.element_at(F.col("items")[0], "category").alias("category")))


@query("""with x as (select o_orderkey as k, o_orderkey % 5 <> 0 as reviewed, case o_orderkey % 3 when 0 then 'qualified_prediction_only' when 1 then 'supported_by_available_premises' else 'critical_source_conflict' end as reason, (o_orderkey % 100) / 100::double as score, case when o_orderkey % 2 = 0 then 'predicted' else 'recorded' end as q from orders)
 select k, case when not reviewed then 'research_preview_only' when k % 3 = 2 or score < 0.3::double then 'not_established' else 'answer' end as status,
 case when not reviewed then 'claim_schema_pending_domain_review' when k % 3 <> 2 and score < 0.3::double then 'support_score_below_threshold' else reason end as reason,
 case when not reviewed then null when k % 3 = 2 or score < 0.3::double then 'The available information does not establish this attribute. This is not a safety verdict.' when q = 'predicted' then 'The model predicts cooking style: fried.' else 'The available record states cooking style: fried.' end as message from x""")
def rendered_answers(spark, d):
    k = F.col("o_orderkey")
    reason = F.when(k % 3 == 0, "qualified_prediction_only").when(k % 3 == 1, "supported_by_available_premises").otherwise("critical_source_conflict")
    answer = gate.render(k % 5 != 0, reason, k % 100 / F.lit(100.0), F.lit(0.3), F.when(k % 2 == 0, "predicted").otherwise("recorded"), F.lit("cooking_style"), F.lit("fried"), F.array(F.lit("fried"), F.lit("boiled")))
    return V.read(spark, d, "orders").select(k.alias("k"), answer.alias("a")).select("k", "a.*")


@query("""select o_orderkey, 'ingredient_panel' as fixed, case when o_orderkey % 3 > 0 then 'ingredient_panel' else 'preparation_detail' end as uncertain, case when o_orderkey % 4 = 0 then 'no_action' when o_orderkey % 2 = 0 then 'barcode_lookup' else 'component_identity' end as best from orders""")
def chosen_actions(spark, d):
    k = F.col("o_orderkey")
    scores = F.create_map(F.lit("barcode_lookup"), F.when(k % 4 == 0, -0.5).when(k % 2 == 0, 0.7).otherwise(0.1), F.lit("component_identity"), F.when(k % 4 == 0, -0.1).otherwise(0.4))
    return V.read(spark, d, "orders").select("o_orderkey", gate.baseline_action("fixed", F.lit(0)).alias("fixed"), gate.baseline_action("uncertainty", k % 3).alias("uncertain"), gate.best_action(scores).alias("best"))


@query("select o_orderkey, (o_orderkey % 4)::bigint as before, (o_orderkey % 4 + (case when o_orderkey % 4 < 3 then 2 else 0 end))::bigint as after, (case when o_orderkey % 4 = 3 then 0 when o_orderkey % 2 = 0 then 1 else 2 end)::bigint as n_actions from orders")
def replayed_steps(spark, d):
    rows = V.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("v"), (F.col("o_orderkey") % 4).alias("first"))
    choose = lambda df: F.when(F.col("first") == 3, "no_action").when((F.col("first") == 1) & (F.size("actions") > 0), "preparation_detail").otherwise("ingredient_panel")
    update = lambda df: df.withColumn("v", F.col("v") + F.when(F.col("first") < 3, 1).otherwise(0))
    return rounded(gate.replay_steps(rows, choose, update, lambda df: F.col("v"), 2).select("o_orderkey", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), "n_actions"))


@query("select o_orderkey as record_id from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 and not (o_orderkey % 4 = 0 and o_orderkey % 5 <> 0)")
def monotone_breaks(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    k = F.col("record_id")
    less = o.select("record_id", (k % 2 == 0).alias("eligible"), F.when(k % 3 == 0, "predicted").otherwise("recorded").alias("qualifier"))
    full = o.select("record_id", (k % 4 == 0).alias("eligible"), F.when(k % 5 == 0, "predicted").otherwise("recorded").alias("qualifier"))
    return gate.monotone(full, less)


@query("select o_orderpriority as p, count(*) as n, round(sum(l_quantity), 6) as q from lineitem join orders on o_orderkey = l_orderkey group by 1")
def join_many_to_one(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("p"))
    return rounded(contracts.join_checked(V.read(spark, d, "lineitem"), o, ["l_orderkey"], complete=True).groupBy("p").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")))


@query("select a.o_orderkey, b.n from orders a left join (select l_orderkey, count(*) as n from lineitem group by 1) b on l_orderkey = o_orderkey")
def join_one_to_one(spark, d):
    n = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return contracts.join_checked(V.read(spark, d, "orders").select("o_orderkey"), n, ["o_orderkey"], cardinality="one_to_one")


def _documented(spark, d):
    k = F.col("o_orderkey")
    return V.read(spark, d, "orders").select(
        k.alias("record_id"), F.when(k % 2 == 0, "meal").otherwise("product").alias("domain"), F.col("o_custkey").alias("collection_group_id"), F.concat(F.lit("/data/"), k, F.lit(".jpg")).alias("image_path"),
        F.lit("r1").alias("rights_id"), F.lit("adjudicated").alias("reference_status"), F.when(F.col("o_custkey") % 3 == 0, "external").otherwise("main").alias("cohort"),
    )


@query("select case when o_orderkey % 2 = 0 then 'meal' else 'product' end as domain, case when o_custkey % 3 = 0 then 'external' else 'main' end as cohort, count(*) as n, 'record_presence' as visual_scope from orders group by all")
def documented_records(spark, d):
    records = contracts.validate_documented(_documented(spark, d), "/data")
    states = contracts.validate_states(records, contracts.presence_states(records))
    return contracts.join_checked(records, states, ["record_id"], complete=True).groupBy("domain", "cohort", "visual_scope").agg(F.count("*").alias("n"))


@query("select count(*) filter (l_partkey >= 15) as with_image, count(*) filter (l_partkey < 15) as without, count(distinct l_partkey) filter (l_partkey < 15) as missing from lineitem")
def images_missing(spark, d):
    a = V.read(spark, d, "lineitem").select(F.col("l_partkey").alias("image_name"))
    images = a.where("image_name >= 15").distinct()
    have, ledger = contracts.missing_images(a, images)
    both = have.select(F.lit(1).alias("h"), "image_name").unionByName(ledger.select(F.lit(0).alias("h"), "image_name"))
    return both.agg(F.count_if(F.col("h") == 1).alias("with_image"), F.count_if(F.col("h") == 0).alias("without"), F.count_distinct(F.when(F.col("h") == 0, F.col("image_name"))).alias("missing"))


@query("select l_orderkey as record_id, count(*) as n from lineitem where l_orderkey in (select l_orderkey from lineitem where l_linenumber = 1) and (l_orderkey % 2 = 0 or l_linenumber = 1) group by 1")
def focal_items(spark, d):
    a = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("string").alias("item_id"))
    records = a.where("item_id = '1'").select("record_id").distinct().withColumn("focal_item_id", F.when(F.col("record_id") % 2 == 0, "__record__").otherwise("1"))
    return contracts.focal_annotations(a.join(records.select("record_id"), "record_id", "left_semi"), records).groupBy("record_id").agg(F.count("*").alias("n"))


@query("select (o_custkey % 4)::bigint as fold, count(*) as n, count(distinct o_custkey) as n_groups from orders group by 1")
def oof_ledger(spark, d):
    g = F.col("o_custkey")
    others = lambda a, b: F.to_json(F.transform(F.array(a, b), lambda x: x.cast("string")))
    ledger = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), g.alias("group_id"), F.lit("fit").alias("split"), (g % 4).alias("fold"), others(g + 1, g + 2).alias("training_group_ids"), others(g + 3, g + 5).alias("early_stop_group_ids"))
    return entities.validate_oof(ledger).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))


@query("select split, count(*) as n, count(distinct o_custkey) as n_groups from (select o_custkey, case o_custkey % 4 when 0 then 'fit' when 1 then 'validation' when 2 then 'calibration' else 'test' end as split from orders) group by 1")
def validated_split(spark, d):
    g = F.col("o_custkey")
    split = F.element_at(F.array(*[F.lit(s) for s in ("fit", "validation", "calibration", "test")]), (g % 4 + 1).cast("int"))
    rows = entities.validate_split(V.read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), g.alias("group_id"), split.alias("split")))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))


@query("select case when o_custkey % 3 = 0 then 'external' else 'split' end as kind, count(*) as n, count(distinct o_custkey) as n_groups, (case when o_custkey % 3 = 0 then 1 else 4 end)::bigint as n_splits from orders group by all")
def cohort_splits(spark, d):
    rows = entities.cohort_split(_documented(spark, d).withColumnRenamed("collection_group_id", "group_id"))
    kind = F.when(F.col("split") == "external", "external").otherwise("split")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.count_distinct("split").alias("n_splits"))


@query("select (select count(*) from orders) as images, (select count(distinct o_custkey) from orders) as participants, (select count(*) from lineitem) as annotations, (select count(distinct l_suppkey) from lineitem) as reviewers, (select sum(n)::bigint from (select count(*) as n from orders group by o_custkey % 50 having count(*) > 1)) as duplicate_rows")
def dataset_audit(spark, d):
    records = V.read(spark, d, "orders").select(F.col("o_custkey").alias("participant_id"), (F.col("o_custkey") % 50).alias("sha256"))
    return studies.dataset_audit(records, V.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("reviewer_id")))


@query("select event_type as policy, round(avg((event_id % 3 = 0)::int), 6) as supported_share, round(avg(event_id % 2), 6) as mean_actions, round(avg(value), 6) as mean_seconds from events group by 1")
def clarification_summary(spark, d):
    e = F.col("event_id")
    rows = V.read(spark, d, "events").select(F.col("event_type").alias("policy"), F.when(e % 3 == 0, "supported").otherwise("unverifiable").alias("support_status"), (e % 2).alias("question_count"), F.col("value").alias("elapsed_seconds"))
    return rounded(studies.clarification_summary(rows))


@query("select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events")
def latency(spark, d):
    return rounded(studies.latency(V.read(spark, d, "events"), "value"))


@query("with " + V.PREDICTIONS + ", q as (select label, least(greatest(coalesce(sum(y * mask) / nullif(sum(mask), 0), 0), 1e-4::double), 1 - 1e-4::double) as p from predictions_v group by 1) select label, round(ln(p) - ln(1 - p), 6) as bias from q")
def base_rate_biases(spark, d):
    return rounded(calibrate.base_rate_bias(targets.prevalence(V.predictions(spark, d))))


@query("select o_orderkey, case when o_orderkey % 4 > 1 then o_totalprice end as x from orders")
def finite_numbers(spark, d):
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("-inf")).otherwise(F.col("o_totalprice"))
    return writers.finite(V.read(spark, d, "orders").select("o_orderkey", x.alias("x")))


@query("select case when o_orderkey % 3 = 0 then 'supported' else 'contradicted' end as support_status, count(*) as n from orders group by 1")
def attached_outcomes(spark, d):
    k = F.col("candidate_id")
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    ratings = o.withColumn("support_status", F.when(k % 3 == 0, "supported").otherwise("contradicted"))
    return metrics.attach_outcomes(o, ratings.unionByName(ratings)).groupBy("support_status").agg(F.count("*").alias("n"))


@query("""select b || '__' || r || '__' || h || '__seed' || s as run_id from (values ('resnet50'), ('convnext_tiny'), ('dinov2_vits14')) x(b), (values ('frozen'), ('finetune')) y(r), (values ('independent'), ('joint')) z(h), range(5) t(s)""")
def run_grid(spark, d):
    return locks.run_grid(spark).select("run_id")


@query("""with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as e, value, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events),
 i as (select *, max(case when before is null or value < before - 1e-8::double then e end) over (partition by user_id order by e) as best from s), z as (select user_id, min(e) filter (e - best >= 3) as stop, max(e) as last from i group by 1)
 select i.user_id as run_id, i.e + 1 as epochs, i.best as best_epoch, round(min(j.value), 6) as best_loss from z join i on i.user_id = z.user_id and i.e = coalesce(stop, last) join i j on j.user_id = i.user_id and j.e = i.best group by all""")
def early_stopping(spark, d):
    history = V.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.col("value").alias("validation_loss"))
    return rounded(training.run_lengths(history, patience=3))


@query("""select o_orderkey as candidate_id, case when o_orderkey % 2 = 0 and o_orderkey % 3 > 0 then 'supported' when o_orderkey % 2 = 0 then 'unverifiable' else 'contradicted' end as support_status from orders""")
def fixture_labels(spark, d):
    k = F.col("o_orderkey")
    rows = V.read(spark, d, "orders").select(k.alias("candidate_id"), F.lit("red").alias("value"), F.when(k % 2 == 0, "red").otherwise("green").alias("truth"), (k % 3 > 0).alias("eligible"), F.lit(True).alias("informative"))
    rated = gate.fixture_ratings(rows)
    return rated.select("candidate_id", gate.support_status(F.col("factual_status"), F.col("evidential_status"), F.col("informative")).alias("support_status"))


@query("select o_orderkey::varchar as record_id, 'main' as item_id, round(o_orderkey % 10 / 10::double, 6) as unknown_mass, 1::bigint as n_sources, o_orderkey % 2 = 0 as conflict from orders")
def strict_states(spark, d):
    k = F.col("o_orderkey")
    source = F.struct(F.lit("s").alias("source_id"), k.cast("string").alias("record_id"), F.lit("main").alias("item_id"), F.lit("menu_record").alias("source_type"), (k % 2 == 0).alias("conflict"))
    text = F.to_json(F.struct(k.cast("string").alias("record_id"), F.lit("main").alias("item_id"), F.array(source).alias("sources"), (k % 10 / F.lit(10.0)).alias("unknown_mass")))
    s = V.read(spark, d, "orders").select(gate.strict_state(text).alias("s")).select("s.*")
    return rounded(s.select("record_id", "item_id", "unknown_mass", F.size("sources").alias("n_sources"), F.col("sources")[0]["conflict"].alias("conflict")))


@query("select o_orderkey as record_id, 'external' as split from orders where o_custkey % 3 = 0")
def external_addendum(spark, d):
    rows = _documented(spark, d).withColumn("captured_at", F.to_timestamp(F.lit("2026-10-01 00:00:00")))
    main, fresh = rows.where("cohort = 'main'"), rows.where("cohort = 'external'")
    return external.addendum(main, fresh, "2026-09-18 00:00:00").select("record_id", "split")


@query("with " + V.CANDIDATES + """ select method, seed::bigint as seed, count(*) filter (eligible and informative and score >= case when method = 'A' then 0.3::double else 0.6::double end) as n_accepted, count(*) as n from candidates_v group by all""")
def frozen_predictions(spark, d):
    at = spark.createDataFrame([(m, s, t) for m, t in (("A", 0.3), ("B", 0.6)) for s in (0, 1)], "method string, seed int, threshold double")
    out = external.frozen_predictions(V.candidates(spark, d), at)
    return rounded(out.groupBy("method", "seed").agg(F.count_if("accepted").alias("n_accepted"), F.count("*").alias("n")))


_PAIR_DRAWS = _DRAWS.replace("predictions_v", "candidates_v")


@query("with " + V.CANDIDATES + ", " + _PAIR_DRAWS + """, s as (select method, seed, domain, group_id, count(*) as n, count(*) filter (accepted and informative) as a, count(*) filter (accepted and informative and support_status <> 'supported') as u from candidates_v group by all),
 w as (select * from dr union all select distinct -1, group_id, 1 from s), dm as (select b, method, seed, domain, sum(m * a / n::double) as a, sum(m * u / n::double) as u, sum(m) as m from s join w using (group_id) group by all),
 rt as (select b, method, seed, sum(case domain when 'F' then 0.5 when 'O' then 0.3 else 0.2 end * a / m) as c, sum(case domain when 'F' then 0.5 when 'O' then 0.3 else 0.2 end * u / m) as u, count(*) as nd from dm group by all),
 df as (select b, sum(case method when 'B' then 1 else -1 end * u / c) / 2 as risk, sum(case method when 'B' then 1 else -1 end * c) / 2 as cov from rt where nd = 3 group by b having count(*) = 4 and count(*) filter (c = 0) = 0)
 select round(max(risk) filter (b < 0), 6) as risk_difference, round(max(cov) filter (b < 0), 6) as coverage_difference, count(*) filter (b >= 0) as bootstrap_valid, round(quantile_cont(risk, 0.025) filter (b >= 0), 6) as risk_lo, round(quantile_cont(risk, 0.975) filter (b >= 0), 6) as risk_hi,
 round(quantile_cont(cov, 0.025) filter (b >= 0), 6) as coverage_lo, round(quantile_cont(cov, 0.975) filter (b >= 0), 6) as coverage_hi, (quantile_cont(risk, 0.975) filter (b >= 0)) < 0 and (quantile_cont(cov, 0.025) filter (b >= 0)) > -0.05 as success from df""")
def paired_bootstrap(spark, d):
    rows = V.candidates(spark, d)
    return rounded(resample.paired_bootstrap(rows, "B", "A", V.SHARES, 1000, hashed=True))


@query("with " + V.PREDICTIONS + """, l(t) as (select -4 + i * 0.05::double from range(161) x(i)), c as (select t, sum((greatest(z * exp(-t), 0) + ln(1 + exp(-abs(z * exp(-t)))) - y * z * exp(-t)) * mask) / sum(mask) as loss from predictions_v, l group by t),
 f(t) as (select (select min_by(t, loss) from c) - 0.05 + i * 0.001::double from range(101) x(i)), g as (select t, sum((greatest(z * exp(-t), 0) + ln(1 + exp(-abs(z * exp(-t)))) - y * z * exp(-t)) * mask) / sum(mask) as loss from predictions_v, f group by t)
 select round(min(loss), 5) as least_loss from g""")
def temperature_fit(spark, d):
    """The loss at the fitted temperature, which is that of the best of a fine grid."""
    rows = V.predictions(spark, d)
    best = calibrate.losses(rows, [1 / calibrate.fit_temperature(rows)])[0]
    return spark.createDataFrame([(round(best, 5),)], "least_loss double")


@query("with " + V.PREDICTIONS + " select distinct label, 0::double as slope, 0::double as bias from predictions_v")
def sigmoid_fit(spark, d):
    """The penalised mean loss is convex: at the fitted pair its gradient is zero to 4 places, but for what points out of
    the allowed ranges."""
    rows = V.predictions(spark, d).where("mask > 0")
    fit = F.broadcast(calibrate.fit_sigmoid(V.predictions(spark, d)))
    e = S.sigmoid(F.col("a") * F.col("z") + F.col("b")) - F.col("y")
    g = rows.join(fit, "label").groupBy("label", "a", "b").agg(F.avg(e * F.col("z")).alias("ga"), F.avg(e).alias("gb"))
    inside = lambda c, at, low, high: F.abs(F.round(F.when(at <= low, F.least(c, F.lit(0.0))).when(at >= high, F.greatest(c, F.lit(0.0))).otherwise(c), 4))
    a, b = F.col("a"), F.col("b")
    return g.select("label", inside(F.col("ga") + 0.01 * (a - 1), a, 0.01, 20.0).alias("slope"), inside(F.col("gb") + 0.01 * b, b, -20.0, 20.0).alias("bias"))


@query("select i::bigint as i, 0::double as gradient from range(5) t(i)")
def soft_logistic(spark, d):
    """As above, of the soft-label logistic regression: the gradient is zero in every weight, to 4 places."""
    rows = V.read(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)], F.when(F.col("label") < 3, 0.9).otherwise(0.1).alias("y"))
    m = calibrate.SoftLogistic(("x0", "x1", "x2", "x3")).fit(rows)
    e = m.score() - F.col("y")
    sums = rows.agg(*[F.avg(e * (x if i < 4 else F.lit(1.0))).alias(f"g{i}") for i, x in enumerate([*m._x()[:4], F.lit(1.0)])])
    parts = [F.struct(F.lit(i).cast("long").alias("i"), F.abs(F.round(F.col(f"g{i}") + (m.l2 * float(m.weights[i]) if i < 4 else 0.0), 4)).alias("gradient")) for i in range(5)]
    return sums.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


_SCORED = V.RECORDS + """, scored_v as (select *, (record_id * 31 % 101) / 101::double as joint_confidence, (record_id * 17 % 103) / 103::double as generic, (record_id * 13 % 107) / 107::double as pcsi, record_id % 3 <> 0 as gate, record_id % 7 <> 0 as informative from records_v),
 methods_v as (select record_id, group_id, domain, m.method, case m.method when 'M3' then generic when 'M7' then pcsi else joint_confidence end as score, informative and (m.method in ('M2', 'M3') or gate) as eligible from scored_v, (values ('M2'), ('M3'), ('M6'), ('M7')) m(method)),
 weighted_v as (select c.*, (case domain when 'F' then 0.5::double when 'O' then 0.3::double else 0.2::double end) / count(distinct group_id) over (partition by method, domain) / count(*) over (partition by method, domain, group_id) as weight from methods_v c)"""


@query("with " + _SCORED + """, steps as (select method, score as threshold, sum(sum(weight)) over (partition by method order by score desc) as c from weighted_v where eligible group by method, score union all select distinct method, 1.000001::double, 0::double from weighted_v),
 alls as (select method, sum(weight) as whole, sum(case when eligible then weight else 0 end) as most from weighted_v group by method), t as (select s.method, threshold, c / whole as coverage, most / whole as most, target, abs(c / whole - target) as e from steps s join alls using (method), (values (0.5::double), (0.8::double)) x(target)),
 near as (select *, min(e) over (partition by method, target) as m from t)
 select method, target, round(max(threshold), 6) as threshold, round(max_by(coverage, threshold), 6) as coverage, round(max(most), 6) as max_eligible_coverage from near where e - m <= 1e-8 + 1e-5 * m group by all""")
def policy_thresholds(spark, d):
    """Four methods, of which two answer only what the gate lets through: for each target the threshold of nearest coverage."""
    k = F.col("record_id")
    rows = V.records(spark, d).withColumns({"joint_confidence": (k * 31 % 101) / 101.0, "generic": (k * 17 % 103) / 103.0, "pcsi": (k * 13 % 107) / 107.0, "gate": k % 3 != 0, "informative": k % 7 != 0})
    return rounded(metrics.policy_thresholds(rows, (0.5, 0.8), V.SHARES).select("method", "target", "threshold", "coverage", "max_eligible_coverage"))


@query("""with m as (select o_custkey as p, case when o_custkey % 2 = 0 then 'a' else 'b' end as arm, avg(o_totalprice) as score from orders group by 1, 2), r as (select *, row_number() over (partition by arm order by p) - 1 as r, count(*) over (partition by arm) as n from m),
 sizes as (select distinct arm, n from r), draws as (select arm, n, i // n as b, ('0x' || substr(md5('0:' || arm || ':' || (i // n)::int || ':' || i % n), 1, 8))::bigint % n as r from (select arm, n, unnest(range(100 * n)) as i from sizes)),
 d as (select b, sum(case when draws.arm = 'b' then 1 else -1 end * score / draws.n) as d from draws join r using (arm, r) group by b)
 select round((select avg(score) from m where arm = 'b') - (select avg(score) from m where arm = 'a'), 4) as difference, round(quantile_cont(d, 0.025), 4) as lo, round(quantile_cont(d, 0.975), 4) as hi, 'b-a' as contrast from d""")
def two_arms(spark, d):
    """The difference of two arms' means with an interval from participants drawn within each arm."""
    means = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("participant_id"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("arm")).agg(F.avg("o_totalprice").alias("score"))
    out = resample.two_arms(means, "score", 100)
    return out.select(*[F.round(c, 4).alias(c) for c in ("difference", "lo", "hi")], "contrast")
