"""Views that let the driver's tables stand in for a study's, each in DataFrame form and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the order statuses, which stand in for domains.
SHARES = {"F": 0.5, "O": 0.3, "P": 0.2}
FIELDS = ("category", "subcategory", "cooking_style")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("domain"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """A row for each order, method A or B and seed 0 or 1."""
    rows = records(spark, d).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    r, m, s = F.col("record_id"), F.col("m"), F.col("seed")
    rows = rows.withColumns({
        "method": F.when(m == 0, "A").otherwise("B"), "score": ((r * 7919 + m * 131 + s * 17) % 1000) / 1000.0, "eligible": r % 3 != 0, "informative": r % 7 != 0,
        "support_status": F.when((r * 31 + m * r) % 5 == 0, "contradicted").when((r * 31 + m * r) % 5 == 1, "unverifiable").otherwise("supported"),
    })
    return rows.withColumn("accepted", F.col("eligible") & (F.col("score") >= 0.4)).drop("m")


RECORDS = "records_v as (select o_orderkey as record_id, o_custkey as group_id, o_orderstatus as domain from orders)"
CANDIDATES = RECORDS + """, candidates_v as (select *, eligible and score >= 0.4::double as accepted from (
  select record_id, group_id, domain, seed, case when m = 0 then 'A' else 'B' end as method, ((record_id * 7919 + m * 131 + seed * 17) % 1000) / 1000::double as score,
    record_id % 3 <> 0 as eligible, record_id % 7 <> 0 as informative,
    case when (record_id * 31 + m * record_id) % 5 = 0 then 'contradicted' when (record_id * 31 + m * record_id) % 5 = 1 then 'unverifiable' else 'supported' end as support_status
  from records_v, (values (0), (1)) a(m), (values (0), (1)) b(seed)))"""
WEIGHTS = CANDIDATES + """, weights_v as (select c.*, (case domain when 'F' then 0.5::double when 'O' then 0.3::double else 0.2::double end)
    / (select count(distinct group_id) from candidates_v g where g.domain = c.domain)
    / count(*) over (partition by method, seed, domain, group_id) as weight from candidates_v c)"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = read(spark, d, "lineitem").join(part, "l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") % 3).alias("reviewer_id"), F.concat_ws("_", F.col("l_partkey"), F.col("l_linenumber")).alias("item_id"),
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("subcategory"), F.when(F.col("l_discount") == 0, "").otherwise(F.col("p_type")).alias("cooking_style"),
    )


ANNOTATIONS = """annotations_v as (select l_orderkey as record_id, l_suppkey % 3 as reviewer_id, l_partkey || '_' || l_linenumber as item_id,
  l_returnflag as category, l_linestatus as subcategory, case when l_discount = 0 then '' else p_type end as cooking_style from lineitem join part on l_partkey = p_partkey),
labelled_v as (select record_id, reviewer_id, item_id, category <> '' and subcategory <> '' and cooking_style <> '' as complete,
  '{"category":"' || category || '","cooking_style":"' || cooking_style || '","subcategory":"' || subcategory || '"}' as label from annotations_v),
vocab_v as (select label, count(distinct record_id) as n_records, row_number() over (order by label) - 1 as label_id from labelled_v where complete and record_id % 2 = 0 group by label having count(distinct record_id) >= 2),
panel_v as (select record_id, reviewer_id, bool_and(complete) as ok from labelled_v group by all)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Long: the components of each vector as logits of as many labels."""
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("j", "x"))
    z = 4 * F.col("x").cast("double")
    return rows.select(
        F.col("vec_id").alias("record_id"), (F.col("vec_id") % 37).alias("group_id"), "j", F.concat(F.lit("l"), "j").alias("label"), z.alias("z"), (1 / (1 + F.exp(-z))).alias("p"),
        F.when(F.col("label") == F.col("j"), 1.0).otherwise(0.0).alias("y"), F.when((F.col("vec_id") + F.col("j")) % 5 != 0, 1).otherwise(0).alias("mask"),
    )


PREDICTIONS = """predictions_v as (select record_id, record_id % 37 as group_id, j, 'l' || j as label, 4 * x as z, 1 / (1 + exp(-4 * x)) as p,
  case when true_label = j then 1::double else 0::double end as y, case when (record_id + j) % 5 <> 0 then 1 else 0 end as mask
  from (select vec_id as record_id, label as true_label, unnest(range(len(embedding)))::int as j, unnest(embedding)::double as x from embeddings))"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.substring(F.md5(F.floor(F.col("doc_id") / 3).cast("string")), 1, 15), (F.col("doc_id") % 3).cast("string"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), h.alias("dhash"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """States of (user, day) with an array of sources from the day's events."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("rid", F.concat_ws("_", F.col("user_id"), F.date_format("day", "yyyyMMdd")))
    fact = F.when(F.from_json("props", "k int")["k"] % 2 == 0, "even").otherwise("odd")
    # Fixed value: which event type stands in for which source type.
    kind = F.when(F.col("event_type") == "purchase", "ingredient_panel").when(F.col("event_type") == "signup", "recipe_record").when(F.col("event_type") == "click", "manufacturer_record").otherwise("user_note")
    source = F.struct(
        F.col("event_id").cast("string").alias("source_id"), F.col("rid").alias("record_id"), F.lit("__record__").alias("item_id"), kind.alias("source_type"), F.create_map(F.lit("parity"), fact).alias("facts"),
        F.col("ts").cast("timestamp").alias("observed_at"), F.lit(True).alias("available_at_inference"), F.lit(False).alias("reference_only"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), "reviewed").otherwise("draft").alias("verification_status"), (F.col("value") > 200).alias("conflict"),
    )
    rows = e.groupBy("rid").agg(F.min("user_id").alias("user_id"), F.collect_list(source).alias("sources"))
    p = (F.col("user_id") * 37 % 100) / 100.0
    return rows.select(
        F.col("rid").alias("record_id"), (F.col("user_id") % 50).alias("group_id"), F.lit("main").alias("domain"), F.lit("test").alias("split"), F.lit("parity").alias("focal_field"),
        F.lit("__record__").alias("focal_item_id"), F.lit("record_presence").alias("visual_scope"), "sources", F.array(F.lit("even"), F.lit("odd"), F.lit("other")).alias("labels"),
        F.array(p, 1 - p, F.lit(0.05)).alias("probabilities"), F.lit(0.0).alias("predicted_joint_marginal_gap"),
    )


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("parity", "claim_parity", ["parity"], ["even", "odd"], ["predicted", "recorded"], True, 1)], "field string, claim_id string, fields array<string>, values array<string>, qualifiers array<string>, documentary_for_recorded boolean, specificity int")


SOURCES = """events_v as (select event_id, ts, user_id, user_id || '_' || strftime(ts, '%Y%m%d') as record_id, value > 200 as conflict, event_type in ('purchase', 'signup', 'click') as reviewed,
    case when cast(props->>'k' as int) % 2 = 0 then 'even' else 'odd' end as fact from events),
facts_v as (select record_id, min(user_id) as user_id, count(*) as n_sources, max(reviewed::int) as has_documentary, max(conflict::int) as any_conflict, count(distinct fact) as n_facts,
    count(distinct case when reviewed then fact end) as n_reviewed, count(distinct case when reviewed and not conflict then fact end) as n_quiet, min(case when reviewed and not conflict then fact end) as quiet_fact,
    min(case when reviewed then fact end) as reviewed_fact, min(ts) as first_ts, list_sort(list_distinct(list(case when reviewed and not conflict then fact end))) as quiet_facts from events_v group by record_id),
claims_v as (select *, case when (user_id * 37 % 100) / 100::double >= 1 - (user_id * 37 % 100) / 100::double and (user_id * 37 % 100) / 100::double >= 0.05::double then 'even' else 'odd' end as predicted,
    greatest((user_id * 37 % 100) / 100::double, 1 - (user_id * 37 % 100) / 100::double) as candidate_confidence from facts_v),
valued_v as (select *, case when n_quiet = 1 then quiet_fact else predicted end as value, case when n_quiet = 1 then 'recorded' else 'predicted' end as qualifier from claims_v),
gated_v as (select *, case when any_conflict = 1 or n_reviewed > 1 then 'critical_source_conflict' when qualifier = 'predicted' then 'qualified_prediction_only'
    when n_reviewed = 0 or reviewed_fact <> value then 'missing_reviewed_premise' else 'supported_by_available_premises' end as gate_reason from valued_v)"""
