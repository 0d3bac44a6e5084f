"""Queries that take the given tables out through a sink and back through a source, and of what files are for: images, locks, queues, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, entities, locks, training
from ..operators.ranges import checkpointed
from ..sources import images, readers, writers
from ..sources.storage import Storage, shared_folder
from ..streaming import queue
from . import views as V
from .queries import query, rounded


def in_folder(spark: SparkSession, work: Callable[[str], DataFrame]) -> DataFrame:
    """What work makes with a folder of its own below spark.checkpoint.dir; the folder goes when the result is settled."""
    folder = shared_folder(spark, "files")
    try:
        return checkpointed(work(folder))
    finally:
        Storage(spark, folder).delete()


@query("select doc_id::varchar as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents")
def table_of_text(spark, d):
    """Texts with quotes, separators and line ends, through a table of text and back: all strings, empty for null."""
    docs = V.read(spark, d, "documents").select("doc_id", "text", "lang", "source")

    def work(folder):
        writers.write_table(docs, f"{folder}/t")
        return readers.read_table(spark, f"{folder}/t")

    return in_folder(spark, work)


@query("select event_id, event_type, case when event_id % 10 > 1 then round(value, 6) end as value from events")
def lines_of_json(spark, d):
    """Undefined numbers are written as null, and read as such."""
    k = F.col("event_id") % 10
    rows = V.read(spark, d, "events").select("event_id", "event_type", F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value")).alias("value"))

    def work(folder):
        writers.write_json(rows, f"{folder}/t")
        return readers.read_jsonl(spark, f"{folder}/t", "event_id long, event_type string, value double")

    return rounded(in_folder(spark, work))


@query("select c_custkey, c_name, c_mktsegment, c_nationkey::bigint as c_nationkey from customer")
def documents_of_json(spark, d):
    """A file for each nation, one JSON document that spans lines."""
    rows = V.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    files = rows.groupBy(F.concat("c_nationkey", F.lit(".json")).alias("name")).agg(F.regexp_replace(F.to_json(F.collect_list(F.struct(*rows.columns))), r"\},", "},\n").alias("content"))

    def work(folder):
        writers.write_files(files, folder).agg(F.sum("bytes")).collect()
        return readers.read_json(spark, folder, "c_custkey long, c_name string, c_mktsegment string, c_nationkey long")

    return in_folder(spark, work)


@query("select vec_id, len(embedding) as n, round(list_sum([x::double for x in embedding]), 5) as total from embeddings")
def tables_of_arrays(spark, d):
    def work(folder):
        writers.write_arrays(V.read(spark, d, "embeddings"), f"{folder}/t")
        return readers.read_arrays(spark, f"{folder}/t")

    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return in_folder(spark, work).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("""with r as (select l_suppkey as s, l_orderkey::varchar as id, l_returnflag || '"' || chr(10) || ',;' || l_linestatus as note, row_number() over (partition by l_suppkey order by l_orderkey, l_returnflag, l_linestatus) - 1 as row_number from lineitem)
 select id, note, s || '_labeled_data.csv' as source_file, row_number from r""")
def labelled_files(spark, d):
    """A file for each supplier, with one of two separators, the columns in one of two orders, and line ends within quotes."""
    mark = F.when(F.col("l_suppkey") % 2 == 0, ",").otherwise(";")
    turned = F.col("l_suppkey") % 3 == 0
    pair = lambda a, b: F.when(turned, F.concat(b, mark, a)).otherwise(F.concat(a, mark, b))
    note = lambda r: F.concat(F.lit('"'), r["l_returnflag"], F.lit('""\n,;'), r["l_linestatus"], F.lit('"'))
    rows = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_returnflag", "l_linestatus")))
    files = V.read(spark, d, "lineitem").groupBy("l_suppkey").agg(rows.alias("r"))
    body = F.array_join(F.transform("r", lambda r: pair(r["l_orderkey"].cast("string"), note(r))), "\n")
    files = files.select(F.concat("l_suppkey", F.lit("_labeled_data.csv")).alias("name"), F.concat(pair(F.lit("id"), F.lit("note")), F.lit("\n"), body, F.lit("\n")).alias("content"))

    def work(folder):
        writers.write_files(files, folder).agg(F.sum("bytes")).collect()
        return readers.read_labelled(spark, folder, None, ["id", "note"])

    return in_folder(spark, work)


_DISHES = "select l_orderkey, 'ingr_' || lpad(l_partkey::varchar, 10, '0') as ingredient_id, 'part ' || l_partkey % 50 as ingredient_name, l_quantity::int::varchar as mass_g from lineitem"


def _dish_lines(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    part = F.concat_ws(",", F.concat(F.lit("ingr_"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")), F.concat(F.lit("part "), F.col("l_partkey") % 50), q, F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"))
    rows = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(part).alias("parts"), F.sum(q).alias("mass"))
    head = F.concat_ws(",", F.concat(F.lit("dish_"), "l_orderkey"), F.lit("10"), "mass", F.lit("1"), F.lit("2"), F.lit("3"))
    counted = F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws(",", head, F.size("parts"), F.concat_ws(",", "parts"))).otherwise(F.concat_ws(",", head, F.concat_ws(",", "parts")))
    return rows.select(counted.alias("value"))


@query(f"with r as ({_DISHES}) select 'dish_' || l_orderkey as record_id, count(*) as n, sum(mass_g::bigint)::bigint as mass, min(ingredient_id) as first from r group by l_orderkey")
def dish_files(spark, d):
    """Lines of dishes, written as text with and without the number of ingredients, and parsed again."""

    def work(folder):
        _dish_lines(spark, d).write.text(f"{folder}/t")
        dishes, parts = readers.parse_dishes(spark.read.text(f"{folder}/t"))
        sums = parts.groupBy("record_id").agg(F.count("*").alias("n"), F.sum(F.col("mass_g").cast("long")).alias("mass"), F.min("ingredient_id").alias("first"))
        return dishes.select("record_id", F.col("total_mass_g").cast("long").alias("_m")).join(sums, "record_id").where("_m = mass").drop("_m")

    return in_folder(spark, work)


@query(f"with r as ({_DISHES}) select ingredient_name, case when substr(ingredient_name, 6)::int % 3 <> 0 then 'target ' || substr(ingredient_name, 6) end as target, substr(ingredient_name, 6)::int % 3 <> 0 as mapped, count(*) as n from r group by all")
def mapped_ingredients(spark, d):
    """Ingredients by name against a crosswalk, some of whose names have no reviewed target."""
    k = F.col("p_partkey") % 50
    walk = V.read(spark, d, "part").select(F.concat(F.lit("part "), k).alias("ingredient_name"), F.when(k % 3 != 0, F.concat(F.lit("target "), k)).otherwise("").alias("target")).distinct()
    _, parts = readers.parse_dishes(_dish_lines(spark, d))
    return readers.map_ingredients(parts, walk).groupBy("ingredient_name", "target", "mapped").agg(F.count("*").alias("n"))


def _reduced(rows: str, line: str, place: str, to: int) -> str:
    """Lines of levels (vec_id, n, `line`, `place`, level), each reduced to `to` levels: bicubic, by integer weights of 2 ** 22."""
    return f"""select vec_id, r.{line}, k.i as {place}, greatest(least((sum(k.weight * level) + 2097152) // 4194304, 255), 0)::bigint as level
 from {rows} r join weights k on k.wanted = {to} and k.n = r.n and k.x = r.{place} group by vec_id, r.{line}, k.i"""


# Pictures are of 9, 12, 15 or 18 by 8, 13 or 18 pixels, the levels of a vector's components by lines, again from the first after the last.
_WEIGHTS = """sizes as (select 9 + 3 * unnest(range(4)) as n, 9 as wanted union all select 8 + 5 * unnest(range(3)), 8),
 places as (select n, wanted, i, (i + 0.5::double) * (n::double / wanted) as center, greatest(n::double / wanted, 1) as wide from (select n, wanted, unnest(range(wanted)) as i from sizes)),
 taps as (select n, wanted, i, x, abs((x - center + 0.5::double) / wide) as t from (select *, unnest(range(greatest(0, trunc(center - 2 * wide + 0.5::double))::bigint, least(n, trunc(center + 2 * wide + 0.5::double))::bigint)) as x from places)),
 kernel as (select n, wanted, i, x, case when t < 1 then (1.5 * t - 2.5) * t * t + 1 when t < 2 then ((-0.5 * t + 2.5) * t - 4) * t + 2 else 0 end as w from taps),
 weights as (select n, wanted, i, x, trunc(share * 4194304 + case when share < 0 then -0.5::double else 0.5::double end)::bigint as weight from (select *, w / sum(w) over (partition by n, wanted, i) as share from kernel))"""


@query(f"""with {_WEIGHTS}, v as (select vec_id, embedding, 9 + 3 * ((vec_id % 4 + 4) % 4) as width, 8 + 5 * ((vec_id % 3 + 3) % 3) as height from embeddings),
 pixels as (select vec_id, width as n, p // width as y, p % width as x, least(greatest(floor(128 + 400 * embedding[p % 64 + 1]::double), 0), 255)::bigint as level from (select *, unnest(range(width * height)) as p from v)),
 narrow as (select vec_id, height as n, y, x, level from ({_reduced("pixels", "y", "x", 9)}) join v using (vec_id)), small as ({_reduced("narrow", "x", "y", 8)}),
 bits as (select vec_id, x, y, (lead(level) over (partition by vec_id, y order by x) > level)::int as bit from small), b as (select vec_id, (8 * y + x) // 4 as place, sum(bit * (1 << (x % 4)::int))::int as digit from bits where x < 8 group by all)
 select 'v' || vec_id || '.png' as image_name, string_agg(printf('%x', digit), '' order by place desc) as dhash, any_value(width)::bigint as width, any_value(height)::bigint as height from b join v using (vec_id) group by vec_id""")
def image_hashes(spark, d):
    """A grey picture for each vector, of one of twelve sizes, written as PNG, decoded, reduced and hashed."""
    x = lambda i: F.get("embedding", i % 64).cast("double")
    level = lambda i: F.floor(F.least(F.greatest(128 + 400 * x(i), F.lit(0.0)), F.lit(255.0))).cast("int")
    width, height = 9 + 3 * F.pmod("vec_id", F.lit(4)), 8 + 5 * F.pmod("vec_id", F.lit(3))
    rows = V.read(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit(".png")).alias("name"), width.cast("int").alias("width"), F.transform(F.sequence(F.lit(0), (width * height - 1).cast("int")), level).alias("pixels"))

    def work(folder):
        images.write_images(rows, folder).agg(F.sum("bytes")).collect()
        return images.scan_images(spark, folder)[0].select("image_name", "dhash", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))

    return in_folder(spark, work)


@query("""select item_id % 7 || '/' || item_id || '.txt' as path, case when item_id % 3 = 0 then 'missing' when item_id % 3 = 1 then 'changed' else 'added' end as status from benchmark where item_id % 12 < 9""")
def locked_files(spark, d):
    """Files are locked with a root over their hashes; then some go, some change, some come, and some stay as they were."""
    rows = V.read(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("k"), (F.col("item_id") % 12 >= 9).alias("stays"), F.concat(F.col("item_id"), F.lit(".txt")).alias("name"), F.concat("item_id", F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))

    def work(folder):
        short = lambda hashes: hashes.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "sha256")
        writers.write_files(rows.where("stays or k < 2"), f"{folder}/a").agg(F.sum("bytes")).collect()
        writers.write_files(rows.where("stays or k > 0").withColumn("content", F.when(F.col("stays") | (F.col("k") == 2), F.col("content")).otherwise(F.concat("content", F.lit("!")))), f"{folder}/b").agg(F.sum("bytes")).collect()
        locks.make_lock(short(locks.file_hashes(spark, f"{folder}/a")), f"{folder}/lock", {"purpose": "query"})
        locks.verify_lock(spark, f"{folder}/lock", short(locks.file_hashes(spark, f"{folder}/a")), added=False)
        return locks.lock_changes(spark.read.parquet(f"{folder}/lock/files"), short(locks.file_hashes(spark, f"{folder}/b")))

    k = F.regexp_extract("path", r"^(\d+)", 1).cast("long")
    return in_folder(spark, work).select(F.concat(k % 7, F.lit("/"), "path").alias("path"), "status")


@query("""with a as (select row_number() over (order by doc_id) - 1 as place, sha256(doc_id || chr(10) || sha256(coalesce(text, ''))) as h from documents),
 b as (select place // 1024 as place, sha256(string_agg(h, '' order by place)) as h from a group by 1), c as (select place // 1024 as place, sha256(string_agg(h, '' order by place)) as h from b group by 1), e as (select place // 1024 as place, sha256(string_agg(h, '' order by place)) as h from c group by 1)
 select case when (select count(*) from b) = 1 then (select h from b) when (select count(*) from c) = 1 then (select h from c) else (select h from e) end as root, (select count(*) from a) as n""")
def root_of_documents(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\n", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)), 256).alias("h"))
    root, n = locks.merkle_root(docs, "doc_id", F.col("h"))
    return spark.createDataFrame([(root, n)], "root string, n long")


@query("select o_orderkey, o_custkey, o_orderkey % 3 = 0 as first from orders")
def appended_rows(spark, d):
    """A table that is there in part gets the rows it lacks, and again gets none."""
    work = V.read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3 == 0).alias("first"))

    def run(folder):
        work.where("first").write.parquet(f"{folder}/t")
        for _ in range(2):
            writers.append_missing(work, checkpointed(spark.read.parquet(f"{folder}/t")), ["o_orderkey"], f"{folder}/t")
        return spark.read.parquet(f"{folder}/t")

    return in_folder(spark, run)


@query("select event_id, user_id, (value * 2)::double as twice from events")
def drained_queue(spark, d):
    """Two loads of files, the second of which holds rows of the first again: each event is worked on once."""
    rows = V.read(spark, d, "events").select("event_id", "user_id", "value")

    def work(folder):
        for low, high in ((0, 2), (1, 3)):
            rows.where((F.col("event_id") % 3 >= low) & (F.col("event_id") % 3 < high)).write.mode("append").parquet(f"{folder}/in")
            queue.drain(spark, f"{folder}/in", "event_id long, user_id long, value double", lambda df: df.select("event_id", "user_id", (F.col("value") * 2).alias("twice")), f"{folder}/out", f"{folder}/mark", ["event_id"])
        return queue.finished(spark, f"{folder}/out").drop("batch")

    return in_folder(spark, work)


_GREEDY = """g as (select {key} as group_id, count(*) as n from {table} group by 1), o as materialized (select *, row_number() over (order by n desc, group_id) as i from g),
 walk(i, w, group_id, n, fold) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], null::bigint, null::bigint, null::bigint union all
   select o.i, [case when k = list_position(w, list_min(w)) then w[k] + o.n else w[k] end for k in range(1, 6)], o.group_id, o.n, list_position(w, list_min(w)) - 1 from walk join o on o.i = walk.i + 1),
 folds_v as materialized (select group_id, n, fold from walk where i > 0)"""


@query("with recursive " + _GREEDY.format(key="o_custkey", table="orders") + " select group_id, n, fold from folds_v")
def balanced_folds(spark, d):
    return rounded(entities.balanced_folds(V.records(spark, d), 5))


@query("with recursive " + _GREEDY.format(key="l_suppkey", table="lineitem") + """, r as (select fold, l_quantity as a, l_discount * 100 as b, l_extendedprice as y from lineitem join folds_v on group_id = l_suppkey),
 s as (select fold, count(*) as n, sum(a) as a, sum(b) as b, sum(y) as y, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_ from r group by fold),
 t as (select s.fold, sum(u.n) as n, sum(u.a) / sum(u.n) as ma, sum(u.b) / sum(u.n) as mb, sum(u.y) / sum(u.n) as my, sum(u.aa) / sum(u.n) as aa, sum(u.ab) / sum(u.n) as ab, sum(u.bb) / sum(u.n) as bb, sum(u.ay) / sum(u.n) as ay, sum(u.by_) / sum(u.n) as by_ from s join s u on u.fold <> s.fold group by s.fold),
 m as (select fold, ma, mb, my, 1 + 1 / n as p, sqrt(aa - ma * ma) as sa, sqrt(bb - mb * mb) as sb, ab - ma * mb as cab, ay - ma * my as cay, by_ - mb * my as cby from t),
 w as (select *, (cay / sa * p - cby / sb * cab / (sa * sb)) / (p * p - (cab / (sa * sb)) ** 2) / sa as wa, (cby / sb * p - cay / sa * cab / (sa * sb)) / (p * p - (cab / (sa * sb)) ** 2) / sb as wb, cay / sa / p / sa as one from m),
 e as (select abs(y - my - wa * (a - ma) - wb * (b - mb)) as e2, abs(y - my - one * (a - ma)) as e1 from r join w using (fold))
 select 'both' as model, round(avg(e2), 4) as mae, count(*) as n from e union all select 'quantity', round(avg(e1), 4), count(*) from e""")
def ridge_cv(spark, d):
    rows = V.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), F.col("l_extendedprice").alias("y"))
    return calibrate.ridge_cv(rows, {"both": ("a", "b"), "quantity": ("a",)}, "y").select("model", F.round("mae", 4).alias("mae"), "n")


@query()
def head_grid(spark, d):
    """Heads of ten labels over all components of the vectors, three learning rates at once, each stopped early."""
    rows = V.read(spark, d, "embeddings").select("vec_id", F.col("label").alias("_l"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])
    rows = rows.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumns({"y": F.when(F.col("_l") == F.col("label"), 0.95).otherwise(0.05), "mask": F.when((F.col("vec_id") + F.col("label")) % 5 != 0, 1).otherwise(0), "split": F.when(F.col("vec_id") % 4 == 0, "validation").otherwise("train")})
    heads = training.Heads([f"x{i}" for i in range(64)], (0.3, 0.1, 0.03), epochs=12, patience=2).fit(rows)
    return rounded(heads.runs(rows)).withColumn("chosen", F.col("rate") == heads.chosen())


@query("with recursive " + V.PREDICTIONS + """, p as materialized (select label, z, y from predictions_v where mask > 0),
 walk(it, label, a, b) as (select 0, label, 1::double, 0::double from (select distinct label from p) union all
   select it + 1, label, least(20, greatest(0.01::double, a - (ga * (bb + 0.01::double) - gb * ab) / ((aa + 0.01::double) * (bb + 0.01::double) - ab * ab))),
     least(20, greatest(-20, b - (gb * (aa + 0.01::double) - ga * ab) / ((aa + 0.01::double) * (bb + 0.01::double) - ab * ab)))
   from (select it, label, a, b, avg(e * z) + 0.01::double * (a - 1) as ga, avg(e) + 0.01::double * b as gb, avg(v * z * z) as aa, avg(v * z) as ab, avg(v) as bb
     from (select it, label, a, b, z, q - y as e, q * (1 - q) as v from (select walk.*, z, y, 1 / (1 + exp(-(a * z + b))) as q from walk join p using (label) where it < 30)) group by it, label, a, b))
 select label, round(a, 4) as a, round(b, 4) as b from walk where it = 30""")
def sigmoid_weights(spark, d):
    """The fitted pairs themselves; SQL takes the same 30 Newton steps."""
    return calibrate.fit_sigmoid(V.predictions(spark, d)).select("label", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("""with recursive r as (select embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as e, case when label < 3 then 0.9::double else 0.1::double end as y from embeddings),
 s as materialized (select (a - avg(a) over ()) / stddev_pop(a) over () as a, (b - avg(b) over ()) / stddev_pop(b) over () as b, (c - avg(c) over ()) / stddev_pop(c) over () as c, (e - avg(e) over ()) / stddev_pop(e) over () as e, y from r),
 walk(it, wa, wb, wc, we, w) as (select 0, 0::double, 0::double, 0::double, 0::double, 0::double union all
   select it + 1, wa - 2 * (avg(g * a) + 0.01::double * wa), wb - 2 * (avg(g * b) + 0.01::double * wb), wc - 2 * (avg(g * c) + 0.01::double * wc), we - 2 * (avg(g * e) + 0.01::double * we), w - 2 * avg(g)
   from (select walk.*, s.*, 1 / (1 + exp(-(wa * a + wb * b + wc * c + we * e + w))) - y as g from walk, s where it < 400) group by it, wa, wb, wc, we, w)
 select unnest(range(5)) as i, round(unnest([wa, wb, wc, we, w]), 4) as weight from walk where it = 400""")
def soft_weights(spark, d):
    """The fitted weights themselves; SQL comes to them by gradient steps."""
    rows = V.read(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)], F.when(F.col("label") < 3, 0.9).otherwise(0.1).alias("y"))
    weights = calibrate.SoftLogistic(("x0", "x1", "x2", "x3")).fit(rows).weights
    return spark.createDataFrame([(i, round(float(w), 4)) for i, w in enumerate(weights)], "i long, weight double")


def _gradient_steps(names: tuple[str, ...], steps: int = 500, rate: float = 1.5) -> str:
    """SQL that comes to the weights of a soft-label logistic regression over r (the names, y): columns i and weight."""
    w = [f"w{i}" for i in range(len(names) + 1)]
    z = " + ".join([*[f"w{i} * s{i}" for i in range(len(names))], w[-1]])
    stretched = ", ".join(f"(({n}) - avg({n}) over ()) / greatest(stddev_pop({n}) over (), 1e-6) as s{i}" for i, n in enumerate(names))
    moves = ", ".join([*[f"w{i} - {rate} * (avg(g * s{i}) + 0.01::double * w{i})" for i in range(len(names))], f"{w[-1]} - {rate} * avg(g)"])
    return f"""s as materialized (select {stretched}, y from r),
 walk(it, {", ".join(w)}) as (select 0, {", ".join(["0::double"] * len(w))} union all
   select it + 1, {moves} from (select walk.*, s.*, 1 / (1 + exp(-({z}))) - y as g from walk, s where it < {steps}) group by it, {", ".join(w)})
 select unnest(range({len(w)})) as i, round(unnest([{", ".join(w)}]), 3) as weight from walk where it = {steps}"""


_SELECTOR = """r as (select o_orderkey % 97 / 97::double as candidate_confidence, o_orderkey % 31 / 31::double as joint_marginal_gap, o_totalprice / 100000::double as entropy, (o_custkey % 3)::double as specificity,
 (case when o_orderkey % 97 > 40 then 0.8::double else 0.3::double end) as y from orders)"""


def _selector_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return V.read(spark, d, "orders").select(
        (k % 97 / F.lit(97.0)).alias("candidate_confidence"), (k % 31 / F.lit(31.0)).alias("joint_marginal_gap"), (F.col("o_totalprice") / 100000.0).alias("entropy"), (F.col("o_custkey") % 3).cast("double").alias("specificity"),
        F.when(k % 97 > 40, 0.8).otherwise(0.3).alias("y"), *[F.lit(0.0).alias(c) for c in calibrate.PROVENANCE[1:]], (k % 5).cast("double").alias("n_sources"),
    )


@query(f"with recursive {_SELECTOR}, " + _gradient_steps(("candidate_confidence", "joint_marginal_gap", "entropy", "specificity")))
def selector_weights(spark, d):
    """The weights of the selector over the generic features, with soft labels; SQL comes to them by gradient steps."""
    model = calibrate.train_selectors(_selector_rows(spark, d))["generic"]
    return spark.createDataFrame([(i, round(float(w), 3)) for i, w in enumerate(model.weights)], "i long, weight double")


@query("""with recursive p as materialized (select ln(q) - ln(1 - q) as z, y from (select least(greatest(o_orderkey % 97 / 97::double, 1e-7), 1 - 1e-7) as q, (o_orderkey * 7 % 5 < 3)::int::double as y from orders)),
 walk(it, a, b) as (select 0, 1::double, 0::double union all
   select it + 1, least(20, greatest(0.01::double, a - (ga * (bb + 0.01::double) - gb * ab) / ((aa + 0.01::double) * (bb + 0.01::double) - ab * ab))),
     least(20, greatest(-20, b - (gb * (aa + 0.01::double) - ga * ab) / ((aa + 0.01::double) * (bb + 0.01::double) - ab * ab)))
   from (select it, a, b, avg(e * z) + 0.01::double * (a - 1) as ga, avg(e) + 0.01::double * b as gb, avg(v * z * z) as aa, avg(v * z) as ab, avg(v) as bb
     from (select it, a, b, z, q - y as e, q * (1 - q) as v from (select walk.*, z, y, 1 / (1 + exp(-(a * z + b))) as q from walk, p where it < 30)) group by it, a, b))
 select unnest(['generic', 'pcsi', 'joint_confidence']) as score, round(a, 4) as a, round(b, 4) as b from walk where it = 30""")
def support_calibrators(spark, d):
    """Sigmoid calibrators of three scores, fitted on calibration rows only; here the three are the same score."""
    k = F.col("o_orderkey")
    rows = V.read(spark, d, "orders").select(F.lit("calibration").alias("split"), (k * 7 % 5 < 3).cast("int").alias("y"), *[(k % 97 / F.lit(97.0)).alias(c) for c in ("generic", "pcsi", "joint_confidence")])
    fits = calibrate.fit_support_calibrators(rows)
    return spark.createDataFrame([(c, round(f["sigmoid"]["a"], 4), round(f["sigmoid"]["b"], 4)) for c, f in fits.items()], "score string, a double, b double")


@query("""select case when o_orderkey % 4 = 0 then 'barcode_lookup' when o_orderkey % 4 = 1 then 'ingredient_panel' when o_orderkey % 4 = 2 then 'preparation_detail' else 'no_action' end as action_id, count(*) as n from orders group by 1""")
def gain_policy(spark, d):
    """Trees learn each action's gain from episodes in which it is 1 or -1 by the state alone, and the best action above 0 is taken."""
    features = [*calibrate.GENERIC, *calibrate.PROVENANCE]
    k = F.col("o_orderkey")
    states = V.read(spark, d, "orders").select(k, *[((k + i) % 7 / F.lit(7.0)).alias(c) for i, c in enumerate(features) if c != "n_sources"], (k % 4).cast("double").alias("n_sources"))
    gains = {"barcode_lookup": 0, "ingredient_panel": 1, "component_identity": 9, "preparation_detail": 2}
    rows = states.withColumn("action_id", F.explode(F.array(*[F.lit(a) for a in gains])))
    right = F.lit(False)
    for a, n in gains.items():
        right = right | ((F.col("action_id") == a) & (F.col("n_sources") == n))
    episodes = rows.withColumns({"split": F.lit("fit"), "supported_gain": F.when(right, 1.0).otherwise(0.0), "unsupported_gain": F.when(right, 0.0).otherwise(1.0), "cost_units": F.lit(0.0)})
    return calibrate.GainPolicy(rounds=3).fit(episodes).choose(states).groupBy("action_id").agg(F.count("*").alias("n"))
