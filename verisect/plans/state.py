"""Scans, sinks and streams: rows are written to the shared folder and read back."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from verisect.functions.udfs import arrow
from verisect.operators import metrics as M
from verisect.plans.base import expect, query
from verisect.sources import readers as R
from verisect.sources.tables import Table, scratch
from verisect.streaming import state as S


def written(spark, df, name, kind="json", **options):
    """Rows written to a folder of their own; its path."""
    path = scratch(spark, name)
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT doc_id, lang, n_chars FROM documents")
def sc1_json_lines(spark, t):
    path = written(spark, t("documents").select("doc_id", "lang", "n_chars"), "jsonl")
    return R.read_jsonl(spark, path, "doc_id long, lang string, n_chars long")


@query("SELECT p_partkey AS qid, 'first' AS src FROM part UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)")
def sc2_first_file_wins(spark, t):
    from verisect.operators.reports import latest_gold

    a = t("part").select(F.col("p_partkey").alias("qid"), F.lit("first").alias("src"))
    b = t("customer").select(F.col("c_custkey").alias("qid"), F.lit("second").alias("src"))
    return latest_gold([a, b])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sc3_scan_with_pushed_filter(spark, t):
    return t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation")
def sc4_read_only_dimension(spark, t):
    return t("nation").select("n_nationkey", "n_name")


@query(expect("n long", (0,)))
def sc6_missing_file(spark, t):
    return R.read_jsonl_optional(spark, scratch(spark, "nothing"), "id string").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def sc7_json_documents(spark, t):
    path = scratch(spark, "documents")
    rows = t("region").select(F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("value"))
    rows.repartition(3).write.option("lineSep", "\n\n").text(path)
    return R.read_jsonl(spark, path, "id int, name string")


@query("SELECT n_name AS name, n_regionkey AS code FROM nation WHERE n_regionkey IN (1, 3)")
def sc8_tab_separated(spark, t):
    path = written(spark, t("nation").select("n_name", "n_regionkey"), "tsv", "csv", sep="\t", header=True)
    return R.read_tsv(spark, path, "name string, code int", F.col("code").isin(1, 3))


@query("SELECT doc_id % 7 AS id, max(text) AS body FROM documents GROUP BY 1")
def sc9_last_file_of_an_id(spark, t):
    rows = t("documents").select((F.col("doc_id") % 7).alias("id"), F.col("text").alias("path"), F.col("text").alias("body"))
    return R.latest_files(rows).select("id", "body")


@query("SELECT conv_id AS id, turn FROM conversations WHERE turn % 2 = 0")
def sc10_reply_of_the_current_input(spark, t):
    rows = t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    inputs = rows.select("id", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("stale").alias("body"))
    found = R.matching_files(rows.select("id", F.col("text").alias("body")), inputs, rows.select("id", "text"))
    return found.join(rows.select("id", "conv_id", "turn").withColumnRenamed("id", "k"), F.col("id") == F.col("k")).select(F.col("conv_id").alias("id"), "turn")


@query("SELECT CAST(conv_id AS VARCHAR) AS id, arg_max(text, turn) AS answer FROM conversations GROUP BY conv_id")
def sc11_last_answer_wins(spark, t):
    path = scratch(spark, "answers")
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("answer"), "turn").orderBy("turn").coalesce(1)
    rows.select(F.to_json(F.struct("id", "answer")).alias("value")).write.text(path)
    return R.read_answers(spark, [path])


@query("SELECT printf('d-%04d', row_number() OVER (ORDER BY doc_id)) AS id, doc_id FROM documents")
def sc12_import_examples(spark, t):
    spans = F.array(F.struct(F.col("lang").alias("span"), F.lit("kind").alias("type")))
    rows = t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text", spans.alias("spans"), "doc_id")
    out = R.import_examples(rows, "d", F.col("doc_id"))
    return out.select("id", F.regexp_extract("filename", "^([0-9]+)", 1).cast("long").alias("doc_id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3")
def sc13_split_by_id_list(spark, t):
    ids = t("customer").where("c_nationkey = 3").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("value"))
    return R.select_split(t("customer").select(F.col("c_custkey").cast("string").alias("id")), ids).select(F.col("id").cast("long").alias("id"))


REPORT = "# report\n\n| a | b |\n|---|---|\n| 0 | x |\n\n| model | n | rate |\n|---|---:|---|\n| m1 | 3 | 12.5% |\n| m2 | 4 | n/a |\ntext\n"


@query(expect("model string, rate string", ("m1", "12.5%"), ("m2", "n/a")))
def sc14_markdown_table(spark, t):
    return R.markdown_rows(spark.createDataFrame([("r", REPORT)], "id string, body string"), ["model", "rate"]).select("model", "rate")


@query("SELECT count(DISTINCT o_custkey) - count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n FROM orders")
def sc19_calls_to_fetch(spark, t):
    calls = t("orders").select(R.cache_key(F.lit("get"), F.struct(F.col("o_custkey").alias("id"))).alias("key"), "o_custkey")
    cache = t("orders").where("o_orderstatus = 'F'").select(R.cache_key(F.lit("get"), F.struct(F.col("o_custkey").alias("id"))).alias("key"), F.lit("body").alias("body")).distinct()
    return R.to_fetch(calls, cache).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text FROM documents")
def sc20_compressed_text_cache(spark, t):
    deflate = arrow("binary")(lambda x: zlib.compress(x.encode()))
    stored = t("documents").select("doc_id", deflate("text").alias("z"))
    return stored.select("doc_id", R.inflate("z").alias("text"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
def sc21_paged_text(spark, t):
    return R.assemble_pages(t("conversations").select("conv_id", F.col("turn").alias("offset"), "text"), "conv_id")


ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double"


def orders(spark, t):
    """A table of all orders."""
    table = Table(spark, scratch(spark, "orders"), ORDERS, ["o_orderkey"])
    table.replace(t("orders"))
    return table


def incoming(t):
    """Changed rows of all finished orders, and new ones for all pending orders."""
    known = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = known.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X"))
    return changed.unionByName(known.where("o_orderstatus = 'P'").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N")}))


NEW = "SELECT -1 - o_orderkey AS o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'"


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders UNION ALL {NEW}")
def sk1_upsert(spark, t):
    table = orders(spark, t)
    table.upsert(incoming(t))
    return table.read()


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL {NEW}")
def sk2_insert_if_absent(spark, t):
    table = orders(spark, t)
    table.insert_absent(incoming(t))
    return table.read()


@query(f"SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM ({NEW})) GROUP BY 1")
def sk3_append(spark, t):
    table = orders(spark, t)
    table.append(incoming(t))
    return table.read().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(expect("id long, config string", (1, "a=1,b=3,c=4"), (2, "a=2")))
def sk4_patch_document(spark, t):
    table = Table(spark, scratch(spark, "configs"), "id long, config map<string,string>", ["id"])
    table.replace(spark.createDataFrame([(1, {"a": "1", "b": "2", "d": "5"}), (2, {"a": "2"})], "id long, config map<string,string>"))
    table.patch_map("config", spark.createDataFrame([(1, {"b": "3", "c": "4", "d": None})], "id long, config map<string,string>"))
    entries = F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table.read().select("id", F.array_join(entries, ",").alias("config"))


@query("SELECT doc_id, text FROM documents WHERE lang <> 'en'")
def sk5_json_writer_keeps_letters(spark, t):
    path = written(spark, t("documents").where("lang <> 'en'").select("doc_id", "text"), "letters")
    return R.read_jsonl(spark, path, "doc_id long, text string")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def sk6_atomic_rewrite(spark, t):
    table = Table(spark, scratch(spark, "cache"), "k int, v string", ["k"])
    table.replace(spark.createDataFrame([(0, "old")], "k int, v string"))
    table.replace(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    return table.read()


@query("SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS added FROM supplier")
def sk9_added_column_reads_as_null(spark, t):
    path = scratch(spark, "evolving")
    Table(spark, path, "s_suppkey long, s_name string", ["s_suppkey"]).replace(t("supplier"))
    return Table(spark, path, "s_suppkey long, s_name string, added double", ["s_suppkey"]).read()


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'missing' END AS kind FROM orders UNION ALL SELECT o_orderkey, 'new' FROM ({NEW})")
def sk10_dry_run(spark, t):
    from verisect.operators.grading import changed_grades

    return changed_grades(orders(spark, t).read(), incoming(t), ["o_orderkey"]).select("o_orderkey", "kind")


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS verdict, max(event_id) AS ts FROM events GROUP BY 1) SELECT user_id, verdict FROM l WHERE verdict <> 'purchase'")
def a25_streamed_verdicts(spark, t):
    log = t("events").select("user_id", F.when(F.col("event_type") == "purchase", "clear").otherwise(F.col("event_type")).alias("verdict"), F.col("event_id").alias("ts"))
    path = scratch(spark, "verdict-log")
    log.repartition(4).write.json(path)
    schema = "user_id long, verdict string, ts long"
    table = Table(spark, scratch(spark, "verdicts"), schema, ["user_id"])
    # Several small batches, so that later ones must not lose to earlier ones: the order decides, not the arrival.
    batches = S.read_log(spark, path, schema, files_per_batch=2)

    def newest(batch):
        return batch.unionByName(table.read())

    S.upsert_stream(batches, table, F.col("ts"), scratch(spark, "stream"), newest).awaitTermination()
    return S.current_verdicts(table).select("user_id", "verdict")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def j2_incremental_grades(spark, t):
    """A second run grades only what the first left out; together they have graded everything once."""
    table = Table(spark, scratch(spark, "grades"), "l_returnflag string, n long", ["l_returnflag"])
    rows = t("lineitem")
    for part in (rows.where("l_returnflag <> 'R'"), rows):
        left = part.join(table.read().select("l_returnflag"), "l_returnflag", "left_anti")
        table.append(left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))
    return table.read()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a13_counts_survive_a_round_trip(spark, t):
    path = written(spark, M.frequency_map(t("events").withColumn("one", F.lit(1)), ["one"], "event_type"), "map", "parquet")
    return spark.read.parquet(path).select(F.explode("counts").alias("event_type", "n"))
