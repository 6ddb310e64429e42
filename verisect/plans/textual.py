"""Text normalisers, token statistics and JSON over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import containment as K
from verisect.plans.base import expect, query

WORDS = "list_filter(string_split(regexp_replace(lower(replace(replace(text, '’', ''''), '‘', '''')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
MATCH_WORDS = f"list_filter({WORDS}, lambda x: NOT regexp_full_match(x, '[0-9]+'))"


@query(expect("id long, t string", (1, "Title"), (2, "quoted words here"), (3, "item *3 kept bold"), (4, "an emphasised word"), (5, "snake_case stays")))
def s1_strip_markdown(spark, t):
    rows = [(1, "## Title"), (2, "> quoted `words` here"), (3, "- item *3 kept **bold**"), (4, "an _emphasised_ word"), (5, "snake_case stays")]
    return spark.createDataFrame(rows, "id long, t string").select("id", T.strip_markdown(F.col("t")).alias("t"))


@query(f"SELECT doc_id, len({WORDS}) AS n, array_to_string(list_slice({WORDS}, 1, 5), ' ') AS head FROM documents")
def s2_norm_words(spark, t):
    w = T.norm_words(F.col("text"), brackets=False)
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))


@query(f"SELECT doc_id, len({MATCH_WORDS}) AS n FROM documents")
def s3_match_words(spark, t):
    return t("documents").select("doc_id", F.size(T.match_words(F.col("text"))).cast("long").alias("n"))


@query(expect("id long, plain string, stripped string", (1, " the rule see roe v wade u s is settled ", " the rule is settled "), (2, " first page ", " first page ")))
def s4_prepared_opinion(spark, t):
    rows = [(1, "The rule, see Roe v. Wade, 410 U.S. 113, 116 (1973) is settled."), (2, "First *277 page [12]")]
    return spark.createDataFrame(rows, "id long, t string").select("id", U.prepare("t").alias("p")).select("id", "p.*")


@query(expect("id long, t string", (1, 'dis "cretion"'), (2, "discretion"), (3, "a-b c")))
def s5_fold_print(spark, t):
    rows = [(1, "dis “cret\u200bion”"), (2, "dis-\ncretion"), (3, "a\u2011b c")]
    return spark.createDataFrame(rows, "id long, t string").select("id", T.fold_print(F.col("t")).alias("t"))


@query("SELECT doc_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '’', ''''), '‘', ''''), '`', ''''), '[–—]|--+', '-', 'g'), '[ \\t\\n\\r\\f\\v]*-[ \\t\\n\\r\\f\\v]*', '-', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS folded FROM documents")
def s6_fold_answer(spark, t):
    return t("documents").select("doc_id", T.fold_answer(F.col("text")).alias("folded"))


@query(expect("id long, t string", (1, "fi strasse-1"), (2, "3d cir.")))
def s6_fold_answer_compatibility_forms(spark, t):
    return spark.createDataFrame([(1, "ﬁ  Straße – １"), (2, " 3d Cir. ")], "id long, t string").select("id", U.fold_answer("t").alias("t"))


@query("SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations")
def s7_fold_span(spark, t):
    return t("conversations").select("conv_id", "turn", T.fold_span(F.col("text")).alias("t"))


@query(expect("name string, plain string, joined string", ("B.J.M. v. P.T., Inc.", "b,j,m,p,t", "bjm,pt"), ("The Smith's Co. & Sons", "smith,sons", "smith,sons")))
def s9_name_tokens(spark, t):
    from verisect.functions.cites import party_tokens

    rows = spark.createDataFrame([("B.J.M. v. P.T., Inc.",), ("The Smith's Co. & Sons",)], "name string")
    return rows.select("name", F.array_join(party_tokens(F.col("name")), ",").alias("plain"), F.array_join(party_tokens(F.col("name"), True), ",").alias("joined"))


@query(expect("id long, t string", (1, "The court in   held so."), (2, "No cite here."), (3, "As   at one point.")))
def s10_strip_citations(spark, t):
    rows = [(1, "The court in Smith v. Jones, 12 So. 2d 345 (Fla. 1950) held so."), (2, "No cite here."), (3, "As Id. at 12 at one point.")]
    return spark.createDataFrame(rows, "id long, t string").select("id", U.strip_cites("t").alias("t"))


@query(expect("id long, t string", (1, "“the *rule*” is"), (2, "elsewhere"), (3, "a—b")))
def s11_anchor_span(spark, t):
    rows = [(1, '"the rule" is', "so “the *rule*” is old"), (2, "elsewhere", "not in here"), (3, "a-b", "x a—b y")]
    return spark.createDataFrame(rows, "id long, span string, t string").select("id", U.anchor_span("span", "t").alias("t"))


@query(expect("id long, t string", (1, "the  “old”\nrule"), (2, "rule stands"), (3, "missing")))
def s12_locate(spark, t):
    rows = [(1, 'the "old" rule', "x the  “old”\nrule y"), (2, "[The] rule stands.", "a rule stands here"), (3, "missing", "nothing")]
    return spark.createDataFrame(rows, "id long, needle string, t string").select("id", U.locate("t", "needle").alias("t"))


@query(
    """WITH q AS (SELECT doc_id, text, substr(text, 1 + CAST(doc_id % 90 AS INT), 60) AS quote FROM documents WHERE length(text) >= 150)
    SELECT doc_id, strpos(text, quote) - 1 AS start, strpos(text, quote) - 1 + length(quote) AS stop, regexp_replace(trim(quote, E' \\n\\t'), '\\s+', ' ', 'g') AS flat FROM q WHERE strpos(text, quote) > 0"""
)
def s13_find_quote_in_documents(spark, t):
    """Sixty characters out of every longer document are found at their place."""
    quotes = t("documents").where("length(text) >= 150").withColumn("quote", F.substring("text", (F.col("doc_id") % 90 + 1).cast("int"), F.lit(60)))
    found = quotes.select("doc_id", "quote", U.find_quote("text", "quote").alias("at"))
    return found.select("doc_id", "at.start", F.col("at.end").alias("stop"), F.regexp_replace(F.regexp_replace("quote", r"^[ \n\t]+|[ \n\t]+$", ""), r"\s+", " ").alias("flat"))


@query(expect("id long, a int, b int", (1, 2, 9), (2, 0, 7), (3, None, None)))
def s13_find_quote(spark, t):
    rows = [(1, "one two", "x one two"), (2, "one two", "one\ntwo"), (3, "three", "one two")]
    return spark.createDataFrame(rows, "id long, q string, t string").select("id", U.find_quote("t", "q").alias("p")).select("id", F.col("p.start").alias("a"), F.col("p.end").alias("b"))


@query("SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, strpos(lower(text), list_last(regexp_extract_all(lower(text), '[a-z0-9]+'))) > 0 AS ok FROM benchmark WHERE length(text) = length(lower(text))")
def s14_tokens_with_places(spark, t):
    rows = t("benchmark").select("item_id", "text", U.tokens("text").alias("w"))
    last = F.element_at("w", -1)
    there = F.lower(F.substring(F.col("text"), last["start"] + 1, last["end"] - last["start"])) == last["word"]
    return rows.select("item_id", F.size("w").cast("long").alias("n"), there.alias("ok"))


@query("SELECT item_id, CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN trim(text) ELSE trim(text) || '.' END AS ended, upper(left(trim(text), 1)) || substr(trim(text), 2) AS shown FROM benchmark")
def s15_small_rewrites(spark, t):
    return t("benchmark").select("item_id", T.ends_sentence(F.col("text")).alias("ended"), T.capitalised(F.col("text")).alias("shown"))


@query(expect("id long, s string", (1, 'a "b" c d'), (2, "")))
def s16_json_snippet(spark, t):
    rows = [(1, '{"x": 1, "snippet": "a \\"b\\"\\n c   d", "y"'), (2, '{"x": 1}')]
    return spark.createDataFrame(rows, "id long, t string").select("id", T.json_snippet(F.col("t"), "snippet").alias("s"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def m1_safe_json_path(spark, t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def m2_json_array_length(spark, t):
    packed = t("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list("turn")).alias("j"))
    return packed.select("conv_id", F.json_array_length("j").cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")
def m3_json_key_injection(spark, t):
    body = F.from_json("props", "k string")
    joined = F.to_json(F.struct(body["k"].alias("k"), F.struct(F.col("event_type").alias("kind")).alias("_meta")))
    rows = t("events").select("event_id", joined.alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$._meta.kind").alias("kind"))


@query("SELECT l_returnflag, printf('%.1f%%', 100 * avg(l_discount)) AS pct, CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE printf('%+.1f pp', 100 * (avg(l_tax) - avg(l_discount))) END AS delta FROM lineitem GROUP BY 1")
def m4_percent_formats(spark, t):
    from verisect.operators.reports import percent, points

    rows = t("lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
    return rows.select("l_returnflag", percent(F.col("d")).alias("pct"), points(F.when(F.col("l_returnflag") != "N", F.col("d")), F.col("x")).alias("delta"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 THEN l_tax ELSE (l_quantity * 3 + l_suppkey * 15) / 1e6 END, 8) AS cost FROM lineitem")
def m5_cost_from_tokens(spark, t):
    from verisect.operators.reports import cost

    own = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(cost(own, F.col("l_quantity"), F.col("l_suppkey"), 3, 15), 8).alias("cost"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'good' WHEN p_retailprice < 1500 THEN 'fair' ELSE 'poor' END AS tint FROM part")
def m6_threshold_tint(spark, t):
    from verisect.operators.reports import tint

    return t("part").select("p_partkey", tint(F.col("p_retailprice"), (1000, "good"), (1500, "fair"), "poor").alias("tint"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'trap' ELSE 'control' END AS kind, CASE WHEN p_size < 10 THEN 'wrong:' || p_brand ELSE p_brand END AS gold FROM part")
def m7_item_constructors(spark, t):
    parts = t("part")
    traps = parts.where("p_size < 10").select("p_partkey", F.struct(F.lit("trap").alias("kind"), F.concat(F.lit("wrong:"), "p_brand").alias("gold")).alias("item"))
    controls = parts.where("p_size >= 10").select("p_partkey", F.struct(F.lit("control").alias("kind"), F.col("p_brand").alias("gold")).alias("item"))
    return traps.unionByName(controls).select("p_partkey", "item.*")


GRAMS12 = f"""d AS (SELECT doc_id, lang, source, {MATCH_WORDS} AS w FROM documents), b AS (SELECT item_id, {MATCH_WORDS} AS w FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
    bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12)),
    hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g))"""


@query(f"WITH {GRAMS12}, h AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) SELECT lang, source, count(*) AS docs, count(h.doc_id) AS hits, count(h.doc_id) / count(*) AS share FROM documents LEFT JOIN h USING (doc_id) GROUP BY lang, source")
def q13_gold_equivalent_by_source(spark, t):
    """The flagship: share of documents that hold a run of twelve words of a reference passage."""
    hits = K.shared_runs(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", 12).select("doc_id").distinct().withColumn("hit", F.lit(1))
    rows = t("documents").select("doc_id", "lang", "source").join(hits, "doc_id", "left")
    n = F.count(F.lit(1))
    return rows.groupBy("lang", "source").agg(n.alias("docs"), F.count("hit").alias("hits"), (F.count("hit") / n).alias("share"))


@query(f"WITH {GRAMS12} SELECT doc_id, item_id FROM hits")
def q13_shared_runs(spark, t):
    return K.shared_runs(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", 12)


@query(expect("id long, equivalent boolean", (1, True), (2, True), (3, False), (4, True), (5, False)))
def q13_gold_equivalent_rules(spark, t):
    long = "a court may not weigh the evidence when it rules upon a motion for summary judgment"
    rows = [
        (1, long, "we hold that a court may not weigh the evidence when it rules upon a motion in any case"),
        (2, "the commissioner must consider . . . the age and the ability to earn", "first the commissioner must consider that and then the age and the ability to earn too"),
        (3, "the commissioner must consider every fact . . . the age and the ability to earn", "first the commissioner must consider much"),
        (4, "justice delayed is justice denied", "since justice delayed is justice denied here"),
        (5, "too few words", "too few words"),
    ]
    df = spark.createDataFrame(rows, "id long, prop string, opinion string")
    return df.select("id", K.gold_equivalent(F.col("prop"), T.padded(T.match_words(F.col("opinion")))).alias("equivalent"))
