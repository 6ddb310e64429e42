"""The rule grader, its self-check, class tables, replies and item building."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.operators import rules as R
from verisect.plans.base import Fixture, expect, query


def gold(**rules):
    """A task's rules with all fields, in the order of R.GOLD."""
    return tuple(rules.get(field.split(":")[0]) for field in R.GOLD.removeprefix("struct<").removesuffix(">").split(","))


TASKS = [
    ("t1", "coverage", "Smith v. Jones, 12 So. 2d 345 (Fla. 1950)", gold(right=["12 So. 2d 345"])),
    ("t2", "twin", "A v. B, 1 F.3d 2", gold(reject=True)),
    ("t3", "treatment", "C v. D, 3 F.3d 4", gold(any_of=["overruled"], verdict_line=True)),
    ("t4", "misprint", "E v. F, 5 F.3d 6 (3rd Cir. 1999)", gold(any_right=["3d Cir."], wrong=["3rd Cir."])),
    ("t5", "control", "G v. H, 7 F.3d 8", gold(right=["7 F.3d 8"], absent=["does not exist"], forbid_vendor=True)),
]
SCHEMA = f"id string, class string, text string, gold {R.GOLD}"
ANSWERS = [
    ("a1", "t1", "The cite is fine.\nANSWER: 12 So. 2d 345", True, "ok"),
    ("a2", "t1", "ANSWER: 12 So. 3d 345", False, "missing 12 so. 2d 345"),
    ("a3", "t2", "ANSWER: this case does not exist", True, "ok"),
    ("a4", "t2", "ANSWER: A v. B, 1 F.3d 2", False, "did not reject"),
    ("a5", "t3", "It was overruled.\nANSWER: good law", False, "missing overruled"),
    ("a6", "t3", "ANSWER: has not been overruled", False, "missing overruled"),
    ("a7", "t3", "ANSWER: overruled by X", True, "ok"),
    ("a8", "t4", "ANSWER: 3d Cir., not 3rd Cir.", True, "ok"),
    ("a9", "t4", "ANSWER: 3d Cir. or 3rd Cir.", False, "answer line has 3rd cir."),
    ("b1", "t5", "ANSWER: 7 F.3d 8, 1999 WL 1", False, "vendor cite on the answer line"),
    ("b2", "t5", "no answer from the tool", False, "no answer"),
    ("b3", "t5", "7 F.3d 8 does not exist", False, "answer line says does not exist"),
    ("b4", "t5", "7 F.3d 8 stands", True, "ok"),
]


def tasks(spark):
    return spark.createDataFrame(TASKS, SCHEMA)


@query(expect("aid string, passed boolean, reason string", *((a, p, r) for a, _, _, p, r in ANSWERS)))
def q23_rule_grader(spark, t):
    answers = spark.createDataFrame([a[:3] for a in ANSWERS], "aid string, id string, answer string")
    graded = answers.join(tasks(spark), "id").withColumn("g", R.grade_answer("answer", F.to_json("gold"), F.lit(None).cast("string")))
    return graded.select("aid", "g.passed", "g.reason")


@query(expect("passed boolean, reason string", (False, "missing 12 so. 2d 345")))
def q23_passage_echo(spark, t):
    rows = spark.createDataFrame([("[tool Smith v. Jones, 12 So. 2d 345 (Fla. 1950)]\nANSWER: unknown", TASKS[0][2])], "answer string, passage string")
    return rows.select(R.grade_answer("answer", F.lit('{"right": ["12 So. 2d 345"]}'), "passage").alias("g")).select("g.passed", "g.reason")


@query(expect("id string, variants long, failed long", ("t1", 1, 0), ("t2", 2, 0), ("t3", 3, 0), ("t4", 3, 0), ("t5", 3, 0)))
def q28_self_check(spark, t):
    checked = R.self_check(tasks(spark))
    return checked.groupBy("id").agg(F.count(F.lit(1)).alias("variants"), F.count_if(~F.col("ok")).alias("failed"))


@query(expect("row string, level int, n long, passed long, missed long", ("coverage", 0, 1, 1, 0), ("misprint", 0, 1, 0, 1), ("treatment", 0, 1, 1, 0), ("traps", 1, 3, 2, 1), ("control", 1, 1, 1, 0), ("total", 3, 4, 3, 1)))
def d12_score_answers(spark, t):
    answers = spark.createDataFrame([("t1", "ANSWER: 12 So. 2d 345"), ("t3", "ANSWER: overruled"), ("t4", "ANSWER: 3rd Cir."), ("t5", "ANSWER: 7 F.3d 8")], "id string, answer string")
    return R.score_table(R.grade_items(tasks(spark), answers))


QUOTAS = Fixture("quotas", "reporter string, size long", [("Brand#1", 4), ("Brand#2", 2), ("Brand#3", 3), ("Brand#4", 1), ("Brand#5", 2)])


@query(
    """WITH q AS (SELECT DISTINCT p_brand AS reporter, 3 AS size FROM part),
    j AS (SELECT p_partkey AS id, p_brand AS reporter, p_size // 10 AS decade, p_retailprice AS price, CASE WHEN p_retailprice < 905 THEN 'thin' WHEN p_size = 1 THEN 'echo' END AS dropped FROM part),
    a AS (SELECT *, row_number() OVER (PARTITION BY reporter, decade ORDER BY price, id) AS turn FROM j WHERE dropped IS NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY turn, decade) AS place FROM a)
    SELECT id, reporter, dropped, CASE WHEN (place - 1) % 2 = 0 THEN 'full' ELSE 'short' END AS shape, place <= 3 AS chosen FROM b
    UNION ALL SELECT id, reporter, dropped, NULL, false FROM j WHERE dropped IS NOT NULL"""
)
def d10_build_items(spark, t):
    pool = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("reporter"), F.floor(F.col("p_size") / 10).alias("decade"), F.col("p_retailprice").alias("price"), "p_size")
    quotas = t("part").select(F.col("p_brand").alias("reporter")).distinct().withColumn("size", F.lit(3))
    gates = [("thin", F.col("price") < 905), ("echo", F.col("p_size") == 1)]
    return R.build_items(pool, quotas, gates, ["full", "short"], F.col("price"), F.col("id")).select("id", "reporter", "dropped", "shape", "chosen")


@query(expect("id string, class string, text string, wrong string", ("t5", "control", "G v. H, 7 F.3d 8", None), ("t1", "coverage", "Smith v. Jones, 12 So. 2d 345 (Fla. 1950)", None), ("t4", "misprint", "new text", "bad form"), ("t3", "treatment", "C v. D, 3 F.3d 4", None)))
def d11_assemble_tasks(spark, t):
    all_tasks = tasks(spark)
    decisions = spark.createDataFrame([("t2", True, None, None, None), ("t4", False, "new text", ["bad form"], None), ("t5", None, None, None, True)], "id string, drop boolean, text string, wrong array<string>, clear_wrong boolean")
    out = R.assemble([all_tasks.where("class <> 'control'"), all_tasks.where("class = 'control'")], decisions)
    return out.select("id", "class", "text", F.array_join("gold.wrong", "|").alias("wrong"))


REPLY = 'Results:\n  1. 12 So. 2d 345 — Smith\n     Status: FOUND\n     Cluster ID: 77\n     WARNING: Input case name "Smyth" differs from verified "Smith"\n  2. 1 F.3d 2\n     Status: NOT FOUND\n  3. no status here\n'


@query(expect("n int, cite string, status string, warning boolean, input_name string, cluster_id long", (1, "12 So. 2d 345", "FOUND", True, "Smyth", 77), (2, "1 F.3d 2", "NOT FOUND", False, None, None)))
def q34_reply_blocks(spark, t):
    rows = spark.createDataFrame([(REPLY,)], "t string").select(F.explode(R.reply_blocks(F.col("t"))).alias("b"))
    return rows.select("b.n", "b.cite", "b.status", "b.warning", "b.input_name", "b.cluster_id")


BODIES = [
    (1, "get_treatment", '{"bluebook": "A v. B", "treatment": {"flag": "red"}, "overruled_by": {"case_name": "C v. D", "year": 1999}}', "ANSWER: A v. B — overruled by C v. D (1999)"),
    (2, "get_treatment", '{"treatment": {"flag": "green"}}', "ANSWER: good law, not overruled"),
    (3, "find_court", '{"courts": [{"bluebook": "Fla. 1st DCA"}]}', "ANSWER: Fla. 1st DCA"),
    (4, "check_citation", '{"bluebook": "A v. B, 1 F.3d 2", "verdict": "ok"}', "ANSWER: A v. B, 1 F.3d 2, correct as written"),
    (5, "check_citation", '{"verdict": "mismatch", "citation": "1 F.3d 2"}', "ANSWER: mismatch: 1 F.3d 2"),
    (6, "other", "{}", "ANSWER: no answer from the tool"),
    (7, "check_brief", '{"cites": [{"cluster_id": 1, "raw": "1 F.3d 2"}]}', "ANSWER: 1 F.3d 2, correct as written"),
]


@query(expect("id long, answer string", *((b[0], b[3]) for b in BODIES)))
def q35_render_answer(spark, t):
    return spark.createDataFrame([b[:3] for b in BODIES], "id long, tool string, body string").select("id", R.render_answer(F.col("tool"), F.col("body")).alias("answer"))


@query(expect("answer string, cite string, problem string", ("x", "1 F.3d 2", "unresolved"), ("x", "3 F.3d 4", "name mismatch"), ("x", "3 F.3d 4", "misquote"), ("y", "5 F.3d 6", "red flag")))
def q37_brief_findings(spark, t):
    rows = [("x", 1, "1 F.3d 2", None, None, None, None, None, None), ("x", 2, "3 F.3d 4", 7, "mismatch", "words", "misquote", "absent", "green"), ("x", 3, "3 F.3d 4", 7, "mismatch", "words", "misquote", "absent", "green"), ("y", 1, "5 F.3d 6", 8, "match", "fine", "ok", "ok", "red")]
    cites = spark.createDataFrame(rows, "answer string, ord int, raw string, cluster_id long, party_verdict string, quote string, quote_verdict string, quote_integrity string, flag string")
    return R.brief_findings(cites).select("answer", "cite", "problem")


@query(expect("names string", ("Smith v. Jones|Roe v. Wade",)))
def q38_listed_cases(spark, t):
    rows = spark.createDataFrame([("  1. Smith v. Jones, 12 So. 2d 345\n  2. Roe v. Wade (1973)\nno list\n - Smith v. Jones",)], "t string")
    return rows.select(F.array_join(R.listed_cases(F.col("t")), "|").alias("names"))


@query(expect("kind string, fired boolean", ("coverage", False), ("wrong_index", True), ("twin", True), ("caption", True), ("vendor", False), ("treatment", True), ("misprint", False), ("unknown", None)))
def f13_trap_fired(spark, t):
    kinds = ["coverage", "wrong_index", "twin", "caption", "vendor", "treatment", "misprint", "unknown"]
    return spark.createDataFrame([(k, REPLY) for k in kinds], "kind string, t string").select("kind", R.trap_fired(F.col("kind"), F.col("t"), F.lit("9 F.3d 9")).alias("fired"))
