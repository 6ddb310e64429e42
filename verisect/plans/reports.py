"""Grading of whole answers, run reports, deltas, question building and audits."""

from __future__ import annotations

import re
import string

from pyspark.sql import functions as F

from verisect.operators import grading as D
from verisect.operators import questions as B
from verisect.operators import reports as R
from verisect.plans.base import Fixture, expect, query

TEXT = {
    "a1": "Summary judgment fails. Smith v. Jones, 12 So. 2d 345 (Fla. 1950) held \"the moving party must show that no fact is in dispute\". Pinpoint: 12 So. 2d 347.",
    "a2": "See Moon v. Sun, 999 F.3d 1 (2020). The court wrote \"these words were never written down by any court at all\".",
    "a3": "I cannot verify any authority for this.",
    "a4": "Roe v. Wade, 410 U.S. 113, 93 S. Ct. 705 (1973), review denied, 500 U.S. 1 (1974). It was overruled.",
}
GOLD = {"a1": (7, "Smith v. Jones, 12 So. 2d 345 (Fla. 1950)", "short"), "a2": (8, "Roe v. Wade, 410 U.S. 113", "x"), "a3": (8, "Roe v. Wade, 410 U.S. 113", "x"), "a4": (8, "Roe v. Wade, 410 U.S. 113", "x")}
CITES = [  # answer, ord, raw, volume, reporter, page, cluster, case, flag, party verdict
    ("a1", 1, "12 So. 2d 345", "12", "So. 2d", "345", 7, "Smith v. Jones", "green", "match"),
    ("a1", 2, "12 So. 2d 347", "12", "So. 2d", "347", None, None, None, None),
    ("a2", 1, "999 F.3d 1", "999", "F.3d", "1", None, None, None, None),
    ("a4", 1, "410 U.S. 113", "410", "U.S.", "113", 8, "Roe v. Wade", "red", "mismatch"),
    ("a4", 2, "93 S. Ct. 705", "93", "S. Ct.", "705", None, None, None, None),
    ("a4", 3, "500 U.S. 1", "500", "U.S.", "1", None, None, None, None),
]


def graded(spark):
    answers = spark.createDataFrame([(a, x, *GOLD[a]) for a, x in TEXT.items()], D.ANSWERS)
    cites = spark.createDataFrame([(a, o, raw, v, r, p, TEXT[a].index(raw), cid, None, case, flag, party, None, None, []) for a, o, raw, v, r, p, cid, case, flag, party in CITES], D.CITES)
    opinions = spark.createDataFrame([(7, "We hold the moving party must show that no fact is in dispute."), (8, "Nothing of the kind.")], "cluster_id long, text string")
    return answers, cites, opinions


@query(
    expect(
        "answer string, n_cites long, n_verified long, n_fabricated long, n_unindexed long, n_pin_reference long, n_name_mismatch long, n_quote_absent long, n_quote_unattributed long, n_red long, gold_hit long, abstained int, warned_treatment int",
        ("a1", 1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0),
        ("a2", 1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0),
        ("a3", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0),
        ("a4", 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1),
    )
)
def d1_grade_answers(spark, t):
    names = "answer n_cites n_verified n_fabricated n_unindexed n_pin_reference n_name_mismatch n_quote_absent n_quote_unattributed n_red gold_hit abstained warned_treatment"
    return D.grade_answers(*graded(spark)).select(*names.split())


@query(expect("answer string, ord int, status string", ("a1", 1, "resolved"), ("a1", 2, "pin_reference"), ("a2", 1, "fabricated"), ("a4", 1, "resolved"), ("a4", 2, "parallel"), ("a4", 3, "history")))
def d1_citation_stages(spark, t):
    answers, cites, _ = graded(spark)
    return D.classify(answers, cites).select("answer", "ord", "status")


@query(expect("answer string, kind string, columns string", ("a1", "changed", "n_red"), ("a2", "new", "n_red,n_cites"), ("a9", "missing", "n_red,n_cites")))
def d15_dry_run_differences(spark, t):
    old = spark.createDataFrame([("a1", 0, 1), ("a3", 0, 1), ("a9", 0, 1)], "answer string, n_red int, n_cites int")
    new = spark.createDataFrame([("a1", 1, 1), ("a2", 0, 1), ("a3", 0, 1)], "answer string, n_red int, n_cites int")
    return D.changed_grades(old, new, ["answer"])


RUNS = Fixture("runs", "run_id string, model string, arm string, config_json string", [("m:bare:v1", "m", "bare", "{}"), ("m:mcp:v1", "m", "mcp", '{"model_key": "m"}'), ("mock:bare:v1", "mock", "bare", None), ("n:bare:v1", "n", "bare", '{"dry_run": true}')])
ANSWERED = Fixture("answers", "run_id string, qid string, tool_calls_json string, cost_usd double, latency_s double, error string", [("m:bare:v1", "q0001", "[]", 0.5, 10.0, None), ("m:bare:v1", "q0002", "[]", None, 20.0, None), ("m:bare:v1", "q0003", None, 0.25, None, "timeout"), ("m:mcp:v1", "q0001", "[1, 2]", 1.0, 30.0, None), ("m:mcp:v1", "q0002", "[1]", 1.0, 10.0, None)])
GRADED = Fixture(
    "grades",
    "run_id string, qid string, n_cites long, n_verified long, n_fabricated long, n_unindexed long, n_name_mismatch long, n_quote_absent long, n_red long, gold_hit long, gold_equivalent long, abstained long, warned_treatment long, grader_version string",
    [("m:bare:v1", "q0001", 4, 3, 1, 0, 0, 1, 1, 1, 1, 0, 0, "g1"), ("m:bare:v1", "q0002", 0, 0, 0, 0, 0, 0, 0, 0, None, 1, 1, "g1"), ("m:mcp:v1", "q0001", 2, 2, 0, 0, 0, 0, 0, 1, 1, 0, 1, "g1"), ("m:mcp:v1", "q0002", 2, 1, 0, 1, 1, 0, 0, 1, 1, 0, None, "g2")],
)
QUESTIONS = Fixture("gold", "qid string, gold_flag string", [("q0001", "green"), ("q0002", "red")])
METRICS = """count(*) AS n, sum(n_cites) AS cites, sum(n_fabricated) / nullif(sum(n_cites), 0) AS fabricated_rate, (sum(n_name_mismatch) + sum(n_quote_absent)) / nullif(sum(n_cites), 0) AS misgrounded_rate,
    sum(n_red) / nullif(sum(n_verified), 0) AS red_rate, sum(gold_hit) / count(*) AS gold_recall, CASE WHEN count(gold_equivalent) = count(*) THEN sum(gold_equivalent) / count(*) END AS gold_equiv,
    sum(abstained) / count(*) AS abstain_rate, avg(CASE WHEN gold_flag IN ('yellow', 'red') THEN coalesce(warned_treatment, 0) END) AS warned_rate"""
CTES = ", ".join(f.cte() for f in (RUNS, ANSWERED, GRADED, QUESTIONS))


@query(
    f"""WITH {CTES}, f AS (SELECT run_id, count(*) AS answers, count(error) AS errors, sum(coalesce(cost_usd, 0)) AS cost, sum(coalesce(latency_s, 0)) / count(*) AS latency, sum(coalesce(json_array_length(tool_calls_json), 0)) / count(*) AS tools FROM answers GROUP BY 1),
    m AS (SELECT run_id, {METRICS}, string_agg(DISTINCT grader_version, ',' ORDER BY grader_version) AS grader_versions FROM grades LEFT JOIN gold USING (qid) GROUP BY 1)
    SELECT run_id, arm, answers, errors, cost, latency, tools, n, cites, fabricated_rate, misgrounded_rate, red_rate, gold_recall, gold_equiv, abstain_rate, warned_rate, grader_versions FROM runs JOIN f USING (run_id) JOIN m USING (run_id)"""
)
def d6_run_report(spark, t):
    out = R.run_report(RUNS.df(spark), ANSWERED.df(spark), GRADED.df(spark), QUESTIONS.df(spark))
    return out.drop("model_key", "tag", "fabricated_strict_rate", "n_bad")


@query(
    f"""WITH {CTES}, g AS (SELECT grades.*, arm, gold_flag FROM grades JOIN runs USING (run_id) LEFT JOIN gold USING (qid)), m AS (SELECT arm, {METRICS} FROM g GROUP BY arm)
    SELECT 'm' AS model_key, 'v1' AS tag, b.n AS common, x.fabricated_rate - b.fabricated_rate AS d_fabricated_rate, x.misgrounded_rate - b.misgrounded_rate AS d_misgrounded_rate, x.red_rate - b.red_rate AS d_red_rate,
    x.gold_recall - b.gold_recall AS d_gold_recall, x.abstain_rate - b.abstain_rate AS d_abstain_rate, x.warned_rate - b.warned_rate AS d_warned_rate FROM m b JOIN m x ON b.arm = 'bare' AND x.arm = 'mcp'"""
)
def d6_paired_deltas(spark, t):
    return R.paired_deltas(RUNS.df(spark), GRADED.df(spark), QUESTIONS.df(spark))


@query(expect("qid string, cut boolean", ("q0001", True), ("q0003", False)))
def d6_last_qid_is_a_text_bound(spark, t):
    rows = spark.createDataFrame([("q0001",), ("q0003",)], "qid string")
    return rows.select("qid", (F.col("qid") <= "q0002").alias("cut"))


PROPS = [
    ("A court may not weigh the evidence at the summary judgment stage.", None),
    ("Too short.", "length"),
    ("A court may not weigh the evidence at the summary judgment stage", "no_terminal_period"),
    ("A court may not weigh the evidence at the summary judgment stage...", "trailing_ellipsis"),
    ("(a court may not weigh the evidence at the summary judgment stage.", "fragment_start"),
    ("Well-settled law of the state is that no court may weigh it.", "fragment_start"),
    ("Provides a mechanism by which a party may be heard on the point.", "fragment_start"),
    ("A defendant shall be heard on the merits of the whole petition.", "enacted_text_quote"),
    ("It follows from precedent of long standing that no court may weigh.", "pronoun_start"),
    ("A party may move under this section once the time has run out.", "context_reference"),
    ("There is no more than a metaphysical doubt as to the material facts.", "condition_fragment"),
    ("A party may move for relief 12 days into the term of court.", "ocr_line_numbers"),
    ("A party may move for relief within 12 days of the term of court.", None),
    ("We hold that a court may not weigh the evidence at this early stage.", "fragment_start"),
    ("A court may not weigh what we call the evidence at an early stage.", "first_person"),
    ("Weighing of all the evidence by the court at the summary stage.", "fragment_start"),
    ("If the evidence is in dispute the court may not rule upon it.", "dangling_conditional"),
    ("The documents of which a court may take some notice at any stage.", "relative_clause_fragment"),
    ("A court may not weigh the\u0007 evidence at the summary judgment stage.", "junk_bytes"),
    ('A court may not "weigh the evidence at the summary judgment stage.', "unbalanced_quote"),
    ("A court may not 'weigh the evidence at the summary judgment stage.", "unbalanced_quote"),
    ("A court may not 'weigh' the evidence at the summary judgment stage.", None),
    ("A court may not weigh 12345 678901 evidence at stage 2345 of it.", "digit_heavy"),
    ("The evidence of record before the court at the summary judgment stage.", "no_finite_verb"),
]


@query(expect("p string, reason string", *PROPS))
def f5_proposition_filter(spark, t):
    return spark.createDataFrame([(p,) for p, _ in PROPS], "p string").select("p", B.reject_reason(F.col("p")).alias("reason"))


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(sql_text(w) for w in sorted(words)) + ")"


PATTERN = dict(B.PATTERNS) | {"junk_bytes": re.sub(r"\\u(\w{4})", lambda m: chr(int(m[1], 16)), dict(B.PATTERNS)["junk_bytes"]), "ocr_runs": "|".join([*(f"{re.escape(c)}{{4}}" for c in string.ascii_letters + string.digits), "_{3,}", "-{3,}"])}
# Sentences of all documents, and the rules in order.  DuckDB's patterns have neither look-around nor back-references, and
# their \\b knows ASCII letters only, so other Latin letters stand as z where words are looked for.
REASONS = f"""WITH s AS (SELECT regexp_replace(unnest(string_split_regex(text, '\\.\\s')) || '.', '^\\s+|\\s+$', '', 'g') AS t FROM documents),
    p AS (SELECT t, regexp_replace(lower(t), '[À-ÖØ-öø-ɏ]', 'z', 'g') AS low, string_split_regex(t, '\\s+') AS w, regexp_replace(lower(string_split_regex(t, '\\s+')[1]), '[^a-z]', '', 'g') AS first, regexp_replace(t, {sql_text("['" + '"' + "” ]+$")}, '') AS core FROM s),
    q AS (SELECT *, string_split_regex(low, {sql_text(B.VERB)})[1] AS before_verb, list_last(string_split(low, ',')) AS clause, regexp_matches(low, {sql_text(B.VERB)}) AS has_verb, first IN {sql_list(B.CONDITIONS)} AS conditional FROM p),
    r AS (SELECT CASE WHEN NOT len(w) BETWEEN {B.MIN_WORDS} AND {B.MAX_WORDS} THEN 'length' WHEN NOT ends_with(core, '.') THEN 'no_terminal_period' WHEN regexp_matches(core, '\\.\\s?\\.$') THEN 'trailing_ellipsis'
        WHEN regexp_matches(t, {sql_text("^[(" + chr(92) + "[.,;:" + chr(92) + "-'" + '"' + "0-9]")}) OR first IN {sql_list(B.BAD_STARTS | B.NOUNLESS_STARTS)} OR regexp_full_match(first, {sql_text(B.VERB)}) THEN 'fragment_start'
        WHEN regexp_matches(lower(t), {sql_text(B.VERB_OBJECT_START)}) AND first NOT IN ('there', 'this', 'thus') THEN 'fragment_start' WHEN regexp_matches(low, {sql_text(B.ENACTED)}) THEN 'enacted_text_quote'
        WHEN first = 'it' AND lower(w[2]) NOT IN ('is', 'has', 'was') THEN 'pronoun_start' WHEN regexp_matches(low, {sql_text(B.DEMONSTRATIVE)}) THEN 'context_reference'
        WHEN regexp_matches(low, {sql_text(B.CONDITION_FRAGMENT)}) THEN 'condition_fragment'
        WHEN len(list_filter(regexp_extract_all(low, {sql_text(B.LINE_NUMBER)}, 1), lambda x: x NOT IN {sql_list(B.QUANTITY_WORDS)})) > 0 THEN 'ocr_line_numbers'
        WHEN regexp_matches(first, '(ly|ed|ing)$') AND NOT ends_with(w[1], ',') AND first <> 'only' THEN 'fragment_start' WHEN conditional AND (NOT contains(t, ',') OR NOT regexp_matches(clause, {sql_text(B.VERB)})) THEN 'dangling_conditional'
        WHEN NOT has_verb THEN 'no_finite_verb' WHEN NOT conditional AND regexp_matches(before_verb, {sql_text(B.RELATIVE)}) THEN 'relative_clause_fragment'
        {" ".join(f"WHEN regexp_matches({'t' if name in ('stripped_symbol', 'junk_bytes', 'ocr_runs') else 'low'}, {sql_text(pattern)}) THEN '{name}'" for name, pattern in PATTERN.items())}
        WHEN len(regexp_extract_all(t, '"')) % 2 = 1 OR len(regexp_extract_all(t, {sql_text("(?:^|[" + chr(92) + "s(" + chr(92) + "[])'[0-9A-Za-z_]")})) > len(regexp_extract_all(t, {sql_text("[0-9A-Za-z_.,;:!?)" + chr(92) + "]]'(?:[" + chr(92) + "s.,;:)" + chr(92) + "]]|$)")})) THEN 'unbalanced_quote'
        WHEN len(regexp_extract_all(t, '[0-9]')) > 0.08 * length(t) THEN 'digit_heavy' WHEN len(regexp_extract_all(t, '[^\\x00-\\x7F]')) > 3 THEN 'non_ascii' END AS reason FROM q)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""


@query(REASONS)
def f5_reasons_of_sentences(spark, t):
    """How often each rule is the first to reject a sentence of the documents."""
    rows = t("documents").select(F.explode(F.split("text", r"\.\s")).alias("s")).select(F.concat("s", F.lit(".")).alias("s"))
    return rows.groupBy(F.coalesce(B.reject_reason(F.col("s")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


NAMES = [("Smith v. Jones", "1950-01-01", True), ("Smith", "1950-01-01", False), ("In re Estate of Lee", "1950-01-01", True), ("SMITH v. Jones", "1950-01-01", False), ("State v. One 1987 Car", "1974-01-01", False), (None, "1950-01-01", False)]


@query(expect("name string, date string, sane boolean", *NAMES))
def f7_caption_sanity(spark, t):
    return spark.createDataFrame([n[:2] for n in NAMES], "name string, date string").select("name", "date", B.name_sane(F.col("name"), F.col("date")).alias("sane"))


CITATIONS = [("fl", "12 So. 2d 345", 1950, True), ("fl", "12 S.W.2d 345", 1950, False), ("us:scotus", "410 U.S. 113", 1973, True), ("us:scotus", "587 U.S. 1", 2003, False), ("us:scotus", "3 F.3d 4", 2003, False), ("st:xx", "1 Any 2", 1900, True)]


@query(expect("stratum string, cite string, year int, sane boolean", *CITATIONS))
def f9_citation_sanity(spark, t):
    return spark.createDataFrame([c[:3] for c in CITATIONS], "stratum string, cite string, year int").select("*", B.cite_sane(F.col("stratum"), F.col("cite"), F.col("year")).alias("sane"))


@query(expect("qid string, cluster_id long, stratum string", ("q0001", 1, "fl")))
def d7_build_questions(spark, t):
    good = "A court may not weigh the evidence at the summary judgment stage."
    props = spark.createDataFrame([(1, 1, 1, good, 50, 9), (2, 1, 2, "The " + good, 40, 9), (3, 2, 1, "We " + good, 60, 9), (4, 3, 1, "The state must prove each element of the crime beyond a doubt.", 30, 5), (5, 4, 1, "An agency must give notice before it may act upon a rule.", 20, 5)], "rowid long, cluster_id long, rank int, proposition string, citation_count long, distinct_citers long")
    cases = spark.createDataFrame([(1, "fl", "Smith v. Jones", "1950-01-01", "12 So. 2d 345", "green"), (2, "fl", "Lee v. Ray", "1960-01-01", "90 So. 2d 1", "green"), (3, "us:scotus", "Roe v. Wade", "1973-01-22", "410 U.S. 113", "red"), (4, "fl", "Agency v. Doe", "1970-01-01", "99 S.W.2d 1", "green")], "cluster_id long, stratum string, case_name string, date_filed string, gold_citation string, gold_flag string")
    strata = spark.createDataFrame([("fl", 2), ("us:scotus", 1)], "stratum string, size long")
    return B.build_questions(props, cases, strata).select("qid", "cluster_id", "stratum")


@query(expect("source string, pool string, draws long", ("r1", "absent", 2), ("r2", "absent", 1), ("r1", "found", 3), ("r2", "found", 1)))
def d8_audit_packet(spark, t):
    quotes = spark.createDataFrame([("r1", "q1", k, f"quote {k % 3}") for k in range(6)] + [("r2", "q1", k, f"quote {k}") for k in range(3)], "run_id string, qid string, ord int, quote string")
    absent = spark.createDataFrame([("r1", "q1", "quote 0"), ("r1", "q1", "quote 0"), ("r2", "q1", "quote 1")], "run_id string, qid string, quote string")
    cites = spark.createDataFrame([("r1", 20), ("r2", 10)], "run_id string, n_cites long")
    packet = B.audit_packet(quotes, absent, cites, {"absent": 3, "found": 4})
    return packet.groupBy(F.col("run_id").alias("source"), "pool").agg(F.count(F.lit(1)).alias("draws"))


@query("SELECT lang, source, count(*) AS docs FROM documents GROUP BY lang, source")
def sk7_markdown_table(spark, t):
    counts = t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    lines = R.markdown_table(counts, ["lang", "source", "docs"]).splitlines()[2:]
    cells = [[x.strip() for x in line.strip("| ").split("|")] for line in lines]
    return spark.createDataFrame([(a, b, int(n)) for a, b, n in cells], "lang string, source string, docs long")
