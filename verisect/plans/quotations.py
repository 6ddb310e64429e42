"""Quotations, retractions, references and verdict text on literal rows and the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import refs as N
from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import quotations as Q
from verisect.plans.base import expect, query

ANSWER = (
    'The court held "the moving party must show that no fact is in dispute" in Smith v. Jones, 12 So. 2d 345 (Fla. 1950).\n\n'
    'I would add "some words of my own that quote nothing at all here".\n\n'
    'See Roe v. Wade, 410 U.S. 113 (1973) ("quoting the words of another court in this place").\n\n'
    'Under § 57.105 "drafted text says \'a reasonable fee shall be awarded to the prevailing party now\' under § 57.105".\n'
)


@query(expect("quote string, skipped string", ("the moving party must show that no fact is in dispute", None), ("some words of my own that quote nothing at all here", None), ("quoting the words of another court in this place", "signal"), ("drafted text says 'a reasonable fee shall be awarded to the prevailing party now' under § 57.105", "rule_text"), ("a reasonable fee shall be awarded to the prevailing party now", None)))
def q1_quote_spans(spark, t):
    rows = spark.createDataFrame([(ANSWER,)], "t string")
    return rows.select(F.explode(U.extract_quotes("t")).alias("q")).select("q.quote", "q.skipped")


@query("SELECT page_id, (len(string_split(html, '\"')) - 1) // 2 AS pairs FROM pages")
def q1_paired_marks(spark, t):
    marks = F.size(F.regexp_extract_all("html", F.lit('"'), F.lit(0)))
    return t("pages").select("page_id", F.floor(marks / 2).cast("long").alias("pairs"))


SKIPS = [
    (1, "The court held that ", "see the rule that governs this kind of case today", "", "signal"),
    (2, "It reads ", "under 42 U.S.C. the claim must be filed in time", "", "rule_text"),
    (3, "The court held ", "Motion For Summary Judgment Granted Against Plaintiff Company", "", "heading"),
    (4, "The rule is close to ", "a party may not rely upon the bare pleadings alone", "", "hedged"),
    (5, "I suggest ", "that you check all of these before you file them", "", "unattributed_talk"),
    (6, "The court held ", "a party may not rely upon the bare pleadings alone", "", None),
]


@query(expect("id long, reason string", *((s[0], s[4]) for s in SKIPS)))
def q2_skip_reasons(spark, t):
    rows = spark.createDataFrame([(s[0], f'{s[1]}"{s[2]}"{s[3]}') for s in SKIPS], "id long, t string")
    return rows.select("id", F.explode(U.extract_quotes("t")).alias("q")).select("id", F.col("q.skipped").alias("reason"))


@query(expect("id long, reason string", (1, "history"), (2, "docket_parenthetical"), (3, None)))
def q3_non_quotations(spark, t):
    rows = [
        (1, 'The court noted "affirmed in part by the supreme court of the state" there.'),
        (2, 'As held in Lee v. Ray, No. 21-cv-123 (the court said "a party may not rely upon the bare pleadings alone").'),
        (3, 'As held in Lee v. Ray, 1 F.3d 2 (the court said "a party may not rely upon the bare pleadings alone").'),
    ]
    return spark.createDataFrame(rows, "id long, t string").select("id", F.explode(U.extract_quotes("t")).alias("q")).select("id", F.col("q.skipped").alias("reason"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[.]\\s*[.]\\s*[.]|…'), lambda x: len(regexp_extract_all(lower(x), '[a-z0-9]*[a-z][a-z0-9]*')) >= 4)) AS n FROM documents")
def q4_segments(spark, t):
    return t("documents").select("doc_id", F.size(T.segments(F.col("text"))).cast("long").alias("n"))


HAY = "the moving party must show that there is no genuine dispute as to any material fact"
SEGMENTS = [(1, "moving party must show", "verbatim"), (2, "moving party must show that there is no real thing", "near"), (5, "party must show that there is no real dispute", None), (3, "nobody must show anything at all", None), (4, "must show that", "verbatim")]


@query(expect("id long, kind string", *((a, c) for a, _, c in SEGMENTS)))
def q5_segment_match(spark, t):
    rows = spark.createDataFrame([(a, b, HAY) for a, b, _ in SEGMENTS], "id long, s string, hay string")
    return rows.select("id", T.segment_match(T.match_words(F.col("s")), T.padded(T.match_words(F.col("hay")))).alias("kind"))


OPINIONS = [
    (7, "We hold that the moving party must show, see Roe v. Wade, 410 U.S. 113 (1973), that there is no genuine dispute as to any material fact in the case at hand."),
    (8, "A court may freely give leave to amend the complaint when justice so requires and no party is harmed by the delay."),
]
QUOTED = [
    ("a", 1, "there is no genuine dispute as to any material fact"),
    ("a", 2, "the moving party must show that there is no genuine dispute"),
    ("a", 3, "[a] court may freely give leave . . . when justice so requires"),
    ("a", 4, "court may give leave freely to amend any complaint when justice requires it and no one is harmed by delay"),
    ("a", 5, "entirely invented words that no court of law has ever written down"),
    ("b", 1, "there is no genuine dispute as to any material fact"),
]


def quoted(spark):
    return spark.createDataFrame(QUOTED, "answer string, ord int, quote string")


def cited(spark):
    return spark.createDataFrame([("a", 7), ("a", 8), ("b", 8)], "answer string, cluster_id long")


def opinions(spark):
    return spark.createDataFrame(OPINIONS, "cluster_id long, text string")


@query(expect("answer string, ord int, verdict string, kind string, cluster_id long", ("a", 1, "found", "verbatim", 7), ("a", 2, "found", "verbatim", 7), ("a", 3, "found", "verbatim", 8), ("a", 4, "absent", "paraphrase_in_quotes", 8), ("a", 5, "absent", "fabricated", None), ("b", 1, "absent", "fabricated", None)))
def q6_match_over_cited_opinions(spark, t):
    return Q.match_quotes(quoted(spark), cited(spark), opinions(spark), ["answer", "ord"]).select("answer", "ord", "verdict", "kind", "cluster_id")


@query(expect("id long, ratio double", (1, 1.0), (2, 0.0), (3, 0.8)))
def q7_paraphrase_ratio(spark, t):
    rows = [(1, "no genuine dispute as to fact", "there is no genuine dispute as to fact here"), (2, "nothing alike", "there is no genuine dispute"), (3, "one two three four five", "one two three six five")]
    return spark.createDataFrame(rows, "id long, q string, t string").select("id", U.paraphrase_ratio("q", "t").alias("ratio"))


@query(expect("id long, v string", (1, "[t]he [old] rule"), (1, "[t]he   rule"), (1, " he   rule"), (2, "plain")))
def q8_bracket_variants(spark, t):
    rows = spark.createDataFrame([(1, "[t]he [old] rule"), (2, "plain")], "id long, q string")
    return rows.select("id", F.explode(T.bracket_variants(F.col("q"))).alias("v"))


ORDERED = [(1, "the first part of this rule . . . the second part of this rule", "verbatim"), (2, "the second part of this rule . . . the first part of this rule", None), (3, "the first part of this rule, Roe v. Wade, 410 U.S. 113, the second part of this rule", "verbatim"), (4, "three words only", None)]


@query(expect("id long, kind string", *((a, c) for a, _, c in ORDERED)))
def q10_ordered_parts(spark, t):
    rows = [(a, b, "Here the first part of this rule stands, and then the second part of this rule follows.") for a, b, _ in ORDERED]
    return spark.createDataFrame(rows, "id long, q string, t string").select("id", U.match_ordered("q", "t").alias("kind"))


@query(
    """WITH q AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS s, l_partkey + 5 AS e FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS s, l_partkey + 3 AS e FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity > 40),
    a AS (SELECT q.id, q.s, min(c.s) AS near FROM q JOIN c ON c.id = q.id AND c.s >= q.e AND c.s < least(q.e + 250, 1500) GROUP BY 1, 2), b AS (SELECT q.id, q.s, max(c.s) AS near FROM q JOIN c ON c.id = q.id AND c.e <= q.s AND c.e >= greatest(q.s - 120, 100) GROUP BY 1, 2)
    SELECT q.id, q.s AS start, coalesce(a.near, b.near) AS cite FROM q LEFT JOIN a USING (id, s) LEFT JOIN b USING (id, s)"""
)
def j15_nearest_citation_by_order(spark, t):
    """Lines of an order as spans along one axis: each open line with the first other line after it, else the last before it."""
    place = F.col("l_partkey")
    quotes = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"), place.alias("start"), (place + 5).alias("end"), F.lit(100).alias("para_start"), F.lit(1_500).alias("para_end")).distinct()
    cites = t("lineitem").where("l_returnflag <> 'N' OR l_quantity > 40").select(F.col("l_orderkey").alias("id"), place.alias("start"), (place + 3).alias("end"), place.alias("raw")).distinct()
    return Q.attached_cites(quotes, cites, ["id"]).select("id", "start", F.col("raw").alias("cite"))


SPANS = [("a", 0, 40, None), ("b", 100, 140, None)]


@query(expect("id long, raw string", (1, "after"), (2, "before"), (3, None), (4, "first after")))
def j15_nearest_citation(spark, t):
    text = "x" * 2_000
    quotes = spark.createDataFrame([(1, 500, 560, 0, 2_000), (2, 900, 950, 0, 2_000), (3, 1_500, 1_550, 1_400, 2_000), (4, 100, 150, 0, 2_000)], "id long, start int, end int, para_start int, para_end int")
    spans = [(1, 600, 620, "after"), (1, 700, 720, "later"), (2, 800, 880, "before"), (2, 1_300, 1_320, "too far"), (3, 1_300, 1_390, "other paragraph"), (4, 160, 170, "first after"), (4, 40, 60, "before")]
    cites = spark.createDataFrame(spans, "id long, start int, end int, raw string")
    del text
    return Q.attached_cites(quotes, cites, ["id"]).select("id", "raw")


WARNINGS = [(1, "Smith was overruled in 1990.", 1), (2, "Smith has not been overruled.", 0), (3, "It is not old, but it was superseded by rule.", 1), (4, "A fine case.", 0), (5, None, 0)]


@query(expect("id long, warned int", *((a, c) for a, _, c in WARNINGS)))
def q14_warned(spark, t):
    return spark.createDataFrame([w[:2] for w in WARNINGS], "id long, t string").select("id", U.warned("t").alias("warned"))


@query("SELECT conv_id, turn, CAST(regexp_matches(text, '(?i)not (?:certain|sure|confident)|cannot (?:verify|confirm|find)|unable to (?:verify|find)|don''t know|uncertain') AS INT) AS abstained FROM conversations")
def q15_abstained(spark, t):
    return t("conversations").select("conv_id", "turn", T.abstains(F.col("text"), F.lit(0)).alias("abstained"))


RETRACTED = [
    (1, "I initially cited a wrong page (81 N.Y.2d 612); the correct one is 81 N.Y.2d 66.", "81 N.Y.2d 612", "corrected"),
    (2, "I initially cited a wrong page (81 N.Y.2d 612); the correct one is 81 N.Y.2d 66.", "81 N.Y.2d 66.", None),
    (3, "The citation, 317 So. 3d 72, did not verify, so leave it out.", "317 So. 3d 72", "did not verify"),
    (4, "I could not verify Smith v. Jones, 1 So. 3d 1, at all.", "1 So. 3d 1", "could not verify"),
    (5, "317 So. 3d 72 holds this; I could not confirm the pin page.", "317 So. 3d 72", None),
    (6, 'Lee, 317 So. 3d 72, says "the county did not verify the claim".', "317 So. 3d 72", None),
]


@query(expect("id long, phrase string", *((r[0], r[3]) for r in RETRACTED)))
def q16_q17_retractions(spark, t):
    rows = spark.createDataFrame([(i, x, x.index(c), x.index(c) + len(c)) for i, x, c, _ in RETRACTED], "id long, t string, a int, b int")
    return rows.select("id", U.retracted("t", "a", "b").alias("phrase"))


@query(expect("id long, starts string", (1, "0,11"), (2, "0"), (3, "0,10,15")))
def q18_sentence_starts(spark, t):
    rows = [(1, "One rules. Two follows."), (2, "Smith v. Jones and Acme Co. Ltd. agree."), (3, "It holds.\nYes! No")]
    return spark.createDataFrame(rows, "id long, t string").select("id", F.array_join(F.transform(U.sentences("t"), lambda x: x.cast("string")), ",").alias("starts"))


REFERENCES = "Smith v. Jones, 12 So. 2d 345 (Fla. 1950). Id. at 347. " + "The rule has many parts that need not be told here. " * 3 + "Roe v. Wade, 410 U.S. 113. Smith, supra, at 346. 410 U.S. at 116. Fed. R. Civ. P. 56."


@query(expect("kind string, text string, target string", ("name", "Smith", "12 So. 2d 345"), ("name", "Wade", "410 U.S. 113"), ("name", "Smith", "12 So. 2d 345"), ("full", "12 So. 2d 345", "12 So. 2d 345"), ("id", "Id. at 347", "12 So. 2d 345"), ("full", "410 U.S. 113", "410 U.S. 113"), ("supra", "Smith, supra, at 346", "12 So. 2d 345"), ("short", "410 U.S. at 116", "410 U.S. 113"), ("noncase", "Fed. R.", None)))
def q19_references(spark, t):
    rows = spark.createDataFrame([(REFERENCES,)], "t string").select("t", F.explode(N.citation_refs("t")).alias("r"))
    target = F.when(F.col("r.target") < 40, "12 So. 2d 345").when(F.col("r.target") >= 40, "410 U.S. 113")
    return rows.select("r.kind", "r.text", target.alias("target"))


ATTRIBUTED = [
    (1, 'Nousari v. Nousari, 94 So. 3d 704, 707 (Fla. 4th DCA 2012) ("The purpose is to inform the court").', "The purpose is to inform the court", "parenthetical", "94 So. 3d 704"),
    (2, 'The court said "the purpose is to inform." Smith v. Jones, 12 So. 2d 345.', "the purpose is to inform.", "right_after", "12 So. 2d 345"),
    (3, 'In Smith v. Jones, 12 So. 2d 345, the court wrote at length that "the purpose is to inform the court"; nothing follows.', "the purpose is to inform the court", "closest_before", "12 So. 2d 345"),
    (4, "no quotation", "absent words", None, None),
]


@query(expect("id long, rule string, ref string", *((a[0], a[3], a[4]) for a in ATTRIBUTED)))
def q20_attribution(spark, t):
    rows = spark.createDataFrame([a[:3] for a in ATTRIBUTED], "id long, t string, q string")
    return rows.select("id", N.attribute_quote("t", "q").alias("a")).select("id", "a.rule", "a.ref")


@query(expect("id long, run int, passage string", (1, 4, "a b the old rule holds here now"), (2, 0, None)))
def q22_passage_around_best_run(spark, t):
    rows = [(1, "this is the old rule holds", "a b the old rule holds here now"), (2, "nothing", "a b c")]
    return spark.createDataFrame(rows, "id long, q string, t string").select("id", U.passage("q", "t").alias("p")).select("id", "p.run", "p.passage")


@query(expect("id long, line string, found boolean", (1, "12 So. 2d 345", True), (2, "last line", False), (3, "", False), (4, "second", True), (5, "ANSWER:", True)))
def q24_answer_line(spark, t):
    rows = [(1, "Why.\n**ANSWER: 12 So. 2d 345"), (2, "one\nlast line\n\n"), (3, None), (4, "answer: first\nAnswer : second\nmore"), (5, "x\nANSWER:")]
    return spark.createDataFrame(rows, "id long, t string").select("id", T.answer_line(F.col("t")).alias("a")).select("id", "a.*")


HITS = [("it is overruled", "overruled", True), ("it has not been overruled", "overruled", False), ("not old; overruled", "overruled", True), ("never overruled. it was overruled", "overruled", True), ("", "overruled", False)]


@query(expect("t string, phrase string, hit boolean", *HITS))
def q25_positive_hit(spark, t):
    return spark.createDataFrame([h[:2] for h in HITS], "t string, phrase string").select("t", "phrase", U.has_positive_hit("t", "phrase").alias("hit"))


DISOWNED = [("3d cir., not 3rd cir.", "3rd cir.", True), ("3rd cir.", "3rd cir.", False), ("the year written (1969) is not the decision year", "1969", True), ("1969, not 1969", "1969", False), ("none", "1969", False)]


@query(expect("t string, phrase string, disowned boolean", *DISOWNED))
def q26_all_disowned(spark, t):
    return spark.createDataFrame([d[:2] for d in DISOWNED], "t string, phrase string").select("t", "phrase", U.is_all_disowned("t", "phrase").alias("disowned"))


@query("SELECT page_id, regexp_matches(lower(url), '\\bwl\\b') OR contains(lower(url), 'lexis') OR contains(lower(url), 'westlaw') AS vendor FROM pages")
def q27_vendor_cite(spark, t):
    return t("pages").select("page_id", T.vendor_cite(F.lower("url")).alias("vendor"))


@query(expect("id long, leak boolean", (1, True), (2, True), (3, False), (4, False), (5, True)))
def q36_tool_call_leak(spark, t):
    rows = [(1, "<tool_call>{}"), (2, '```json\n{"name": "f", "arguments": {}}\n```'), (3, "An answer."), (4, '{"answer": 1}'), (5, "call:get_case{cluster_id:1}")]
    return spark.createDataFrame(rows, "id long, t string").select("id", U.tool_call_leak("t").alias("leak"))
