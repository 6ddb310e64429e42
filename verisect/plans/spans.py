"""Span findings and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import spans as S
from verisect.plans.base import expect, query

# Documents as examples: gold spans are a document's first words, predictions the first words of its normalised copy.
GOLD = "list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}')[1:4])"
PRED = "list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')[1:6])"
SCORED = f"""e AS (SELECT doc_id, lang, source, {GOLD} AS g, {PRED} AS p FROM documents),
    s AS (SELECT doc_id, lang, source, len(g) AS gold_n, len(p) AS pred, len(list_filter(g, lambda x: len(list_filter(p, lambda y: contains(lower(x), y) OR contains(y, lower(x)))) > 0)) AS found,
    len(list_filter(p, lambda y: len(list_filter(g, lambda x: contains(lower(x), y) OR contains(y, lower(x)))) > 0)) AS tp FROM e)"""


def examples(t):
    gold = F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0)), 1, 4))
    own = F.array_distinct(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)), 1, 6))
    typed = F.map_from_arrays(gold, F.transform(gold, lambda g: F.when(F.length(g) > 9, "long").otherwise("short")))
    return t("documents").select("doc_id", "lang", "source", typed.alias("gold"), own.alias("predicted"))


@query(f"WITH {SCORED} SELECT lang, count(*) AS n, sum(found) AS found, sum(gold_n) AS gold_n, sum(tp) AS tp, sum(pred) AS pred, round(coalesce(sum(tp) / nullif(sum(pred), 0), 0), 9) AS precision, round(coalesce(sum(found) / nullif(sum(gold_n), 0), 0), 9) AS recall FROM s GROUP BY lang")
def a14_span_scores(spark, t):
    return S.micro_scores(S.score_examples(examples(t)), "lang").withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)}).drop("f1")


@query(
    f"""WITH e AS (SELECT doc_id, {GOLD} AS g, {PRED} AS p FROM documents), x AS (SELECT unnest(g) AS span, p FROM e)
    SELECT CASE WHEN length(span) > 9 THEN 'long' ELSE 'short' END AS type, sum(CAST(len(list_filter(p, lambda y: contains(lower(span), y) OR contains(y, lower(span)))) > 0 AS INT)) AS found, count(*) AS gold,
    avg(CAST(len(list_filter(p, lambda y: contains(lower(span), y) OR contains(y, lower(span)))) > 0 AS INT)) AS recall FROM x GROUP BY 1"""
)
def a15_recall_by_type(spark, t):
    return S.recall_by_type(S.score_examples(examples(t), "all"))


@query(f"WITH {SCORED} SELECT source, count(*) AS n, count(CASE WHEN pred > 0 THEN 1 END) AS with_any, sum(pred) AS predictions FROM s WHERE gold_n = 0 GROUP BY source")
def a16_clean_examples(spark, t):
    return S.clean_examples(S.score_examples(examples(t)), "source")


@query()
def a17_bootstrap_intervals(spark, t):
    """Intervals of precision, recall and F1 of every language's documents."""
    return S.bootstrap_intervals(S.score_examples(examples(t)), ["lang"])


MATCHES = [("The old rule", "old rule", True), ("the rule ... stands", "the rule of law stands here", True), ("a b", "c d", False), ("", "x", False), ("one … three", "three then one", False), ("same", "SAME ", True)]


@query(expect("gold string, predicted string, same boolean", *MATCHES))
def q29_span_match(spark, t):
    return spark.createDataFrame([m[:2] for m in MATCHES], "gold string, predicted string").select("gold", "predicted", T.span_match(F.col("gold"), F.col("predicted")).alias("same"))


OUTPUTS = [
    (1, '{"action": {"response": ["a", " b "]}}', "a|b", "object_list"),
    (2, 'Sure: {"response": "[\\"x\\", null]"}', "x", "object_string"),
    (3, '{"response": "one span"}', "one span", "object_bare"),
    (4, 'I found ["p", "q"] in it', "p|q", "array"),
    (5, "nothing here", "", "unparsed"),
    (6, None, "", "none"),
    (7, '<think>["no"]</think>["yes"]', "yes", "array"),
    (8, '{"predicted_hallucinations": ["z"]}', "z", "object_list"),
]


@query(expect("id long, spans string, status string", *((o[0], o[2], o[3]) for o in OUTPUTS)))
def q30_parse_predictions(spark, t):
    rows = spark.createDataFrame([o[:2] for o in OUTPUTS], "id long, raw string").select("id", U.parse_predictions("raw").alias("p"))
    return rows.select("id", F.array_join("p.spans", "|").alias("spans"), "p.status")


TEXT = "The law is settled and clear on this point. See Smith v. Jones, 12 So. 2d 345 (Fla. 1950). Lee v. Ray, 1 F.3d 2 (9th Cir. 1993), says “every word counts” here. Also 5 U.S. 7."


@query(expect("cite string, sentence string, name string", ("12 So. 2d 345", "See Smith v. Jones,", "Smith v. Jones"), ("5 U.S. 7", "Ray, 1 F.3d 2 (9th Cir. 1993), says “every word counts” here. Also", None)))
def q31_segments_around_a_cite(spark, t):
    rows = spark.createDataFrame([(TEXT, "12 So. 2d 345", "Smith v. Jones"), (TEXT, "5 U.S. 7", "Nobody v. Else")], "t string, cite string, name string")
    return rows.select("cite", U.preceding_sentence("t", "cite").alias("sentence"), U.name_segment("t", "name", "cite").alias("name"))


def checked(spark):
    blank = dict.fromkeys(f.split()[0] for f in S.CITE.split(", "))
    cites = [
        blank | {"ex_id": "e", "ord": 1, "text": TEXT, "raw": "12 So. 2d 345", "verdict": "strong"},
        blank | {"ex_id": "e", "ord": 2, "text": TEXT, "raw": "1 F.3d 2", "cluster_id": 7, "party_verdict": "mismatch", "written_name": "Lee v. Ray", "quote": '"every word counts"', "quote_verdict": "near", "quote_differs": True},
        blank | {"ex_id": "e", "ord": 3, "text": TEXT, "raw": "5 U.S. 7", "verdict": "cite_mismatch"},
        blank | {"ex_id": "e", "ord": 4, "text": TEXT, "raw": "5 U.S. 7", "status": "pin_reference"},
        blank | {"ex_id": "e", "ord": 5, "text": TEXT, "raw": "1 F.3d 2", "cluster_id": 7, "pin_verdict": "pin_mismatch", "cited_for_verdict": "proposition_uncited", "cited_for_confidence": "hard", "cited_for_text": "The law is settled"},
    ]
    return spark.createDataFrame([tuple(c.values()) for c in cites], S.CITE)


@query(
    expect(
        "version string, tier string, reason string, segment string",
        *(("v1", *r) for r in (("strict", "unresolved:strong", "12 So. 2d 345"), ("strict", "name_mismatch", "1 F.3d 2"), ("broad", "quote_near", "“every word counts”"), ("broad", "unresolved:cite_mismatch", "5 U.S. 7"), ("cited_for", "proposition_uncited", "The law is settled"))),
        *(("v6", *r) for r in (("strict", "unresolved:strong", "12 So. 2d 345"), ("strict", "name_mismatch:name", "Lee v. Ray, 1 F.3d 2 (9th Cir. 1993)"), ("strict", "quote_near_diff", "“every word counts”"), ("strict", "unresolved:cite_mismatch", "5 U.S. 7"), ("strict", "pin:pin_mismatch", "1 F.3d 2"), ("cited_for", "proposition_uncited", "The law is settled"))),
    )
)
def q32_finding_mappings(spark, t):
    found = None
    for version in ("v1", "v6"):
        part = S.map_findings(checked(spark), version=version).select(F.lit(version).alias("version"), "tier", "reason", "segment")
        found = part if found is None else found.unionByName(part)
    return found


@query(expect("tier string, n int", ("strict", 2), ("broad", 4), ("cited_for", 3)))
def q33_tiers(spark, t):
    found = S.map_findings(checked(spark), version="v1")
    out = None
    for tier in S.TIERS:
        part = S.predictions(found, tier).select(F.lit(tier).alias("tier"), F.size("predicted").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(expect("run_id string, rule string, found long, gold_n long, tp long, pred long, f1 double", ("r", "paper", 1, 2, 2, 3, 0.571428571), ("r", "repo", 2, 3, 2, 3, 0.666666667)))
def d9_score_run(spark, t):
    examples = spark.createDataFrame([("x", "brief", "The ’old’ rule stands. A second one.", {"The ’old’ rule": "misquote", "second one": "optional"}), ("y", "dahl", "Nothing here.", {"Nothing": "fabricated"})], "id string, source string, text string, gold map<string,string>")
    preds = spark.createDataFrame([("r", "x", ["The 'old' rule", "second", "absent"], None), ("r", "y", [], "timeout")], "run_id string, ex_id string, predicted array<string>, error string")
    out = None
    for rule in ("paper", "repo"):
        part = S.micro_scores(S.score_run(preds, examples, rule), "run_id").select("run_id", F.lit(rule).alias("rule"), "found", "gold_n", "tp", "pred", F.round("f1", 9).alias("f1"))
        out = part if out is None else out.unionByName(part)
    return out
