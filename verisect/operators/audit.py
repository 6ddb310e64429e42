"""Items of a human audit: each drawn quotation and each mismatched name with all that a reader needs for a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisect.functions import refs as N
from verisect.functions import udfs as U
from verisect.operators.grading import cited_cases

#: Words that a passage must have in common with a quotation for being shown; characters around a quotation, before and after.
SHOWN, BEFORE, AFTER = 3, 250, 120


def quote_items(answers: DataFrame, quotes: DataFrame, classified: DataFrame, opinions: DataFrame) -> DataFrame:
    """One row a quotation: how the answer credits it, the sentence that shows it, and the passages that come nearest.

    quotes: answer, ord, quote, start, end, verdict, kind, cluster_id (the case it was found in or came closest to).  The
    passage is that of this case, else of the case that the answer credits; `elsewhere` is the longest run of the quotation
    in any other case that the answer cites, if it is longer.  Each quotation is compared with each cited opinion in a row
    of its own, so neither an answer's citations nor an opinion's readers meet in one task.
    """
    c = F.col
    rows = quotes.join(answers.select("answer", "text"), "answer").withColumn("a", N.attribute_quote("text", "quote"))
    context = F.substring("text", F.greatest(c("start") - BEFORE, F.lit(0)) + 1, F.least(c("start"), F.lit(BEFORE)) + c("end") - c("start") + AFTER)
    rows = rows.select("answer", "ord", "quote", "verdict", "kind", "cluster_id", context.alias("context"), "a")
    source = classified.select("answer", c("start").alias("_at"), c("cluster_id").alias("credited"), c("raw").alias("credited_cite"), c("status").alias("credited_status"))
    rows = rows.join(source.dropDuplicates(["answer", "_at"]), (rows["answer"] == source["answer"]) & (c("a.target") == c("_at")), "left").drop(source["answer"]).drop("_at")
    cited = cited_cases(classified)
    searched = rows.select("answer", "ord", "quote", F.coalesce("cluster_id", "credited").alias("_own")).join(cited, "answer")
    wanted = opinions.join(cited.select("cluster_id").distinct(), "cluster_id", "left_semi").select("cluster_id", c("text").alias("_opinion"))
    runs = searched.join(wanted, "cluster_id").select("answer", "ord", "cluster_id", (c("cluster_id") == c("_own")).alias("_mine"), U.passage("quote", "_opinion").alias("p")).where(c("p.run") >= SHOWN)
    piece = F.struct("p.run", "cluster_id", "p.passage")
    best = runs.groupBy("answer", "ord").agg(F.max_by(piece, F.when(c("_mine"), F.struct("p.run", -c("cluster_id")))).alias("passage"), F.max_by(piece, F.when(~F.coalesce("_mine", F.lit(False)), F.struct("p.run", -c("cluster_id")))).alias("other"))
    out = rows.join(best, ["answer", "ord"], "left").join(cited.groupBy("answer").agg(F.sort_array(F.collect_set("cluster_id")).alias("searched")), "answer", "left")
    longer = c("other.run") > F.coalesce("passage.run", F.lit(0))
    return out.select(
        "answer", "ord", "quote", "verdict", "kind", "context", c("a.sentence").alias("sentence"), F.struct("a.quote_start", "a.quote_end", "a.ref_start", "a.ref_end").alias("marks"), c("a.cite_sentence").alias("cite_sentence"),
        c("a.rule").alias("credited_by"), c("a.ref").alias("credited_ref"), c("a.note").alias("note"), "credited", "credited_cite", F.coalesce(F.array_contains("searched", c("credited")), F.lit(False)).alias("credited_was_searched"),
        "searched", "passage", F.when(longer, c("other")).alias("elsewhere"),
    )


def name_items(answers: DataFrame, classified: DataFrame, names: DataFrame) -> DataFrame:
    """One row a case whose every claimed name is another's: its citations as the answer wrote them, and the text around the first.

    names: answer, cluster_id, mismatched, as operators.grading.name_verdicts() tells them.
    """
    wrong = names.where("mismatched").select("answer", "cluster_id")
    cites = classified.where("status = 'resolved'").join(wrong, ["answer", "cluster_id"])
    said = F.struct("start", "ord", "raw", "lhs", "rhs", "party_verdict")
    grouped = cites.groupBy("answer", "cluster_id").agg(F.sort_array(F.collect_list(said)).alias("cites"), F.min("case_name").alias("case_name"), F.min("start").alias("_at"))
    around = F.substring("text", F.greatest(F.col("_at") - BEFORE, F.lit(0)) + 1, F.least(F.col("_at"), F.lit(BEFORE)) + 200)
    return grouped.join(answers.select("answer", "text"), "answer").select("answer", "cluster_id", "case_name", "cites", around.alias("context"))
