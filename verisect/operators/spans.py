"""Span findings: mapping of a checker's findings to text spans, matching against gold, scores and their intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import metrics as M
from verisect.operators.sampling import best_per_group

#: What a checked citation of an example has; the input of map_findings().
CITE = (
    "ex_id string, ord int, text string, raw string, cluster_id long, status string, verdict string, verdict_evidence string, party_verdict string, wrong_part string, written_name string, "
    "quote string, quote_verdict string, quote_integrity string, quote_percent double, quote_differs boolean, quote_inside boolean, quote_pinned string, "
    "pin_verdict string, pin_reason string, proposition_verdict string, cited_for_match boolean, cited_for_verdict string, cited_for_confidence string, cited_for_text string"
)
VERSIONS = ("v1", "v2", "v3", "v4", "v5", "v6", "v6n")
# Verdicts that count as made up, as a wrong pin, and as an unsupported proposition.
MADE_UP = ("strong", "interior_mismatch")
WRONG_PIN = ("interior_mismatch", "exterior", "exterior_pin", "outside")
UNSUPPORTED = ("proposition_uncited", "proposition_contradicted", "proposition_entity_mismatch")
#: Which findings a tier predicts.
TIERS = {"strict": ("strict",), "broad": ("strict", "broad"), "cited_for": ("strict", "cited_for")}


def _since(version: str, first: str) -> bool:
    return VERSIONS.index(version) >= VERSIONS.index(first)


#: What a checked quotation that stands by no citation has.
LOOSE = "ex_id string, ord int, text string, quote string, verdict string"


def map_findings(cites: DataFrame, loose: DataFrame | None = None, version: str = "v6") -> DataFrame:
    """ex_id, tier, reason, segment, ord: the findings of checked citations under a version of the mapping rules.

    loose: quotations that stand by no citation (LOOSE); from v2 on those that differ in words count, before all citations.
    Versions add rules: v2 quotations that differ in words, and pins; v3 misattributed quotations; v4 propositions
    elsewhere; v5 wrong names and citations at another page; v6 spans from the name to the citation, v6n the name alone.
    """
    span = U.locate("text", "raw")
    missing, c = F.col("cluster_id").isNull(), F.col
    finding = lambda tier, reason, segment: F.struct(F.lit(tier).alias("tier"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), segment.alias("segment"))
    rows = cites.where(~F.coalesce(c("status") == "pin_reference", F.lit(False))).withColumns({"_span": span, "_quote": U.locate("text", "quote"), "_name": U.name_segment("text", "written_name", "raw"), "_before": U.preceding_sentence("text", "raw"), "_for": U.locate("text", "cited_for_text")})

    invented = c("verdict").isin(*MADE_UP) | (c("verdict_evidence") == "cited_as_fabricated")
    if _since(version, "v5"):
        invented = invented | (c("verdict") == "cite_mismatch")
    named = F.concat(F.lit("unresolved:"), F.coalesce("verdict", F.lit("unknown")))
    unresolved = F.when(missing, F.when(F.coalesce(invented, F.lit(False)), finding("strict", named, c("_span"))).otherwise(finding("broad", named, c("_span"))))

    mismatch = ~missing & (c("party_verdict") == "mismatch")
    by_name = (c("wrong_part") == "name") & c("_name").isNotNull()
    if version == "v5":
        name_span = F.when(by_name, c("_name"))
    elif version == "v6n":
        name_span = c("_name")
    elif version == "v6":
        at = F.instr("text", c("_span"))
        start = F.when(c("_name").isNotNull(), F.length(F.substring(c("text"), F.lit(1), at - 1)) - F.instr(F.reverse(F.substring(c("text"), F.lit(1), at - 1)), F.reverse("_name")) - F.length("_name") + 2)
        tail = F.regexp_extract(F.substring(c("text"), at + F.length("_span"), F.lit(70)), r"^(\s*\([^()]{2,60}\))", 1)
        whole = F.concat(F.substring(c("text"), start, at + F.length("_span") - start), tail)
        name_span = F.when(by_name, c("_name")).when((start > 0) & (at - start - F.length("_name") <= 120), whole)
    else:
        name_span = F.lit(None).cast("string")
    party = F.when(mismatch, F.when(name_span.isNotNull(), finding("strict", "name_mismatch:name", name_span)).otherwise(finding("strict", "name_mismatch", c("_span"))))

    quoted, v = ~missing & c("quote").isNotNull(), c("quote_verdict")
    rules = F.when(F.lit(_since(version, "v3")) & (v == "misattributed"), finding("broad", "quote_misattributed", c("_quote")))
    rules = rules.when((c("quote_integrity") == "absent") | (v == "misquote"), finding("strict", "misquote", c("_quote")))
    rules = rules.when(F.lit(_since(version, "v2")) & (v == "near") & c("quote_differs"), finding("strict", "quote_near_diff", c("_quote")))
    rules = rules.when(v.isin("near", "paraphrase") | ((v == "ok") & (c("quote_percent") < 100)), finding("broad", "quote_near", c("_quote")))
    elsewhere = F.when(quoted & ~c("quote_inside") & c("quote_pinned").isNotNull(), finding("broad", "pin_quote_elsewhere", c("_span")))

    pin = c("pin_verdict")
    pins = F.when(F.lit(_since(version, "v2")) & ((pin == "pin_mismatch") | ((pin == "interior_mismatch") & (c("pin_reason") == "quote_elsewhere"))), finding("strict", F.concat(F.lit("pin:"), pin), c("_span")))
    pins = pins.when(F.lit(_since(version, "v4")) & (c("proposition_verdict") == "proposition_elsewhere"), finding("strict", "pin:proposition_elsewhere", c("_span")))
    pins = F.when(~missing, pins.when(pin.isin(*WRONG_PIN), finding("broad", F.concat(F.lit("pin:"), pin), c("_span"))))

    proposition = F.when(~missing & (~c("cited_for_match") | (c("verdict") == "proposition_mismatch")) & c("_before").isNotNull(), finding("broad", "proposition_mismatch", c("_before")))
    cited_for = F.when(~missing & c("cited_for_verdict").isin(*UNSUPPORTED) & c("_for").isNotNull(), F.when(c("cited_for_confidence") == "hard", finding("cited_for", c("cited_for_verdict"), c("_for"))).otherwise(finding("cited_for_advice", c("cited_for_verdict"), c("_for"))))

    found = rows.select("ex_id", "ord", F.posexplode(F.array(unresolved, party, F.when(quoted, rules), elsewhere, pins, proposition, cited_for)).alias("rule", "f")).where("f.segment IS NOT NULL")
    found = found.select("ex_id", "f.*", "ord", "rule")
    if loose is not None and _since(version, "v2"):
        near = loose.where((c("verdict") == "near") & (c("quote") != ""))
        near = near.select("ex_id", F.lit("strict").alias("tier"), F.lit("unattached_quote_near").alias("reason"), U.locate("text", "quote").alias("segment"), c("ord"), F.lit(-1).alias("rule"))
        found = found.unionByName(near.where("segment IS NOT NULL"))
    first = (c("rule") >= 0).cast("int")
    return best_per_group(found, ["ex_id", "tier", "segment"], first, F.col("ord"), F.col("rule")).drop("rule")


def predictions(findings: DataFrame, tier: str) -> DataFrame:
    """ex_id and the distinct segments of a tier's findings, in the order of the citations."""
    mine = findings.where(F.col("tier").isin(*TIERS[tier])).groupBy("ex_id", "segment").agg(F.min("ord").alias("ord"))
    return mine.groupBy("ex_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment"))), lambda s: s["segment"]).alias("predicted"))


def score_examples(examples: DataFrame, rule: str = "paper") -> DataFrame:
    """With found, gold, tp and pred of each example (gold: map of span to type; predicted: array of spans; text).

    Recall is over gold spans, precision over predictions.  Under `paper` optional spans count when met and never when
    missed; under any other rule they are ordinary gold.
    """
    spans = F.filter(F.map_keys(F.coalesce("gold", F.expr("cast(map() as map<string,string>)"))), lambda s: s != "")
    wanted = F.filter("_spans", lambda s: F.element_at("gold", s) != "optional") if rule == "paper" else F.col("_spans")
    own = F.array_distinct(F.filter(F.coalesce("predicted", F.expr("cast(array() as array<string>)")), lambda p: F.coalesce(p != "", F.lit(False))))
    rows = examples.withColumns({"_spans": spans, "_own": own}).withColumn("_wanted", wanted)
    met = F.filter("_wanted", lambda g: F.exists("_own", lambda p: T.span_match(g, p)))
    right = F.filter("_own", lambda p: F.exists("_spans", lambda g: T.span_match(g, p)))
    return rows.withColumns({"_met": met, "found": F.size(met).cast("long"), "gold_n": F.size("_wanted").cast("long"), "tp": F.size(right).cast("long"), "pred": F.size("_own").cast("long")}).drop("_spans", "_own")


def micro_scores(scored: DataFrame, *keys: str) -> DataFrame:
    """Micro precision, recall and F1 by keys."""
    sums = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("found", "gold_n", "tp", "pred")))
    p, r, f1 = M.precision_recall(F.col("found"), F.col("gold_n"), F.col("tp"), F.col("pred"))
    return sums.withColumns({"precision": p, "recall": r, "f1": f1})


def recall_by_type(scored: DataFrame, *keys: str) -> DataFrame:
    """found, gold and recall of each type of gold span."""
    flat = scored.select(*keys, "_met", F.explode("_wanted").alias("span"), "gold")
    kind = F.coalesce(F.nullif(F.element_at("gold", F.col("span")), F.lit("")), F.lit("untyped"))
    return flat.select(*keys, kind.alias("type"), F.array_contains("_met", F.col("span")).cast("int").alias("hit")).groupBy(*keys, "type").agg(F.sum("hit").alias("found"), F.count(F.lit(1)).alias("gold"), F.avg("hit").alias("recall"))


def clean_examples(scored: DataFrame, *keys: str) -> DataFrame:
    """Of examples with nothing but optional spans: their number, how many have any prediction, and the predictions."""
    clean = scored.where(F.size("_wanted") == 0)
    return clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") > 0).alias("with_any"), F.sum("pred").alias("predictions"))


def bootstrap_intervals(scored: DataFrame, keys: Sequence[str], samples: int = 2_000, seed: int = 20261016) -> DataFrame:
    """95 % percentile intervals of micro precision, recall and F1 over examples drawn with replacement.

    Examples with the same counts are interchangeable, so a sample is a multinomial draw over the distinct counts: the
    work is the number of distinct counts, not of examples.
    """
    cells = scored.groupBy(*keys, "found", "gold_n", "tp", "pred").agg(F.count(F.lit(1)).alias("_n"))
    schema = ", ".join([*(f"{k} {dict(scored.dtypes)[k]}" for k in keys), "metric string, low double, high double"])

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["found", "gold_n", "tp", "pred"])
        n = group["_n"].to_numpy()
        counts = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), samples)
        found, gold, tp, pred = (counts @ group[c].to_numpy() for c in ("found", "gold_n", "tp", "pred"))
        recall = np.divide(found, gold, out=np.zeros(samples), where=gold > 0)
        precision = np.divide(tp, pred, out=np.zeros(samples), where=pred > 0)
        f1 = np.divide(2 * precision * recall, precision + recall, out=np.zeros(samples), where=precision + recall > 0)
        rows = []
        for name, values in (("precision", precision), ("recall", recall), ("f1", f1)):
            values = np.sort(values)
            rows.append([*(group[k].iloc[0] for k in keys), name, values[int(0.025 * samples)], values[int(0.975 * samples) - 1]])
        return pd.DataFrame(rows, columns=[*keys, "metric", "low", "high"])

    return cells.groupBy(*keys).applyInPandas(draw, schema)


def score_run(preds: DataFrame, examples: DataFrame, rule: str = "paper") -> DataFrame:
    """Scored examples of each run: predictions are anchored to the text first; a failed example predicts nothing.

    preds: run_id, ex_id, predicted (array), error; examples: id, source, text, gold (map).
    """
    rows = preds.join(examples.select(F.col("id").alias("ex_id"), "source", "text", "gold"), "ex_id")
    flat = rows.select("run_id", "ex_id", F.posexplode_outer("predicted").alias("k", "span"), "text")
    anchored = flat.withColumn("span", U.anchor_span("span", "text")).groupBy("run_id", "ex_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "span"))), lambda x: x["span"]).alias("predicted"))
    return score_examples(rows.drop("predicted").join(anchored, ["run_id", "ex_id"], "left"), rule)


def same_finding(a: Column, b: Column) -> Column:
    return T.span_match(a, b)
