"""Grading of answers as a staged relation: citations are classified, reconciled, folded and counted; quotations are matched.

Every stage refines one `status` column, so the evidence of each decision stays in the rows: history, retracted,
resolved, parallel, unindexed_real, pin_reference, fabricated.  `route` says how a parallel or unindexed one was told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.functions.text import reporter_key
from verisect.operators import citations as G
from verisect.operators import quotations as Q
from verisect.operators.intervals import overlapping
from verisect.sources.tables import stored

ANSWERS = "answer string, text string, gold_cluster_id long, gold_citation string, proposition string"
#: A checked citation: where it stands and what the checker says of it. hit_* is a reconciled case, pinned by the caller or reconcile().
CITES = "answer string, ord int, raw string, volume string, reporter string, page string, start int, cluster_id long, resolution string, case_name string, flag string, party_verdict string, lhs string, rhs string, did_you_mean array<struct<cluster_id:bigint,page:string>>"


#: Year before which the index lacks official reports; characters after a chain that still belong to it.
OLD_REPORTS, CHAIN_TAIL = 1950, 40


def near_miss_tags(answers: DataFrame, classified: DataFrame) -> DataFrame:
    """answer, ord, kind, cluster_id, delta of made-up citations that are near a cited case, or near the answer's gold case."""
    c = F.col
    parsed = F.explode(F.transform(C.cite_keys(c("gold_citation")), lambda k: F.split(k, r"\|")))
    gold = answers.where("gold_cluster_id IS NOT NULL").select("answer", parsed.alias("_k"), c("gold_cluster_id").alias("cluster_id"))
    gold = gold.select("answer", c("_k")[0].alias("volume"), c("_k")[1].alias("reporter"), c("_k")[2].alias("page"), "cluster_id")
    cited = classified.where("status IN ('resolved', 'unindexed_real') AND cluster_id IS NOT NULL").select("answer", "volume", "reporter", "page", "cluster_id")
    made_up = classified.where("status = 'fabricated'").select("answer", "ord", "volume", "reporter", "page", "did_you_mean")
    return G.near_misses(made_up, cited.unionByName(gold), ["answer"], "ord")


def read(answers: DataFrame, cites: DataFrame, reconciled: DataFrame | None = None) -> DataFrame:
    """Citations with all that later stages want to know of their answer's text, so that the text goes no further.

    `end`, `status` (history, retracted, unresolved, unindexed_real, resolved), `withdrawn`; `glue`: separators and pages right
    before it; `claimed`: the name before it, if it is at odds with the case; `_sentence`: its sentence, where an official report
    may stand beside a regional one; `_places`: where an unresolved one among others is written; `_year` in its parentheses, and
    `_found`: what reconciliation told of it.
    """
    c = F.col
    fields = [n for n in cites.columns if n != "answer"]
    missing, odd = c("cluster_id").isNull(), c("party_verdict") == "mismatch"
    mine = cites.groupBy("answer").agg(
        F.collect_list(F.struct(*fields)).alias("_cites"),
        (F.bool_or(~missing & C.is_regional(c("reporter"))) & F.bool_or(missing & C.is_official(c("reporter")))).alias("_beside"),
        F.collect_list(F.when(missing, F.struct("ord", "volume", "reporter", "page"))).alias("_asked"),
        F.coalesce(F.bool_or(odd), F.lit(False)).alias("_odd"),
        (F.count(F.lit(1)) == 1).alias("_alone"),
    )
    rows = answers.select("answer", "text").join(mine, "answer")
    if reconciled is not None:
        known = lambda name, kind: (c(name) if name in reconciled.columns else F.lit(None)).cast(kind).alias(name)
        found = F.struct("ord", "status", c("cluster_id").cast("long").alias("cluster_id"), known("miscited", "boolean"), known("hi", "long"))
        rows = rows.join(reconciled.groupBy("answer").agg(F.collect_list(found).alias("_reconciled")), "answer", "left")
    starts, ends = F.transform("_cites", lambda x: x["start"]), F.transform("_cites", lambda x: x["start"] + F.length(x["raw"]))
    # One answer, one call: Python gets its text once for all its citations. It gets every row, so a row that needs no answer has no values for it.
    searched = ~c("_alone") & (F.size("_asked") > 0)
    rows = rows.withColumns({
        "_withdrawn": U.retractions("text", starts, ends),
        "_starts": U.sentences(F.when(c("_beside"), c("text"))),
        "_written": U.find_cites(*(F.when(searched, c(x)) for x in ("text", "_asked"))),
        "_claimed": U.claimed_names(F.when(c("_odd"), c("text")), F.when(c("_odd"), F.transform("_cites", lambda x: F.when(x["party_verdict"] == "mismatch", x["start"])))),
    })
    kept = ["_reconciled"] if reconciled is not None else []
    rows = rows.select("answer", "text", "_withdrawn", "_starts", "_written", "_claimed", "_beside", "_alone", *kept, F.posexplode("_cites").alias("_nth", "_c"))
    rows = rows.select("answer", "text", "_starts", "_written", "_beside", "_alone", *kept, F.get("_withdrawn", c("_nth")).alias("withdrawn"), F.get("_claimed", c("_nth")).alias("claimed"), "_c.*")
    rows = rows.withColumn("end", c("start") + F.length("raw"))
    status = F.when(C.is_history(c("text"), c("start")), "history").when(c("withdrawn").isNotNull(), "retracted").when(missing, "unresolved").when(c("resolution") == "name_year", "unindexed_real").otherwise("resolved")
    facts = {
        "status": status,
        "glue": G.glue(c("text"), c("start")),
        "_sentence": F.when(c("_beside"), F.size(F.filter("_starts", lambda s: s <= c("start")))),
        "_places": F.when(missing, F.transform(F.filter("_written", lambda p: p["ord"] == c("ord")), lambda p: p["start"])),
    }
    if reconciled is not None:
        facts |= {"_year": F.when(missing & C.is_official(c("reporter")), C.parenthetical(c("text"), c("start"), c("end"))["year"]), "_found": F.filter("_reconciled", lambda r: r["ord"] == c("ord"))}
        facts |= {"_alone": c("_alone") & (F.coalesce(F.size(facts["_found"]), F.lit(0)) <= 1)}
    return rows.withColumns({"_alone": c("_alone")} | facts).select("answer", *fields, "end", "withdrawn", "claimed", *({"_alone": 0} | facts))


def classify(answers: DataFrame, cites: DataFrame, reconciled: DataFrame | None = None) -> DataFrame:
    """Citations with `status`, `route` and the cluster they stand for, read from tables that stored() wrote; see read() for `claimed`.

    reconciled: answer, ord, status, cluster_id of unresolved ones, and if known `miscited` (a real case was found under
    another citation) and `hi` (the last year of the volume's band).
    """
    keys = ["answer"]
    c = F.col
    # Written once, without the texts: all that follows goes by what was read in them.
    rows = stored(read(answers, cites, reconciled), "checked")
    out = [*cites.columns, "end", "withdrawn", "claimed", "status", "route"]
    gone = rows.where("status IN ('history', 'retracted')").withColumn("route", F.lit(None).cast("string")).select(*out)
    live = rows.where("status NOT IN ('history', 'retracted')")

    def told(live: DataFrame) -> DataFrame:
        """Unresolved citations that reconciliation settles."""
        if reconciled is None:
            return live.select(*out)
        live = live.select(*out, "_year", F.explode_outer("_found").alias("_f"))
        open_ = c("status") == "unresolved"
        real = open_ & (c("_f.status") == "unindexed_real")
        # The index lacks most official reports of before 1950: their citations can't be checked, so they aren't made up.
        dated = F.coalesce(c("_year") < OLD_REPORTS, F.lit(False)) | F.coalesce(c("_f.hi") < OLD_REPORTS, F.lit(False))
        old = open_ & c("_f.status").isNotNull() & ~real & ~F.coalesce("_f.miscited", F.lit(False)) & C.is_official(c("reporter")) & dated
        return live.withColumns({"cluster_id": F.when(real, c("_f.cluster_id")).otherwise(c("cluster_id")), "status": F.when(real | old, "unindexed_real").otherwise(c("status")), "route": F.when(old, "old_official_unindexed").when(real, "reconciled").otherwise(c("route"))}).select(*out)

    outcome = F.when(c("status") == "unresolved", "fabricated").when(c("status") != "parallel", c("status"))
    # The only citation of an answer has no chain, no twin and no case beside it.
    alone = told(live.where("_alone").withColumn("route", F.lit(None).cast("string"))).withColumn("status", outcome)

    # Parallels: in a chain with a resolved member all unresolved ones, else all but the first. Chains, sentences, twins and
    # reports of a case are groups within an answer, so one shuffle by the answer serves them all.
    live = G.parallel_chains(live.where("NOT _alone"), keys)
    chain, answer = Window.partitionBy("answer", "island"), Window.partitionBy("answer")
    known = c("status") != "unresolved"
    rank = F.struct(known.alias("known"), "start", "ord")
    live = live.withColumns({"_has": F.max(known).over(chain), "_first": F.min(rank).over(chain), "_from": F.min("start").over(chain) + 1, "_to": F.max(F.struct("start", "end")).over(chain)["end"] + CHAIN_TAIL + 1, "_lead": F.min_by("ord", F.struct("start", "ord")).over(chain)})
    in_chain = ~known & (c("_has") | ~c("_first").eqNullSafe(rank))
    live = live.withColumns({"status": F.when(in_chain, "parallel").otherwise(c("status")), "route": F.when(in_chain, "chain")})

    # A citation that is also written inside a chain that another one leads, or CHAIN_TAIL characters after it, is that chain's
    # parallel; an official report's citation in the sentence of a resolved regional one is its parallel.
    regional = c("status").isin("resolved", "unindexed_real") & C.is_regional(c("reporter"))
    live = live.withColumns({"_chains": F.collect_set(F.struct("_from", "_to", "_lead")).over(answer), "_regional": F.collect_set(F.when(regional, c("_sentence"))).over(answer)})
    inside = lambda p: F.exists("_chains", lambda x: (x["_lead"] != c("ord")) & (x["_from"] <= p) & (p < x["_to"]))
    again = (c("status") == "unresolved") & F.coalesce(F.exists("_places", inside), F.lit(False))
    live = live.withColumns({"status": F.when(again, "parallel").otherwise(c("status")), "route": F.when(again, "recurs_in_chain").otherwise(c("route"))})
    beside = (c("status") == "unresolved") & C.is_official(c("reporter")) & F.coalesce(F.array_contains("_regional", c("_sentence")), F.lit(False))
    live = live.withColumns({"status": F.when(beside, "parallel").otherwise(c("status")), "route": F.when(beside, "same_sentence").otherwise(c("route"))})

    live = told(live)

    # Twins: the best outcome of the same volume, reporter and page holds for all. Where no bare pinpoint can turn up, it holds now.
    anchor = c("status").isin("resolved", "unindexed_real") & c("cluster_id").isNotNull()
    case = Window.partitionBy("answer", "volume", "_rep")
    live = G.settle_twins(live.withColumn("outcome", outcome), keys).withColumn("_rep", reporter_key(c("reporter")))
    live = live.withColumn("_pins", F.max(anchor).over(case) & F.max(c("status") == "unresolved").over(case)).drop("_rep")
    chained = stored(live, "chained")
    settled = chained.where("NOT _pins").withColumn("status", F.when(c("status") == "parallel", "parallel").otherwise(c("outcome"))).select(*out)

    # Bare pinpoints into a resolved case of the same answer.
    live = chained.where("_pins").select(*out)
    anchors = live.where(anchor).select("answer", "volume", "reporter", "page", "cluster_id", "case_name")
    pins = G.pin_references(live.where("status = 'unresolved'"), anchors, keys, "ord").select("answer", "ord", c("cluster_id").alias("_pin"))
    live = live.join(pins, ["answer", "ord"], "left")
    live = live.withColumns({"status": F.when(c("status") != "unresolved", c("status")).when(c("_pin").isNotNull(), "pin_reference").otherwise("fabricated"), "cluster_id": F.coalesce("cluster_id", "_pin")}).drop("_pin")
    twins = G.settle_twins(live.where("status <> 'parallel'").withColumnRenamed("status", "outcome"), keys).withColumnRenamed("outcome", "status")
    folded = stored(twins.unionByName(live.where("status = 'parallel'")).select(*out), "folded")
    return settled.unionByName(folded).unionByName(alone).unionByName(gone)


def name_verdicts(classified: DataFrame) -> DataFrame:
    """answer, cluster_id, mismatched and flag of each resolved case: mismatched if every claimed name is, after the guard for initials, short names and acronyms."""
    c = F.col
    # A Python function gets every row, whatever the condition: those that need no name have no text for it.
    claimed = c("claimed") if "claimed" in classified.columns else U.claimed_name(F.when(c("party_verdict") == "mismatch", c("text")), "start")
    guarded = C.names_equivalent(F.concat_ws(" v. ", "lhs", "rhs"), c("case_name")) | F.coalesce(C.names_equivalent(claimed, c("case_name")), F.lit(False))
    # Names are only compared where they are at odds: of a conjunction, both sides would be.
    verdict = F.when(c("party_verdict") == "mismatch", F.when(guarded, "match_guard").otherwise("mismatch")).otherwise(F.coalesce("party_verdict", F.lit("none")))
    rows = classified.where("status = 'resolved' AND cluster_id IS NOT NULL").withColumn("_v", verdict)
    return rows.groupBy("answer", "cluster_id").agg(F.bool_and(c("_v") == "mismatch").alias("mismatched"), F.min_by("flag", F.when(c("flag").isNotNull(), c("ord"))).alias("flag"))


def _attached(answers: DataFrame, classified: DataFrame, quotes: DataFrame) -> DataFrame:
    """answer, ord, has_case and no_reporter of quotations that stand by a citation: whether it stands for a case, and the docket citation that does instead. quotes: answer, ord, start, end."""
    c = F.col
    spans = quotes.join(answers.select("answer", "text"), "answer")
    before, after = F.substring(c("text"), F.lit(1), c("start")), F.substring(c("text"), c("end") + 1, F.length("text"))
    bounds = spans.withColumns({"para_start": F.length(before) - F.length(F.substring_index(before, "\n\n", -1)), "para_end": c("end") + F.length(F.substring_index(after, "\n\n", 1))})
    places = classified.select("answer", "start", (c("start") + F.length("raw")).alias("end"), F.struct(c("cluster_id").isNotNull() | (c("status") == "parallel")).alias("raw"))
    found = Q.attached_cites(bounds, places, ["answer"])
    has_case = F.when(c("no_reporter").isNotNull(), False).otherwise(c("raw.col1"))
    return quotes.select("answer", "ord", "start", "end").join(found.select("answer", "start", "end", has_case.alias("has_case"), "no_reporter"), ["answer", "start", "end"]).select("answer", "ord", "has_case", "no_reporter")


def cited_cases(classified: DataFrame) -> DataFrame:
    """answer and cluster_id of the cases that an answer cites and that were found."""
    return classified.where("status IN ('resolved', 'unindexed_real') AND cluster_id IS NOT NULL").select("answer", "cluster_id").distinct()


def quoted(answers: DataFrame) -> DataFrame:
    """answer, ord, quote, start, end of every quotation."""
    spans = answers.select("answer", F.explode(U.extract_quotes("text")).alias("q")).where("q.skipped IS NULL").select("answer", "q.quote", "q.start", "q.end")
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy("answer").orderBy("start")))


#: Why a quotation is unattributed: no case of its answer was found, its citation names no reporter, or stands for no case.
NO_CASE, NO_REPORTER, UNRESOLVED = "no resolved opinion", "no reporter", "unresolved citation"


def _unattributed(cases: Column) -> Column:
    """The reason why an absent quotation isn't held against its answer; null if it is. cases: how many cases of the answer were found."""
    return F.when(F.coalesce(cases, F.lit(0)) == 0, NO_CASE).when(F.col("no_reporter").isNotNull(), NO_REPORTER).when(~F.coalesce("has_case", F.lit(True)), UNRESOLVED)


def grade_quotes(answers: DataFrame, classified: DataFrame, opinions: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every quotation with verdict (found, rule_text, absent, unattributed), kind, and the reason of an unattributed one.

    An absent one that follows through a rule is rule text; one whose citation stands for no case, or names no reporter,
    or whose answer cites no case that was found, is unattributed.  rules: jurisdiction, rule, text of rules to look up.
    """
    c = F.col
    spans = stored(quoted(answers), "quotations")
    cited = cited_cases(classified)
    matched = stored(Q.match_quotes(spans.select("answer", "ord", "quote"), cited, opinions, ["answer", "ord"]), "matched")
    if rules is None:
        rules = answers.sparkSession.range(0).select(*(F.lit(None).cast("string").alias(n) for n in ("jurisdiction", "rule", "text")))
    absent = stored(spans.join(matched.where("verdict = 'absent'").select("answer", "ord"), ["answer", "ord"]), "absent")
    by_rule = Q.rule_texts(answers, absent, rules, ["answer", "ord"]).select("answer", "ord", "rule")
    attached = _attached(answers, classified, absent)  # only absent ones need to know their citation
    rows = spans.join(matched, ["answer", "ord"]).join(attached, ["answer", "ord"], "left").join(by_rule, ["answer", "ord"], "left")
    rows = rows.join(cited.groupBy("answer").agg(F.count(F.lit(1)).alias("_cases")), "answer", "left")
    verdict = F.when(c("rule").isNotNull(), "rule_text").otherwise(c("verdict"))
    reason = F.when(verdict == "absent", _unattributed(c("_cases")))
    kind = F.when(c("rule").isNotNull(), "rule_text").when(reason.isNotNull(), "unattributed").otherwise(c("kind"))
    return rows.select("answer", "ord", "quote", "start", "end", F.when(reason.isNotNull(), "unattributed").otherwise(verdict).alias("verdict"), kind.alias("kind"), "cluster_id", "paraphrase_ratio", "rule", reason.alias("reason"))


def regrade_quotes(answers: DataFrame, stored_quotes: DataFrame, classified: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Stored quotations under new citations, without reading an opinion: only what depends on the changes is decided anew.

    stored_quotes: what grade_quotes gave; classified: the citations as they stand now; withdrawn: answer, cluster_id of
    hits that no longer count.  In answers that lost a hit, absent quotations whose citation lost its case are detached
    (unattributed); unattributed ones whose citation has got a case, as a pin or a twin, are reattached (absent again, by
    their ratio); found ones of a lost opinion keep their verdict, since only its text could tell, and are marked.
    With `change`: detached, reattached, found_in_withdrawn_hit, or null.
    """
    c = F.col
    cited = cited_cases(classified)
    lost = withdrawn.select("answer", "cluster_id").distinct().join(cited, ["answer", "cluster_id"], "left_anti")
    shrunk = lost.select("answer").distinct().withColumn("_shrunk", F.lit(True))
    rows = stored_quotes.join(shrunk, "answer", "left").withColumn("_shrunk", c("_shrunk").isNotNull())
    may_go = (c("verdict") == "absent") & c("_shrunk")
    may_come = (c("verdict") == "unattributed") & (c("reason") == UNRESOLVED)
    asked = rows.where(may_go | may_come).select("answer", "ord", "start", "end")
    attached = _attached(answers, classified, asked)
    rows = rows.join(attached, ["answer", "ord"], "left").join(cited.groupBy("answer").agg(F.count(F.lit(1)).alias("_cases")), "answer", "left")
    rows = rows.join(lost.withColumn("_lost", F.lit(True)), ["answer", "cluster_id"], "left")
    reason = F.when(may_go, _unattributed(c("_cases")))
    back = F.coalesce(may_come & c("has_case"), F.lit(False))
    change = F.when((c("verdict") == "found") & c("_lost"), "found_in_withdrawn_hit").when(reason.isNotNull(), "detached").when(back, "reattached")
    close = F.coalesce(c("paraphrase_ratio") >= Q.PARAPHRASE, F.lit(False))
    return rows.select(
        "answer", "ord", "quote", "start", "end", F.when(reason.isNotNull(), "unattributed").when(back, "absent").otherwise(c("verdict")).alias("verdict"),
        F.when(reason.isNotNull(), "unattributed").when(back, F.when(close, "paraphrase_in_quotes").otherwise("fabricated")).otherwise(c("kind")).alias("kind"), "cluster_id", "paraphrase_ratio", "rule",
        F.when(reason.isNotNull(), reason).when(~back, c("reason")).alias("reason"), change.alias("change"),
    )


def grade_answers(answers: DataFrame, cites: DataFrame, opinions: DataFrame, reconciled: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row per answer with the counts of its grade."""
    c = F.col
    classified = classify(answers, cites, reconciled)
    key = F.concat_ws("|", "volume", reporter_key(c("reporter")), "page")
    names = stored(name_verdicts(classified), "names")
    by_case = names.groupBy("answer").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(~c("mismatched")).alias("n_verified"), F.count_if("mismatched").alias("n_name_mismatch"), F.count_if((c("flag") == "red") & ~c("mismatched")).alias("n_red"), F.count_if((c("flag") == "yellow") & ~c("mismatched")).alias("n_yellow"))
    # An unindexed case that is also cited through an indexed citation doesn't count again.
    known = names.select("answer", c("cluster_id").alias("_known"))
    real = classified.where("status = 'unindexed_real'").join(known, (classified["answer"] == known["answer"]) & (c("cluster_id") == c("_known")), "left_anti")
    unindexed = real.groupBy("answer").agg(F.count_distinct(F.coalesce(c("cluster_id").cast("string"), key)).alias("n_unindexed"))
    made_up = classified.where("status = 'fabricated'").groupBy("answer").agg(F.count_distinct(key).alias("n_fabricated"))
    pins = classified.where("status = 'pin_reference'").groupBy("answer").agg(F.count_distinct(key).alias("n_pin_reference"))
    misses = near_miss_tags(answers, classified).groupBy("answer").agg(F.count(F.lit(1)).alias("n_near_miss"))
    quotes = grade_quotes(answers, classified, opinions, rules).groupBy("answer").agg(F.count_if(c("verdict") == "rule_text").alias("n_quote_rule_text"), F.count_if(c("verdict") == "absent").alias("n_quote_absent"), F.count_if(c("verdict") == "unattributed").alias("n_quote_unattributed"))
    standing = classified.where("status IN ('resolved', 'unindexed_real')").join(names.where("mismatched").select("answer", "cluster_id"), ["answer", "cluster_id"], "left_anti")
    hits = G.gold_hits(standing.select("answer", "cluster_id", "volume", "reporter", "page"), answers.select("answer", "gold_cluster_id", "gold_citation"), "answer")
    from verisect.operators.containment import gold_equivalent

    used = standing.select("answer", "cluster_id").distinct()
    wanted = opinions.join(used.select("cluster_id").distinct(), "cluster_id", "left_semi")  # each cited opinion is prepared once
    # Propositions go to the opinions; of these, only what was found in them goes back.
    texts = used.join(answers.select("answer", "proposition"), "answer").join(wanted.select("cluster_id", U.prepare(F.lower("text")).alias("hay")), "cluster_id")
    runs = texts.groupBy("answer").agg(F.max((gold_equivalent(c("proposition"), c("hay.plain")) | gold_equivalent(c("proposition"), c("hay.stripped"))).cast("int")).alias("_run"))
    out = answers.select("answer", U.warned("text").alias("warned_treatment"), (T.abstains(c("text"), F.lit(0)) == 1).alias("_declines"))
    for part in (by_case, unindexed, made_up, pins, misses, quotes, hits, runs):
        out = out.join(part, "answer", "left")
    counts = ("n_cases", "n_verified", "n_name_mismatch", "n_red", "n_yellow", "n_unindexed", "n_fabricated", "n_pin_reference", "n_near_miss", "n_quote_absent", "n_quote_unattributed", "n_quote_rule_text", "gold_hit")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in counts})
    out = out.withColumn("n_cites", c("n_cases") + c("n_fabricated") + c("n_unindexed"))
    equivalent = F.greatest(c("gold_hit"), F.coalesce("_run", F.lit(0))).cast("long")
    return out.withColumns({"gold_equivalent": equivalent, "abstained": ((c("n_cites") == 0) & c("_declines")).cast("int")}).drop("_declines", "_run", "n_cases")


def changed_grades(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A dry run's report: keys and the columns in which a fresh grade differs from the stored one; new and missing rows too."""
    names = [n for n in fresh.columns if n not in keys and n in stored.columns]
    a, b = stored.select(*keys, F.struct(*names).alias("_old")), fresh.select(*keys, F.struct(*names).alias("_new"))
    both = a.join(b, keys, "full")
    differs = F.filter(F.array(*(F.when(~F.col(f"_old.{n}").eqNullSafe(F.col(f"_new.{n}")), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").otherwise("changed")
    return both.withColumns({"kind": kind, "columns": F.array_join(differs, ",")}).where((F.col("kind") != "changed") | (F.col("columns") != "")).select(*keys, "kind", "columns")
