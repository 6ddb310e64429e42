"""The stages of a grade over all orders: each order's answer needs one of them, and the oracle takes the outcome from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import refs as N
from verisect.operators import citations as G
from verisect.operators import grading as D
from verisect.operators import quotations as Q
from verisect.plans.base import query
from verisect.plans.written import COLUMNS, answered, orders

EMPTY = "cast(array() as array<struct<cluster_id:bigint,page:string>>)"


def citation(ord_, raw, parts, last, cluster):
    """A citation as the checker reports it: `raw` in the text at its first or last place, as volume, reporter and page."""
    at = F.length("text") - F.instr(F.reverse("text"), F.reverse(raw)) - F.length(raw) + 1 if last else F.instr("text", raw) - 1
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(ord_).alias("ord"), raw.alias("raw"), *(x.alias(n) for n, x in zip(("volume", "reporter", "page"), parts, strict=True)), at.cast("int").alias("start"), cluster.cast("long").alias("cluster_id"), none.alias("resolution"),
        F.when(cluster.isNotNull(), F.lit("Lee v. Ray")).alias("case_name"), F.when(cluster.isNotNull(), F.lit("green")).alias("flag"), F.when(cluster.isNotNull(), F.lit("match")).alias("party_verdict"), none.alias("lhs"), none.alias("rhs"), F.expr(EMPTY).alias("did_you_mean"),
    )


def checked(rows, *cites):
    """Citations of texts: of one citation(), or of all that are given, which aren't null."""
    return rows.select("answer", F.explode(F.array_compact(F.array(*cites))).alias("c")).select("answer", "c.*")


def staged(t):
    """Answers, their citations and what reconciliation found, by the order's party: five ways in which a second citation is settled."""
    text = """CASE party % 5
        WHEN 0 THEN concat('Lee v. Ray, ', cite, ', 480 N.E.2d 679 (Fla. 1960). It is said in all the later cases of this court that one should treat 480 N.E.2d 679 as unverified.')
        WHEN 1 THEN concat('Lee v. Ray, ', cite, ' (Fla. 1960). Quite another matter was decided much earlier in Moon v. Sun, 71 Fla. 177 (Fla. 1916).')
        WHEN 2 THEN concat('Lee v. Ray, ', cite, ', 71 Fla. 177 (Fla. 1960). So it was decided.')
        WHEN 3 THEN concat('Lee v. Ray, ', cite, ' (Fla. 1960), was decided as the court then did see 71 Fla. 177 decide.')
        ELSE concat('Lee v. Ray, ', cite, ' (Fla. 1960). Quite another matter was decided much later in Moon v. Sun, ', volume, ' So. 3d ', page + 5, ' (Fla. 2010).') END"""
    rows = answered(t, text=text)
    answers = rows.select("answer", "text", F.lit(-1).cast("long").alias("gold_cluster_id"), F.lit("Gold v. Silver, 7 U.S. 8").alias("gold_citation"), F.lit("x").alias("proposition"))
    kind, lit, none = F.col("party") % 5, F.lit, F.lit(None)
    page = (F.col("page").cast("long") + 5).cast("string")
    second = (F.when(kind == 0, "480").when(kind == 4, F.col("volume")).otherwise("71"), F.when(kind == 0, "N.E.2d").when(kind == 4, "So. 3d").otherwise("Fla."), F.when(kind == 0, "679").when(kind == 4, page).otherwise("177"))
    cites = checked(rows, citation(1, F.col("cite"), (F.col("volume"), lit("So. 2d"), F.col("page")), False, F.col("party")), citation(2, F.concat_ws(" ", *second), second, True, none))
    reconciled = rows.select("answer", lit(2).alias("ord"), lit("fabricated").alias("status"), none.cast("long").alias("cluster_id"))
    return answers, cites, reconciled


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, 1 AS ord, 'resolved' AS status, NULL AS route, NULL AS near FROM o
    UNION ALL SELECT CAST(id AS VARCHAR), 2, CASE party % 5 WHEN 1 THEN 'unindexed_real' WHEN 4 THEN 'fabricated' ELSE 'parallel' END, CASE party % 5 WHEN 0 THEN 'recurs_in_chain' WHEN 1 THEN 'old_official_unindexed' WHEN 2 THEN 'chain' WHEN 3 THEN 'same_sentence' END,
        CASE party % 5 WHEN 4 THEN 'reporter_series' END FROM o"""
)
def d1_stages_of_orders(spark, t):
    """Citations that recur in a chain, stand in old official reports, in a chain, beside a regional one, or near a cited case."""
    answers, cites, reconciled = staged(t)
    found = D.classify(answers, cites, reconciled)
    near = D.near_miss_tags(answers, found).select("answer", "ord", F.col("kind").alias("near"))
    rows = found.select("answer", "ord", "status", "route")
    # Only made-up citations have a tag to look up.
    tagged = rows.where("status = 'fabricated'").join(near, ["answer", "ord"], "left")
    return tagged.unionByName(rows.where("status <> 'fabricated'").withColumn("near", F.lit(None).cast("string")))


RULE = "concat('a party may move in part', party % 9, 'x for judgment on all or part of a claim')"
SPOKEN = "the court of appeal spoke these very words to party of that name"


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, CASE party % 5 WHEN 0 THEN 'rule_text' WHEN 1 THEN 'rule_text' WHEN 2 THEN 'absent' WHEN 3 THEN 'unattributed' ELSE 'found' END AS verdict,
    CASE party % 5 WHEN 0 THEN 'Fed. R. Civ. P. 15(a)(2)' WHEN 1 THEN concat('MCR 2.', party % 9) END AS rule FROM o"""
)
def d1_quotations_of_orders(spark, t):
    """A quotation of a rule of the fixed list, of a rule that is named, of the same rule unnamed, of a docket's opinion, and of the cited case."""
    text = f"""concat('In Lee v. Ray, ', cite, ' (Fla. 1960), the court held this. ', CASE party % 5
        WHEN 0 THEN concat('The rule reads "court should freely give leave when justice so requires." So Lee v. Ray, ', cite, '.')
        WHEN 1 THEN concat('By MCR 2.', party % 9, ' the court said "', {RULE}, '" in Lee v. Ray, ', cite, '.')
        WHEN 2 THEN concat('The court said "', {RULE}, '" in Lee v. Ray, ', cite, '.')
        WHEN 3 THEN concat('The court said "there was never any such case in all the books of law" in Moon v. Sun, No. 12-345, like Lee v. Ray, ', cite, '.')
        ELSE concat('The court said "{SPOKEN}" in Lee v. Ray, ', cite, '.') END)"""
    rows = orders(t, text=text, rule=RULE).withColumn("answer", F.col("id").cast("string"))
    answers = rows.select("answer", "text")
    cited = rows.select("answer", F.lit(1).alias("ord"), F.col("cite").alias("raw"), (F.instr("text", F.col("cite")) - 1).alias("start"), F.col("party").cast("long").alias("cluster_id"), F.lit("resolved").alias("status"))
    again = cited.join(rows.select("answer", "text"), "answer").select("answer", F.lit(2).alias("ord"), "raw", (F.length("text") - 1 - F.length("raw")).alias("start"), "cluster_id", "status")
    opinions = rows.select(F.col("party").cast("long").alias("cluster_id")).distinct().withColumn("text", F.lit(f"We hold that {SPOKEN} once."))
    rules = rows.select(F.lit("mi").alias("jurisdiction"), F.concat(F.lit("MCR 2."), (F.col("party") % 9).cast("string")).alias("rule"), F.concat(F.lit("Motion. "), F.col("rule"), F.lit(".")).alias("text")).distinct()
    return D.grade_quotes(answers, cited.unionByName(again), opinions, rules).select("answer", "verdict", "rule")


@query(
    f"""WITH o AS ({COLUMNS}) SELECT id, CASE party % 4 WHEN 0 THEN 'Fed. R. Evid. 403 (2011-); MRE 403 (2024-)' WHEN 1 THEN concat('MCR 2.', party % 9) WHEN 2 THEN concat('MCR 2.', party % 9) END AS rule, CASE party % 4 WHEN 0 THEN 'fixed_list' WHEN 3 THEN NULL ELSE 'named_rule' END AS via FROM o WHERE party % 4 < 3"""
)
def q11_rules_of_orders(spark, t):
    """Rules by the fixed list, named before and after a quotation, and, of the same rule, named too far away or behind four others."""
    far = "repeat('and so on and on ', 60)"
    quote = f"CASE party % 4 WHEN 0 THEN 'relevant evidence if its probative value is substantially outweighed by a danger' ELSE {RULE} END"
    name = "concat('MCR 2.', party % 9)"
    text = f"""CASE party % 4 WHEN 1 THEN concat({name}, ' says ', quote) WHEN 2 THEN concat('It says ', quote, '. So ', {name}, ' it is.')
        WHEN 3 THEN CASE WHEN id % 2 = 0 THEN concat({name}, {far}, quote) ELSE concat('FRCP 1, FRCP 2, FRCP 3, FRCP 4, ', {name}, quote) END ELSE concat('It says ', quote) END"""
    rows = orders(t, quote=quote).withColumn("text", F.expr(text)).withColumn("answer", F.col("id"))
    quotes = rows.select("answer", "quote", (F.instr("text", F.col("quote")) - 1).alias("start")).withColumn("end", F.col("start") + F.length("quote"))
    rules = orders(t, text=RULE).select(F.lit("mi").alias("jurisdiction"), F.concat(F.lit("MCR 2."), (F.col("party") % 9).cast("string")).alias("rule"), "text").distinct()
    return Q.rule_texts(rows.select("answer", "text"), quotes, rules, ["answer"]).select(F.col("answer").alias("id"), "rule", "via")


@query(
    """WITH q AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS s, l_partkey + 300 AS e FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT DISTINCT l_orderkey AS id, l_suppkey * 20 AS s, l_suppkey * 20 + l_linenumber AS e FROM lineitem)
    SELECT q.id, q.s AS start, count(c.s) AS met FROM q JOIN c ON q.id = c.id AND c.s < q.e AND q.s < c.e GROUP BY 1, 2"""
)
def j15_spans_that_meet_by_order(spark, t):
    """The interval join: spans of an order's lines along one axis, each with the number of those it shares a place with."""
    from verisect.operators.intervals import overlapping

    spans = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 300).alias("end")).distinct()
    others = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") * 20).alias("start"), (F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("end")).distinct()
    return overlapping(spans, others, ["id"]).groupBy("id", "start").agg(F.count(F.lit(1)).alias("met"))


def spelled(n: str) -> str:
    """A word for a number: each digit as two letters that no other digit has."""
    word = f"lpad(cast({n} as string), 6, '0')"
    for digit, letters in zip("0123456789", ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"), strict=True):
        word = f"replace({word}, '{digit}', '{letters}')"
    return word


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey")
def j14_names_of_customers_and_suppliers(spark, t):
    """The join of misspelled names: suppliers write the customer of their number without a letter, and every other one swaps the parties."""
    from verisect.operators import fuzzy

    right, wrong = ("concat('Uv', {})", "concat('U', {})")
    parties = t("customer").select("c_custkey", F.expr(f"concat({right.format(spelled('c_custkey'))}, ' v. ', {right.format(spelled('c_custkey * 3 + 1'))})").alias("name"))
    one, two = wrong.format(spelled("s_suppkey")), wrong.format(spelled("s_suppkey * 3 + 1"))
    cases = t("supplier").select("s_suppkey", F.expr(f"CASE WHEN s_suppkey % 2 = 0 THEN concat({one}, ' v. ', {two}) ELSE concat({two}, ' v. ', {one}) END").alias("case_name"))
    return parties.join(fuzzy.similar_names(parties, cases), "name").join(cases, "case_name").select("c_custkey", "s_suppkey")


PRINTED = "doc_id % 40 + 1, ' So. 2d ', doc_id % 25 + 1"


@query(
    """WITH w AS (SELECT c_custkey AS id, c_custkey % 40 + 1 AS v, c_custkey % 25 + 1 AS p, c_custkey % 4 AS kind FROM customer), d AS (SELECT doc_id % 40 + 1 AS v, doc_id % 25 + 1 AS p, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1, 2)
    SELECT id, CASE WHEN kind <> 1 THEN n END AS citers, CASE WHEN kind IN (0, 3) AND (n > 0 OR kind = 3) THEN 'unindexed_real' ELSE 'fabricated' END AS status, CASE WHEN kind = 3 THEN 'search_cases' WHEN kind = 0 AND n > 0 THEN 'cited_by_courts' END AS route,
        concat_ws('+', CASE WHEN kind = 2 THEN 'search_cases 1 no' WHEN kind = 3 THEN 'search_cases 1 yes' END, CASE WHEN kind <> 1 AND n > 0 THEN concat('cited_by_courts ', n, CASE WHEN kind = 0 THEN ' yes' ELSE ' no' END) END) AS attempts
    FROM w LEFT JOIN d USING (v, p)"""
)
def a24_courts_that_print_the_citation(spark, t):
    """Citations looked up in an index of those that documents print: beside the right name, another name, of a case found at another page, of an accepted case."""
    name = lambda v, p: f"concat('Ka', {spelled(f'({v}) * 100 + {p}')}, ' v. State')"
    printed = f"concat(coalesce(text, ''), ' It was so held in ', {name('doc_id % 40 + 1', 'doc_id % 25 + 1')}, ', ', {PRINTED}, ', and again at ', {PRINTED}, ', 9.')"
    opinions = t("documents").select(F.col("doc_id").alias("cluster_id"), F.expr(printed).alias("text"))
    v, p = "c_custkey % 40 + 1", "c_custkey % 25 + 1"
    right = name(v, p)
    wanted = t("customer").select(
        F.col("c_custkey").alias("cite"), F.expr(f"cast({v} as string)").alias("volume"), F.lit("So. 2d").alias("reporter"), F.expr(f"cast({p} as string)").alias("page"),
        F.expr(f"CASE WHEN c_custkey % 4 = 1 THEN 'Zwyxt v. Zwyxt' ELSE {right} END").alias("name"), F.lit("Fla.").alias("court"), F.lit(1950).alias("year"), F.lit(1949).cast("long").alias("lo"), F.lit(1952).cast("long").alias("hi"),
    )
    found = wanted.where("cite % 4 >= 2").select(
        "cite", F.lit("search_cases").alias("route"), F.lit(1).alias("ord"), F.col("cite").cast("long").alias("cluster_id"), F.col("name").alias("case_name"), F.lit(1950).alias("year"), F.lit("Supreme Court of Florida").alias("court"),
        F.when(F.col("cite") % 4 == 2, F.concat("volume", F.lit(" So. 2d 999"))).otherwise(F.concat("volume", F.lit(" So. 2d "), "page")).alias("cites"),
    )
    out = G.reconcile(wanted, found, G.citation_index(opinions))
    said = F.array_join(F.transform("attempts", lambda a: F.concat_ws(" ", a["route"], a["n"], F.when(a["accepted"], "yes").otherwise("no"))), "+")
    return out.select(F.col("cite").alias("id"), "citers", "status", "route", said.alias("attempts"))


@query(
    f"""WITH o AS ({COLUMNS}) SELECT id, 'full' AS kind, 'Mejiax v. Ortegax' AS stands_for FROM o UNION ALL SELECT id, 'full', 'Kahnx' FROM o UNION ALL SELECT id, 'name', 'Mejiax v. Ortegax' FROM o UNION ALL SELECT id, 'name', 'Kahnx' FROM o
    UNION ALL SELECT id, CASE party % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'supra' ELSE 'noncase' END, CASE party % 3 WHEN 2 THEN NULL ELSE 'Mejiax v. Ortegax' END FROM o UNION ALL SELECT id, 'name', 'Mejiax v. Ortegax' FROM o WHERE party % 3 = 1"""
)
def q19_names_in_text_of_orders(spark, t):
    """Two full citations with their names, and the first case named again, by name or by supra, or a treatise."""
    text = "concat('Mejiax v. Ortegax, ', cite, ' (Fla. 1950). ', repeat('Much else was said of it. ', 8), 'Kahnx v. State, 20 F.3d 7. ', CASE party % 3 WHEN 0 THEN 'So it was in Mejiax once.' WHEN 1 THEN 'But see also Mejiax, supra, at 9.' ELSE 'So has Corbin said.' END)"
    refs = orders(t, text=text).select("id", F.explode(N.citation_refs("text")).alias("r"))
    return refs.select("id", "r.kind", F.when(F.col("r.target") == 19, "Mejiax v. Ortegax").when(F.col("r.target") > 19, "Kahnx").alias("stands_for"))


@query(
    f"""WITH o AS ({COLUMNS}) SELECT id, CASE party % 3 WHEN 0 THEN 'closest_before' WHEN 1 THEN 'earlier' ELSE 'right_after' END AS rule, CASE party % 3 WHEN 0 THEN 'Mejiax' ELSE cite END AS ref,
    CASE party % 3 WHEN 0 THEN concat('So Mejiax held "the purpose of p', party, 'x is to inform" there.') WHEN 1 THEN concat('The court held "the purpose of p', party, 'x is to inform" there.')
        ELSE concat('The court held "the purpose of p', party, 'x is to inform." Mejiax v. Ortegax, ', cite, '.') END AS sentence,
    CASE party % 3 WHEN 1 THEN concat('Mejiax v. Ortegax, ', cite, ' is old.') END AS cite_sentence FROM o"""
)
def q20_sentences_of_orders(spark, t):
    """A quotation beside a case that is only named, one in a paragraph without references, one before its citation; with the sentence that shows it."""
    quote = "concat('the purpose of p', party, 'x is to inform')"
    text = f"""CASE party % 3 WHEN 0 THEN concat('Mejiax v. Ortegax, ', cite, ' (Fla. 1950), is old. So Mejiax held "', {quote}, '" there.') WHEN 1 THEN concat('Mejiax v. Ortegax, ', cite, ' is old.\n\nThe court held "', {quote}, '" there.')
        ELSE concat('It is old. The court held "', {quote}, '." Mejiax v. Ortegax, ', cite, '.') END"""
    rows = orders(t, quote=quote, text=text)
    return rows.select("id", N.attribute_quote("text", "quote").alias("a")).select("id", "a.rule", "a.ref", "a.sentence", "a.cite_sentence")


def credited(t):
    """Answers that quote, and their citations: of the case that holds the words, of another one, of none."""
    words = "concat('the purpose of p', party, 'x is to inform the court')"
    text = f"""CASE party % 3 WHEN 0 THEN concat('It is old. The court said "', {words}, '." Lee v. Ray, ', cite, '.')
        WHEN 1 THEN concat('It is old. The court said "', {words}, '." Lee v. Ray, ', cite, '. But see Roe v. Wade, 410 U.S. 113.')
        ELSE concat('It is old. The court said "never were such words in any opinion heard." Lee v. Ray, ', cite, '.') END"""
    rows = orders(t, text=text).withColumn("answer", F.col("id").cast("string"))
    cites = checked(rows, citation(1, F.col("cite"), (F.col("volume"), F.lit("So. 2d"), F.col("page")), False, F.col("party")))
    cites = cites.unionByName(checked(rows.where("party % 3 = 1"), citation(2, F.lit("410 U.S. 113"), (F.lit("410"), F.lit("U.S."), F.lit("113")), False, -1 - F.col("party"))))
    own = rows.select(F.col("party").cast("long").alias("cluster_id"), F.expr(f"CASE WHEN party % 3 = 0 THEN concat('We say that ', {words}, ' now.') ELSE 'We say that the purpose is another one.' END").alias("text")).distinct()
    other = rows.where("party % 3 = 1").select((-1 - F.col("party")).cast("long").alias("cluster_id"), F.expr(f"concat('They say that ', {words}, ' now.')").alias("text")).distinct()
    return rows.select("answer", "text"), cites.withColumn("status", F.lit("resolved")), own.unionByName(other)


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, 'right_after' AS credited_by, party AS credited, true AS credited_was_searched,
    CASE party % 3 WHEN 2 THEN concat('The court said "never were such words in any opinion heard." Lee v. Ray, ', cite, '.') ELSE concat('The court said "the purpose of p', party, 'x is to inform the court." Lee v. Ray, ', cite, '.') END AS sentence,
    CASE party % 3 WHEN 2 THEN 'never were such words in any opinion heard.' ELSE concat('the purpose of p', party, 'x is to inform the court.') END AS marked, CASE party % 3 WHEN 0 THEN 9 END AS run, CASE party % 3 WHEN 0 THEN concat('We say that the purpose of p', party, 'x is to inform the court now.') END AS passage,
    CASE party % 3 WHEN 1 THEN -1 - party END AS elsewhere FROM o"""
)
def d8_quote_items_of_orders(spark, t):
    """Audit items of quotations: words of the credited case, words of another cited case, and words of nobody."""
    from verisect.operators import audit

    answers, cites, opinions = credited(t)
    quotes = D.quoted(answers).withColumns({"verdict": F.lit("absent"), "kind": F.lit("fabricated"), "cluster_id": F.lit(None).cast("long")})
    items = audit.quote_items(answers, quotes, cites, opinions)
    marked = F.substring("sentence", F.col("marks.quote_start") + 1, F.col("marks.quote_end") - F.col("marks.quote_start"))
    return items.select("answer", "credited_by", "credited", "credited_was_searched", "sentence", marked.alias("marked"), F.col("passage.run").alias("run"), F.col("passage.passage").alias("passage"), F.col("elsewhere.cluster_id").alias("elsewhere"))


@query(f"WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, party AS cluster_id, 'Lee v. Ray' AS case_name, concat(cite, '+', cite) AS cites, concat('See Moon v. Sun, ', cite, ' (Fla. 1950). Moon, ', cite, ' again.') AS context FROM o WHERE party % 2 = 0")
def d8_name_items_of_orders(spark, t):
    """Audit items of names: a case that is cited twice, each time under other parties, or once under its own."""
    from verisect.operators import audit

    rows = orders(t, text="concat('See Moon v. Sun, ', cite, ' (Fla. 1950). Moon, ', cite, ' again.')").withColumn("answer", F.col("id").cast("string"))
    parts = (F.col("volume"), F.lit("So. 2d"), F.col("page"))
    wrong = lambda df, lhs, rhs, verdict: df.withColumns({"lhs": lhs, "rhs": rhs, "party_verdict": verdict})
    cites = wrong(checked(rows, citation(1, F.col("cite"), parts, False, F.col("party"))), F.lit("Moon"), F.lit("Sun"), F.lit("mismatch"))
    second = F.when(F.col("cluster_id") % 2 == 0, "mismatch").otherwise("match")
    cites = cites.unionByName(wrong(checked(rows, citation(2, F.col("cite"), parts, True, F.col("party"))), F.lit("Moon"), F.lit("Sun"), second)).withColumn("status", F.lit("resolved"))
    answers = rows.select("answer", "text")
    items = audit.name_items(answers, cites, D.name_verdicts(cites.join(answers, "answer")))
    return items.select("answer", "cluster_id", "case_name", F.array_join(F.transform("cites", lambda x: x["raw"]), "+").alias("cites"), "context")


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, CASE party % 6 WHEN 0 THEN 'unattributed' WHEN 1 THEN 'unattributed' WHEN 4 THEN 'found' WHEN 5 THEN 'unattributed' ELSE 'absent' END AS verdict,
    CASE party % 6 WHEN 0 THEN 'detached' WHEN 1 THEN 'detached' WHEN 2 THEN 'reattached' WHEN 4 THEN 'found_in_withdrawn_hit' END AS change, CASE party % 6 WHEN 0 THEN 'no resolved opinion' WHEN 1 THEN 'unresolved citation' WHEN 5 THEN 'unresolved citation' END AS reason FROM o"""
)
def d15_reused_quotations_of_orders(spark, t):
    """Stored quotations after their answers lost a hit (the only one, or one of two), gained a pin, or neither; no opinion is read."""
    text = """concat('The court said "never were such words in any opinion heard" in Lee v. Ray, ', cite, '.', CASE WHEN party % 6 IN (1, 3, 5) THEN ' Elsewhere, and on quite another matter altogether, it is as in the old case of Roe v. Wade, 410 U.S. 113, too.' ELSE '' END)"""
    rows = orders(t, text=text).withColumn("answer", F.col("id").cast("string"))
    kind = F.col("party") % 6
    known = F.when(kind.isin(2, 3), F.col("party"))  # the quotation's own citation, as it stands now
    cites = checked(rows, citation(1, F.col("cite"), (F.col("volume"), F.lit("So. 2d"), F.col("page")), False, known)).withColumn("status", F.when(F.col("cluster_id").isNotNull(), "resolved").otherwise("fabricated"))
    cites = cites.unionByName(checked(rows.where(kind.isin(1, 3, 5)), citation(2, F.lit("410 U.S. 113"), (F.lit("410"), F.lit("U.S."), F.lit("113")), False, F.lit(-1))).withColumn("status", F.lit("resolved")))
    withdrawn = rows.where(kind.isin(0, 1, 4)).select("answer", F.col("party").cast("long").alias("cluster_id"))
    was = F.when(kind.isin(2, 5), "unattributed").when(kind == 4, "found").otherwise("absent")
    before = D.quoted(rows.select("answer", "text")).join(rows.select("answer", was.alias("verdict"), F.when(kind == 4, F.col("party")).cast("long").alias("cluster_id"), F.when(kind.isin(2, 5), D.UNRESOLVED).alias("reason")), "answer")
    before = before.withColumns({"kind": F.lit("fabricated"), "paraphrase_ratio": F.lit(0.1), "rule": F.lit(None).cast("string")})
    return D.regrade_quotes(rows.select("answer", "text"), before, cites, withdrawn).select("answer", "verdict", "change", "reason")


@query(
    """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'proper_nouns_or_ocr' WHEN 2 THEN 'flag' WHEN 3 THEN 'cite_sanity' WHEN 4 THEN 'vol_year_mismatch' WHEN 5 THEN 'bad_case_name' WHEN 6 THEN 'party_name_in_prop' WHEN 7 THEN 'first_person' END AS skipped FROM documents"""
)
def d7_reasons_of_documents(spark, t):
    """A proposition and a case for every document, each with one fault or none: words of no dictionary, flag, reporter, volume, caption, party, person; and words of the law."""
    from verisect.operators import questions as B

    kind = "CASE doc_id % 9 WHEN 1 THEN 'zqbert and zqarth' WHEN 6 THEN 'zqberg' WHEN 7 THEN 'our state' WHEN 8 THEN 'habeas corpus mandamus' ELSE 'each party' END"
    text = f"concat('A trial court must weigh the plea of ', {kind}, ' before it may enter the final judgment in the matter.')"
    rows = t("documents").select(
        "doc_id", F.expr(text).alias("proposition"), F.expr("CASE doc_id % 9 WHEN 2 THEN 'grey' ELSE 'green' END").alias("gold_flag"), F.expr("concat(100 + doc_id % 3, CASE doc_id % 9 WHEN 3 THEN ' S.W.2d ' ELSE ' So. 2d ' END, doc_id + 1)").alias("gold_citation"),
        F.expr("CASE doc_id % 9 WHEN 4 THEN '1950-01-01' ELSE '1990-01-01' END").alias("date_filed"), F.expr("CASE doc_id % 9 WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Zqberg v. State' ELSE 'Moon v. Florida' END").alias("case_name"),
    )
    words = spark.sql("SELECT explode(split('a trial court must weigh the plea of before it may enter final judgment in matter each party our state and', ' ')) AS word")
    propositions = rows.select(F.col("doc_id").alias("rowid"), F.col("doc_id").alias("cluster_id"), F.lit(1).alias("rank"), "proposition", F.lit(1).alias("citation_count"), F.lit(1).alias("distinct_citers"))
    cases = rows.select(F.col("doc_id").alias("cluster_id"), F.lit("fl").alias("stratum"), "case_name", "date_filed", "gold_citation", "gold_flag")
    return B.question_reasons(propositions, cases, words).select(F.col("rowid").alias("doc_id"), "skipped")
