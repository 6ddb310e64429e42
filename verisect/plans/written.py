"""Operators of position-dependent text logic over whole tables: texts are written from the columns of orders, and the oracle
takes the answers from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import refs as N
from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import citations as G
from verisect.operators import grading as D
from verisect.operators import quotations as Q
from verisect.operators import reports as R
from verisect.operators import rules
from verisect.operators import spans as P
from verisect.operators.joins import spread
from verisect.plans.base import query
from verisect.plans.reports import METRICS, RUNS

VOLUME, PAGE = "(o_custkey % 900 + 1)", "(o_orderkey % 9000 + 1)"
CITE = f"concat({VOLUME}, ' So. 2d ', {PAGE})"
#: The same in both dialects: concat() casts numbers to text.
COLUMNS = f"SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS party, CAST({VOLUME} AS VARCHAR) AS volume, CAST({PAGE} AS VARCHAR) AS page, {CITE} AS cite, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year FROM orders"


def orders(t, **texts: str):
    """id, status, party, volume, page, cite and year of every order, and texts by SQL expressions over them."""
    return _read(spread(t("orders"), "o_orderkey"), texts)


def answered(t, **texts: str):
    """orders() with `answer`, their key as a text, by which they are dealt out: an answer's text, citations and quotations are where they meet."""
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("answer"))
    return _read(spread(rows, "answer"), texts, "answer")


def _read(rows, texts, *kept: str):
    year = F.year(F.col("o_orderdate").cast("date"))
    volume, page = (F.expr(x).cast("string") for x in (VOLUME, PAGE))
    rows = rows.select(*kept, F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("party"), volume.alias("volume"), page.alias("page"), F.concat(volume, F.lit(" So. 2d "), page).alias("cite"), year.alias("year"))
    for name, text in texts.items():
        rows = rows.withColumn(name, F.expr(text))
    return rows


@query(f"WITH o AS ({COLUMNS}) SELECT id, concat(volume, '|so2d|', page) AS key FROM o UNION ALL SELECT id, '5|f3d|6' FROM o")
def s20_cite_keys_of_orders(spark, t):
    rows = orders(t, text="concat('See A v. B, ', cite, ' (Fla. ', year, '); and 5 F.3d 6, 9. Again 5 F. 3d 6.')")
    return rows.select("id", F.explode(C.cite_keys(F.col("text"))).alias("key"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE WHEN status <> 'P' THEN volume END AS volume, CASE WHEN status <> 'P' THEN 'So. 2d' END AS reporter, CASE WHEN status <> 'P' THEN page END AS page FROM o")
def s21_whole_cites_of_orders(spark, t):
    rows = orders(t, text="CASE WHEN status <> 'P' THEN concat(' ', cite, ' ') ELSE concat('page ', page) END")
    return rows.select("id", C.whole_cite(F.col("text")).alias("w")).select("id", "w.*")


@query(f"WITH o AS ({COLUMNS}) SELECT id, concat('Party', party, ' v. State') AS name, cite, CASE status WHEN 'F' THEN 'Fla.' WHEN 'O' THEN 'Fla. 4th DCA' ELSE '' END AS court, CAST(year AS VARCHAR) AS year FROM o")
def s23_bluebook_of_orders(spark, t):
    court = "CASE status WHEN 'F' THEN 'Fla. ' WHEN 'O' THEN 'Fla. 4th DCA ' ELSE '' END"
    rows = orders(t, text=f"concat('Party', party, ' v. State, ', cite, CASE WHEN id % 2 = 0 THEN ', 12' ELSE '' END, ' (', {court}, year, ').')")
    return rows.select("id", C.bluebook(F.col("text")).alias("b")).select("id", "b.*")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE WHEN status = 'F' THEN 'Fla.' END AS court, CASE WHEN status <> 'P' THEN year END AS year FROM o")
def s26_parentheticals_of_orders(spark, t):
    """After the citation, before it, or nowhere near."""
    rows = orders(t, text="CASE status WHEN 'F' THEN concat('Lee, ', cite, ', 7 (Fla. ', year, ') holds') WHEN 'O' THEN concat('Lee (', year, ') ', cite, ' holds') ELSE concat('Lee, ', cite, ' holds') END")
    start = F.instr("text", F.col("cite")) - 1
    return rows.select("id", C.parenthetical(F.col("text"), start, start + F.length("cite")).alias("p")).select("id", "p.*")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('Party', party, ' v. de la State') WHEN 'O' THEN concat('Estate of Party', party) END AS name FROM o")
def s27_claimed_names_of_orders(spark, t):
    """A caption after a signal, a one-sided one after a clause, a field label."""
    rows = orders(t, text="CASE status WHEN 'F' THEN concat('The rule is settled. See also Party', party, ' v. de la State, ', cite) WHEN 'O' THEN concat('Moon v. Sun; as held in Estate of Party', party, ', ', cite) ELSE concat('Citation: ', cite) END")
    return rows.select("id", U.claimed_name("text", F.instr("text", F.col("cite")) - 1).alias("name"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, status <> 'O' AS history FROM o")
def s28_histories_of_orders(spark, t):
    rows = orders(t, text="concat('Moon v. Sun, 1 U.S. 2, ', CASE status WHEN 'F' THEN 'review denied, ' WHEN 'P' THEN 'cert. was later granted, ' ELSE 'and we rely on ' END, cite)")
    return rows.select("id", C.is_history(F.col("text"), (F.instr("text", F.col("cite")) - 1).cast("int")).alias("history"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CAST(status = 'F' AS INT) AS warned FROM o")
def q14_warnings_of_orders(spark, t):
    rows = orders(t, text="concat('Party', party, ' v. State, ', cite, CASE status WHEN 'F' THEN ' is not old; it was overruled.' WHEN 'O' THEN ' has never been overruled.' ELSE ' stands.' END)")
    return rows.select("id", U.warned("text").alias("warned"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE WHEN status = 'F' THEN 'did not verify' WHEN status = 'O' AND id % 2 = 0 THEN 'corrected' WHEN status = 'O' THEN 'wasn''t able to verify' END AS phrase FROM o")
def q16_q17_retractions_of_orders(spark, t):
    text = """CASE WHEN status = 'F' THEN concat('The citation, ', cite, ', did not verify.') WHEN status = 'O' AND id % 2 = 0 THEN concat('I first cited ', cite, ' there; the correct one is 1 U.S. 2.')
        WHEN status = 'O' THEN concat('I wasn\\'t able to verify Party', party, ' v. State, ', cite, '.') ELSE concat(cite, ' holds so; I could not confirm its subsequent history.') END"""
    rows = orders(t, text=text)
    start = F.instr("text", F.col("cite")) - 1
    return rows.select("id", U.retracted("text", start, start + F.length("cite")).alias("phrase"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS sentences FROM o")
def q18_sentences_of_orders(spark, t):
    rows = orders(t, text="concat('Party', party, ' of Nev. Corp. won in D.C. Courts so far', CASE status WHEN 'F' THEN '. It is so! Next, (see W.Va. Code)' WHEN 'O' THEN '.\\nNext' ELSE ' and no. 5' END)")
    return rows.select("id", F.size(U.sentences("text")).alias("sentences"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE WHEN status <> 'P' THEN concat('the moving party must show that case ', id, ' is final') ELSE concat('quoting order ', id, ' of the court in this place') END AS quote, CASE WHEN status = 'P' THEN 'signal' WHEN status = 'O' THEN 'unattributed_talk' END AS skipped FROM o")
def q1_quotations_of_orders(spark, t):
    text = """CASE status WHEN 'F' THEN concat('The court held "the moving party must show that case ', id, ' is final" in A v. B, ', cite, '.') WHEN 'O' THEN concat('I add "the moving party must show that case ', id, ' is final" here.')
        ELSE concat('A v. B, ', cite, ' ("quoting order ', id, ' of the court in this place").') END"""
    return orders(t, text=text).select("id", F.explode(U.extract_quotes("text")).alias("q")).select("id", "q.quote", "q.skipped")


PRIORITY = "regexp_replace(lower(o_orderpriority), '^[0-9]-', '')"


@query(
    f"""WITH o AS (SELECT o_orderkey AS answer, {PRIORITY} AS own, o_orderstatus AS status, row_number() OVER (PARTITION BY 1 ORDER BY o_orderkey) AS n FROM orders),
    c AS (SELECT own AS kind, row_number() OVER (ORDER BY own) AS cluster FROM (SELECT DISTINCT own FROM o))
    SELECT answer, CASE WHEN status = 'F' THEN 'found' ELSE 'absent' END AS verdict, CASE status WHEN 'F' THEN 'verbatim' WHEN 'O' THEN 'paraphrase_in_quotes' ELSE 'fabricated' END AS kind,
        CASE status WHEN 'F' THEN cluster WHEN 'O' THEN cluster % (SELECT count(*) FROM c) + 1 END AS cluster_id FROM o JOIN c ON own = kind"""
)
def q6_quotations_over_opinions_of_orders(spark, t):
    """Each order quotes its priority's rule: from the opinion that holds it, from another one, or from nowhere."""
    rows = t("orders").select(F.col("o_orderkey").alias("answer"), F.expr(PRIORITY).alias("own"), F.col("o_orderstatus").alias("status"))
    kinds = sorted(r[0] for r in rows.select("own").distinct().collect())  # the priorities: a handful
    opinions = spark.createDataFrame([(k + 1, f"We hold that the {kind} rule applies to every party in such a case.") for k, kind in enumerate(kinds)], "cluster_id long, text string")
    number = F.element_at(F.create_map(*(F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k + 1))), F.col("own")).cast("long")
    cited = rows.where("status <> 'P'").select("answer", F.when(F.col("status") == "F", number).otherwise(number % len(kinds) + 1).alias("cluster_id"))
    quotes = rows.select("answer", F.lit(1).alias("ord"), F.concat(F.lit("the "), "own", F.lit(" rule applies to every party")).alias("quote"))
    return Q.match_quotes(quotes, cited, opinions, ["answer", "ord"]).select("answer", "verdict", "kind", "cluster_id")


@query(f"WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS qid, CAST(status <> 'P' AS INT) AS gold_hit FROM o")
def j16_gold_hits_of_orders(spark, t):
    """The gold case is cited by its id, by its citation in another spelling, or not."""
    rows = orders(t, gold="concat('A v. B, ', cite, ' (Fla. ', year, ')')").withColumn("qid", F.col("id").cast("string"))
    gold = rows.select("qid", F.col("party").cast("long").alias("gold_cluster_id"), F.col("gold").alias("gold_citation"))
    by_id, by_cite = F.col("status") == "F", F.col("status") == "O"
    cited = rows.select(
        "qid",
        F.when(by_id, F.col("party")).when(~by_cite, -1 - F.col("party")).cast("long").alias("cluster_id"),
        F.when(by_cite, F.col("volume")).otherwise("9999").alias("volume"),
        F.lit("So.2d").alias("reporter"),
        "page",
    )
    return G.gold_hits(cited, gold, "qid")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('span ', id, '|', cite) WHEN 'O' THEN cite ELSE '' END AS spans, CASE status WHEN 'F' THEN 'object_list' WHEN 'O' THEN 'array' ELSE 'unparsed' END AS how FROM o")
def q30_predictions_of_orders(spark, t):
    text = """CASE status WHEN 'F' THEN concat('<think>[1]</think> {"action": {"response": ["span ', id, '", "', cite, '", null]}} end') WHEN 'O' THEN concat('The spans: ["', cite, '"] and [2]') ELSE concat('none in ', id) END"""
    rows = orders(t, text=text).select("id", U.parse_predictions("text").alias("p"))
    return rows.select("id", F.array_join("p.spans", "|").alias("spans"), F.col("p.status").alias("how"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, status <> 'P' AS leak FROM o")
def q36_tool_calls_of_orders(spark, t):
    text = """CASE status WHEN 'F' THEN concat('```json\\n{"name": "get", "arguments": {"id": ', id, '}}\\n```') WHEN 'O' THEN concat('call:get_case{id:', id, '}') ELSE concat('{"answer": ', id, '}') END"""
    return orders(t, text=text).select("id", U.tool_call_leak("text").alias("leak"))


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, CASE status WHEN 'P' THEN 2 ELSE 1 END AS n_cites, CASE status WHEN 'O' THEN 0 ELSE 1 END AS n_verified, CASE status WHEN 'F' THEN 0 ELSE 1 END AS n_fabricated,
    0 AS n_quote_absent, CASE status WHEN 'O' THEN 1 ELSE 0 END AS n_quote_unattributed, CASE status WHEN 'P' THEN 1 ELSE 0 END AS n_red, CASE status WHEN 'F' THEN 1 ELSE 0 END AS gold_hit, CASE status WHEN 'P' THEN 1 ELSE 0 END AS warned_treatment, 0 AS n_name_mismatch, 0 AS abstained FROM o"""
)
def d1_grades_of_orders(spark, t):
    """An answer an order: its case with a true quotation; a made-up citation with a quotation from elsewhere; bad law beside a made-up citation."""
    name = "concat('Party', party, ' v. State')"
    true, false = "the moving party must show that no fact is in dispute", "these words were never written down by any court at all"
    text = f"""CASE status WHEN 'F' THEN concat('The rule is settled. See ', {name}, ', ', cite, ' (Fla. 1950). The court held "{true}".')
        WHEN 'O' THEN concat('See ', {name}, ', ', cite, ' (Fla. 1950). The court held "{false}". So in Gold v. State, 1 U.S. 2, too.')
        ELSE concat('See ', {name}, ', ', cite, ' (Fla. 1950), which was overruled, and Moon v. Sun, 999 F.3d 1 (2020).') END"""
    rows = answered(t, text=text, name=name)
    c, none = F.col, F.lit(None).cast("string")
    answers = rows.select("answer", "text", F.when(c("status") == "F", c("party")).otherwise(-1).cast("long").alias("gold_cluster_id"), F.lit("Gold v. Silver, 7 U.S. 8").alias("gold_citation"), F.lit("x").alias("proposition"))

    def cite(ord_, raw, volume, reporter, page, cluster, flag):
        known = cluster.isNotNull()
        return F.struct(
            F.lit(ord_).alias("ord"), raw.alias("raw"), volume.alias("volume"), F.lit(reporter).alias("reporter"), page.alias("page"), (F.instr("text", raw) - 1).alias("start"), cluster.cast("long").alias("cluster_id"), none.alias("resolution"),
            F.when(known, c("name")).alias("case_name"), F.when(known, flag).alias("flag"), F.when(known, "match").alias("party_verdict"), none.alias("lhs"), none.alias("rhs"), F.expr("cast(array() as array<struct<cluster_id:bigint,page:string>>)").alias("did_you_mean"),
        )

    first = cite(1, c("cite"), c("volume"), "So. 2d", c("page"), F.when(c("status") != "O", c("party")), F.when(c("status") == "F", "green").otherwise("red"))
    second = F.when(c("status") == "P", cite(2, F.lit("999 F.3d 1"), F.lit("999"), "F.3d", F.lit("1"), F.lit(None), none))
    cites = rows.select("answer", F.explode(F.array_compact(F.array(first, second))).alias("c")).select("answer", "c.*")
    opinions = rows.select(F.col("party").cast("long").alias("cluster_id")).distinct().withColumn("text", F.lit(f"We hold, as ever, that {true}."))
    names = "answer n_cites n_verified n_fabricated n_quote_absent n_quote_unattributed n_red gold_hit warned_treatment n_name_mismatch abstained"
    return D.grade_answers(answers, cites, opinions).select(*names.split())


@query(f"WITH o AS ({COLUMNS}) SELECT id, status = 'F' OR (status = 'O' AND id % 2 = 0) AS passed, CASE WHEN status = 'F' OR (status = 'O' AND id % 2 = 0) THEN 'ok' WHEN status = 'O' THEN 'vendor cite on the answer line' ELSE concat('missing ', lower(cite)) END AS reason FROM o")
def q23_answers_of_orders(spark, t):
    """Answer lines against each order's own gold: the citation, the citation beside a vendor's, another page."""
    text = """CASE WHEN status = 'F' THEN concat('It is so.\nANSWER: ', cite, ' (Fla. ', year, ')') WHEN status = 'O' THEN concat('ANSWER: ', cite, CASE WHEN id % 2 = 1 THEN ', 1999 WL 1' ELSE '' END) ELSE concat('ANSWER: ', volume, ' So. 2d 0', page) END"""
    rows = orders(t, text=text).withColumn("gold", F.to_json(F.struct(F.array("cite").alias("right"), F.lit(True).alias("forbid_vendor"))))
    return rows.select("id", rules.grade_answer("text", "gold", F.lit(None).cast("string")).alias("g")).select("id", "g.passed", "g.reason")


ANSWERED = """SELECT {run} AS run_id, CAST(o_orderkey AS {text}) AS qid, CASE o_custkey % 3 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '[]' END AS tool_calls_json, CASE WHEN o_custkey % 7 > 0 THEN 0.25 * (o_custkey % 5) END AS cost_usd,
    CAST(o_custkey % 11 AS DOUBLE) AS latency_s, CASE WHEN o_custkey % 13 = 0 THEN 'timeout' END AS error FROM orders WHERE {where}"""
GRADED = """SELECT {run} AS run_id, CAST(o_orderkey AS {text}) AS qid, CAST(o_custkey % 6 AS BIGINT) AS n_cites, CAST(o_custkey % 4 AS BIGINT) AS n_verified, CAST(o_custkey % 3 AS BIGINT) AS n_fabricated, CAST(0 AS BIGINT) AS n_unindexed, CAST(o_orderkey % 2 AS BIGINT) AS n_name_mismatch,
    CAST(o_custkey % 2 AS BIGINT) AS n_quote_absent, CAST(o_orderkey % 3 AS BIGINT) AS n_red, CAST((o_orderkey + {turn}) % 2 AS BIGINT) AS gold_hit, CASE WHEN o_orderstatus <> 'P' OR o_custkey % 5 > 0 THEN CAST(1 AS BIGINT) END AS gold_equivalent, CAST(CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS abstained,
    CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 2 AS BIGINT) END AS warned_treatment, CASE WHEN o_custkey % 2 = 0 THEN 'g1' ELSE 'g2' END AS grader_version FROM orders WHERE o_custkey % 13 <> 0 AND {where}"""
ARMS = (("'m:bare:v1'", "1 = 1", 0), ("'m:mcp:v1'", "o_orderstatus <> 'F'", 1), ("'mock:bare:v1'", "o_orderstatus = 'P'", 0))
QUESTIONS = "SELECT CAST(o_orderkey AS {text}) AS qid, CASE o_orderkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS gold_flag FROM orders"


def over_arms(template: str, text: str) -> str:
    return " UNION ALL ".join(template.format(run=run, where=where, turn=turn, text=text) for run, where, turn in ARMS)


TABLES = f"{RUNS.cte()}, answers AS ({over_arms(ANSWERED, 'VARCHAR')}), grades AS ({over_arms(GRADED, 'VARCHAR')}), gold AS ({QUESTIONS.format(text='VARCHAR')})"


def run_tables(spark, t):
    """Runs, answers, grades and gold: every order is a question that one arm answers, and all but finished orders another."""
    t("orders").createOrReplaceTempView("orders_of_runs")
    sql = lambda text: spark.sql(text.replace("FROM orders", "FROM orders_of_runs"))
    return RUNS.df(spark), sql(over_arms(ANSWERED, "STRING")), sql(over_arms(GRADED, "STRING")), sql(QUESTIONS.format(text="STRING"))


@query(
    f"""WITH {TABLES}, f AS (SELECT run_id, count(*) AS answers, count(error) AS errors, sum(coalesce(cost_usd, 0)) AS cost, sum(coalesce(latency_s, 0)) / count(*) AS latency, sum(coalesce(json_array_length(tool_calls_json), 0)) / count(*) AS tools FROM answers GROUP BY 1),
    m AS (SELECT run_id, {METRICS}, string_agg(DISTINCT grader_version, ',' ORDER BY grader_version) AS grader_versions FROM grades LEFT JOIN gold USING (qid) GROUP BY 1)
    SELECT run_id, arm, answers, errors, cost, latency, tools, n, cites, fabricated_rate, misgrounded_rate, red_rate, gold_recall, gold_equiv, abstain_rate, warned_rate, grader_versions FROM runs JOIN f USING (run_id) JOIN m USING (run_id) WHERE run_id NOT LIKE 'mock%'"""
)
def d6_run_report_of_orders(spark, t):
    return R.run_report(*run_tables(spark, t)).drop("model_key", "tag", "fabricated_strict_rate", "n_bad")


@query(
    f"""WITH {TABLES}, g AS (SELECT grades.*, arm, gold_flag FROM grades JOIN runs USING (run_id) LEFT JOIN gold USING (qid) WHERE qid IN (SELECT qid FROM grades WHERE run_id = 'm:mcp:v1') AND run_id IN ('m:bare:v1', 'm:mcp:v1')), m AS (SELECT arm, {METRICS} FROM g GROUP BY arm)
    SELECT 'm' AS model_key, 'v1' AS tag, b.n AS common, x.fabricated_rate - b.fabricated_rate AS d_fabricated_rate, x.misgrounded_rate - b.misgrounded_rate AS d_misgrounded_rate, x.red_rate - b.red_rate AS d_red_rate,
    x.gold_recall - b.gold_recall AS d_gold_recall, x.abstain_rate - b.abstain_rate AS d_abstain_rate, x.warned_rate - b.warned_rate AS d_warned_rate FROM m b JOIN m x ON b.arm = 'bare' AND x.arm = 'mcp'"""
)
def d6_paired_deltas_of_orders(spark, t):
    runs, _, grades, gold = run_tables(spark, t)
    return R.paired_deltas(runs, grades, gold)


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'court:ca11' WHEN 'O' THEN 'state:fl' ELSE 'state:ny' END AS scope FROM o")
def s29_scopes_of_orders(spark, t):
    rows = orders(t, court="CASE status WHEN 'F' THEN '11th Cir.' WHEN 'O' THEN 'Fla. 2d DCA' ELSE '' END", state="CASE status WHEN 'P' THEN 'ny' ELSE 'us' END")
    return rows.select("id", C.court_scope(F.col("court"), F.col("state")).alias("scope"))


STATES = "element_at(array('Florida', 'Georgia', 'West Virginia', 'New Hampshire'), CAST(party % 4 + 1 AS INT))"


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE WHEN status = 'P' THEN 'fed_app' ELSE 'state' END AS kind, CASE WHEN status <> 'P' THEN ['fl', 'ga', 'wv', 'nh'][party % 4 + 1] END AS state, CASE status WHEN 'F' THEN 'sup' WHEN 'O' THEN 'app' END AS level FROM o")
def s30_courts_of_orders(spark, t):
    rows = orders(t, state=STATES, court="CASE status WHEN 'F' THEN concat('Supreme Court of ', state) WHEN 'O' THEN concat('District Court of Appeal of ', state) ELSE 'Eleventh Circuit' END")
    return rows.select("id", C.court_class(F.col("court")).alias("c")).select("id", "c.kind", "c.state", "c.level")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'regional' WHEN 'O' THEN 'fed_app' ELSE 'scotus' END AS kind, CASE status WHEN 'F' THEN 'al fl la ms' END AS states, status = 'F' AND party % 4 = 0 OR status = 'O' AND party % 4 = 1 OR status = 'P' AND party % 4 = 2 AS fits FROM o")
def s31_s32_reporters_of_orders(spark, t):
    """Each reporter against a state court of its region, a federal court of appeals, the highest court, and a state court elsewhere."""
    rows = orders(t, reporter="CASE status WHEN 'F' THEN 'So. 2d' WHEN 'O' THEN 'F.3d' ELSE 'U.S.' END", court="element_at(array('Supreme Court of Florida', 'Ninth Circuit', 'Supreme Court', 'Supreme Court of Georgia'), CAST(party % 4 + 1 AS INT))")
    return rows.select("id", C.reporter_class(F.col("reporter")).alias("c"), C.reporter_fits_court(F.col("reporter"), F.col("court")).alias("fits")).select("id", "c.kind", "c.states", "fits")


@query(f"WITH o AS ({COLUMNS}) SELECT id, concat('party', party, ',water') AS words, status = 'F' AS same, status <> 'F' AS conflict FROM o")
def s34_s35_s36_names_of_orders(spark, t):
    rows = orders(t, name="concat('State v. Party', party, ' Water')", other="CASE status WHEN 'F' THEN concat('Party', party, ' Water v. State') ELSE concat('Moon', party, ' v. Sun') END", side="CASE status WHEN 'F' THEN concat('Party', party) ELSE 'Stars' END")
    words = F.array_join(F.filter(C.search_words(F.col("name")), lambda w: w != "state"), ",")
    return rows.select("id", words.alias("words"), C.names_equivalent(F.col("other"), F.col("name")).alias("same"), C.claim_conflicts(F.col("side"), F.lit(None).cast("string"), F.col("name")).alias("conflict"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, status <> 'P' AS match FROM o")
def j14_fuzzy_names_of_orders(spark, t):
    """A letter more in a long name, sides the other way round, another name."""
    rows = orders(t, claimed="concat('Peterson', party, ' v. Moonlight')", hit="CASE status WHEN 'F' THEN concat('Petersen', party, ' v. Moonlights') WHEN 'O' THEN concat('Moonlight v. Peterson', party) ELSE concat('Peterson', party, ' v. Daylight') END")
    return rows.select("id", U.name_match("claimed", "hit").alias("match"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('Party', party, ' v. State') ELSE '' END AS name, CASE status WHEN 'F' THEN cite ELSE '' END AS cite, CASE status WHEN 'F' THEN 'get_treatment' WHEN 'O' THEN 'find_court' ELSE 'check_brief' END AS tool FROM o")
def s24_passages_of_orders(spark, t):
    rows = orders(t, kind="CASE status WHEN 'F' THEN 'treatment' WHEN 'O' THEN 'court' ELSE 'any' END", text="CASE status WHEN 'F' THEN concat('Party', party, ' v. State, ', cite) ELSE 'no citation' END")
    p = rows.select("id", "status", C.passage_parts(F.col("text")).alias("p"), C.tool_of(F.col("kind"), F.col("text")).alias("tool"))
    return p.select("id", F.when(F.col("status") == "F", F.col("p.name")).otherwise("").alias("name"), "p.cite", "tool")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('Case ', id) WHEN 'O' THEN concat('quoted case ', id, ' here') ELSE concat('item *', id, ' kept bold') END AS flat FROM o")
def s1_markdown_of_orders(spark, t):
    rows = orders(t, text="CASE status WHEN 'F' THEN concat('## Case ', id) WHEN 'O' THEN concat('> quoted `case ', id, '` here') ELSE concat('- item *', id, ' kept **bold**') END")
    return rows.select("id", T.strip_markdown(F.col("text")).alias("flat"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, concat(' the rule of p', party, 'x see roe v wade u s is settled ') AS plain, concat(' the rule of p', party, 'x is settled ') AS stripped, concat('The rule of p', party, 'x held   so.') AS without FROM o")
def s4_s10_opinions_of_orders(spark, t):
    rows = orders(t, text="concat('The rule of p', party, 'x, see Roe v. Wade, ', volume, ' U.S. ', page, ', 116 (1973) is *', party, ' settled.')", other="concat('The rule of p', party, 'x held Roe v. Wade, ', cite, ' (Fla. 1950) so.')")
    return rows.select("id", U.prepare("text").alias("p"), U.strip_cites("other").alias("without")).select("id", "p.*", "without")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('the  “case”\n', id) WHEN 'O' THEN concat('case ', id, ' stands') ELSE 'missing' END AS located, CASE status WHEN 'F' THEN concat('“the *rule*” of ', id) ELSE concat('elsewhere ', id) END AS anchored FROM o")
def s11_s12_places_of_orders(spark, t):
    rows = orders(
        t,
        text="CASE status WHEN 'F' THEN concat('x the  “case”\\n', id, ' y') WHEN 'O' THEN concat('a case ', id, ' stands here') ELSE 'nothing' END",
        needle="CASE status WHEN 'F' THEN concat('the \"case\" ', id) WHEN 'O' THEN concat('[The] case ', id, ' stands.') ELSE 'missing' END",
        spans="concat('so “the *rule*” of ', id, ' is old')",
        span="CASE status WHEN 'F' THEN concat('\"the rule\" of ', id) ELSE concat('elsewhere ', id) END",
    )
    return rows.select("id", U.locate("text", "needle").alias("located"), U.anchor_span("span", "spans").alias("anchored"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'verbatim' WHEN 'O' THEN 'near' END AS kind FROM o")
def q5_segments_of_orders(spark, t):
    """A run of an opinion's words, one with its last words changed, and words from elsewhere."""
    rows = orders(t, hay="concat('the party p', party, 'x must show that there is no genuine dispute as to any fact')", part="CASE status WHEN 'F' THEN concat('party p', party, 'x must show that') WHEN 'O' THEN concat('party p', party, 'x must show that there is no real thing') ELSE concat('nobody p', party, 'x shows anything') END")
    return rows.select("id", T.segment_match(T.match_words(F.col("part")), T.padded(T.match_words(F.col("hay")))).alias("kind"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'verbatim' END AS kind, CASE status WHEN 'O' THEN 1.0 WHEN 'P' THEN 0.0 END AS ratio FROM o")
def q7_q10_parts_of_orders(spark, t):
    """Parts in their order, in the wrong order (whose words all lie in one window), and words from elsewhere."""
    rows = orders(t, hay="concat('In short the first part of p', party, 'x holds and then the other half of it must follow as well.')", quote="CASE status WHEN 'F' THEN concat('the first part of p', party, 'x holds . . . the other half of it must follow') WHEN 'O' THEN concat('the first part of p', party, 'x holds and then') ELSE concat('no such words q', party, 'y anywhere') END")
    wrong = F.when(F.col("status") == "O", F.concat(F.lit("the other half of it . . . the first part of p"), "party", F.lit("x holds"))).otherwise(F.col("quote"))
    return rows.select("id", U.match_ordered(wrong, F.col("hay")).alias("kind"), F.when(F.col("status") != "F", F.round(U.paraphrase_ratio("quote", "hay"), 6)).alias("ratio"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'parenthetical' WHEN 'O' THEN 'right_after' ELSE 'closest_before' END AS rule, cite AS ref FROM o")
def q20_attributions_of_orders(spark, t):
    quote = "concat('the purpose of p', party, 'x is to inform')"
    text = f"""CASE status WHEN 'F' THEN concat('Lee v. Ray, ', cite, ' (Fla. 1999) ("', {quote}, '").') WHEN 'O' THEN concat('The court said "', {quote}, '." Lee v. Ray, ', cite, '.')
        ELSE concat('In Lee v. Ray, ', cite, ', the court wrote at length that "', {quote}, '"; nothing follows.') END"""
    rows = orders(t, text=text, quote=quote)
    return rows.select("id", N.attribute_quote("text", "quote").alias("a")).select("id", "a.rule", "a.ref")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'P' THEN 0 ELSE 5 END AS run, CASE WHEN status <> 'P' THEN concat('so the old rule of p', party, 'x now') END AS passage FROM o")
def q22_passages_of_orders(spark, t):
    rows = orders(t, text="concat('so the old rule of p', party, 'x now')", quote="CASE status WHEN 'P' THEN 'nothing' ELSE concat('this is the old rule of p', party, 'x in short') END")
    return rows.select("id", U.passage("quote", "text").alias("p")).select("id", "p.run", "p.passage")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'P' THEN concat('last ', id) ELSE cite END AS line, status <> 'P' AS found FROM o")
def q24_answer_lines_of_orders(spark, t):
    rows = orders(t, text="CASE status WHEN 'F' THEN concat('Why.\\n**ANSWER: ', cite) WHEN 'O' THEN concat('answer: first\\nAnswer : ', cite, '\\nmore') ELSE concat('one\\nlast ', id, '\\n\\n') END")
    return rows.select("id", T.answer_line(F.col("text")).alias("a")).select("id", "a.*")


@query(f"WITH o AS ({COLUMNS}) SELECT id, status = 'F' AS hit, status = 'O' AS disowned, status <> 'P' AS same FROM o")
def q25_q26_q29_hits_of_orders(spark, t):
    rows = orders(
        t,
        text="CASE status WHEN 'F' THEN concat('not old; p', party, 'x is overruled') ELSE concat('p', party, 'x has not been overruled') END",
        form="CASE status WHEN 'O' THEN concat('3d cir., not ', cite, '.') ELSE concat(cite, ' stands, not ', cite) END",
        gold="concat('the rule of p', party, 'x ... stands')",
        predicted="CASE status WHEN 'P' THEN concat('stands then the rule of p', party, 'x') ELSE concat('the rule of p', party, 'x always stands here') END",
    )
    return rows.select("id", U.has_positive_hit("text", F.lit("overruled")).alias("hit"), U.is_all_disowned("form", "cite").alias("disowned"), T.span_match(F.col("gold"), F.col("predicted")).alias("same"))


@query(
    """WITH n AS (SELECT count(*) AS gold_n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS tp, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS pred FROM orders)
    SELECT 'r' AS run_id, tp AS found, gold_n, tp, pred, round(2 * (tp / pred) * (tp / gold_n) / (tp / pred + tp / gold_n), 9) AS f1 FROM n"""
)
def d9_scores_of_orders(spark, t):
    """An example an order: its span is found, another one is predicted, or the run times out."""
    rows = orders(t, span="concat('The rule of p', party, 'x')").withColumn("ex", F.col("id").cast("string"))
    examples = rows.select(F.col("ex").alias("id"), F.lit("brief").alias("source"), F.concat("span", F.lit(" stands.")).alias("text"), F.create_map("span", F.lit("misquote")).alias("gold"))
    predicted = F.when(F.col("status") == "F", F.array("span")).when(F.col("status") == "O", F.array(F.lit("something else"))).otherwise(F.expr("cast(array() as array<string>)"))
    preds = rows.select(F.lit("r").alias("run_id"), F.col("ex").alias("ex_id"), predicted.alias("predicted"), F.when(F.col("status") == "P", "timeout").alias("error"))
    return P.micro_scores(P.score_run(preds, examples, "repo"), "run_id").select("run_id", "found", "gold_n", "tp", "pred", F.round("f1", 9).alias("f1"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN 'interior_page' ELSE 'reporter_series' END AS kind, party AS cluster_id, CASE status WHEN 'F' THEN 10 ELSE 2 END AS delta FROM o WHERE status <> 'P'")
def j12_near_misses_of_orders(spark, t):
    """A page inside the case that was offered, the right volume in another series, and a volume that nothing is near to."""
    rows = orders(t).select(F.col("id").cast("string").alias("answer"), "id", "status", F.col("party").cast("long").alias("party"), "volume", F.col("page").cast("int").alias("page"))
    anchors = rows.where("status <> 'F'").select("answer", F.col("party").alias("cluster_id"), "volume", F.lit("So.2d").alias("reporter"), F.col("page").cast("string").alias("page"), F.lit("Moon v. Sun").alias("case_name"))
    offered = F.array(F.struct(F.col("party").alias("cluster_id"), F.col("page").cast("string").alias("page")))
    none = F.expr("cast(array() as array<struct<cluster_id:bigint,page:string>>)")
    fabricated = rows.select(
        "answer",
        "id",
        F.when(F.col("status") == "P", F.concat(F.lit("9"), "volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(F.col("status") == "F", "So. 2d").otherwise("So. 3d").alias("reporter"),
        (F.col("page") + F.when(F.col("status") == "F", 10).otherwise(2)).cast("string").alias("page"),
        F.lit(None).cast("string").alias("lhs"),
        F.lit(None).cast("string").alias("rhs"),
        F.when(F.col("status") == "F", offered).otherwise(none).alias("did_you_mean"),
    )
    return G.near_misses(fabricated, anchors, ["answer"], "id").select("id", "kind", "cluster_id", "delta")


@query(
    f"""WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'P' THEN 'fabricated' ELSE 'unindexed_real' END AS status, CASE status WHEN 'F' THEN 'check_citation' WHEN 'O' THEN 'cited_by_courts' END AS route, CASE status WHEN 'F' THEN party END AS cluster_id FROM o"""
)
def d2_reconciled_orders(spark, t):
    """A candidate of the right name, year and court; no candidate, but two courts that cite it; a candidate of another year."""
    rows = orders(t, name="concat('Party', party, ' v. Moonlight')").withColumn("cite_id", F.col("id").cast("string"))
    wanted = rows.select(F.col("cite_id").alias("cite"), "volume", F.lit("So. 2d").alias("reporter"), "page", "name", F.lit("Fla.").alias("court"), F.col("year"), (F.col("year") - 1).cast("long").alias("lo"), (F.col("year") + 2).cast("long").alias("hi"), F.when(F.col("status") == "O", 2).otherwise(0).cast("long").alias("citers"))
    candidates = rows.where("status <> 'O'").select(
        F.col("cite_id").alias("cite"), F.lit("check_citation").alias("route"), F.lit(1).alias("ord"), F.col("party").cast("long").alias("cluster_id"), F.col("name").alias("case_name"),
        (F.col("year") + F.when(F.col("status") == "P", 30).otherwise(0)).cast("int").alias("year"), F.lit("Supreme Court of Florida").alias("court"), F.lit("").alias("cites"),
    )
    return G.reconcile(wanted, candidates).select(F.col("cite").cast("long").alias("id"), "status", "route", "cluster_id")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'O' THEN 'fabricated' ELSE 'unindexed_real' END AS status, CASE status WHEN 'F' THEN 'search_cases' WHEN 'P' THEN 'cited_by_courts' END AS route FROM o")
def d4_rejudged_orders(spark, t):
    """The same name in order, the parties the other way round, the wrong court but a citing one."""
    rows = orders(t, name="concat('Party', party, ' v. Moonlight')", hit="CASE status WHEN 'O' THEN concat('Moonlight v. Party', party) ELSE concat('Party', party, ' v. Moonlight') END")
    p = F.col("status") == "P"
    stored = rows.select(
        F.col("id").cast("string").alias("cite"), F.lit("unindexed_real").alias("status"), F.when(p, "check_citation").otherwise("search_cases").alias("route"), F.lit("So. 2d").alias("reporter"), "name", F.col("hit").alias("hit_name"),
        F.when(p, "Supreme Court of Georgia").otherwise("Supreme Court of Florida").alias("hit_court"), F.lit("Fla.").alias("court"), F.when(p, 1).otherwise(0).cast("long").alias("citers"), F.lit(False).alias("miscited"),
    )
    return G.rejudge(stored).select(F.col("cite").cast("long").alias("id"), "status", "route")


@query(f"WITH o AS ({COLUMNS}) SELECT id, concat('case \"', id, '\" b c') AS snippet, concat('the rule of ', id) AS plain, CASE WHEN status = 'F' THEN 'So' ELSE 'F' END AS family FROM o")
def s16_s37_q8_pieces_of_orders(spark, t):
    rows = orders(t, body="concat('{\"x\": ', id, ', \"snippet\": \"case \\\\\"', id, '\\\\\"\\\\n b   c\", \"y\"')", quote="concat('the [old] rule of ', id)", reporter="CASE WHEN status = 'F' THEN 'So. 2d' ELSE 'F.3d' END")
    plain = F.regexp_replace(F.element_at(T.bracket_variants(F.col("quote")), -1), r"\s+", " ")
    return rows.select("id", T.json_snippet(F.col("body"), "snippet").alias("snippet"), plain.alias("plain"), F.initcap(C.series_family(F.col("reporter"))).alias("family"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, 'full' AS kind, cite AS target FROM o UNION ALL SELECT id, CASE status WHEN 'F' THEN 'id' WHEN 'O' THEN 'supra' ELSE 'short' END, cite FROM o UNION ALL SELECT id, 'noncase', NULL FROM o")
def q19_references_of_orders(spark, t):
    """A full citation, one that stands for it, and a rule."""
    rows = orders(t, text="concat('Lee v. Ray, ', cite, ' (Fla. 1950). ', CASE status WHEN 'F' THEN 'Id. at 347' WHEN 'O' THEN 'Ray, supra, at 346' ELSE concat(volume, ' So. 2d at 9') END, '. Fed. R. Civ. P. 56.')")
    refs = rows.select("id", "text", "cite", F.explode(N.citation_refs("text")).alias("r"))
    there = F.col("r.target") == F.instr("text", F.col("cite")) - 1
    return refs.select("id", "r.kind", F.when(there, F.col("cite")).alias("target"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('The law of p', party, 'x is settled on this point.') ELSE concat('It is the law of p', party, 'x,') END AS sentence, concat('Lee', party, ' v. Ray') AS name FROM o")
def q31_segments_of_orders(spark, t):
    """The sentence before a citation that stands alone, and the part of a sentence before one inside it."""
    rows = orders(t, name="concat('Lee', party, ' v. Ray')", text="CASE status WHEN 'F' THEN concat('So it began. The law of p', party, 'x is settled on this point. See ', cite, '. By Lee', party, ' v. Ray.') ELSE concat('So it began. It is the law of p', party, 'x, ', cite, '.') END", naming="concat('By Lee', party, ' v. Ray, ', cite)")
    return rows.select("id", U.preceding_sentence("text", "cite").alias("sentence"), U.name_segment("naming", "name", "cite").alias("name"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, 1 AS n, cite, 'FOUND' AS status, true AS warning, concat('Smyth', party) AS input_name, party AS cluster_id FROM o UNION ALL SELECT id, 2, '1 F.3d 2', 'NOT FOUND', false, NULL, NULL FROM o WHERE status = 'F'")
def q34_replies_of_orders(spark, t):
    reply = """concat('Results:\\n  1. ', cite, ' — Smith\\n     Status: FOUND\\n     Cluster ID: ', party, '\\n     WARNING: Input case name "Smyth', party, '" differs from verified "Smith"\\n', CASE WHEN status = 'F' THEN '  2. 1 F.3d 2\\n     Status: NOT FOUND\\n' ELSE '' END, '  3. no status here\\n')"""
    rows = orders(t, text=reply).select("id", F.explode(rules.reply_blocks(F.col("text"))).alias("b"))
    return rows.select("id", "b.n", "b.cite", "b.status", "b.warning", "b.input_name", "b.cluster_id")


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('ANSWER: P', party, ' v. B — overruled by C v. D (', year, ')') WHEN 'O' THEN concat('ANSWER: P', party, ' v. B, ', cite, ', correct as written') ELSE concat('ANSWER: mismatch: ', cite) END AS answer, concat('P', party, ' v. B|Roe v. Wade') AS names FROM o")
def q35_q38_answers_of_orders(spark, t):
    rows = orders(
        t,
        tool="CASE status WHEN 'F' THEN 'get_treatment' ELSE 'check_citation' END",
        body="""CASE status WHEN 'F' THEN concat('{"bluebook": "P', party, ' v. B", "treatment": {"flag": "red"}, "overruled_by": {"case_name": "C v. D", "year": ', year, '}}') WHEN 'O' THEN concat('{"bluebook": "P', party, ' v. B, ', cite, '", "verdict": "ok"}') ELSE concat('{"verdict": "mismatch", "citation": "', cite, '"}') END""",
        listed="concat('  1. P', party, ' v. B, 12 So. 2d 345\\n  2. Roe v. Wade (1973)\\nno list\\n - P', party, ' v. B')",
    )
    return rows.select("id", rules.render_answer(F.col("tool"), F.col("body")).alias("answer"), F.array_join(rules.listed_cases(F.col("listed")), "|").alias("names"))


@query(f"WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS answer, cite, CASE status WHEN 'F' THEN 'unresolved' WHEN 'O' THEN 'name mismatch' ELSE 'red flag' END AS problem FROM o UNION ALL SELECT CAST(id AS VARCHAR), cite, 'misquote' FROM o WHERE status = 'O'")
def q37_findings_of_orders(spark, t):
    """Each citation is checked twice, with the same findings."""
    of = lambda f, o, p: F.when(F.col("status") == "F", f).when(F.col("status") == "O", o).otherwise(p)
    rows = orders(t).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2))))
    cites = rows.select(
        F.col("id").cast("string").alias("answer"), "ord", F.col("cite").alias("raw"), of(F.lit(None), F.col("party"), F.col("party")).cast("long").alias("cluster_id"), of(F.lit(None), "mismatch", "match").alias("party_verdict"),
        of(F.lit(None), "words", "fine").alias("quote"), of(F.lit(None), "misquote", "ok").alias("quote_verdict"), of(F.lit(None), "absent", "ok").alias("quote_integrity"), of(F.lit(None), "green", "red").alias("flag"),
    )
    return rules.brief_findings(cites).select("answer", "cite", "problem")
