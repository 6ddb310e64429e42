"""Operators whose first queries state rows worked out by hand, over whole tables: the oracle takes the answers from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import citations as G
from verisect.operators import rules as R
from verisect.operators import spans as P
from verisect.plans.base import query
from verisect.plans.written import COLUMNS, orders
from verisect.sources import readers
from verisect.sources.tables import Table, scratch, stored


@query("SELECT 'there' AS file, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'none', count(*) FILTER (WHERE n_nationkey < 0), 'rows' FROM nation")
def sc6_optional_files_of_nations(spark, t):
    """A file that is there, and one that isn't, by the same reader."""
    path = scratch(spark, "optional")
    t("nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("value")).write.text(path)
    there = readers.read_jsonl_optional(spark, path, "id long, name string").select(F.lit("there").alias("file"), "id", "name")
    missing = readers.read_jsonl_optional(spark, scratch(spark, "nothing"), "id long, name string")
    return there.unionByName(missing.agg(F.count(F.lit(1)).alias("id")).select(F.lit("none").alias("file"), "id", F.lit("rows").alias("name")))


@query("SELECT r_name AS report, n_name AS model, concat(n_nationkey, '.5%') AS rate FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc14_reports_of_regions(spark, t):
    """A report for each region: a table of other columns, text, and the table of its nations, its columns in an order of the region's own."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    swapped = F.col("r_regionkey") % 2 == 0
    cells = F.when(swapped, F.concat(F.lit("| "), "n_name", F.lit(" |"), "n_nationkey", F.lit(".5% | x |"))).otherwise(F.concat(F.lit("|"), "n_nationkey", F.lit(".5%|x|  "), "n_name", F.lit(" |")))
    body = rows.groupBy("r_name", swapped.alias("swapped")).agg(F.array_join(F.array_sort(F.collect_list(cells)), "\n").alias("lines"))
    head = F.when(F.col("swapped"), "| model | rate | n |\n|---|---:|:-:|\n").otherwise("| rate | n | model |\r\n|:---|---|---|\r\n")
    text = F.concat(F.lit("# report\n\n| a | b |\n|---|---|\n| 0 | x |\n\nso it is\n"), head, "lines", F.lit("\nend\n"))
    return readers.markdown_rows(body.select(F.col("r_name").alias("id"), text.alias("body")), ["model", "rate"]).select(F.col("id").alias("report"), "model", "rate")


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('a=', c_custkey, ',b=2') WHEN 1 THEN concat('a=', c_custkey, ',b=3,c=4') ELSE concat('a=', c_custkey) END AS config FROM customer"""
)
def sk4_patched_configs_of_customers(spark, t):
    """Configurations of customers: a third is left alone, a third gets entries, a third loses one; only patched ones are written."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("b"), F.lit("2")).alias("config"))
    table = Table(spark, scratch(spark, "configs"), "id long, config map<string,string>", ["id"])
    table.replace(rows)
    more, less = F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")), F.create_map(F.lit("b"), F.lit(None).cast("string"))
    table.patch_map("config", rows.where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, more).otherwise(less).alias("config")))
    entries = F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table.read().select("id", F.array_join(entries, ",").alias("config"))


@query(f"""WITH o AS ({COLUMNS}) SELECT id, CASE party % 4 WHEN 0 THEN concat('the "rule" of p', party, 'x') WHEN 1 THEN concat('discretion of p', party, 'x, dis- Cretion') WHEN 2 THEN concat('the well-known rule, 1999-', party) ELSE concat('it''s p', party, '''s own') END AS text FROM o""")
def s5_printed_texts_of_orders(spark, t):
    """Curly marks with soft hyphens, words broken at a line's end (but not before a capital), odd hyphens and spaces, apostrophes."""
    text = """CASE party % 4 WHEN 0 THEN concat('the “ru­le” of p​', party, 'x') WHEN 1 THEN concat('dis-\n cretion of p', party, 'x, dis- Cretion') WHEN 2 THEN concat('the well‐known rule, 1999‑', party) ELSE concat('it’s p', party, 'ʼs own') END"""
    return orders(t, text=text).select("id", T.fold_print(F.col("text")).alias("text"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, CASE status WHEN 'F' THEN concat('b,j,m,part', party, ',p,t') ELSE concat('part', party, ',smith') END AS plain, CASE status WHEN 'F' THEN concat('bjm,part', party, ',pt') ELSE concat('part', party, ',smith') END AS joined FROM o")
def s9_party_words_of_orders(spark, t):
    """Initials, apart and joined, possessives, and words that say nothing."""
    rows = orders(t, name="CASE WHEN status = 'F' THEN concat('B.J.M. Part', party, ' v. P.T., Inc.') ELSE concat('The Part', party, '’s Co. & Smith''s') END")
    return rows.select("id", F.array_join(C.party_tokens(F.col("name")), ",").alias("plain"), F.array_join(C.party_tokens(F.col("name"), True), ",").alias("joined"))


@query(
    f"""WITH o AS ({COLUMNS}), k AS (SELECT *, CASE party % 8 WHEN 0 THEN 'scotus' WHEN 1 THEN 'ca11' WHEN 2 THEN 'cadc' WHEN 3 THEN 'flsd' WHEN 4 THEN 'fla' WHEN 5 THEN 'ny' WHEN 6 THEN 'nd' ELSE 'ca99' END AS court FROM o)
    SELECT id, CASE party % 8 WHEN 0 THEN 'us:scotus' WHEN 1 THEN 'us:circuit' WHEN 2 THEN 'us:circuit' WHEN 3 THEN 'us:district' WHEN 4 THEN CASE WHEN status = 'P' THEN NULL ELSE 'fl' END WHEN 5 THEN CASE WHEN status = 'P' THEN NULL ELSE 'st:ny' END END AS stratum,
        CASE id % 3 WHEN 0 THEN concat('Cite law of ', court, ' for: rule ', party) WHEN 1 THEN concat('rule ', party, '? (', court, ')') ELSE concat('Is it rule ', party, ' in ', court, '? Say rule ', party, '.') END AS prompt FROM k"""
)
def s40_strata_and_prompts_of_orders(spark, t):
    rows = orders(t, court="CASE party % 8 WHEN 0 THEN 'scotus' WHEN 1 THEN 'ca11' WHEN 2 THEN 'cadc' WHEN 3 THEN 'flsd' WHEN 4 THEN 'fla' WHEN 5 THEN 'ny' WHEN 6 THEN 'nd' ELSE 'ca99' END", prop="concat('rule ', party)")
    federal = F.col("court").isin("scotus", "ca11", "cadc", "flsd", "ca99")
    state = F.when(federal, "us").when(F.col("court") == "fla", "fl").otherwise(F.col("court"))
    kind = F.when(F.col("court") == "flsd", "FD").when(federal, "F").when(F.col("status") == "P", "ST").when(F.col("status") == "O", "SA").otherwise("S")
    prompt = C.fill_template(["Cite law of {court} for: {prop}", "{prop}? ({court})", "Is it {prop} in {court}? Say {prop}."], (F.col("id") % 3).cast("int"), court=F.col("court"), prop=F.col("prop"))
    return rows.select("id", C.stratum(F.col("court"), state, federal, kind, ["ca11"], ["ny"]).alias("stratum"), prompt.alias("prompt"))


@query(
    f"""WITH o AS ({COLUMNS}) SELECT id, CASE party % 10 WHEN 0 THEN 'signal' WHEN 1 THEN 'rule_text' WHEN 2 THEN 'mostly_citation' WHEN 3 THEN 'parenthetical' WHEN 4 THEN 'heading' WHEN 5 THEN 'hedged' WHEN 6 THEN 'unattributed_talk' WHEN 7 THEN 'history' WHEN 8 THEN 'docket_parenthetical' END AS reason FROM o
    UNION ALL SELECT id, 'duplicate' FROM o WHERE party % 10 = 9"""
)
def q2_q3_skipped_spans_of_orders(spark, t):
    """Every reason why a quoted span is no quotation, and a quotation that is told twice."""
    words = "concat('a party of p', party, 'x may not rely upon the bare pleadings alone')"
    text = f"""CASE party % 10 WHEN 0 THEN concat('The court held "see also p', party, 'x and all of the many cases cited there".') WHEN 1 THEN concat('It reads "under 42 U.S.C. the claim of p', party, 'x must be filed in time".')
        WHEN 2 THEN concat('The court held "Lee v. Ray, ', cite, ' (Fla. 1950), and Moon v. Sun, ', cite, ' (Fla. 1951)".') WHEN 3 THEN concat('The court held so (quoting "', {words}, '").') WHEN 4 THEN 'The court held "Motion For Summary Judgment Granted Against Plaintiff Company".'
        WHEN 5 THEN concat('The rule is close to "', {words}, '".') WHEN 6 THEN concat('I suggest "that you check all of p', party, 'x before you file them".') WHEN 7 THEN concat('The court noted "affirmed in part by the supreme court of p', party, 'x".')
        WHEN 8 THEN concat('As held in Lee v. Ray, No. 21-cv-', party, ' (the court said "', {words}, '").') ELSE concat('The court held "', {words}, '" and again "', {words}, '".') END"""
    rows = orders(t, text=text)
    return rows.select("id", F.explode(U.extract_quotes("text")).alias("q")).select("id", F.col("q.skipped").alias("reason"))


def ruled(t):
    """A task an order, in five classes with rules of their own."""
    arrays = {
        "right": "CASE WHEN party % 5 IN (0, 4) THEN array(cite) END", "any_right": "CASE WHEN party % 5 = 3 THEN array(concat(volume, 'd Cir.')) END", "any_of": "CASE WHEN party % 5 = 2 THEN array('overruled') END",
        "wrong": "CASE WHEN party % 5 = 3 THEN array(concat(volume, 'rd Cir.')) END", "absent": "CASE WHEN party % 5 = 4 THEN array('does not exist') END", "reject": "CASE WHEN party % 5 = 1 THEN true END", "forbid_vendor": "CASE WHEN party % 5 = 4 THEN true END", "verdict_line": "CASE WHEN party % 5 = 2 THEN true END",
    }
    rows = orders(t, text="concat('Lee v. Ray, ', cite)", name="element_at(array('coverage', 'twin', 'treatment', 'misprint', 'control'), cast(party % 5 + 1 AS INT))", answer="'x'")
    gold = F.struct(*(F.expr(e).alias(n) for n, e in arrays.items())).cast(R.GOLD)
    return rows.select(F.col("id").cast("string").alias("id"), F.col("name").alias("class"), "text", gold.alias("gold"), "cite", "volume", "party", "status")


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS id, CASE party % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS variants, 0 AS failed FROM o"""
)
def q28_self_checks_of_orders(spark, t):
    """Answers made from each order's rules: those that must pass do, those that mustn't don't."""
    checked = R.self_check(ruled(t).select("id", "class", "text", "gold"))
    return checked.groupBy("id").agg(F.count(F.lit(1)).alias("variants"), F.count_if(~F.col("ok")).alias("failed"))


@query(
    f"""WITH o AS ({COLUMNS}), g AS (SELECT CASE party % 5 WHEN 0 THEN 'coverage' WHEN 1 THEN 'twin' WHEN 2 THEN 'treatment' WHEN 3 THEN 'misprint' ELSE 'control' END AS class, CAST(status = 'F' AS INT) AS ok FROM o WHERE status <> 'P'),
    c AS (SELECT class AS row, CASE class WHEN 'control' THEN 1 ELSE 0 END AS level, count(*) AS n, sum(ok) AS passed FROM g GROUP BY 1, 2 UNION ALL SELECT 'traps', 1, count(*), sum(ok) FROM g WHERE class <> 'control' UNION ALL SELECT 'total', 3, count(*), sum(ok) FROM g)
    SELECT row, level, n, CAST(passed AS BIGINT) AS passed, CAST(n - passed AS BIGINT) AS missed FROM c"""
)
def d12_scores_of_orders(spark, t):
    """A file of answers by class: finished orders answer rightly, open ones wrongly, pending ones not at all."""
    tasks = ruled(t)
    right = "CASE party % 5 WHEN 1 THEN 'ANSWER: this case does not exist' WHEN 2 THEN 'ANSWER: overruled' WHEN 3 THEN concat('ANSWER: ', volume, 'd Cir.') ELSE concat('ANSWER: ', cite) END"
    answers = tasks.where("status <> 'P'").select("id", F.expr(f"CASE WHEN status = 'F' THEN {right} ELSE 'ANSWER: I agree with 9 X.9d 9 in all' END").alias("answer"))
    return R.score_table(R.grade_items(tasks.select("id", "class", "text", "gold"), answers))


@query(
    f"""WITH o AS ({COLUMNS}) SELECT CAST(id AS VARCHAR) AS id, CASE party % 5 WHEN 0 THEN 'coverage' WHEN 1 THEN 'twin' WHEN 2 THEN 'treatment' WHEN 3 THEN 'misprint' ELSE 'control' END AS class, CASE id % 4 WHEN 1 THEN concat('new text of ', id) ELSE concat('Lee v. Ray, ', cite) END AS text,
    CASE WHEN id % 4 = 2 THEN 'bad form' WHEN id % 4 <> 3 AND party % 5 = 3 THEN concat(volume, 'rd Cir.') ELSE '' END AS wrong FROM o WHERE id % 8 <> 4"""
)
def d11_assembled_tasks_of_orders(spark, t):
    """Tasks and controls together under decisions: some dropped, some with a new text, with other wrong forms, or without any."""
    tasks = ruled(t).select("id", "class", "text", "gold")
    n = F.col("id").cast("long")
    decided = tasks.where((n % 4 > 0) | (n % 8 == 4)).select(
        "id", F.when(n % 8 == 4, True).alias("drop"), F.when(n % 4 == 1, F.concat(F.lit("new text of "), "id")).alias("text"), F.when(n % 4 == 2, F.array(F.lit("bad form"))).alias("wrong"), F.when(n % 4 == 3, True).alias("clear_wrong"),
    )
    out = R.assemble([tasks.where("class <> 'control'"), tasks.where("class = 'control'")], decided)
    return out.select("id", "class", "text", F.coalesce(F.array_join("gold.wrong", "|"), F.lit("")).alias("wrong"))


KINDS = 9
#: By kind of finding: tier and reason under v1, v3 and v6; null for none.
FOUND = (
    ("strict unresolved:strong", "strict unresolved:strong", "strict unresolved:strong"),
    ("broad unresolved:cite_mismatch", "broad unresolved:cite_mismatch", "strict unresolved:cite_mismatch"),
    ("strict name_mismatch", "strict name_mismatch", "strict name_mismatch:name"),
    ("broad quote_near", "strict quote_near_diff", "strict quote_near_diff"),
    (None, "broad quote_misattributed", "broad quote_misattributed"),
    ("strict misquote", "strict misquote", "strict misquote"),
    (None, "strict pin:pin_mismatch", "strict pin:pin_mismatch"),
    (None, None, "strict pin:proposition_elsewhere"),
    (None, "strict unattached_quote_near", "strict unattached_quote_near"),
)


def by_kind(version: int) -> str:
    return "CASE party % 9 " + " ".join(f"WHEN {k} THEN '{row[version]}'" for k, row in enumerate(FOUND) if row[version]) + " END"


SEGMENT = "CASE WHEN party % 9 IN (3, 4, 5, 8) THEN 'every word of p' || party || 'x counts' WHEN party % 9 = 2 AND version = 'v6' THEN 'Lee v. Ray, ' || cite || ' (9th Cir. 1993)' ELSE cite END"


@query(
    f"""WITH o AS ({COLUMNS}), f AS (SELECT *, 'v1' AS version, {by_kind(0)} AS found FROM o UNION ALL SELECT *, 'v3', {by_kind(1)} FROM o UNION ALL SELECT *, 'v6', {by_kind(2)} FROM o)
    SELECT CAST(id AS VARCHAR) AS ex_id, version, found, {SEGMENT} AS segment FROM f WHERE found IS NOT NULL"""
)
def q32_mappings_of_orders(spark, t):
    """A checker's findings of nine kinds under three versions of the mapping, with the text that each marks."""
    found = None
    for version in ("v1", "v3", "v6"):
        part = P.map_findings(*checked(t), version).select("ex_id", F.lit(version).alias("version"), F.concat_ws(" ", "tier", "reason").alias("found"), "segment")
        found = part if found is None else found.unionByName(part)
    return found


def checked(t):
    """Checked citations of the orders' texts, and quotations that stand by none."""
    words = "concat('every word of p', party, 'x counts')"
    rows = orders(t, text=f"concat('So it is. Lee v. Ray, ', cite, ' (9th Cir. 1993), says \"', {words}, '\" here.')", words=words)
    kind, of = F.col("party") % KINDS, lambda k, value: F.when(F.col("party") % KINDS == k, F.lit(value))
    quote = F.when(kind.isin(3, 4, 5), F.col("words"))
    values = {
        "ex_id": F.col("id").cast("string"), "ord": F.lit(1), "text": F.col("text"), "raw": F.col("cite"), "cluster_id": F.when(kind > 1, F.col("party")), "verdict": F.coalesce(of(0, "strong"), of(1, "cite_mismatch")), "party_verdict": of(2, "mismatch"),
        "written_name": F.lit("Lee v. Ray"), "quote": quote, "quote_verdict": F.coalesce(of(3, "near"), of(4, "misattributed"), of(5, "misquote")), "quote_differs": of(3, True), "pin_verdict": of(6, "pin_mismatch"), "proposition_verdict": of(7, "proposition_elsewhere"),
    }
    fields = [f.split() for f in P.CITE.split(", ")]
    cites = rows.select(*(values.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in fields))
    loose = rows.where(kind == 8).select(F.col("id").cast("string").alias("ex_id"), F.lit(1).alias("ord"), "text", F.col("words").alias("quote"), F.lit("near").alias("verdict"))
    return cites, loose


@query(
    f"""WITH o AS ({COLUMNS}), f AS (SELECT CAST(id AS VARCHAR) AS ex_id, {by_kind(2)} AS found FROM o) SELECT ex_id, tier FROM f, (VALUES ('strict'), ('broad'), ('cited_for')) AS v(tier) WHERE found LIKE 'strict %' OR (found LIKE 'broad %' AND tier = 'broad')"""
)
def q33_tiers_of_orders(spark, t):
    """Which examples each tier predicts a span for."""
    found = stored(P.map_findings(*checked(t), "v6"), "findings")  # each tier reads it
    out = None
    for tier in P.TIERS:
        part = P.predictions(found, tier).where(F.size("predicted") > 0).select("ex_id", F.lit(tier).alias("tier"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH d AS (SELECT CAST(o_custkey % 60 + 1 AS INT) AS volume, year(o_orderdate) AS y, year(o_orderdate) + (month(o_orderdate) - 0.5) / 12 AS f FROM orders),
    v AS (SELECT volume, count(*) AS n, list_sort(list(y)) AS ys, round(median(f), 2) AS mid FROM d GROUP BY 1),
    w AS (SELECT unnest(range(1, 161, 3))::INT AS volume),
    own AS (SELECT w.volume, ys[round_even(0.1 * (n - 1), 0)::BIGINT + 1] - 1 AS lo, ys[round_even(0.9 * (n - 1), 0)::BIGINT + 1] + 1 AS hi FROM w JOIN v ON v.volume = w.volume WHERE n >= 5),
    l AS (SELECT w.volume, max(v.volume) AS dense FROM w JOIN v ON v.volume < w.volume AND v.volume > w.volume - 600 AND v.n >= 20 WHERE w.volume NOT IN (SELECT volume FROM own) GROUP BY 1),
    s AS (SELECT l.volume, v.volume AS x, v.mid AS y FROM l, (VALUES (0), (25), (50), (75), (100)) AS k(k) JOIN v ON v.volume = l.dense - k.k AND v.n >= 5),
    p AS (SELECT volume, count(*) AS n, avg(y) + greatest(0, coalesce(regr_slope(y, x), 0)) * (volume - avg(x)) AS predicted, arg_max(y, x) AS m FROM s GROUP BY volume)
    SELECT 'So. 2d' AS reporter, w.volume, CAST(coalesce(own.lo, CASE WHEN p.n >= 2 THEN floor(predicted - 1.5) ELSE floor(m) END) AS BIGINT) AS lo, CAST(coalesce(own.hi, CASE WHEN p.n >= 2 THEN ceil(predicted + 1.5) WHEN p.n = 1 THEN 9999 END) AS BIGINT) AS hi,
        CASE WHEN own.lo IS NOT NULL THEN 'indexed' WHEN p.n >= 2 THEN 'extrapolated' WHEN p.n = 1 THEN 'floor_only' END AS method FROM w LEFT JOIN own ON own.volume = w.volume LEFT JOIN p ON p.volume = w.volume"""
)
def d5_year_bands_of_orders(spark, t):
    """Bands of volumes that the orders date, and of volumes beyond them by the line through those that they do."""
    rows = t("orders").select(F.col("o_orderkey").alias("cluster_id"), (F.col("o_custkey") % 60 + 1).cast("string").alias("volume"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"))
    wanted = spark.range(1, 161, 3).select(F.lit("So. 2d").alias("reporter"), F.col("id").cast("int").alias("volume"))
    return G.year_bands(wanted, rows.select("cluster_id", F.lit("So. 2d").alias("reporter"), "volume"), rows.select("cluster_id", "date_filed"))


@query(f"WITH o AS ({COLUMNS}) SELECT id, party % 6 IN (0, 2, 3, 5) AS equivalent FROM o")
def q13_elided_propositions_of_orders(spark, t):
    """Propositions against opinions: all parts around an ellipsis; one part of two; a long run inside one part; a bracket; a run that only a dropped ellipsis makes; words apart."""
    from verisect.operators.containment import gold_equivalent

    head, tail = "concat('the court must weigh the claim of p', party, 'x')", "'before it may rule upon the motion'"
    prop = f"""CASE party % 6 WHEN 0 THEN concat({head}, ' . . . ', {tail}) WHEN 1 THEN concat({head}, ' . . . ', {tail}) WHEN 2 THEN concat('so it is [...] ', {head}, ' and of its heirs and assigns too') WHEN 3 THEN concat({head}, ' [as amended] ', {tail})
        WHEN 4 THEN concat('must weigh the claim of p', party, 'x [...] before it may rule upon it') ELSE concat({head}, '…', {tail}, '… and so on') END"""
    opinion = f"""CASE party % 6 WHEN 0 THEN concat('We say ', {head}, ' in full, and then ', {tail}, ' at all') WHEN 1 THEN concat('We say ', {head}, ' in full') WHEN 2 THEN concat('We say ', {head}, ' and of its heirs and assigns') WHEN 3 THEN concat('We say ', {head}, ' ', {tail}, ' now')
        WHEN 4 THEN concat('the claim of p', party, 'x before it may rule upon it, they must weigh, and more of it') ELSE concat('First ', {head}, ', then ', {tail}) END"""
    rows = orders(t, prop=prop, opinion=opinion)
    return rows.select("id", gold_equivalent(F.col("prop"), T.padded(T.match_words(F.col("opinion")))).alias("equivalent"))


@query(
    """WITH w AS (SELECT o_orderpriority AS name, sum(CAST(o_custkey AS BIGINT)) AS weight FROM orders GROUP BY 1), q AS (SELECT name, 20 * weight / sum(weight) OVER () AS exact FROM w),
    r AS (SELECT name, floor(exact) AS whole, row_number() OVER (ORDER BY floor(exact) - exact, name) AS nth, 20 - sum(floor(exact)) OVER () AS spare FROM q)
    SELECT name, CAST(whole + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS BIGINT) AS draws FROM r"""
)
def l7_shares_of_priorities(spark, t):
    """Twenty draws shared among the priorities by the customers' numbers; no pool is too small."""
    from verisect.operators import sampling

    rows = t("orders").groupBy("o_orderpriority").agg(F.sum("o_custkey").alias("weight"), F.count(F.lit(1)).alias("pool")).orderBy("o_orderpriority").collect()
    share = sampling.largest_remainder({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, 20)
    return spark.createDataFrame(list(share.items()), "name string, draws long")
