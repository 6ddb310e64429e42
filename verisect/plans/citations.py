"""The citation layer on literal rows; expected values are written out by hand, or computed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import text as T
from verisect.operators import citations as G
from verisect.operators import joins as J
from verisect.plans.base import Fixture, expect, query


TEXTS = Fixture("texts", "id long, t string", [(1, "Smith v. Jones, 12 So. 2d 345 (Fla. 1950); see 12 So.2d 345 and 410 U.S. 113."), (2, "no cite"), (3, "5 F. Supp. 3d 77, 80"), (4, None)])


@query(
    f"""WITH {TEXTS.cte()}, m AS (SELECT id, unnest(regexp_extract_all(t, '\\b(\\d{{1,4}})\\s+([A-Z][A-Za-z0-9.''\\s]{{0,24}}?)\\s+(\\d{{1,5}})\\b', 0)) AS x FROM texts),
    k AS (SELECT DISTINCT id, regexp_extract(x, '^(\\d+)', 1) || '|' || regexp_replace(lower(regexp_extract(x, '^\\d+\\s+(.*?)\\s+\\d+$', 1)), '[^a-z0-9]', '', 'g') || '|' || regexp_extract(x, '(\\d+)$', 1) AS key FROM m) SELECT * FROM k"""
)
def s20_cite_keys(spark, t):
    return TEXTS.df(spark).select("id", F.explode(C.cite_keys(F.col("t"))).alias("key"))


@query(expect("c string, volume string, reporter string, page string, plain string", ("12 So. 2d 345", "12", "So. 2d", "345", "12 So 2d 345"), ("bad", None, None, None, "bad")))
def s21_whole_cite(spark, t):
    rows = spark.createDataFrame([("12 So. 2d 345",), ("bad",)], "c string").withColumn("w", C.whole_cite(F.col("c")))
    return rows.select("c", "w.volume", "w.reporter", "w.page", C.undotted(F.col("c")).alias("plain"))


@query("SELECT doc_id, regexp_matches(text, '\\b[0-9]{1,4} [A-Z][A-Za-z0-9.]{0,12} [0-9]{1,5}\\b') AS cites FROM documents")
def s22_reporter_in_text(spark, t):
    return t("documents").select("doc_id", F.col("text").rlike(r"\b[0-9]{1,4} [A-Z][A-Za-z0-9.]{0,12} [0-9]{1,5}\b").alias("cites"))


@query(expect("id long, name string, cite string, court string, year string", (1, "Smith v. Jones", "12 So. 2d 345", "Fla.", "1950"), (2, "Roe v. Wade", "410 U.S. 113", "", "1973"), (3, "", "", "", "")))
def s23_bluebook_parts(spark, t):
    rows = spark.createDataFrame([(1, "Smith v. Jones, 12 So. 2d 345, 347 (Fla. 1950)."), (2, "Roe v. Wade, 410 U.S. 113 (1973)"), (3, "nothing")], "id long, t string")
    return rows.select("id", C.bluebook(F.col("t")).alias("b")).select("id", "b.*")


@query(expect("id long, name string, cite string, tool string", (1, "Smith v. Jones", "12 So. 2d 345", "get_treatment"), (2, "Fla. Dist. Ct. App.", "", "find_court"), (3, "See X v. Y", "1 F.3d 2", "check_citation")))
def s24_passage_and_tool(spark, t):
    rows = spark.createDataFrame([(1, "treatment", "Smith v. Jones, 12 So. 2d 345"), (2, "bluebook_court", "Fla. Dist. Ct. App."), (3, "coverage", "See X v. Y, 1 F.3d 2")], "id long, kind string, t string")
    return rows.select("id", C.passage_parts(F.col("t")).alias("p"), C.tool_of(F.col("kind"), F.col("t")).alias("tool")).select("id", "p.*", "tool")


@query("SELECT doc_id, strpos(text, ' the ') - 1 AS at FROM documents WHERE strpos(text, ' the ') > 0")
def s25_byte_to_char_offset(spark, t):
    rows = t("documents").where(F.instr("text", " the ") > 0).select("doc_id", "text", (F.instr("text", " the ") - 1).alias("c"))
    byte = F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("c")))
    return rows.select("doc_id", C.char_offset(F.col("text"), byte, F.lit(" the ")).cast("long").alias("at"))


PARENS = [(1, "Smith v. Jones, 12 So. 2d 345 (Fla. 1950).", 16, 29), (2, "Lee (2021) 11 Cal.5th 614 holds", 11, 25), (3, "12 So. 2d 345 alone", 0, 13), (4, "A, 1 F.3d 2, 5 (11th Cir. 1999)", 3, 11)]


@query(expect("id long, court string, year int", (1, "Fla.", 1950), (2, None, 2021), (3, None, None), (4, "11th Cir.", 1999)))
def s26_parenthetical(spark, t):
    rows = spark.createDataFrame(PARENS, "id long, t string, a int, b int")
    return rows.select("id", C.parenthetical(F.col("t"), F.col("a"), F.col("b")).alias("p")).select("id", "p.*")


@query(expect("id long, history boolean", (1, True), (2, False), (3, True), (4, True)))
def s28_subsequent_history(spark, t):
    rows = [(1, "review denied, 476 So. 2d 674", 15), (2, "we rely on 476 So. 2d 674", 11), (3, "aff'd, 1 U.S. 2", 7), (4, "cert. was later granted, 1 U.S. 2", 25)]
    return spark.createDataFrame(rows, "id long, t string, a int").select("id", C.is_history(F.col("t"), F.col("a")).alias("history"))


COURTS = [("11th Cir.", "fl"), ("Fla. 2d DCA", "us"), ("S.D. Fla.", "fl"), ("W. Va.", "us"), ("", "ny"), ("", "us"), ("D.C. Cir.", "us"), (None, "ga")]


@query(expect("court string, state string, scope string", *zip(*zip(*COURTS, strict=True), ("court:ca11", "state:fl", None, "state:wv", "state:ny", None, "court:cadc", "state:ga"), strict=True)))
def s29_court_scope(spark, t):
    return spark.createDataFrame(COURTS, "court string, state string").select("court", "state", C.court_scope(F.col("court"), F.col("state")).alias("scope"))


@query(
    expect(
        "court string, kind string, state string, level string",
        ("Supreme Court of Florida", "state", "fl", "sup"),
        ("District Court of Appeal of Florida", "state", "fl", "app"),
        ("New York Court of Appeals", "state", "ny", "sup"),
        ("Appellate Division of the Supreme Court of New York", "state", "ny", "app"),
        ("Supreme Court", "scotus", None, None),
        ("Eleventh Circuit", "fed_app", None, None),
        ("S.D. Florida", "fed_dist", None, None),
        ("U.S. Tax Court", "fed_other", None, None),
        ("Court of Special Appeals of Maryland", "state", "md", "app"),
        ("Supreme Court of West Virginia", "state", "wv", "sup"),
        ("Moon Court", "unknown", None, "trial"),
        ("", "unknown", None, None),
    )
)
def s30_court_class(spark, t):
    names = ["Supreme Court of Florida", "District Court of Appeal of Florida", "New York Court of Appeals", "Appellate Division of the Supreme Court of New York", "Supreme Court", "Eleventh Circuit", "S.D. Florida", "U.S. Tax Court", "Court of Special Appeals of Maryland", "Supreme Court of West Virginia", "Moon Court", ""]
    rows = spark.createDataFrame([(n,) for n in names], "court string")
    return rows.select("court", C.court_class(F.col("court")).alias("c")).select("court", "c.*")


@query(
    expect(
        "reporter string, kind string, states string, level string",
        ("So. 2d", "regional", "al fl la ms", None),
        ("U.S.", "scotus", None, None),
        ("F.3d", "fed_app", None, None),
        ("F. Supp. 2d", "fed_dist", None, None),
        ("F.2d", "fed_any", None, None),
        ("Mont.", "official", "mt", "sup"),
        ("Ga. App.", "official", "ga", "app"),
        ("A.D.2d", "official", "ny", "app"),
        ("Wis. 2d", "official", "wi", None),
        ("Moon", "official", "mo", None),
        ("Zzz", "unknown", None, None),
    )
)
def s31_reporter_class(spark, t):
    names = ["So. 2d", "U.S.", "F.3d", "F. Supp. 2d", "F.2d", "Mont.", "Ga. App.", "A.D.2d", "Wis. 2d", "Moon", "Zzz"]
    rows = spark.createDataFrame([(n,) for n in names], "reporter string")
    return rows.select("reporter", C.reporter_class(F.col("reporter")).alias("c")).select("reporter", "c.*")


FITS = [("So. 2d", "Supreme Court of Florida", "Fla."), ("So. 2d", "Supreme Court of Georgia", "Ga."), ("F.3d", "Eleventh Circuit", "11th Cir."), ("F.3d", "Ninth Circuit", "11th Cir."), ("Ga. App.", "Supreme Court of Georgia", ""), ("Zzz", "any", None), ("So. 3d", "District Court of Appeal of Florida", "Fla. 2d DCA"), ("So. 3d", "Supreme Court of Florida", "Fla. 2d DCA")]


@query(expect("reporter string, court string, written string, fits boolean, level boolean, circuit boolean", *(row + out for row, out in zip(FITS, [(True, True, True), (False, True, True), (True, True, True), (True, True, False), (False, True, True), (True, True, True), (True, True, True), (True, False, True)], strict=True))))
def s32_reporter_fits_court(spark, t):
    rows = spark.createDataFrame(FITS, "reporter string, court string, written string")
    return rows.select("*", C.reporter_fits_court(F.col("reporter"), F.col("court")).alias("fits"), C.level_fits(F.col("written"), F.col("court")).alias("level"), C.circuit_fits(F.col("written"), F.col("court")).alias("circuit"))


@query(expect("name string, words string, token string", ("Smith v. United States", "smith,united states", "smith"), ("In re Advisory Opinion to Governor", "advisory,opinion,governor", "advisory"), ("State v. City of Ocala Water Works", "state,ocala,water", "ocala")))
def s34_search_words(spark, t):
    rows = spark.createDataFrame([("Smith v. United States",), ("In re Advisory Opinion to Governor",), ("State v. City of Ocala Water Works",)], "name string")
    return rows.select("name", F.array_join(C.search_words(F.col("name")), ",").alias("words"), C.single_token(F.col("name")).alias("token"))


EQUAL = [("P.T. v. M.S.", "Pt v. Ms", True), ("Health & Rehab. Servs. v. Doe", "HRS v. Doe", True), ("Commerce P'ship v. Equity Contracting", "Equity v. Commerce", True), ("Smith v. Jones", "Brown v. Jones", False), ("In re X", "X v. Y", False)]


@query(expect("claimed string, resolved string, same boolean", *EQUAL))
def s35_names_equivalent(spark, t):
    return spark.createDataFrame([r[:2] for r in EQUAL], "claimed string, resolved string").select("*", C.names_equivalent(F.col("claimed"), F.col("resolved")).alias("same"))


CONFLICTS = [("Smith", "Jones", "Weimar v. Yacht Club", True), ("Weimar", "Club", "Weimar v. Yacht Club", False), (None, None, "Weimar v. Yacht Club", False), ("Smith", None, "Weimar v. Smith", False), ("Smith", "Jones", None, False)]


@query(expect("l string, r string, name string, conflict boolean", *CONFLICTS))
def s36_claim_conflict(spark, t):
    return spark.createDataFrame([c[:3] for c in CONFLICTS], "l string, r string, name string").select("*", C.claim_conflicts(F.col("l"), F.col("r"), F.col("name")).alias("conflict"))


@query(expect("r string, family string, official boolean, regional boolean", ("So. 2d", "so", False, True), ("F.3d", "f", False, False), ("F. Supp. 2d", "fsupp", False, False), ("Fla.", "fla", True, False), ("N.Y.2d", "ny", True, False), ("N.E.2d", "ne", False, True)))
def s37_series_family(spark, t):
    rows = spark.createDataFrame([(r,) for r in ("So. 2d", "F.3d", "F. Supp. 2d", "Fla.", "N.Y.2d", "N.E.2d")], "r string")
    return rows.select("r", C.series_family(F.col("r")).alias("family"), C.is_official(F.col("r")).alias("official"), C.is_regional(F.col("r")).alias("regional"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS spelled FROM orders")
def s38_year_and_spellings(spark, t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").select("o_orderkey", C.year_of(iso).alias("y"), F.element_at(C.date_spellings(iso), 2).alias("spelled"))


@query("SELECT o_orderkey, round(year(o_orderdate) + (month(o_orderdate) - 0.5) / 12, 6) AS y FROM orders")
def s39_fractional_year(spark, t):
    return t("orders").select("o_orderkey", F.round(C.fractional_year(F.date_format("o_orderdate", "yyyy-MM-dd")), 6).alias("y"))


STRATA = [("scotus", "us", True, "F"), ("ca11", "us", True, "F"), ("flsd", "us", True, "FD"), ("fla", "fl", False, "S"), ("ny", "ny", False, "S"), ("nd", "nd", False, "S"), ("flct", "fl", False, "ST")]


@query(expect("court string, stratum string, prompt string", *((r[0], s, f"Cite law of {r[1]} for: {r[0]}" if k % 2 == 0 else f"{r[0]}? ({r[1]})") for k, (r, s) in enumerate(zip(STRATA, ("us:scotus", "us:circuit", "us:district", "fl", "st:ny", None, None), strict=True)))))
def s40_stratum_and_prompt(spark, t):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(STRATA)], "k int, court string, state string, federal boolean, j string")
    prompt = C.fill_template(["Cite law of {state} for: {prop}", "{prop}? ({state})"], F.col("k") % 2, state=F.col("state"), prop=F.col("court"))
    return rows.select("court", C.stratum(F.col("court"), F.col("state"), F.col("federal"), F.col("j"), ["ca11"], ["ny"]).alias("stratum"), prompt.alias("prompt"))


PINS = [  # id, volume, reporter, page, anchor page, cluster, name, did-you-mean cluster and page, claimed sides; delta and route if it is a pin
    (1, "223", "So. 2d", "102", None, None, None, None),
    (2, "223", "So. 2d", "160", None, None, None, None),
    (3, "223", "So. 2d", "161", None, None, None, None),
    (4, "223", "So. 2d", "250", 7, 100, None, None),
    (5, "223", "So. 2d", "251", 7, 100, None, None),
    (6, "223", "So. 2d", "104", None, None, "Smith", "Jones"),
    (7, "223", "So. 2d", "130", 9, 120, None, None),
    (8, "224", "So. 2d", "102", None, None, None, None),
    (9, "223", "So. 3d", "102", None, None, None, None),
]


def anchors(spark):
    return spark.createDataFrame([("a", 7, "223", "So.2d", "100", "Weimar v. Yacht Club")], "answer string, cluster_id long, volume string, reporter string, page string, case_name string")


def unresolved(spark):
    rows = spark.createDataFrame([("a", *r) for r in PINS], "answer string, id long, volume string, reporter string, page string, dym_cluster long, dym_page int, lhs string, rhs string")
    dym = F.when(F.col("dym_cluster").isNotNull(), F.array(F.struct(F.col("dym_cluster").alias("cluster_id"), F.col("dym_page").cast("string").alias("page")))).otherwise(F.expr("cast(array() as array<struct<cluster_id:bigint,page:string>>)"))
    return rows.withColumn("did_you_mean", dym).drop("dym_cluster", "dym_page")


@query(expect("id long, cluster_id long, delta long, route string", (1, 7, 2, "page_within_60"), (2, 7, 60, "page_within_60"), (4, 7, 150, "did_you_mean_same_cluster")))
def j11_pin_references(spark, t):
    return G.pin_references(unresolved(spark), anchors(spark), ["answer"], "id").select("id", "cluster_id", "delta", "route")


@query(expect("id long, kind string, cluster_id long, delta long", (7, "interior_page", 9, 10), (9, "reporter_series", 7, 2)))
def j12_near_misses(spark, t):
    fabricated = unresolved(spark).where("id IN (3, 5, 6, 7, 8, 9)")
    return G.near_misses(fabricated, anchors(spark), ["answer"], "id").select("id", "kind", "cluster_id", "delta")


GOLD = [("q1", 7, "Smith v. Jones, 12 So. 2d 345 (Fla. 1950)"), ("q2", 8, "Roe v. Wade, 410 U.S. 113"), ("q3", 9, "A v. B, 1 F.3d 2")]
CITED = [("q1", 7, "99", "F.3d", "1"), ("q2", None, "410", "U. S.", "113"), ("q3", 10, "1", "F.2d", "2")]


@query(expect("qid string, gold_hit int", ("q1", 1), ("q2", 1), ("q3", 0)))
def j16_gold_hit(spark, t):
    gold = spark.createDataFrame(GOLD, "qid string, gold_cluster_id long, gold_citation string")
    cited = spark.createDataFrame(CITED, "qid string, cluster_id long, volume string, reporter string, page string")
    return G.gold_hits(cited, gold, "qid")


@query(expect("raw string, outcome string", ("a", "resolved"), ("b", "resolved"), ("c", "unindexed_real"), ("d", "unindexed_real"), ("e", "fabricated")))
def w9_twin_outcomes(spark, t):
    rows = [("x", "a", "12", "So. 2d", "1", "resolved"), ("x", "b", "12", "So.2d", "1", "fabricated"), ("x", "c", "5", "F.3d", "9", "pin_reference"), ("x", "d", "5", "F. 3d", "9", "unindexed_real"), ("x", "e", "6", "F.3d", "9", "fabricated")]
    return G.settle_twins(spark.createDataFrame(rows, "answer string, raw string, volume string, reporter string, page string, outcome string"), ["answer"]).select("raw", "outcome")


SENTENCE = "See A v. B, 65 N.Y.2d 189, 198, 491 N.Y.S.2d 90, 480 N.E.2d 679 (1985). Then C v. D, 5 F.3d 6 (1993)."


@query(expect("raw string, island long", ("65 N.Y.2d 189", 1), ("491 N.Y.S.2d 90", 1), ("480 N.E.2d 679", 1), ("5 F.3d 6", 2)))
def w2_parallel_chains(spark, t):
    raws = ["65 N.Y.2d 189", "491 N.Y.S.2d 90", "480 N.E.2d 679", "5 F.3d 6"]
    rows = spark.createDataFrame([("x", SENTENCE, r, SENTENCE.index(r), SENTENCE.index(r) + len(r)) for r in raws], "answer string, text string, raw string, start int, end int")
    return G.parallel_chains(rows, ["answer"]).select("raw", "island")


NAMES = [("Smith v. Jones", "Smyth v. Jones", False), ("Peterson v. Jones", "Petersen v. Jones", True), ("Jones v. Smith", "Smith v. Jones", True), ("Rule 1.510", "Rule 1.280", False), ("In re Estate of Hoffmann", "Estate of Hoffman", True)]


@query(expect("claimed string, hit string, match boolean", *NAMES))
def j14_fuzzy_names(spark, t):
    from verisect.functions.udfs import name_match

    return spark.createDataFrame([n[:2] for n in NAMES], "claimed string, hit string").select("claimed", "hit", name_match("claimed", "hit").alias("match"))


@query(expect("id long, name string", (1, "Smith v. Jones Corp."), (2, None), (3, "Estate of Lee"), (4, "Lee v. State"), (5, None)))
def s27_claimed_name(spark, t):
    from verisect.functions.udfs import claimed_name

    texts = [(1, "The rule is settled. See Smith v. Jones Corp., 12 So. 2d 345"), (2, "Citation: 12 So. 2d 345"), (3, "as held in In re Estate of Lee, 12 So. 2d 345"), (4, "we cite Lee v. State (2021) 12 So. 2d 345"), (5, "review denied, 12 So. 2d 345")]
    rows = spark.createDataFrame([(i, x, x.index("12 So.")) for i, x in texts], "id long, t string, at int")
    return rows.select("id", claimed_name("t", "at").alias("name"))


@query("SELECT o_orderkey, regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS volume, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS key FROM orders")
def s8_reporter_key(spark, t):
    return t("orders").select("o_orderkey", F.regexp_extract("o_orderpriority", "^([0-9]+)", 1).alias("volume"), T.reporter_key(F.col("o_orderpriority")).alias("key"))


VOLUMES = [("So. 2d", 100, y) for y in (1956, 1957, 1957, 1958, 1958, 1958, 1959)] + [("So. 2d", v, 1960 + v // 25) for v in (150, 175, 200) for _ in range(25)] + [("So. 2d", 201, 1969)]


@query(expect("reporter string, volume int, lo long, hi long, method string", ("So. 2d", 100, 1956, 1959, "indexed"), ("So. 2d", 150, 1965, 1967, "indexed"), ("So. 2d", 201, 1968, 1972, "extrapolated"), ("So. 2d", 300, 1978, 1982, "extrapolated"), ("F.3d", 9, None, None, None)))
def d5_year_bands(spark, t):
    citations = spark.createDataFrame([(k, r, str(v)) for k, (r, v, _) in enumerate(VOLUMES)], "cluster_id long, reporter string, volume string")
    cases = spark.createDataFrame([(k, f"{y}-06-15") for k, (_, _, y) in enumerate(VOLUMES)], "cluster_id long, date_filed string")
    wanted = spark.createDataFrame([("So. 2d", 100), ("So. 2d", 150), ("So. 2d", 201), ("So. 2d", 300), ("F.3d", 9)], "reporter string, volume int")
    return G.year_bands(wanted, citations, cases)


CANDIDATES = Fixture(
    "candidates",
    "cite string, route string, ord int, cluster_id long, case_name string, year int, court string, cites string",
    [
        ("c1", "check_citation", 1, 11, "Smith v. Jones", 1950, "Supreme Court of Florida", ""),
        ("c2", "check_citation", 1, 12, "Brown v. Jones", 1950, "Supreme Court of Florida", ""),
        ("c2", "search_cases", 2, 13, "Smith v. Jones", 1951, "Supreme Court of Florida", "12 So. 2d 345"),
        ("c3", "search_cases", 1, 14, "Smith v. Jones", 1950, "Supreme Court of Florida", "99 So. 2d 1"),
        ("c4", "search_cases", 1, 15, "Jones v. Smith", 1950, "Supreme Court of Florida", ""),
        ("c5", "search_cases", 1, 16, "Smith v. Jones", 1980, "Supreme Court of Florida", ""),
        ("c6", "search_cases", 1, 17, "Smith v. Jones", 1950, "Supreme Court of Georgia", ""),
    ],
)


@query(expect("cite string, status string, route string, cluster_id long, miscited boolean", ("c1", "unindexed_real", "check_citation", 11, False), ("c2", "unindexed_real", "search_cases", 13, False), ("c3", "fabricated", None, None, True), ("c4", "fabricated", None, None, False), ("c5", "fabricated", None, None, False), ("c6", "fabricated", None, None, False), ("c7", "unindexed_real", "cited_by_courts", None, False)))
def d2_reconcile(spark, t):
    wanted = spark.createDataFrame([(f"c{k}", "12", "So. 2d", "345", "Smith v. Jones", "Fla.", 1950, 1949, 1952, 2 if k in (3, 7) else 0) for k in range(1, 8)], "cite string, volume string, reporter string, page string, name string, court string, year int, lo long, hi long, citers long")
    return G.reconcile(wanted, CANDIDATES.df(spark)).select("cite", "status", "route", "cluster_id", "miscited")


@query(expect("cite string, status string, route string", ("e1", "unindexed_real", "search_cases"), ("e2", "fabricated", None), ("e3", "unindexed_real", "cited_by_courts"), ("e4", "fabricated", None), ("e5", "unindexed_real", "check_brief")))
def d4_rejudge(spark, t):
    rows = [
        ("e1", "unindexed_real", "search_cases", "So. 2d", "Smith v. Jones", "Smith v. Jones", "Supreme Court of Florida", "Fla.", 0, False),
        ("e2", "unindexed_real", "search_cases", "So. 2d", "Smith v. Jones", "Jones v. Smith", "Supreme Court of Florida", "Fla.", 0, False),
        ("e3", "unindexed_real", "check_citation", "So. 2d", "Smith v. Jones", "Smith v. Jones", "Supreme Court of Georgia", "Fla.", 1, False),
        ("e4", "unindexed_real", "check_citation", "So. 2d", "Smith v. Jones", "Smith v. Jones", "Supreme Court of Georgia", "Fla.", 1, True),
        ("e5", "unindexed_real", "check_brief", "So. 2d", "Smith v. Jones", "Jones v. Smith", "Supreme Court of Georgia", "Fla.", 0, False),
    ]
    schema = "cite string, status string, route string, reporter string, name string, hit_name string, hit_court string, court string, citers long, miscited boolean"
    return G.rejudge(spark.createDataFrame(rows, schema)).select("cite", "status", "route")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def sc5_semi_join_for_in_list(spark, t):
    ids = t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").where("l_discount > 0.09").join(J.small(ids), "l_partkey", "left_semi").select("l_partkey").distinct()
