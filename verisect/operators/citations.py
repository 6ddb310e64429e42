"""Citations of an answer as relations: chains, pins, near misses, twins, gold hits, year bands and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import udfs as U
from verisect.functions.text import reporter_key
from verisect.operators import metrics as M
from verisect.operators.sampling import islands

#: Pages that an opinion spans, without and with the index naming it.
PIN_PAGES, PIN_PAGES_NAMED = 60, 150


#: Characters that may stand between parallel citations, and how many of them.
SEPARATORS, SEPARATED = " \t\n\x0b\f\r,;0123456789-–—n.&", 60


def glue(text: Column, start: Column) -> Column:
    """How many separators and pages stand, unbroken, right before a place: SEPARATED at most. A mark of a line's end may come last."""
    n = F.greatest(F.least(start, F.lit(SEPARATED)), F.lit(0))
    before = F.regexp_replace(F.substring(text, F.greatest(start - SEPARATED, F.lit(0)) + 1, n), "[\u0085\u2028\u2029]\\z", " ")
    return n - F.length(F.rtrim(before, F.lit(SEPARATORS)))


def parallel_chains(cites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With `island`: citations of a text that are parallels, since nothing but separators and pages, at most 60 characters, stands between them.

    The rows have the `text`, or what glue() tells of it.
    """
    glued = F.col("glue") if "glue" in cites.columns else glue(F.col("text"), F.col("start"))
    between = F.col("start") - F.col("_prev_end")
    return islands(cites, keys, "start", "end", (between < 0) | (between <= glued))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_rep": reporter_key(F.col("reporter")), "_page": C.page_number(F.col("page"))})


def pin_references(unresolved: DataFrame, anchors: DataFrame, keys: Sequence[str], cite: str) -> DataFrame:
    """Unresolved citations that are pages inside a case cited in the same answer: cluster_id, delta, route.

    Either the index names the case for the page (at most 150 pages on), or the nearest first page is at most 60 pages
    before and the index places the page in no other case that begins in between.  A claimed name of other parties rules it out.
    """
    a = _keyed(anchors).select(*keys, "volume", "_rep", F.col("_page").alias("_first"), "cluster_id", "case_name")
    met = _keyed(unresolved.select(*keys, cite, "volume", "reporter", "page", "lhs", "rhs", "did_you_mean")).join(a, [*keys, "volume", "_rep"]).where("_first < _page").withColumn("delta", (F.col("_page") - F.col("_first")).cast("long"))
    met = met.withColumn("_other", C.claim_conflicts(F.col("lhs"), F.col("rhs"), F.col("case_name")))
    named = F.exists("did_you_mean", lambda d: d["cluster_id"] == F.col("cluster_id")) & ~F.col("_other") & (F.col("delta") <= PIN_PAGES_NAMED)
    elsewhere = F.exists("did_you_mean", lambda d: F.coalesce((d["cluster_id"] != F.col("cluster_id")) & (C.page_number(d["page"]) > F.col("_first")) & (C.page_number(d["page"]) <= F.col("_page")), F.lit(False)))
    near = (F.col("delta") <= PIN_PAGES) & ~F.col("_other") & ~elsewhere
    row = F.struct("cluster_id", "delta")
    best = met.withColumns({"_named": named, "_near": near}).groupBy(*keys, cite).agg(F.min_by(row, F.when(F.col("_named"), F.col("delta"))).alias("_by_name"), F.min_by(F.struct("cluster_id", "delta", "_near"), "delta").alias("_nearest"))
    chosen = F.when(F.col("_by_name").isNotNull(), F.struct("_by_name.cluster_id", "_by_name.delta", F.lit("did_you_mean_same_cluster").alias("route")))
    chosen = chosen.when(F.col("_nearest._near"), F.struct("_nearest.cluster_id", "_nearest.delta", F.lit(f"page_within_{PIN_PAGES}").alias("route")))
    return best.select(*keys, cite, chosen.alias("p")).where("p IS NOT NULL").select(*keys, cite, "p.*")


def near_misses(fabricated: DataFrame, known: DataFrame, keys: Sequence[str], cite: str) -> DataFrame:
    """Of fabricated citations, those in another series of a known case's reporter, else those inside a case that isn't cited: kind, cluster_id, delta."""
    k = _keyed(known).select(*keys, "volume", F.col("_rep").alias("_known_rep"), F.regexp_replace("_rep", C.SERIES, "").alias("_family"), F.col("_page").alias("_first"), "cluster_id")
    rows = _keyed(fabricated).withColumn("_family", C.series_family(F.col("reporter")))
    series = rows.join(k, [*keys, "volume", "_family"]).where("_known_rep <> _rep").withColumn("delta", (F.col("_page") - F.col("_first")).cast("long")).where(F.col("delta").between(0, PIN_PAGES))
    by_series = series.groupBy(*keys, cite).agg(F.min_by(F.struct(F.lit("reporter_series").alias("kind"), "cluster_id", "delta"), "delta").alias("s"))
    cited = known.groupBy(*keys).agg(F.collect_set("cluster_id").alias("_cited"))
    places = rows.join(cited, list(keys), "left").select(*keys, cite, "_page", "_cited", F.explode("did_you_mean").alias("d"))
    inside = places.withColumn("delta", (F.col("_page") - C.page_number(F.col("d.page"))).cast("long")).where(F.col("delta").between(1, PIN_PAGES) & ~F.coalesce(F.array_contains("_cited", F.col("d.cluster_id")), F.lit(False)))
    by_page = inside.groupBy(*keys, cite).agg(F.min_by(F.struct(F.lit("interior_page").alias("kind"), F.col("d.cluster_id").alias("cluster_id"), "delta"), "delta").alias("i"))
    return by_series.join(by_page, [*keys, cite], "full").select(*keys, cite, F.coalesce("s", "i").alias("m")).select(*keys, cite, "m.*")


RANK = ("fabricated", "pin_reference", "unindexed_real", "resolved")


def settle_twins(cites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Citations of the same volume, reporter and page in an answer all get the best outcome among them."""
    rank = F.array_position(F.array(*(F.lit(r) for r in RANK)), F.col("outcome"))
    twins = Window.partitionBy(*keys, "volume", "_rep", "page")
    best = F.max("_rank").over(twins)
    names = F.array(*(F.lit(r) for r in RANK))
    return cites.withColumns({"_rep": reporter_key(F.col("reporter")), "_rank": rank}).withColumn("outcome", F.element_at(names, best.cast("int"))).drop("_rep", "_rank")


def gold_hits(cited: DataFrame, gold: DataFrame, qid: str) -> DataFrame:
    """qid and gold_hit: whether an answer cites the gold case, by cluster or by one of its citations."""
    keys = C.cite_keys(F.col("gold_citation"))
    own = F.concat_ws("|", "volume", reporter_key(F.col("reporter")), "page")
    met = gold.select(qid, "gold_cluster_id", keys.alias("_keys")).join(cited, qid, "left")
    hit = F.coalesce(F.col("cluster_id") == F.col("gold_cluster_id"), F.lit(False)) | F.coalesce(F.array_contains("_keys", own), F.lit(False))
    return met.groupBy(qid).agg(F.max(hit.cast("int")).alias("gold_hit"))


def year_bands(wanted: DataFrame, citations: DataFrame, cases: DataFrame) -> DataFrame:
    """reporter, volume, lo, hi and method: the years in which a reporter's volume was printed.

    From its own cases if at least five are dated; else from a line through volumes 25 apart up to the last dense volume
    (20 citations); else from that volume's median on; else nothing.
    """
    dated = citations.select("reporter", F.col("volume").try_cast("int").alias("volume"), "cluster_id").where("volume IS NOT NULL").join(cases.select("cluster_id", "date_filed"), "cluster_id")
    dated = dated.select("reporter", "volume", C.year_of(F.col("date_filed")).alias("y"), C.fractional_year(F.col("date_filed")).alias("f"))
    ranks = M.order_statistics(dated, ["reporter", "volume"], "y", p10=M.nearest_rank(0.1), p90=M.nearest_rank(0.9))
    volumes = dated.groupBy("reporter", "volume").agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias("n"), F.round(F.median("f"), 2).alias("mid"))
    volumes = volumes.join(ranks.drop("n"), ["reporter", "volume"], "left")
    own = wanted.join(volumes, ["reporter", "volume"], "left")
    indexed = own.where("n >= 5").select("reporter", "volume", (F.col("p10") - 1).cast("long").alias("lo"), (F.col("p90") + 1).cast("long").alias("hi"), F.lit("indexed").alias("method"))
    rest = own.where("coalesce(n, 0) < 5").select("reporter", "volume")
    dense = volumes.where("rows >= 20").select("reporter", F.col("volume").alias("dense"))
    last = rest.join(dense, "reporter").where("dense < volume AND dense > volume - 600").groupBy("reporter", "volume").agg(F.max("dense").alias("dense"))
    steps = last.select("reporter", "volume", F.explode(F.array(*(F.col("dense") - 25 * k for k in range(5)))).alias("at")).where("at > 0")
    points = steps.join(volumes.where("n >= 5").select("reporter", F.col("volume").alias("at"), "mid"), ["reporter", "at"])
    predicted = F.avg("mid") + F.greatest(F.lit(0.0), F.coalesce(F.regr_slope("mid", "at"), F.lit(0.0))) * (F.max("volume") - F.avg("at"))
    line = points.groupBy("reporter", "volume").agg(F.count(F.lit(1)).alias("n"), predicted.alias("p"), F.max_by("mid", "at").alias("m"))
    several = F.col("n") >= 2
    drawn = line.select("reporter", "volume", F.when(several, F.floor(F.col("p") - 1.5)).otherwise(F.floor("m")).alias("lo"), F.when(several, F.ceil(F.col("p") + 1.5)).otherwise(F.lit(9999)).cast("long").alias("hi"), F.when(several, "extrapolated").otherwise("floor_only").alias("method"))
    return wanted.join(indexed.unionByName(drawn), ["reporter", "volume"], "left")


ROUTES = ("check_citation", "search_cases")


def consider(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate of a citation with the outcome of each test, `accepted` and `miscited`."""
    met = wanted.join(candidates.withColumnsRenamed({"year": "hit_year", "court": "hit_court"}), "cite")
    parsed = F.transform(F.filter(F.split(F.coalesce("cites", F.lit("")), ";"), lambda c: F.trim(c) != ""), C.whole_cite)
    same = F.filter(parsed, lambda c: reporter_key(c["reporter"]) == reporter_key(F.col("reporter")))
    carries = F.exists("_same", lambda c: (c["volume"] == F.col("volume")) & (c["page"] == F.col("page")))
    met = met.withColumn("_same", same).withColumns({"carries": carries, "name_ok": U.name_match("name", "case_name")})
    generic = U.has_generic_side("name")
    in_band = F.when(F.col("lo").isNull(), True).otherwise(F.col("hit_year").between(F.col("lo"), F.col("hi")))
    near = F.when(F.col("year").isNull(), True).when(generic, F.col("hit_year") == F.col("year")).otherwise(F.abs(F.col("hit_year") - F.col("year")) <= 1)
    met = met.withColumns({"year_ok": F.coalesce(F.col("hit_year").isNotNull() & in_band & near, F.lit(False)), "level_ok": C.level_fits(F.col("court"), F.col("hit_court")), "page_ok": (F.size("_same") == 0) | F.col("carries")})
    met = met.withColumns({"order_ok": U.party_order("name", "case_name", "carries"), "reporter_ok": C.reporter_fits_court(F.col("reporter"), F.col("hit_court")), "circuit_ok": C.circuit_fits(F.col("court"), F.col("hit_court"))})
    tests = [F.coalesce(F.col(c), F.lit(False)) for c in ("name_ok", "year_ok", "level_ok", "page_ok", "order_ok", "reporter_ok", "circuit_ok")]
    accepted = tests[0]
    for test in tests[1:]:
        accepted = accepted & test
    return met.withColumns({"accepted": accepted, "miscited": tests[0] & ~tests[3]}).drop("_same")


def citation_index(opinions: DataFrame) -> DataFrame:
    """Where opinions print citations, from one scan of their texts: key, cluster_id, place and the words before it.

    opinions: cluster_id, text.  A key is volume, reporter and page in their plain form.  Worth storing: it answers any
    number of reconciliations.
    """
    found = opinions.select("cluster_id", F.explode(U.cites_in_context("text")).alias("p"))
    return found.select("p.key", "cluster_id", "p.place", "p.words")


def citing_courts(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """cite, citers and first: for each wanted citation (cite, volume, reporter, page, name) the courts that print it right after a party's name.

    A court counts once however often it prints it.  Spellings that many citations share meet the index once; an entry with
    the party's words alone, not an opinion, goes on.
    """
    key = F.concat_ws("|", "volume", reporter_key(F.col("reporter")), "page")
    asked = wanted.where(F.col("name").isNotNull()).select("cite", key.alias("key"), "name")
    met = asked.select("key", "name").distinct().join(index, "key").where(U.names_party("name", "words"))
    once = met.groupBy("key", "name", "cluster_id").agg(F.min("place").alias("place"))
    counted = once.groupBy("key", "name").agg(F.count(F.lit(1)).alias("citers"), F.min("cluster_id").alias("first"))
    return asked.join(counted, ["key", "name"]).select("cite", "citers", "first")


def reconcile(wanted: DataFrame, candidates: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """For each unresolved citation: status, route, cluster_id of the first accepted candidate, whether a real case was miscited, and all attempts.

    Routes count in the order of ROUTES.  Without a hit, courts that print the citation beside a party's name confirm it,
    unless the case was found at another page.  They are found in a citation_index(), or given as the column `citers`.
    attempts: route, candidates or courts, and whether it was accepted, one for each route that had any, in order.
    """
    judged = consider(wanted, candidates)
    order = F.struct(F.array_position(F.array(*(F.lit(r) for r in ROUTES)), F.col("route")), F.col("ord"))
    best = judged.groupBy("cite").agg(F.min_by(F.struct("route", "cluster_id"), F.when(F.col("accepted"), order)).alias("hit"), F.bool_or("miscited").alias("miscited"))
    tried = judged.groupBy("cite", "route").agg(F.count(F.lit(1)).alias("n"), F.bool_or("accepted").alias("accepted"))
    nth = F.array_position(F.array(*(F.lit(r) for r in ROUTES)), F.col("route")).cast("int")
    tried = tried.groupBy("cite").agg(F.sort_array(F.collect_list(F.struct(nth.alias("nth"), "route", "n", "accepted"))).alias("_tried"))
    if index is not None:
        wanted = wanted.drop("citers").join(citing_courts(wanted, index).drop("first"), "cite", "left")
    out = wanted.join(best, "cite", "left").join(tried, "cite", "left").withColumn("miscited", F.coalesce("miscited", F.lit(False)))
    quoted = (F.coalesce("citers", F.lit(0)) >= 1) & ~F.col("miscited")
    status = F.when(F.col("hit").isNotNull() | quoted, "unindexed_real").otherwise("fabricated")
    route = F.when(F.col("hit").isNotNull(), F.col("hit.route")).when(quoted, "cited_by_courts")
    attempt = lambda route, n, accepted: F.struct(route.alias("route"), n.cast("long").alias("n"), accepted.alias("accepted"))
    courts = F.when(F.coalesce("citers", F.lit(0)) > 0, F.array(attempt(F.lit("cited_by_courts"), F.col("citers"), F.col("hit").isNull() & quoted)))
    none = F.array().cast("array<struct<route:string,n:bigint,accepted:boolean>>")
    routes = F.transform(F.coalesce("_tried", F.array().cast("array<struct<nth:int,route:string,n:bigint,accepted:boolean>>")), lambda t: attempt(t["route"], t["n"], t["accepted"]))
    return out.withColumns({"status": status, "route": route, "cluster_id": F.col("hit.cluster_id"), "attempts": F.concat(routes, F.coalesce(courts, none))}).drop("hit", "_tried")


def rejudge(evidence: DataFrame) -> DataFrame:
    """Stored outcomes under the party-order, reporter and circuit tests: a hit that fails gives way to courts that cite the same, or to nothing."""
    by_name = (F.col("status") == "unindexed_real") & F.col("route").isin(*ROUTES)
    tests = F.col("_order") & C.reporter_fits_court(F.col("reporter"), F.col("hit_court")) & C.circuit_fits(F.col("court"), F.col("hit_court"))
    out = evidence.withColumn("_order", U.party_order("name", "hit_name", F.lit(False)))
    withdrawn = by_name & ~tests
    quoted = (F.col("citers") >= 1) & ~F.col("miscited")
    status = F.when(withdrawn & ~quoted, "fabricated").otherwise(F.col("status"))
    route = F.when(withdrawn & quoted, "cited_by_courts").when(~withdrawn, F.col("route"))
    return out.withColumn("_withdrawn", withdrawn).withColumns({"status": status, "route": route}).drop("_order", "_withdrawn")
