"""The rule grader of passages: answers against gold rules, class tables, self-checks, and the building of items."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import metrics as M
from verisect.operators import sampling as S
from verisect.operators.joins import first_reason

# Phrases that reject a citation.
REJECTIONS = (
    "not found", "does not exist", "doesn't exist", "do not exist", "no such case", "may be incorrect",
    "not a real case", "cannot find", "can't find", "could not find", "no case", "not this case",
    "does not match", "wrong case", "fabricated", "hallucinat", "not a section", "no such section", "no such title",
)
NO_ANSWER = "no answer from the tool"
GOLD = "struct<right:array<string>,any_right:array<string>,any_of:array<string>,wrong:array<string>,absent:array<string>,reject:boolean,forbid_vendor:boolean,verdict_line:boolean>"


def last_marked_line(answer: str) -> tuple[str, bool]:
    """The last line that opens with ANSWER:, without that, else the last line that isn't empty; and whether it was marked."""
    lines = [x for x in map(str.strip, answer.splitlines()) if x]
    for line in reversed(lines):
        head, colon, body = line.partition(":")
        if colon and head.strip(" *_#>-`\t").lower() == "answer":
            return body.strip() or line, True
    return (lines[-1] if lines else ""), False


LISTS = ("right", "any_right", "wrong", "any_of", "absent")


@lru_cache(4_096)
def read_rules(gold: str) -> tuple[dict, dict[str, list[str]]]:
    """A gold's rules, and its lists folded; read once however many answers a task has."""
    rules = json.loads(gold)
    return rules, {name: [U.plain_answer(x) for x in rules.get(name) or [] if x] for name in LISTS}


def grade(answer: str | None, gold: str | None, passage: str | None = None) -> dict:
    """Whether an answer passes, the reason, and whether it had an ANSWER line. gold: the rules as JSON.

    `right` (all) and `any_right` (one) may stand anywhere but in the echoed passage; `wrong`, `absent` and vendor
    citations are looked for on the ANSWER line only, and a wrong form that the line itself disowns is forgiven if the
    line has the corrected one.
    """
    rules, lists = read_rules(gold or "{}")
    fold = U.plain_answer
    raw_line, marked = last_marked_line(answer or "")
    line, whole = fold(raw_line), fold(answer)
    echoed = fold(passage).rstrip(".").strip()
    if echoed:
        above = whole.replace(line, " ", 1) if line else whole
        whole = f"{above.replace(echoed, ' ')} {line}"
    right, any_right, wrong, any_of, absent = (lists[name] for name in LISTS)
    matched = next((r for r in any_right if r in whole), None)
    held = right + ([matched] if matched else [])

    def verdict() -> str:
        if NO_ANSWER in line:
            return "no answer"
        if rules.get("reject"):
            return "ok" if any(p in (line if marked else whole) for p in REJECTIONS) else "did not reject"
        missing = next((r for r in right if r not in whole), None)
        if missing is not None:
            return f"missing {missing}"
        if any_right and matched is None:
            return f"missing {' / '.join(any_right)}"
        if any_of and not any(U.positive_hit(line if rules.get("verdict_line") else whole, p) for p in any_of):
            return f"missing {' / '.join(any_of)}"
        said = next((p for p in absent if p in line), None)
        if said is not None:
            return f"answer line says {said}"
        if rules.get("forbid_vendor") and (" wl " in f" {line} " or "lexis" in line or "westlaw" in line):
            return "vendor cite on the answer line"
        corrected = any(r in line for r in held + any_of)
        rest = line
        for r in held:
            rest = rest.replace(r, "")
        for w in wrong:
            scope = rest if any(w in r for r in held) else line
            if w in scope and not (corrected and U.all_disowned(scope, w)):
                return f"answer line has {w}"
        return "ok"

    reason = verdict()
    return {"passed": reason == "ok", "reason": reason, "no_answer_line": not marked, "answer_line": raw_line}


grade_answer = U.arrow("struct<passed:boolean,reason:string,no_answer_line:boolean,answer_line:string>")(grade)


def grade_items(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every task with its grade; tasks without an answer have none. tasks: id, class, text, gold (struct); answers: id, answer."""
    rows = tasks.join(answers.select("id", "answer"), "id", "left")
    graded = rows.where("answer IS NOT NULL").withColumn("g", grade_answer("answer", F.to_json("gold"), "text")).select("id", "class", "g.*")
    unscored = rows.where("answer IS NULL").select("id", "class", F.lit(None).cast("boolean").alias("passed"), F.lit("unscored").alias("reason"), F.lit(None).cast("boolean").alias("no_answer_line"), F.lit(None).cast("string").alias("answer_line"))
    return graded.unionByName(unscored)


def score_table(graded: DataFrame) -> DataFrame:
    """The class table of graded items."""
    return M.class_table(graded.where("passed IS NOT NULL"))


def good_answer() -> Column:
    """An answer that the rules must accept."""
    g = lambda f: F.coalesce(F.col(f"gold.{f}"), F.expr("cast(array() as array<string>)"))
    bits = F.concat(g("right"), F.slice(g("any_right"), 1, 1), F.slice(g("any_of"), 1, 1))
    return F.when(F.coalesce("gold.reject", F.lit(False)), "This citation does not exist.").otherwise(F.coalesce(F.nullif(F.array_join(bits, " "), F.lit("")), F.lit("ok")))


def self_check(tasks: DataFrame) -> DataFrame:
    """id, variant, expected, passed and ok: answers made from each task's own rules, which must pass or fail.

    The good answer passes; the wrong form, a confirmation of a case to reject, an added rejection, an added vendor
    citation, and a missing or negated verdict fail; a wrong form only in the explanation passes.
    """
    g = lambda f: F.col(f"gold.{f}")
    first = lambda f: F.try_element_at(g(f), F.lit(1))
    empty = F.expr("cast(array() as array<string>)")
    held = F.concat(F.coalesce(g("right"), empty), F.coalesce(g("any_right"), empty))
    inside = F.exists(held, lambda r: F.contains(r, first("wrong")))
    base = F.array_join(F.concat(F.coalesce(g("right"), empty), F.slice(F.coalesce(g("any_right"), empty), 1, 1)), " ")
    reject = F.coalesce(g("reject"), F.lit(False))
    wrong = F.col("_wrong").isNotNull() & ~F.coalesce(inside, F.lit(False))
    flagged = first("any_of").isNotNull() & ~reject
    variant = lambda name, answer, expected, when: F.when(when, F.struct(F.lit(name).alias("variant"), answer.alias("answer"), F.lit(expected).alias("expected")))
    line = lambda *parts: F.concat(F.lit("ANSWER: "), *parts)
    rows = tasks.withColumns({"_good": good_answer(), "_base": base, "_wrong": first("wrong")})
    made = F.array(
        variant("good", F.concat(F.lit("Explanation.\n"), line(F.col("_good"))), True, F.lit(True)),
        variant("confirmed", F.lit("ANSWER: Status: FOUND. This is a real case."), False, reject),
        variant("wrong", line(F.col("_wrong")), False, wrong),
        variant("explained", F.concat(F.col("_wrong"), F.lit(" is wrong.\n"), line(F.col("_good"))), True, wrong),
        variant("rejected", line(F.col("_good"), F.lit(" "), first("absent")), False, first("absent").isNotNull()),
        variant("vendor", line(F.col("_good"), F.lit(" 2016 WL 1")), False, F.coalesce(g("forbid_vendor"), F.lit(False))),
        variant("silent", line(F.col("_base"), F.lit(" Status: FOUND. The case is good law.")), False, flagged),
        variant("negated", line(F.col("_base"), F.lit(" has not been "), first("any_of")), False, flagged),
    )
    flat = rows.select("id", "gold", F.explode(F.filter(made, lambda v: v.isNotNull())).alias("v")).select("id", "gold", "v.*")
    graded = flat.withColumn("g", grade_answer("answer", F.to_json("gold")))
    return graded.select("id", "variant", "expected", F.col("g.passed").alias("passed"), (F.col("g.passed") == F.col("expected")).alias("ok"))


def build_items(pool: DataFrame, quotas: DataFrame, gates: Sequence[tuple[str, Column]], shapes: Sequence[str], *order: Column) -> DataFrame:
    """Candidates of a pool (id, reporter, decade) that pass the gates, spread over decades, with alternating shapes and `chosen` up to the reporter's quota; dropped ones carry their reason."""
    judged = pool.withColumn("dropped", first_reason(gates))
    kept = judged.where("dropped IS NULL")
    turn = S.round_robin(kept, ["reporter", "decade"], *order)
    placed = turn.withColumn("_place", F.row_number().over(Window.partitionBy("reporter").orderBy("turn", "decade")))
    shaped = S.alternate(placed, shapes, "shape", ["reporter"], F.col("_place"))
    chosen = S.quota(shaped, "reporter", quotas, "size", F.col("_place")).drop("size", "_place", "turn")
    dropped = judged.where("dropped IS NOT NULL").withColumns({"shape": F.lit(None).cast("string"), "chosen": F.lit(False)})
    return chosen.unionByName(dropped)


def assemble(parts: Sequence[DataFrame], decisions: DataFrame) -> DataFrame:
    """All tasks in the order of class and id, with the decisions applied: drop, a new text, and replaced or removed gold lists.

    decisions: id, drop, text, wrong, clear_wrong.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    met = out.join(decisions.withColumnRenamed("text", "_text"), "id", "left").where(~F.coalesce("drop", F.lit(False)))
    gold = F.col("gold").withField("wrong", F.when(F.coalesce("clear_wrong", F.lit(False)), F.expr("cast(null as array<string>)")).otherwise(F.coalesce(F.col("wrong"), F.col("gold.wrong"))))
    return met.withColumns({"text": F.coalesce("_text", "text"), "gold": gold}).drop("drop", "_text", "wrong", "clear_wrong").orderBy("class", "id")


def reply_blocks(text: Column) -> Column:
    """Cases listed in a lookup's text reply: number, cite, status, warning, input and verified name, cluster."""
    blocks = F.filter(F.split(text, r"\n(?=  \d+\. )"), lambda b: b.rlike(r"^  \d+\. .+") & b.rlike(r"Status:\s+(?:FOUND|NOT FOUND|AMBIGUOUS|INVALID|UNRESOLVABLE|PENDING)"))
    warning = r'WARNING: Input case name "(.+?)" differs from verified "(.+?)"'
    some = lambda b, pattern, k=1: F.nullif(F.regexp_extract(b, pattern, k), F.lit(""))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"^  (\d+)\. ", 1).cast("int").alias("n"),
            F.trim(F.substring_index(F.regexp_extract(b, r"^  \d+\. (.+)", 1), " — ", 1)).alias("cite"),
            F.regexp_extract(b, r"Status:\s+(FOUND|NOT FOUND|AMBIGUOUS|INVALID|UNRESOLVABLE|PENDING)", 1).alias("status"),
            b.rlike(warning).alias("warning"),
            some(b, warning, 1).alias("input_name"),
            some(b, warning, 2).alias("verified_name"),
            some(b, r"Cluster ID:\s+(\d+)").cast("long").alias("cluster_id"),
            F.coalesce(some(b, r"other cluster IDs:\s+([0-9, ]+)"), F.lit("")).alias("others"),
        ),
    )


def trap_fired(kind: Column, text: Column, real_cite: Column) -> Column:
    """Whether a saved reply shows the weakness that an item of this kind sets a trap for; null if it can't be told."""
    first = F.try_element_at(reply_blocks(text), F.lit(1))
    status = F.coalesce(first["status"], F.when(F.contains(text, F.lit("No citations found")), "NONE").otherwise("?"))
    names_it = F.coalesce((real_cite != "") & F.contains(text, real_cite), F.lit(False))
    low = F.lower(text)
    return (
        F.when(text.isNull() | F.startswith(text, F.lit("ERROR")), F.lit(None).cast("boolean"))
        .when(kind.isin("coverage", "opinion_cite"), status == "NOT FOUND")
        .when(kind == "wrong_index", status == "FOUND")
        .when(kind == "twin", (status == "FOUND") & (F.coalesce(first["others"], F.lit("")) == ""))
        .when(kind == "treatment", (status == "FOUND") & ~low.rlike("overrul|reced|unpublish"))
        .when(kind.isin("pagination", "misprint"), (status == "NOT FOUND") & ~names_it)
        .when(kind == "vendor", status.isin("NOT FOUND", "NONE", "?"))
        .when(kind == "caption", (status == "NOT FOUND") | F.coalesce(first["warning"], F.lit(False)))
        .when(kind == "vendor_when_official", F.contains(F.concat(F.lit(" "), text), F.lit(" WL ")) | F.contains(text, F.lit("LEXIS")))
    )


def listed_cases(text: Column) -> Column:
    """Case names in a reply's lines."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:\d+\.|-)\s+([A-Z][^\n,]*? v\. [^\n,(]*?)(?:,|\s\(|$)"), F.lit(1)))


def render_answer(tool: Column, body: Column) -> Column:
    """The answer line that a structured reply amounts to: lookups of briefs, citations, courts and treatments."""
    get = lambda path: F.get_json_object(body, path)
    flag, by = F.lower(F.coalesce(get("$.treatment.flag"), F.lit(""))), get("$.overruled_by.case_name")
    year = F.coalesce(F.concat(F.lit(" ("), get("$.overruled_by.year"), F.lit(")")), F.lit(""))
    verdict = (
        F.when((flag == "red") & by.isNotNull(), F.concat(F.coalesce(get("$.overruled_by.verb"), F.lit("overruled")), F.lit(" by "), by, year))
        .when(flag == "red", "overruled")
        .when(flag == "yellow", "questioned")
        .when(flag == "green", "good law, not overruled")
        .otherwise(F.concat(F.lit("no treatment flag ("), F.coalesce(F.nullif(flag, F.lit("")), F.lit("none")), F.lit(")")))
    )
    head = F.coalesce(F.concat(get("$.bluebook"), F.lit(" — ")), F.lit(""))
    citation = F.when(F.coalesce(get("$.verdict"), F.lit("ok")).isin("ok", "match", "verified", "found"), F.concat(F.coalesce(get("$.bluebook"), get("$.case.case_name")), F.lit(", correct as written"))).otherwise(F.concat_ws(": ", get("$.verdict"), get("$.citation")))
    brief = F.when(get("$.cites[0].cluster_id").isNotNull(), F.concat(get("$.cites[0].raw"), F.lit(", correct as written"))).otherwise(F.concat_ws(": ", get("$.cites[0].verdict"), get("$.cites[0].raw")))
    court = F.coalesce(get("$.courts[0].bluebook"), get("$.courts[0].citation_string"))
    answer = F.when(tool == "find_court", court).when(tool == "get_treatment", F.concat(head, verdict)).when(tool == "check_brief", F.nullif(brief, F.lit(""))).when(tool == "check_citation", citation)
    return F.concat(F.lit("ANSWER: "), F.coalesce(answer, F.lit(NO_ANSWER)))


def brief_findings(cites: DataFrame, cap: int = 20) -> DataFrame:
    """answer, cite, problem and detail of a checked draft, distinct, in order, at most `cap` an answer.

    cites: answer, ord, raw, cluster_id, party_verdict, quote, quote_verdict, quote_integrity, flag.
    """
    c = F.col
    entry = lambda problem, detail: F.struct(F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    known = c("cluster_id").isNotNull()
    quote_problem = F.when(c("quote_verdict") == "paraphrase", entry("paraphrase", c("quote"))).when((c("quote_integrity") == "absent") | (c("quote_verdict") == "misquote"), entry("misquote", c("quote")))
    found = F.array(F.when(~known, entry("unresolved", F.lit(None))), F.when(known & (c("party_verdict") == "mismatch"), entry("name mismatch", F.lit(None))), F.when(known, quote_problem), F.when(known & (c("flag") == "red"), entry("red flag", F.lit(None))))
    flat = cites.select("answer", "ord", c("raw").alias("cite"), F.posexplode(F.filter(found, lambda f: f.isNotNull())).alias("k", "f")).select("answer", "ord", "k", "cite", "f.*")
    once = flat.groupBy("answer", "cite", "problem", "detail").agg(F.min(F.struct("ord", "k")).alias("o"))
    return S.best_k(once, ["answer"], cap, F.col("o")).drop("o")
