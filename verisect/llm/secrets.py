"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong parts (assigned secrets, access keys, long hex) are always reported.  Weak parts (client ids, short hex,
mixed-alphabet strings, endpoints) are reported only if a complementary part lies within `scope` code points in the
same text: an identifier next to a secret, a secret next to an identifier, an endpoint next to either.  The linking is
an interval join on (row, position bin), so a very long text costs no more than its bins, and places are summed up in
chunks of matches, so a text with very many matches costs little more than its matches.

Defined cases.  Null text counts as empty; very long texts count whole.  Rows that repeat id and text each give their own
result row, of equal value.  Of spans that start at one place the kinds come as listed in KINDS.  An empty table gives an
empty table.  Extra columns of any name are ignored, and kept by redact, which needs doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})"""
WEAK_HEX = r"(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])"
WEAK_MIXED = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{20,}+"
ENDPOINT = r"(?i:https|http|ftp|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&+,;=%-]+"
#: Kinds in the order in which ties on a start are listed.
KINDS = ("assign", "access", "hex", "id", "shorthex", "mixed", "endpoint")
SPAN = "array<struct<start:int,rank:int,end:int>>"


#: Matches of a text that are summed up one after another.
CHUNK = 64


def _spans(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0, gate: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: what split() leaves between matches gives the starts.

    Appending to an array copies it, so places are found in two steps: where each chunk of matches begins, then those inside.
    """
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    counted = matches if not group else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.slice(F.arrays_zip(matches.alias("m"), counted.alias("n"), gaps.alias("gap")), F.lit(1), F.size(matches))
    none = F.expr(f"cast(array() as {SPAN})")

    def inside(chunk: Column, begin: Column) -> Column:
        state = F.aggregate(
            chunk,
            F.struct(begin.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["m"]).alias("at"),
                F.when(
                    x["n"] >= least,
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["m"]).alias("end")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        return state["out"]

    def placed(all_found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_found) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_found, k * CHUNK + 1, F.lit(CHUNK)))
        begins = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda acc, chunk: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(chunk, F.lit(0), lambda at, x: at + x["gap"] + x["m"]))),
        )
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), begins.alias("begin")), lambda c: F.coalesce(inside(c["chunk"], c["begin"]), none)))

    # The matches are one element of an array, so that they are found once and not wherever they are used.
    spans = F.flatten(F.transform(F.array(found), placed))
    if gate:
        spans = F.when(text.rlike(pattern), spans).otherwise(none)
    return F.when(text.rlike(gate or pattern), spans).otherwise(none)


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def _gap(a: str, b: str) -> Column:
    return F.greatest(F.col(f"{a}.start") - F.col(f"{b}.end"), F.col(f"{b}.start") - F.col(f"{a}.end"), F.lit(0))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per document: `id`, `row_key` (null if nothing is found), `base` and `linked` spans (start, rank, end).

    Ranks index KINDS.  `base` holds the strong parts and `linked` the weak ones that a complementary part supports.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = narrow(docs, id=id_col, text=text_col).withColumn("text", text)
    assign = F.filter(_spans(F.col("text"), ASSIGN, 0, 6, 1, gate=r"(?i:passw|secret|token|api_?key)"), lambda s: s["end"] > 0)
    found = found.select(
        "id",
        F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("~")), F.col("text")), 256).alias("row_key"),
        F.concat(assign, _spans(F.col("text"), ACCESS, 1, 20), _spans(F.col("text"), HEX, 2)).alias("base"),
        F.concat(_spans(F.col("text"), WEAK_ID, 3), _spans(F.col("text"), WEAK_HEX, 4), _spans(F.col("text"), WEAK_MIXED, 5), _spans(F.col("text"), ENDPOINT, 6)).alias("weak"),
    )
    found = materialize(
        found.select(
            "id",
            F.when((F.size("base") > 0) | (F.size("weak") > 1), F.col("row_key")).alias("row_key"),
            F.array_sort("base").alias("base"),
            F.when(F.size("base") + F.size("weak") > 1, F.array_sort("weak")).otherwise(F.expr(f"cast(array() as {SPAN})")).alias("weak"),
        ),
        "secret-parts",
    )
    # Weak copies of what a strong part already covers are not parts of their own.
    found = found.withColumn("weak", F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"]))))
    some = found.where(F.size("weak") > 0).dropDuplicates(["row_key"])
    weak = some.select("row_key", F.explode("weak").alias("w")).select("*", F.explode(F.sequence(F.floor((F.col("w.start") - scope) / scope), F.floor((F.col("w.end") + scope) / scope))).alias("bin"))
    part = some.select("row_key", F.explode(F.concat("base", "weak")).alias("p")).select("*", F.explode(F.sequence(F.floor(F.col("p.start") / scope), F.floor(F.col("p.end") / scope))).alias("bin"))
    is_id, is_secret = F.col("p.rank").isin(1, 3), F.col("p.rank").isin(0, 2, 4, 5)
    fits = F.when(F.col("w.rank") == 3, is_secret).when(F.col("w.rank").isin(4, 5), is_id).otherwise(is_id | is_secret)
    linked = (
        weak.join(part, ["row_key", "bin"])
        .where(fits & (_gap("w", "p") <= scope))
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set("w")).alias("linked"))
    )
    none = F.expr(f"cast(array() as {SPAN})")
    # Rows without any weak part left have nothing to link and stay out of the join.
    alone = found.where(F.size("weak") == 0).select("id", "row_key", "base", none.alias("linked"))
    rest = found.where(F.size("weak") > 0).select("id", "row_key", "base")
    return alone.unionByName(rest.join(linked, "row_key", "left").select("id", "row_key", "base", F.coalesce("linked", none).alias("linked")))


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of scan_secrets()."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scan_secrets(docs).select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; each run of overlapping spans in `text` becomes `mark`, and n_chars follows. Null texts stay null."""
    names = docs.columns
    found = scan_secrets(docs).select(F.col("row_key").alias("__secret_key"), F.array_sort(F.concat("base", "linked")).alias("__secret_spans")).where(F.size("__secret_spans") > 0).dropDuplicates(["__secret_key"])
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), text), 256)
    cut = F.aggregate(
        "__secret_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")).alias("out")),
        ).otherwise(acc),
    )
    cleaned = F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text")))
    out = docs.withColumn("__secret_key", key).join(found, "__secret_key", "left").withColumn("text", F.when(F.col("__secret_spans").isNotNull(), cleaned).otherwise(F.col("text")))
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("__secret_spans").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names)
