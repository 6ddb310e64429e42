"""Cases that a review of the third round found to differ from their definitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import refs as N
from verisect.functions import udfs as U
from verisect.operators import fuzzy
from verisect.operators import questions as B
from verisect.operators import quotations as Q
from verisect.operators.joins import spread
from verisect.plans import registry
from verisect.sources import tables


def test_a_citation_before_a_quotation_outside_its_paragraph(spark):
    quotes = spark.createDataFrame([(1, 3815, 3820, 100, 1500), (2, 1600, 1605, 100, 1500)], "id long, start int, end int, para_start int, para_end int")
    cites = spark.createDataFrame([(1, 3711, 3714, "before"), (2, 1610, 1613, "past the paragraph"), (2, 1600, 1600, "at it")], "id long, start int, end int, raw string")
    assert {r.id: r.raw for r in Q.attached_cites(quotes, cites, ["id"]).collect()} == {1: "before", 2: "at it"}


@pytest.mark.parametrize(("text", "offset", "at"), [("éééé the the x", 8, 4), ("éé the x", 4, 2), ("ab the x", 2, 2), ("é the x", 1, 1), ("€€ the x", 5, 2)])
def test_byte_offsets_are_read_as_bytes(spark, text, offset, at):
    rows = spark.createDataFrame([(text, offset)], "t string, o int")
    assert rows.select(C.char_offset(F.col("t"), F.col("o"), F.lit(" the ")).alias("at")).first().at == at


def test_first_of_key_with_part_keys_over_a_million(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1_150_000, 3, 1), (1, 20, 3, 2), (2, 5, 3, 1), (2, 6, 3, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = c.execute(registry.ORACLES["e2_first_of_key"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["e2_first_of_key"](spark, str(tmp_path)).collect())) == sorted(want)


def test_an_object_before_a_letter_beyond_ascii(spark):
    sentences = [("Des anè enier reque oié tion que de un.", "fragment_start"), ("Des anne enier reque oi tion que de un.", "no_finite_verb")]
    rows = spark.createDataFrame(sentences, "t string, reason string")
    assert [r.got for r in rows.select(B.reject_reason(F.col("t")).alias("got")).collect()] == [r for _, r in sentences]


def test_the_clause_before_a_citation(spark):
    assert U.last_clause("It was settled. In Lee v. Ray, ") == "In Lee v. Ray, " and U.last_clause("as in (Fla. 1950), Lee v. Ray, ") == "Lee v. Ray, "
    assert U.last_clause("In re: Lee; Ray") == "Ray" and U.last_clause("In re: Lee") == "In re: Lee" and U.last_clause("") == ""
    assert [m[0] for m in N.NONCASE.finditer("xRule 5 Rule 5, Stat. § 3")] == ["Rule 5", "Stat. ", "§"]


def test_texts_of_orders_are_dealt_to_all_cores(spark):
    rows = spread(spark.range(100).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_words_with_a_common_beginning_meet_only_if_alike():
    words = [f"uvababab{x}{y}{z}" for x in ("ab", "cd", "ef", "gh") for y in ("ab", "cd", "ef", "gh") for z in ("ab", "cd", "ef", "gh")]
    met = [(a, b) for a in words for b in (w[:1] + w[2:] for w in words) if set(fuzzy.piece_keys(a, {13})) & set(fuzzy.probe_keys(b, {14}))]
    alike = [(a, b) for a in words for b in (w[:1] + w[2:] for w in words) if U.alike(a, [b])]
    assert set(alike) <= set(met) and len(met) < 2 * len(words)


def test_quotations_are_held_to_the_fixed_rules_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Q, "stored", lambda df, name: kept.append(name) or tables.stored(df, name))
    rows = spark.createDataFrame([(1, "relevant evidence if its probative value is substantially outweighed by a danger", 0, 80), (2, "never were such words in any rule heard or read", 0, 47)], "answer long, quote string, start int, end int")
    rules = spark.createDataFrame([], "jurisdiction string, rule string, text string")
    got = Q.rule_texts(rows.select("answer", F.col("quote").alias("text")), rows, rules, ["answer"])
    assert [(r.answer, r.via) for r in got.collect()] == [(1, "fixed_list")] and kept == ["fixed-rules"]


def test_texts_without_any_of_a_patterns_words_are_not_scanned(monkeypatch):
    class Never:
        def __getattr__(self, name):
            raise AssertionError("scanned")

    for name in ("WARNING", "RETRACTION", "DOUBT", "CITE_SPAN"):
        monkeypatch.setattr(U, name, Never())
    text = "The rule holds. The court held as much in Lee v. Ray."
    assert U.warns(text) == 0 and U.withdrawal(text, 43, 51) is None and U.without_cites(text) == text
    assert U.hinted("ſo it iſ", "so") and U.hinted("SO", "so") and not U.hinted("no", "so")


def test_doubts_and_warnings_are_still_told():
    assert U.warns("It was called into doubt.") == 1 and U.warns("It is on red flag treatment; red-flagged.") == 1 and U.warns("It is no longer good law.") == 1
    assert U.withdrawal("I initially gave 1 U.S. 2; rather, it is 3 U.S. 4.", 17, 25) == "corrected"
    assert U.withdrawal("1 U.S. 2 may not exiſt.", 0, 8) == "may not exiſt" and U.overlap("a b c d", "x a b c d y") == 1.0
    assert [r["kind"] for r in N.references("Moonix v. State, 1 U.S. 2. Ibid. So Rule 5. Moonix, supra, at 9.")] == ["name", "full", "id", "noncase", "name", "supra"]


def test_a_text_is_read_once_for_its_citations(spark, monkeypatch):
    from verisect.operators import grading as D

    kept = []
    monkeypatch.setattr(D, "stored", lambda df, name: kept.append(name) or tables.stored(df, name))
    registry.QUERIES["d1_grades_of_orders"](spark, "/root/testdata/sf0.001")
    assert {"checked", "chained", "folded", "names"} <= set(kept)


def test_findings_are_mapped_once_for_all_tiers(spark, monkeypatch):
    from verisect.plans import widened

    kept = []
    monkeypatch.setattr(widened, "stored", lambda df, name: kept.append(name) or tables.stored(df, name))
    registry.QUERIES["q33_tiers_of_orders"](spark, "/root/testdata/sf0.001")
    assert kept == ["findings"]
