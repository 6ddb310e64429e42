"""What the third round of findings asked for."""

from pyspark.sql import functions as F

from verisect.operators import containment as K
from verisect.operators import reports as R
from verisect.plans import registry


def test_grades_are_not_shuffled_by_their_run(spark):
    """A run has as many grades as there are questions; they met in one task. A question of any two arms counts, as before."""
    deltas = registry.QUERIES["d6_paired_deltas_of_orders"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(run_id" not in deltas._jdf.queryExecution().executedPlan().toString()
    runs = spark.createDataFrame([("m:bare:v1", "m", "bare", None), ("m:mcp:v1", "m", "mcp", None), ("m:web:v1", "m", "web", None)], "run_id string, model string, arm string, config_json string")
    names = "n_cites n_verified n_fabricated n_unindexed n_name_mismatch n_quote_absent n_red gold_hit gold_equivalent abstained warned_treatment".split()
    given = [("m:bare:v1", "a", 1), ("m:mcp:v1", "a", 0), ("m:bare:v1", "b", 1), ("m:web:v1", "b", 1), ("m:bare:v1", "c", 1), ("m:bare:v1", "c", 1)]
    grades = spark.createDataFrame([(run, q, hit) for run, q, hit in given], "run_id string, qid string, gold_hit long").selectExpr("*", *(f"1L AS {n}" for n in names if n != "gold_hit"))
    gold = spark.createDataFrame([], "qid string, gold_flag string")
    assert [(r.common, r.d_gold_recall) for r in R.paired_deltas(runs, grades, gold).collect()] == [(2, -1.0)]


def test_documents_are_read_once_for_the_words_of_items(spark, monkeypatch):
    """Neither all words nor all word lists are shuffled: words that no item has leave where a text is read."""
    from verisect.plans import ranking
    from verisect.sources import tables

    kept = {}
    monkeypatch.setattr(ranking, "stored", lambda df, name: kept.setdefault(name, tables.stored(df, name)))
    found = registry.QUERIES["w8_longest_common_run"](spark, "/root/testdata/sf0.001")
    assert set(kept) == {"words-of-items", "rarest-words"} and found.count() > 0
    assert kept["words-of-items"].columns == ["word", "doc_id"]


def test_a_proposition_and_its_opinion_are_read_once(spark):
    """Each of them stands once in the expression; inside lambdas they ran again for every run of words."""
    said = str(K.gold_equivalent(F.col("the_prop"), F.col("the_hay")))
    assert said.count("the_prop") == said.count("the_hay") == 1
    rows = spark.range(20).select(K.once(lambda a, b: F.forall(F.array(F.lit(0), F.lit(1)), lambda x: (a + x == a + x) & (a <= 1) & (b == 2)), F.rand(), F.lit(2)).alias("r"), K.once(lambda a: a - a, F.rand()).alias("z"))
    assert {(r.r, r.z) for r in rows.collect()} == {(True, 0.0)}
    empty = spark.createDataFrame([(None, "x"), ("x", None), ("", " ")], "p string, h string").select(K.gold_equivalent(F.col("p"), F.col("h")).alias("e"))
    assert not any(r.e for r in empty.collect())


def test_a_task_remembers_few_words():
    """Python's memory in a task stays the same however many words the texts have."""
    assert K.REMEMBERED <= 60_000 and K.TEXTS <= 250
