"""What the fourth round of findings asked for."""

import difflib
import random

from pyspark.sql import functions as F

from verisect.functions import udfs as U
from verisect.operators import citations as G
from verisect.operators import grading as D
from verisect.plans import registry
from verisect.sources import tables


def test_stages_of_a_grade_write_no_texts(spark, monkeypatch):
    """A text is read where it meets its citations; no stage after that writes it down or shuffles it."""
    kept, plans = {}, []

    def stored(df, name):
        kept[name] = df.columns
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.stored(df, name)

    monkeypatch.setattr(D, "stored", stored)
    found = registry.QUERIES["d1_stages_of_orders"](spark, "/root/testdata/sf0.001")
    assert kept and not any("text" in columns for columns in kept.values()) and found.count() > 0
    assert all(plan.count("ENSURE_REQUIREMENTS") <= 1 for plan in plans[:2])  # the rows of an answer meet at most once


def test_separators_before_a_citation(spark):
    texts = ["Lee v. Ray, 1 U.S. 2", "x, 12-14; ", "no separators", "n.3 & 4 ", "a  ", "1 2", "", "y" + " " * 80, "–—\t\r\n"]
    rows = spark.createDataFrame([(t, len(t), k) for t in texts for k in range(len(t) + 1)], "text string, start int, before int")
    pattern = r"^[\s,;\d\-–—n.&]*$"
    between = F.substring(F.col("text"), F.col("before") + 1, F.col("start") - F.col("before"))
    want = (F.col("start") - F.col("before") <= 60) & between.rlike(pattern)
    got = F.col("start") - F.col("before") <= G.glue(F.col("text"), F.col("start"))
    assert rows.where(~want.eqNullSafe(got)).collect() == []


def test_every_window_of_an_opinion_counts():
    """A passage behind 20 others that share three words, or behind 200 windows, was never compared."""
    quote = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    true = " ".join([*quote[:3], "and", *quote[3:5], "and", *quote[5:7], "and", *quote[7:9], "and", *quote[9:11], "and", *quote[11:13], "and", *quote[13:15], "and", quote[15]])
    assert U.overlap(" ".join(quote), true) == 1.0
    assert U.overlap(" ".join(quote), "alpha beta gamma or not " * 30 + true) == 1.0
    apart = [" ".join(quote[k : k + 3]) + " or" * 30 for k in range(14)]
    assert U.overlap(" ".join(quote), " ".join([*apart * 19, true])) == 1.0


def test_windows_by_the_definition():
    r = random.Random(4)
    for _ in range(400):
        words = lambda n: [r.choice("ab cd ef gh ij".split()) for _ in range(n)]
        wanted, hay = words(r.randint(1, 9)), words(r.randint(0, 60))
        n, best = len(wanted), 0.0
        runs = [(p, k) for k in range(n - 2) for p in range(len(hay) - 2) if wanted[k : k + 3] == hay[p : p + 3]]
        for s in {max(0, p - k - 5) for p, k in runs}:
            best = max(best, sum(b.size for b in difflib.SequenceMatcher(None, wanted, hay[s : s + n + 15], autojunk=False).get_matching_blocks()) / n)
        assert U.overlap(" ".join(wanted), " ".join(hay)) == best


def test_an_answer_of_one_citation_meets_no_other(spark, monkeypatch):
    """It is settled where its text was read; only answers of several citations were ever in need of the stages after that."""
    kept = {}
    monkeypatch.setattr(D, "stored", lambda df, name: kept.setdefault(name, tables.stored(df, name)))
    grades = registry.QUERIES["d1_grades_of_orders"](spark, "/root/testdata/sf0.001")
    assert grades.count() > kept["chained"].select("answer").distinct().count() > 0
    assert kept["chained"].groupBy("answer").count().where("count < 2").collect() == [] and "text" not in kept["checked"].columns


def test_answers_that_may_withdraw_a_citation():
    assert [U.may_withdraw(t) for t in ("This is another matter, and not so.", "NOT\x1c1 U.S. 2, but", "It does not VERIFY.")] == [(False, False), (True, False), (False, True)]


def test_citations_written_more_than_once():
    cites = [{"ord": k, "volume": v, "reporter": "A.", "page": "1"} for k, v in enumerate(("1", "2", "12", "3", "4", "5"))]
    text = "1 A. 1 A. 1, 12 A.  1 and 1 A. 1"
    assert U.cite_places(text, cites) == [r for c in cites for r in U.cite_places(text, [c])]
    assert [r["start"] for r in U.cite_places(text, cites[:1])] == [0, 5, 26]
