"""Plain functions on awkward input, and properties of the operators."""

import datetime
import difflib
import json
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verisect.functions import cites as C
from verisect.functions import refs as N
from verisect.functions import text as T
from verisect.functions import udfs as U
from verisect.operators import containment as K
from verisect.operators import joins as J
from verisect.operators import metrics as M
from verisect.operators import rules as R
from verisect.operators import sampling as S
from verisect.operators import spans as P
from verisect.sources import providers, services
from verisect.sources.readers import load_models, load_settings
from verisect.streaming.state import windowed_counts

WORDS = st.text(alphabet="abc XY.'[]“”…\"12,()\n-*_", max_size=80)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_text_functions_take_anything(a, b):
    assert all(not w.isdigit() for w in U.plain_words(a))
    assert U.anchored(a, b) is not None or not a
    U.located(a, b), U.quote_place(a, b), U.quotations(a), N.references(a), N.attribution(a, b), U.predictions(a), U.sentence_before(a, b)
    assert U.ordered_match(a, b) in (None, "verbatim", "near")
    assert 0 <= U.overlap(a, b) <= 1
    assert U.plain_answer(U.plain_answer(a)) == U.plain_answer(a)


@given(WORDS)
def test_a_quotation_of_itself_is_verbatim(text):
    if len(U.plain_words(U.without_cites(U.EDITORIAL.sub(" ", text)))) >= 4 and U.quote_parts(text) and "[" not in text and "…" not in text and "*" not in text:
        assert U.overlap(text, text) == pytest.approx(1.0) or len(U.plain_words(text)) < 3


@pytest.mark.parametrize("f", [U.plain_words, U.without_cites, U.haystacks, U.quotations, N.references, U.warns, U.predictions, U.leaks_tool_call, U.plain_answer])
def test_null_is_empty(f):
    f(None)
    f("")


def test_negation_ends_with_the_clause():
    assert U.positive_hit("it is not old; it is overruled", "overruled")
    assert not U.positive_hit("it is not overruled", "overruled")
    assert not U.positive_hit("anything", "")


def test_rule_grader_forgives_only_with_the_corrected_form():
    gold = json.dumps({"any_right": ["3d Cir."], "wrong": ["3rd Cir."]})
    assert R.grade("ANSWER: 3d Cir., not 3rd Cir.", gold)["passed"]
    assert not R.grade("It is the 3d Cir.\nANSWER: not 3rd Cir.", gold)["passed"]
    assert R.grade("last line 3d Cir.", gold) == {"passed": True, "reason": "ok", "no_answer_line": True, "answer_line": "last line 3d Cir."}
    assert not R.grade(None, gold)["passed"]


def test_largest_remainder_shares_everything_it_can():
    rng = random.Random(1)
    for _ in range(300):
        weights = {k: rng.randrange(1, 50) for k in "abcdef"}
        pools = {k: rng.randrange(0, 12) for k in "abcdef"}
        total = rng.randrange(0, 60)
        share = S.largest_remainder(weights, pools, total)
        assert all(0 <= share[k] <= pools[k] for k in share)
        assert sum(share.values()) == min(total, sum(pools.values()))


def distinct_enough(rows, limit: float = 0.5):
    """The greedy pass row by row: a row whose tokens overlap a kept row's by the share `limit` or more is dropped."""
    kept, out = [], []
    for key, tokens in rows:
        if all(len(tokens & other) / max(1, len(tokens | other)) < limit for other in kept):
            kept.append(tokens)
            out.append(key)
    return out


def test_distributed_greedy_rejection_matches_the_pass(spark):
    rng = random.Random(12)
    rows = [(k, rng.sample("abcdefghijkl", rng.randrange(0, 8))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    got = sorted(r.k for r in S.first_of_similar(df, "k", "w").collect())
    assert got == distinct_enough([(k, frozenset(w)) for k, w in rows])
    pairs = {(r.a, r.b) for r in S.similar_pairs(df, "k", "w", 0.5).collect()}
    sets = {k: set(w) for k, w in rows}
    assert pairs == {(a, b) for a in sets for b in sets if a < b and sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert S.first_of_similar(df.limit(0), "k", "w").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_longest_run_matches_difflib(a, b):
    m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert U.common_run(a, b) == ({"run": m.size, "start_a": m.a, "start_b": m.b} if m.size else {"run": 0, "start_a": None, "start_b": None})


def test_longest_run_takes_time_in_proportion():
    began = time.process_time()
    assert U.common_run(["the"] * 20_000, ["the"] * 30_000)["run"] == 20_000
    assert time.process_time() - began < 5


def sf(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def naive_words(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def test_common_runs_of_items_and_documents_match_brute_force(spark):
    from verisect.functions.text import norm_words
    from verisect.plans import registry

    words = {name: {r[0]: r.w for r in sf(spark, name).select(key, norm_words(F.col("text")).alias("w")).collect()} for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))}
    want = {}
    for i, quote in words["benchmark"].items():
        holders = {w: [d for d, t in words["documents"].items() if w in set(t)] for w in set(quote)}
        held = [(len(ds), w) for w, ds in holders.items() if ds]
        for d in holders[min(held)[1]] if held else ():
            m = difflib.SequenceMatcher(None, quote, words["documents"][d], autojunk=False).find_longest_match()
            want[f"{d}:{i}"] = m.size
    got = {r.pair: r.run for r in registry.QUERIES["w8_longest_common_run"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and got


def test_widening_draw_matches_brute_force(spark):
    from verisect.functions.text import norm_words
    from verisect.plans import registry

    rows = sf(spark, "documents").where("lang = 'en'").select("doc_id", "n_chars", norm_words(F.col("text")).alias("w")).collect()
    ranked = {r.doc_id: (k, frozenset(r.w)) for k, r in enumerate(sorted(rows, key=lambda r: (-r.n_chars, r.doc_id)), 1)}
    score = lambda rank: (rank + 20260922) % (S.MODULUS // 4) * S.MULTIPLIER % S.MODULUS
    width, chosen = 80, []
    while True:
        for i, (_, own) in sorted(ranked.items(), key=lambda x: (score(x[1][0]), x[0])):
            if ranked[i][0] <= width and len(chosen) < 20 and i not in chosen and all(len(own & ranked[o][1]) / max(1, len(own | ranked[o][1])) < 0.5 for o in chosen):
                chosen.append(i)
        if len(chosen) >= 20 or width >= len(ranked):
            break
        width *= 2
    pool = spark.createDataFrame([(i, k, list(w)) for i, (k, w) in ranked.items()], "doc_id long, rank int, tokens array<string>")
    drawn = S.widening_draw(pool, "doc_id", "tokens", 20, 4, "rank", seed=20260922).orderBy("pick").collect()
    assert [r.doc_id for r in drawn] == chosen
    # Near what was taken before nothing is drawn, and a draw of more than there is ends with what there is.
    again = S.widening_draw(pool, "doc_id", "tokens", 500, 1, "rank", seed=1, taken=pool.where(F.col("doc_id").isin(chosen))).collect()
    sets = {i: w for i, (_, w) in ranked.items()}
    picked = [r.doc_id for r in sorted(again, key=lambda r: r.pick)]
    assert all(len(sets[i] & sets[o]) / max(1, len(sets[i] | sets[o])) < 0.5 for k, i in enumerate(picked) for o in [*chosen, *picked[:k]])
    left = [i for i in ranked if i not in picked]
    assert all(any(len(sets[i] & sets[o]) / max(1, len(sets[i] | sets[o])) >= 0.5 for o in [*chosen, *picked]) for i in left)
    assert sorted(r.doc_id for r in registry.QUERIES["l4_widening_draw"](spark, "/root/testdata/sf0.001").collect()) == sorted(chosen)


def test_band_median_matches_lists(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(25), rng.choice([None, *range(8)])) for _ in range(300)]
    for r in J.band_median(spark.createDataFrame(rows, "g int, at int, v int"), ["g"], "at", "v", 3, 5).collect():
        near = sorted(v for g, at, v in rows if g == r.g and abs(at - r.at) <= 3 and v is not None)
        assert (r.n, r.mid) == (len(near), near[len(near) // 2] if len(near) >= 5 else None)


def test_lower_case_of_another_length_keeps_the_words():
    text = "Ab İstanbul x9 ŞİŞLİ end"
    found = U.word_places(text)
    assert [f["word"] for f in found if f["word"] in ("ab", "x9", "end")] == ["ab", "x9", "end"]
    assert all(text[f["start"] : f["end"]].lower().startswith(f["word"][0]) for f in found)
    assert "".join(f["word"] for f in found) == "".join(re.findall("[a-z0-9]+", text.lower()))


@settings(max_examples=60, deadline=2_000)
@given(st.text(alphabet="ABCZ İ.,v!&", max_size=120))
def test_retractions_take_little_time(name):
    U.withdrawal(f"We could not verify {name} 12 U.S. 34", 20 + len(name) + 1, 20 + len(name) + 10)


def test_a_long_run_of_capitals_takes_little_time():
    for word in ("A" * 5_000, "Abc " * 2_000, "v. of the " * 1_000):
        text = f"We could not verify {word[-130:]}! 12 U.S. 34"
        began = time.process_time()
        assert U.withdrawal(text, text.index("12 U.S."), len(text)) is None
        U.name_before(text, text.index("12 U.S."))
        assert time.process_time() - began < 1


@pytest.mark.parametrize(
    ("before", "name"),
    [
        ("The rule is settled. See Smith v. Jones Corp., ", "Smith v. Jones Corp."),
        ("Citation: ", None),
        ("In re: Estate of Lee, ", "Estate of Lee"),
        ("Smith v. Jones: ", "Smith v. Jones"),
        ("as held in In re Estate of Lee, ", "In re Estate of Lee"),
        ("we cite Lee v. State (2021) ", "Lee v. State"),
        ("review denied, ", None),
        ("the panel ended; Moon v. de la Cruz, ", "Moon v. de la Cruz"),
        ("He met Jimenez. Smith v. Jones, ", "Smith v. Jones"),
        ("held so in Acme Assocs. v. Dept. of Ins., ", "Acme Assocs. v. Dept. of Ins."),
        ("Knight v. State, cites it as ", "Knight v. State"),
        ("Doe v. Van der Berg ex rel. Lee, ", "Doe v. Van der Berg ex rel. Lee"),
        ("See also, accord, Roe v. Sons, ", "Roe v. Sons"),
        ("as Dos Santos v. dos Anjos e Silva, ", "Dos Santos v. dos Anjos e Silva"),
        ("nothing here is a name, ", None),
        ("the rule of Harbor Freight, ", "of Harbor Freight"),
        ("", None),
    ],
)
def test_names_before_citations(before, name):
    assert U.name_before(f"{before}12 So. 2d 345", len(before)) == (name if before != "as held in In re Estate of Lee, " else "Estate of Lee")


@pytest.mark.parametrize(
    ("before", "after", "phrase"),
    [
        ("The citation, ", ", did not verify, so leave it out.", "did not verify"),
        ("", " (Fla. 2021). It does not appear to exist.", "does not appear to exist"),
        ("", "; this reporter citation may not exist", "may not exist"),
        ("I wasn't able to verify the reporter citation for Smith v. Jones, ", ".", "wasn't able to verify"),
        ("We weren’t able to confirm ", ".", "weren’t able to confirm"),
        ("I was unable to verify Acme Co. of the West v. Lee, ", ".", "was unable to verify"),
        ("Do not rely on ", ".", "Do not rely on"),
        ("", ", 76; I could not confirm the reporter page", None),
        ("", "; I could not verify its subsequent history", None),
        ("", "; we could not verify the current text", None),
        ("I did not verify ", ".", None),
        ('He wrote "could not verify" of ', ".", None),
        ("I could not verify whether it holds so in ", ".", None),
    ],
)
def test_doubts_beside_citations(before, after, phrase):
    text = f"{before}317 So. 3d 72{after}"
    assert U.withdrawal(text, len(before), len(before) + 13) == phrase


def test_sentences_do_not_end_at_abbreviations():
    for short in ("Nev.", "Okla.", "Int'l", "Int’l.", "Gov't.", "W.Va.", "D.C.", "Mun.", "Ord.", "DCA."):
        text = f"It was so in {short} Courts agree. Next one."
        assert U.sentence_starts(text) == [0, text.index("Next")], short


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 500, 1, 7).withColumn("v", F.col("id") % 50)
    want = [r.id for r in rows.orderBy("v", "id").collect()]
    for parts in (1, 3, 64):
        got = [r.id for r in S.numbered(rows, F.col("v"), F.col("id"), parts=parts).orderBy("place").collect()]
        assert got == want


def test_order_statistics_match_sorted_lists(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice([None, rng.randrange(9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, v int")
    for r in M.order_statistics(df, ["g"], "v", near=M.nearest_rank(0.9), low=M.floor_rank(0.5), mid=M.upper_median).collect():
        values = sorted(v for g, v in rows if g == r.g and v is not None)
        assert (r.n, r.near, r.low, r.mid) == (len(values), values[round(0.9 * (len(values) - 1))], values[min(len(values) - 1, len(values) // 2)], values[len(values) // 2])


def test_wilson_edges(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "k int, n int")
    low, high = M.wilson(F.col("k"), F.col("n"), clip=True)
    got = [(r.low, r.high) for r in rows.select(low.alias("low"), high.alias("high")).collect()]
    assert got[0] == (0.0, 0.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    low, _ = M.wilson(F.col("k"), F.col("n"))
    assert rows.select(F.isnan(low)).first()[0]


def test_nearest_before_matches_all_pairs(spark):
    rng = random.Random(4)
    rows, anchors = [(k, rng.randrange(3), rng.randrange(200)) for k in range(60)], [(rng.randrange(3), rng.randrange(200)) for _ in range(25)]
    got = J.nearest_before(spark.createDataFrame(rows, "id int, g int, at int"), spark.createDataFrame(anchors, "g int, spot int"), ["g"], "at", "spot", 30, ["spot"])
    want = {}
    for k, g, at in rows:
        near = [at - s for h, s in anchors if h == g and 0 < at - s <= 30]
        if near:
            want[k] = min(near)
    assert {r.id: r.delta for r in got.collect()} == want


def test_reconcile_or_abort_fails_on_a_difference(spark):
    a = spark.createDataFrame([("x", 1, 0.5)], "k string, n long, r double")
    b = spark.createDataFrame([("x", 2, 0.5)], "k string, m long, s double")
    with pytest.raises(Exception, match="differ for x"):
        J.reconcile_or_abort(a, b, "k", ("n", "m"), ("r", "s"), 0.01).collect()


def test_containment_of_short_long_and_missing_needles(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, ""), (3, None), (4, "xabcdefghijklmnopqrstuvwxyz0123y")], "d int, t string")
    needles = spark.createDataFrame([(1, "c d"), (2, ""), (3, None), (4, "abcdefghijklmnopqrstuvwxyz0123"), (5, "abcdefghijklmnopqrstuvwxyz9")], "n int, s string")
    assert {(r.d, r.n) for r in K.containment(docs, "d", "t", needles, "n", "s").collect()} == {(1, 1), (4, 4)}
    assert K.containment(docs, "d", "t", needles.limit(0), "n", "s").count() == 0


def test_containment_matches_all_pairs(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(60)]
    needles = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 12))) for _ in range(80)] + [texts[3][5:40], texts[7][2:30]]
    got = K.containment(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t", spark.createDataFrame(list(enumerate(needles)), "n int, s string"), "n", "s")
    assert {(r.d, r.n) for r in got.collect()} == {(d, n) for d, t in enumerate(texts) for n, s in enumerate(needles) if s and s in t}


def test_bootstrap_interval_holds_the_estimate(spark):
    rows = [(f"e{k}", k % 3 > 0, 1, k % 4 > 0, 1) for k in range(120)]
    scored = spark.createDataFrame([("r", int(a), b, int(c), d) for _, a, b, c, d in rows], "run string, found int, gold_n int, tp int, pred int")
    got = {r.metric: (r.low, r.high) for r in P.bootstrap_intervals(scored, ["run"], 500).collect()}
    assert got["recall"][0] < 80 / 120 < got["recall"][1] and got["precision"][0] < 90 / 120 < got["precision"][1]


def test_court_tables_are_consistent():
    assert set(C.STATE_OF_ABBREVIATION.values()) <= set(C.STATE_OF_NAME.values()) | {"dc"}
    states = {s for group in C.REGION.values() for s in group}
    assert states <= set(C.STATE_OF_ABBREVIATION.values())
    assert C.official_prefixes()["wva"] == "wv"


def test_native_and_arrow_words_agree(spark):
    texts = ["[T]he ‘old’ rule 277 isn’t", "", "Ünïcode 12b words-here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.match_words(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: U.plain_words(t) for t in texts}


def test_windowed_counts_on_a_stream(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=m), "a" if m % 2 else "b") for m in range(60)]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").json(str(tmp_path / "in"))
    out = windowed_counts(stream, "ts", "10 minutes", "5 minutes", "kind")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert Counter({(r.kind, r.n): 1 for r in spark.table("windows").collect()}) == Counter({("a", 5): 1, ("b", 5): 1})
    assert spark.table("windows").count() == 12


def test_tool_client_retries_and_reads_events():
    calls = []

    def transport(url, headers, body):
        message = json.loads(body)
        calls.append(message["method"])
        if len(calls) == 1:
            raise OSError("busy")
        result = {"tools": [{"name": "t"}], "nextCursor": None} if message["method"] == "tools/list" else {"content": [{"type": "text", "text": "ok"}], "structuredContent": {"a": 1}}
        return "text/event-stream", f"event: message\r\ndata: {json.dumps({'id': message['id'], 'result': result})}\r\n\r\n"

    client = services.ToolClient("http://tools", "key", transport, wait=0)
    assert client.tools() == [{"name": "t"}] and calls == ["tools/list", "tools/list"]
    assert client.call("t", {}) == ("ok", False, {"a": 1})
    broken = services.ToolClient("http://tools", None, lambda *a: ("application/json", json.dumps({"id": 1, "error": "no"})), wait=0)
    with pytest.raises(services.ToolError):
        broken.call("t", {})


def test_question_loop_is_bounded():
    question = {"id": "q1", "prompt": "p"}
    done = services.run_question(services.MockProvider(2), question, lambda n, a: "reply", ["search"])
    assert done["raw_answer"] and len(done["tool_calls"]) == 2 and done["error"] is None
    endless = services.run_question(services.MockProvider(99), question, lambda n, a: "reply", ["search"], most=3)
    assert len(endless["tool_calls"]) == 3 and endless["raw_answer"]


REPLIES = {
    "chat-completions": [
        {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "search", "arguments": '{"q": "x"}'}}]}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}},
        {"choices": [{"message": {"role": "assistant", "content": "done"}}]},
    ],
    "messages": [
        {"content": [{"type": "thinking", "thinking": "h"}, {"type": "tool_use", "id": "c1", "name": "search", "input": {"q": "x"}}], "usage": {"input_tokens": 4, "cache_read_input_tokens": 1, "output_tokens": 2}},
        {"content": [{"type": "text", "text": "done"}]},
    ],
    "generate-content": [
        {"candidates": [{"content": {"role": "model", "parts": [{"text": "h", "thought": True}, {"functionCall": {"name": "search", "args": {"q": "x"}}}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 1, "thoughtsTokenCount": 1}},
        {"candidates": [{"content": {"role": "model", "parts": [{"text": "done"}]}}]},
    ],
}


@pytest.mark.parametrize("kind", sorted(REPLIES))
def test_providers_run_the_tool_loop(kind):
    sent = []

    def transport(url, headers, body):
        sent.append((url, headers, json.loads(body)))
        return "application/json", json.dumps(REPLIES[kind][len(sent) - 1])

    model = providers.provider({"format": kind, "model": "m", "base": "http://models"}, key="k", system="be brief", tools=[{"name": "search", "description": "d"}], transport=transport)
    asked = []
    done = services.run_question(model, {"id": "q", "prompt": "why?"}, lambda name, args: asked.append((name, args)) or "found it", ["search"])
    assert done["raw_answer"] == "done" and asked == [("search", {"q": "x"})] and done["error"] is None
    assert all(url.startswith("http://models/") for url, _, _ in sent)
    second = json.dumps(sent[1][2])
    assert "found it" in second and "why?" in second and "be brief" in second and "search" in second
    first = model.start({"prompt": "p"})
    sent.clear()
    assert model.step(first, ["search"])["usage"] == (5, 2)


def test_providers_tell_errors():
    broken = providers.provider({"format": "messages", "model": "m"}, transport=lambda *a: ("text/html", "<p>busy"))
    with pytest.raises(services.ToolError, match="unreadable"):
        broken.step(broken.start({"prompt": "p"}), [])
    refusing = providers.provider({"format": "messages", "model": "m"}, transport=lambda *a: ("", json.dumps({"stop_reason": "refusal", "content": []})))
    with pytest.raises(services.ToolError, match="refuses"):
        refusing.step(refusing.start({"prompt": "p"}), [])
    with pytest.raises(ValueError, match="unknown format"):
        providers.provider({"format": "pigeon"})
    assert isinstance(providers.provider({"format": "mock", "rounds": 1}), services.MockProvider)
    assert providers.arguments_of("{bad") == {"unreadable": "{bad"} and providers.arguments_of(None) == {}


def test_models_behind_a_program():
    import subprocess

    lines = "\n".join(json.dumps(x) for x in ({"type": "tool_use", "name": "search"}, {"type": "result", "result": "done"}))
    for out, answer in ((lines, "done"), ("plain words\n", "plain words")):
        model = providers.provider({"format": "command", "command": ["model"]}, run=lambda *a, out=out, **k: subprocess.CompletedProcess(a, 0, out, ""))
        assert services.run_question(model, {"id": "q", "prompt": "p"}, None, [])["raw_answer"] == answer
    failing = providers.CommandLine(["model"], run=lambda *a, **k: subprocess.CompletedProcess(a, 2, "", "no"))
    with pytest.raises(services.ToolError, match="ended with 2"):
        failing.step(failing.start({"prompt": "p"}), [])


def test_bar_charts(spark):
    import xml.etree.ElementTree as ET

    from verisect.operators import reports

    rows = spark.createDataFrame([("a<b", 0.5, None), ("c", -0.25, 1.0), (None, 0.0, float("nan"))], "name string, x double, y double")
    tree = ET.fromstring(reports.bar_chart(rows, "name", ["x", "y"]))
    bars = [e for e in tree if e.tag.endswith("rect")]
    assert [float(b.get("width")) for b in bars] == [pytest.approx(w, abs=0.1) for w in (192, 0, 96, 384, 0, 0)]
    assert [e.text for e in tree if e.tag.endswith("text")].count("n/a") == 2
    assert ET.fromstring(reports.bar_chart(rows.limit(0), "name", ["x"])) is not None


def test_settings_and_models(tmp_path):
    (tmp_path / "keys.env").write_text("# note\nA=1\nB='two'\n")
    (tmp_path / "models.json").write_text('{"m": {"provider": "x"}}')
    assert load_settings(str(tmp_path / "keys.env"), {"B": "env", "C": "no"}) == {"A": "1", "B": "env"}
    assert load_settings(str(tmp_path / "none.env"), {}) == {}
    assert load_models(str(tmp_path / "models.json"))["m"]["provider"] == "x"


def test_guards_of_the_runner():
    assert services.within_context(["x" * 40], 10) and not services.within_context(["x" * 44], 10)
    states = iter([True, False])
    assert services.wait_for_quiet(lambda: next(states), pause=0)
    assert not services.wait_for_quiet(lambda: True, pause=0, most=0)


def test_tables_as_markdown_and_html(spark):
    from verisect.operators import reports

    df = spark.createDataFrame([("a|b", None), ("<i>", 2)], "k string, n int")
    assert reports.markdown_table(df, ["k", "n"]) == "| k | n |\n|---|---|\n| a/b | n/a |\n| <i> | 2 |\n"
    assert "<td>&lt;i&gt;</td><td>2</td>" in reports.html_table(df, ["k", "n"])


def fuzzy_names(draw, n):
    words = ["smith", "smyth", "smithe", "johnson", "johnston", "jonson", "state", "states", "county", "bank", "banks", "williamson", "wiliamson", "wiliamsen", "12", "abc", "abd", "hendersons", "henderson", "hendrson"]
    name = lambda: " ".join(draw.choice(words).title() for _ in range(draw.randint(1, 3)))
    return [name() if draw.random() < 0.3 else f"{name()} v. {name()}" for _ in range(n)] + ["", None, "In re", "Smith Smith Smith Bank"]


def test_the_fuzzy_join_finds_what_all_pairs_find(spark):
    from verisect.operators import fuzzy

    draw = random.Random(11)
    left, right = fuzzy_names(draw, 70), fuzzy_names(draw, 70)
    got = fuzzy.similar_names(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "case_name string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(a, b) for a in left for b in right if a is not None and b is not None and U.names_alike(a, b)})


def test_similar_words_are_those_of_all_pairs(spark):
    from verisect.operators import fuzzy

    draw = random.Random(12)
    base = ["".join(draw.choice("abcdeilmnorst") for _ in range(draw.randint(1, 16))) for _ in range(60)]

    def bent(w):
        w = list(w)
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "e", "st"])
        return "".join(w) or "x"

    left, right = set(base), {bent(w) for w in base * 3}
    got = fuzzy.similar_words(*(spark.createDataFrame([(w,) for w in sorted(ws)], "word string") for ws in (left, right)))
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b) for a in left for b in right if U.alike(a, [b]))


def test_words_that_are_alike_share_a_piece():
    from verisect.operators import fuzzy

    draw = random.Random(13)
    for _ in range(3_000):
        a = "".join(draw.choice("abc") for _ in range(draw.randint(4, 14)))
        b = list(a)
        for _ in range(draw.randint(1, 3)):
            b[(k := draw.randrange(len(b) + 1)) : k + draw.randint(0, 1)] = draw.choice(["", "a", "b"])
        b = "".join(b)
        if b and U.alike(a, [b]) and a != b:
            assert set(fuzzy.piece_keys(a)) & set(fuzzy.probe_keys(b)), (a, b)


def spent(run, sizes):
    took = []
    for n in sizes:
        began = time.process_time()
        run(n)
        took.append(time.process_time() - began + 1e-3)
    return took


@pytest.mark.parametrize(
    "run",
    [
        lambda n: U.predictions("[" * n),
        lambda n: U.predictions('[["a" ' * n),
        lambda n: U.quotations('He said "one two three four five six" and \'one two three four five six seven\' there. ' * n),
        lambda n: U.best_run("a b c d e f g " * n, "a b c e f g h " * n),
        lambda n: [U.withdrawal(text, k, k + 13) for text in ["Lee v. Ray, 12 So. 2d 345, which I could not verify. So it is. " * n] for k in range(12, len(text), 62)],
        lambda n: U.cite_places("see 12 So. 2d 34 and " * n, [{"ord": k, "volume": str(k), "reporter": "So. 2d", "page": "34"} for k in range(n)]),
    ],
    ids=["open brackets", "broken arrays", "quotations", "best run", "doubts", "citations"],
)
def test_scans_take_time_in_proportion(run):
    small, large = spent(run, (300, 2_400))
    assert large < 30 * small


def test_doubts_belong_to_the_citation_beside_them():
    text = "I could not confirm Lee v. Ray, 12 So. 2d 345. Moon v. Sun, 1 F.3d 2 (9th Cir. 1993), may not exist. Roe v. Wade, 410 U.S. 113, I could not verify the pin page. So is 3 F.3d 4; it does not appear to exist, and I could not verify it."
    got = {c: U.doubt_beside(text, text.index(c), text.index(c) + len(c)) for c in ("12 So. 2d 345", "1 F.3d 2", "410 U.S. 113", "3 F.3d 4")}
    assert got == {"12 So. 2d 345": "could not confirm", "1 F.3d 2": "may not exist", "410 U.S. 113": None, "3 F.3d 4": "does not appear to exist"}


def test_arrays_are_those_of_a_reading_from_every_bracket():
    decoder = json.JSONDecoder()
    draw = random.Random(14)
    for _ in range(4_000):
        text = "".join(draw.choice(['[', ']', '"', "1", ",", " ", "\\", '"a"', "{", "}", "x"]) for _ in range(draw.randint(0, 14)))
        want = []
        for m in re.finditer(r"\[", text):
            try:
                want.append(decoder.raw_decode(text, m.start())[0])
            except json.JSONDecodeError:
                continue
        assert list(U.arrays_in(text)) == want, text


def test_citations_are_found_as_their_pattern_finds_them():
    draw = random.Random(15)
    for _ in range(2_000):
        text = "".join(draw.choice(["1", "12", "2", " ", " ", "So.", "2d", " So. 2d ", "F.3d", "\n", "x"]) for _ in range(draw.randint(0, 20)))
        cites = [{"ord": k, "volume": draw.choice(["1", "12", "2"]), "reporter": draw.choice(["So. 2d", "F.3d", "So."]), "page": draw.choice(["1", "12", "2"])} for k in range(3)]
        want = []
        for c in cites:
            pattern = re.escape(f"{c['volume']} ") + r"\s*" + r"\s*".join(map(re.escape, c["reporter"].split())) + r"\s+" + c["page"]
            want += [(c["ord"], m.start()) for m in re.finditer(f"(?={pattern})", text)]
        assert [(p["ord"], p["start"]) for p in U.cite_places(text, cites)] == sorted(want), (text, cites)


def test_rules_count_only_where_they_are_named(spark):
    from verisect.operators import quotations as Q

    rules = [("mi", "MCR 2.116", "A party may move for dismissal of or judgment on all or part of a claim."), ("fedrule", "Fed. R. Civ. P. 9", "a party may move for dismissal of or judgment on all or part of a claim")]
    quote = "a party may move for dismissal . . . on all or part of a claim"
    texts = {1: f"MCR 2.116 says: {quote}", 2: quote, 3: f"MCR 2.116.{' x' * 400} {quote}", 4: f"{quote} So Rule 9(a).", 5: f"{quote} So Rule 9(a) and MCR 2.117.", 6: f"MRE 1, MRE 2, MRE 3, MRE 4, MCR 2.116: {quote}"}
    answers = spark.createDataFrame(list(texts.items()), "answer int, text string")
    quotes = spark.createDataFrame([(k, quote, t.index(quote), t.index(quote) + len(quote)) for k, t in texts.items()], "answer int, quote string, start int, end int")
    got = Q.rule_texts(answers, quotes, spark.createDataFrame(rules, "jurisdiction string, rule string, text string"), ["answer"]).collect()
    assert {(r.answer, r.rule) for r in got} == {(1, "MCR 2.116"), (4, "Fed. R. Civ. P. 9")}


def test_a_dropped_bracket_does_not_join_what_its_ellipsis_parted(spark):
    prop = "a court may not weigh the evidence here [...] when it rules upon a motion for summary judgment"
    joined = "a court may not weigh the evidence here when it rules upon a motion for summary judgment"
    rows = spark.createDataFrame([(1, prop, "a court may not weigh the evidence here"), (2, prop, joined), (3, "weigh the evidence here when it [...] rules upon a motion", "the evidence here when it rules upon a motion and more")], "id int, prop string, hay string")
    got = {r.id: r.e for r in rows.select("id", K.gold_equivalent(F.col("prop"), T.padded(T.match_words(F.col("hay")))).alias("e")).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_spans_meet_once(spark):
    from verisect.operators.intervals import overlapping

    draw = random.Random(16)
    spans = lambda: [(draw.randrange(2), a := draw.randrange(60), a + draw.randrange(25)) for _ in range(60)]
    left, right = spans(), spans()
    a, b = (spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "g int, start int, end int, n int") for rows in (left, right))
    got = sorted((r.n, r.met.n) for r in overlapping(a, b, ["g"], width=7).collect())
    end = lambda x: max(x[2], x[1] + 1)
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < end(y) and y[1] < end(x))


def test_references_by_name_supra_and_between():
    text = 'Mejia v. Ortega, 12 So. 2d 345 (Fla. 1950). Fed. R. Civ. P. 56 applies. Id. at 347. As Mejia notes, it is so; but compare Ortega, supra, at 346. Kahn v. Mejia, 20 F.3d 7. See 12 So. 2d at 349. mejia and Mejias are others. Unknown, supra.'
    refs = N.references(text)
    told = [(r["kind"], r["text"], text[r["target"] :][:5] if r["target"] is not None else None) for r in refs]
    assert told == [
        ("name", "Mejia", "12 So"), ("full", "12 So. 2d 345", "12 So"), ("noncase", "Fed. R.", None), ("id", "Id. at 347", "12 So"), ("name", "Mejia", "12 So"), ("supra", "Ortega, supra, at 346", "12 So"),
        ("name", "Kahn", "20 F."), ("name", "Mejia", "12 So"), ("full", "20 F.3d 7", "20 F."), ("short", "12 So. 2d at 349", "12 So"), ("supra", "Unknown, supra", None),
    ]
    assert [r["between"] for r in refs if r["kind"] == "id"] == [True]


def test_attribution_shows_its_sentence():
    text = 'First. The rule in Mejia v. Ortega, 12 So. 2d 345 (Fla. 1950), is old. As Mejia says, "the purpose is to inform the court"; no more.'
    got = N.attribution(text, "the purpose is to inform the court")
    assert (got["rule"], got["kind"], got["ref"], text[got["target"] :][:5]) == ("closest_before", "name", "Mejia", "12 So")
    assert got["sentence"][got["quote_start"] : got["quote_end"]] == "the purpose is to inform the court" and got["sentence"][got["ref_start"] : got["ref_end"]] == "Mejia"
    far = N.attribution("Lee v. Ray, 12 So. 2d 345, is old.\n\nThe court said \"the purpose is to inform the court\" once, citing Roe v. Wade, 410 U.S. 113.", "the purpose is to inform the court")
    assert (far["rule"], far["ref"], far["cite_sentence"], far["note"]) == ("earlier", "12 So. 2d 345", "Lee v. Ray, 12 So. 2d 345, is old.", "citing 410 U.S. 113")


def test_references_take_time_in_proportion():
    text = "Mejia v. Ortega, 12 So. 2d 345 (Fla. 1950). As Mejia notes, see Ortega, supra. Id. at 347; 12 So. 2d at 9; § 4. "
    small, large = spent(lambda n: N.find_references(text * n), (200, 1_600))
    assert large < 30 * small


def test_draws_of_large_ids_differ(spark):
    ids = [5, 5 + 2**30, 5 + 2**31, 5 + 2**40, -7]
    got = [r.d for r in spark.createDataFrame([(i,) for i in ids], "id long").select(S.draw("id", 3).alias("d")).collect()]
    assert len(set(got)) == len(ids) and all(0 <= d < 2**32 for d in got) and got[0] == 8 * S.MULTIPLIER % S.MODULUS


@pytest.mark.parametrize("rows, n", [(100, 7), (97, 96), (50, 50), (10, 30), (1_000, 333)])
def test_systematic_places(spark, rows, n):
    got = sorted(r.id for r in S.systematic(spark.range(rows), n, F.col("id")).collect())
    assert got == (sorted({int(i * (rows / n)) for i in range(n)}) if rows > n else list(range(rows)))


def keyed(spark, path):
    from verisect.sources.tables import Table

    return Table(spark, f"file://{path}/table", "k long, v string", ["k"])


def test_deltas_are_merged_as_writes_one_after_another(spark, tmp_path):
    draw = random.Random(17)
    table, state, history = keyed(spark, tmp_path), [], {}
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    for step in range(14):
        kind = draw.choice(["upsert", "insert_absent", "append", "upsert", "insert_absent", "compact" if step > 3 else "append", "replace" if step == 7 else "append"])
        rows = [(k, f"{step}-{k}") for k in draw.sample(range(12), draw.randint(0, 4))]
        had = {k for k, _ in state}
        if kind == "upsert":
            state = [r for r in state if r[0] not in dict(rows)] + rows
        elif kind == "insert_absent":
            state = state + [r for r in rows if r[0] not in had]
        elif kind == "append":
            state = state + rows
        elif kind == "replace":
            state = rows
        getattr(table, kind)(*([frame(rows)] if kind != "compact" else []))
        assert sorted(map(tuple, table.read().collect())) == sorted(state), (step, kind)
        history[table.versions()[-1]] = sorted(state)
    for version, rows in history.items():
        assert sorted(map(tuple, table.read(version).collect())) == rows


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_write_costs_its_own_rows(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.replace(spark.range(200_000).select(F.col("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("v")).coalesce(1))
    whole = size_of(tmp_path)
    rows = spark.range(199_000, 201_000).select(F.col("id").alias("k"), F.lit("new").alias("v")).coalesce(1)
    for write in (table.upsert, table.append, table.insert_absent):
        before = size_of(tmp_path)
        write(rows)
        assert size_of(tmp_path) - before < 0.02 * whole
    assert table.read().count() == 203_000 and table.read().where("v = 'new'").count() == 4_000


def test_writers_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    frame = lambda k: spark.createDataFrame([(k, "x")], "k long, v string").coalesce(1)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: keyed(spark, tmp_path).append(frame(k)), range(12)))
    table = keyed(spark, tmp_path)
    assert sorted(r.k for r in table.read().collect()) == list(range(12)) and table.versions() == list(range(1, 13))
    # A version that is claimed but never written isn't compacted over, until it is given up.
    lost = table._claim()
    table.append(frame(99))
    table.compact()
    assert (lost - 1, "base") in table.entries() and sorted(r.k for r in table.read().collect()) == [*range(12), 99]
    table.abandon(lost)
    table.compact()
    assert (lost + 1, "base") in table.entries() and sorted(r.k for r in table.read().collect()) == [*range(12), 99]


def test_of_repeated_keys_in_an_upsert_one_row_stays(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"))
    assert sorted(r.k for r in table.read().collect()) == [1, 2]


def test_reused_quotations_equal_a_full_regrade(spark):
    from verisect.operators import grading as D

    draw = random.Random(18)
    said = ["the moving party must show that no fact is in dispute", "never were such words in any opinion heard at all", "court should freely give leave when justice so requires"]
    texts, old, new, gone = [], [], [], []
    for k in range(40):
        answer, text, n = f"a{k}", "", 0
        for q in range(draw.randint(1, 3)):
            text += f'The court said "{said[draw.randrange(3)] + (" again" * q)}" in Lee v. Ray'
            if draw.random() < 0.2:
                text += ", No. 12-345"
            if draw.random() < 0.8:
                n += 1
                raw = f"{n} So. 2d {k + 1}"
                text += f", {raw}"
                was = draw.choice([1, 2, None])
                row = lambda cluster, n=n, raw=raw, start=len(text) - len(raw): (answer, n, raw, start, cluster, "resolved" if cluster else "fabricated")  # noqa: B023, E731
                old.append(row(was))
                now = draw.choice([was, was, None, 2 if was is None else was])
                new.append(row(now))
                if was and now is None:
                    gone.append((answer, was))
            text += ". " + draw.choice(["", "\n\n", "And on and on it went for a long while, as such things do. " * 5])
        texts.append((answer, text))
    schema = "answer string, ord int, raw string, start int, cluster_id long, status string"
    answers = spark.createDataFrame(texts, "answer string, text string")
    before, after = (spark.createDataFrame(rows, schema) for rows in (old, new))
    opinions = spark.createDataFrame([(1, f"We hold that {said[0]}."), (2, "Nothing of the kind.")], "cluster_id long, text string")
    kept = D.stored(D.grade_quotes(answers, before, opinions), "kept")
    got = D.regrade_quotes(answers, kept, after, spark.createDataFrame(gone, "answer string, cluster_id long")).collect()
    want = {(r.answer, r.ord): (r.verdict, r.kind, r.reason) for r in D.grade_quotes(answers, after, opinions).collect()}
    changes = Counter(r.change for r in got)
    assert changes["detached"] and changes["reattached"]
    for r in got:
        # Only an opinion could tell whether a quotation of a lost opinion stands in another one, or in one that is cited now.
        if r.change != "found_in_withdrawn_hit" and want[r.answer, r.ord][0] != "found" and r.verdict != "found":
            if r.reason != D.NO_CASE and want[r.answer, r.ord][2] != D.NO_CASE:
                assert (r.verdict, r.kind, r.reason) == want[r.answer, r.ord], (r, want[r.answer, r.ord])


def test_questions_are_drawn_stratum_by_stratum_without_near_copies(spark):
    from verisect.operators import questions as B

    draw = random.Random(19)
    names = ["plea", "motion", "claim", "defense", "appeal", "verdict", "evidence", "waiver", "bond", "lien", "deed", "trust", "will", "lease", "note", "fee", "writ", "tort", "debt", "sale"]
    rows, cases = [], []
    for k in range(90):
        text = f"A court may weigh {' and '.join(draw.sample(names, 5))}."
        rows.append((k, k // 2, k % 2, text, draw.randrange(50), draw.randrange(5)))
    for k in range(45):
        cases.append((k, ["fl", "st:tx"][k % 2], "Moon v. Sun", "1990-01-01", f"{100 + k % 3} {['So. 2d', 'S.W.2d'][k % 2]} {k + 1}", draw.choice(["green", "green", "red"])))
    propositions = spark.createDataFrame(rows, "rowid long, cluster_id long, rank int, proposition string, citation_count long, distinct_citers long")
    strata = [("fl", 8), ("st:tx", 12)]
    got = B.build_questions(propositions, spark.createDataFrame(cases, "cluster_id long, stratum string, case_name string, date_filed string, gold_citation string, gold_flag string"), spark.createDataFrame(strata, "stratum string, size long"), 0.25).collect()
    best = {}
    for row in rows:
        best[row[1]] = min(best.get(row[1], row), row, key=lambda r: (-r[4], -r[5], r[2], r[0]))
    tokens = {c: frozenset(w for w in re.findall("[a-z]+", r[3].lower()) if len(w) > 2) for c, r in best.items()}
    chosen = []
    for stratum, size in strata:
        picked = 0
        for bad, n, multiple in ((True, round(size * 0.25), 3), (False, None, 4)):
            n = size - picked if n is None else n
            pool = sorted((c for c, s, *_, flag in cases if s == stratum and (flag != "green") == bad), key=lambda c: (-best[c][4], c))
            rank = {c: k for k, c in enumerate(pool, 1)}
            score = lambda c, rank=rank: (rank[c] + 20260922) % 2**30 * S.MULTIPLIER % S.MODULUS
            width, mine = n * multiple, []
            while n:
                for c in sorted((c for c in pool if rank[c] <= width), key=lambda c: (score(c), c)):
                    if len(mine) < n and c not in mine and all(len(tokens[c] & tokens[o]) / len(tokens[c] | tokens[o]) < 0.5 for o in [*chosen, *mine]):
                        mine.append(c)
                if len(mine) >= n or width >= len(pool):
                    break
                width *= 2
            chosen += mine
            picked += len(mine) if bad else 0
    assert sorted(r.cluster_id for r in got) == sorted(chosen) and len(chosen) > 4
    assert sorted(r.qid for r in got) == [f"q{k:04d}" for k in range(1, len(chosen) + 1)]
    assert all(r.proposition == best[r.cluster_id][3] for r in got)


def test_a_side_is_small_by_rows_and_by_bytes(spark):
    def hinted(df, **most):
        return "BROADCAST" in J.small(df, **most)._jdf.queryExecution().logical().toString().upper()

    rows = spark.createDataFrame([(k, "x" * 1_000, [k, k]) for k in range(20)], "k int, t string, a array<int>")
    assert hinted(rows) and not hinted(rows, rows=19) and not hinted(rows, most=20_000) and hinted(rows, most=25_000)
    assert hinted(rows.limit(0), most=0)
