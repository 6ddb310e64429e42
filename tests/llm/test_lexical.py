"""Tiered lexical search against the scores' definition."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from verisect.llm import lexical
from verisect.llm.common import words

DOCS = "doc_id long, text string, tier int, shard string"


def brute(docs, items, k):
    held = [(doc_id, Counter(terms)) for doc_id, text in docs if (terms := words(text.encode() if text else None))]
    total, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text.encode() if text else None))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, c in held:
            m = 50 + 50 * sum(c.values()) * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score:
                scores.append((-score, doc_id is not None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def table(spark, docs, parts):
    return spark.createDataFrame([(*d, 7, "x") for d in docs], DOCS).repartition(parts)


def found(index, spark, items, k, **how):
    got = lexical.search(index, spark.createDataFrame([(*i, 3) for i in items], "item_id string, text string, rank int"), k, **how)
    return sorted((tuple(r) for r in got.select("item", "rank", "id", "score").collect()), key=str), got


def corpus(n, seed):
    """Frequent and rare terms, copies, repeated ids, and terms that repeat in a text."""
    draw = random.Random(seed)
    texts = [" ".join(f"t{int(draw.paretovariate(0.7)) % 60}" for _ in range(draw.randint(0, 40))) for _ in range(n)]
    texts += texts[: n // 4] + ["t1 t1 t1"] * 9 + ["", None, "Ünïc0dé T1", "--- !"]
    return [(draw.choice([None, k, k, k // 3]), t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("shard_words, tiers, parts", [(40, (1, 3), 3), (300, (2,), 2), (10**6, (), 1)])
def test_all_scores(spark, shard_words, tiers, parts):
    docs = corpus(120, 5)
    items = [("a", "t1 t2 t9"), ("b", "t3 T3 t50 t51 t52 never"), ("c", None), ("d", ""), (None, "ünïc0dé"), ("a", "t30"), ("e", " ".join(f"t{k}" for k in range(60))), ("f", "never")]
    index = lexical.build_index(table(spark, docs, parts), shard_words=shard_words, tiers=tiers)
    for k in (1, 7, 500):
        assert found(index, spark, items, k)[0] == brute(docs, items, k)
    assert found(index, spark, items, 7, block_pairs=5)[0] == brute(docs, items, 7)


def test_rows_that_are_proven_early_read_no_lower_tier(spark):
    docs = [(k, "common") for k in range(200)] + [(1000 + k, f"rare rare common x{k}") for k in range(3)]
    index = lexical.build_index(table(spark, docs, 2), shard_words=60, tiers=(2, 4))
    rows, got = found(index, spark, [("a", "rare"), ("b", "rare common")], 3)
    assert rows == brute(docs, [("a", "rare"), ("b", "rare common")], 3)
    assert {r["tier"] for r in got.collect() if r["item"] == "a"} == {0}
    # Where the best row's bound leaves room, the shards that hold it go down; the proof of the others holds.
    deep, got = found(index, spark, [("c", "common")], 150)
    assert deep == brute(docs, [("c", "common")], 150) and max(r["tier"] for r in got.collect()) == 2


def test_every_posting_is_indexed_once_and_bounded(spark):
    docs = corpus(80, 9)
    index = lexical.build_index(table(spark, docs, 2), shard_words=100, tiers=(1, 3))
    got = Counter()
    per_term = {}
    for r in index.postings.where("tier >= 0").collect():
        got[r["term"]] += r["n"]
        assert len(r["docs"]) == len(r["impacts"]) == 4 * r["n"]
        per_term.setdefault((r["shard"], r["term"]), {})[r["tier"]] = np.frombuffer(r["impacts"], "<u4"), r["rest"]
    assert got == Counter(t for _, text in docs for t in set(words((text or "").encode())) for t in [t.decode()])
    for tiers in per_term.values():
        for tier, (impacts, rest) in tiers.items():
            below = [x.max() for t, (x, _) in tiers.items() if t > tier]
            assert rest == max(below, default=0) and impacts.min() >= rest


def test_no_documents_no_items_and_a_very_long_text(spark):
    none = spark.createDataFrame([], DOCS)
    assert found(lexical.build_index(none), spark, [("a", "x")], 5)[0] == []
    docs = [(1, "word " * 60_000 + "end"), (2, "end"), (3, None)]
    index = lexical.build_index(table(spark, docs, 1), shard_words=1_000)
    assert found(index, spark, [("a", "end word")], 5)[0] == brute(docs, [("a", "end word")], 5)
    assert lexical.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []
