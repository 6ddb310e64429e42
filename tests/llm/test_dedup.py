"""Near-duplicates against all pairs, and the signatures against the similarity they estimate."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from verisect.llm import minhash_dedup as dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def shingles(text):
    ws = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.encode().lower())
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def classes(texts):
    """Class of each text by all pairs."""
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        union = len(sets[a] | sets[b])
        if texts[a] == texts[b] or union and len(sets[a] & sets[b]) >= 0.8 * union:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


def make_texts():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(3_000)]
    write = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [" ".join(write(120)) for _ in range(40)]
    passage = write(100)
    texts += [" ".join([*passage, *write(rng.choice((8, 40, 90)))]) for _ in range(60)]  # a shared passage
    for size in (2, 5, 40):
        base = write(200)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return [*texts, texts[3], texts[3].upper(), "", "", "...", "!!", "a b", "A b.", "one", " ".join(write(30_000))]


def test_classes_match_all_pairs(spark):
    texts = make_texts()
    rows = dedup.find_duplicates(docs(spark, list(enumerate(texts)))).collect()
    want = classes(texts)
    assert {r.id: r.class_id for r in rows} == dict(enumerate(want))


def test_whole_table_and_what_stays(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    listed = sorted((r.doc_id, r.text) for r in source.collect())
    want = classes([t for _, t in listed])
    names = {i: listed[c][0] for (i, _), c in zip(listed, want, strict=True)}
    assert {r.doc_id: r.class_id for r in dedup.duplicate_report(source).collect()} == names
    kept = dedup.keep_one(source)
    assert kept.columns == source.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(names.values()))


def test_awkward_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (7, "same words in this text here"), (7, "same words in this text here"), (None, "same words in this text here"), (8, "other words altogether in that one"), (7, "a third text under the id seven")]
    got = dedup.find_duplicates(docs(spark, rows).selectExpr("*", "1 as row", "2 as label")).collect()
    assert len(got) == len(rows)
    assert len({r.label for r in got}) == 2 + 1 + 1 + 1 + 1
    stay = dedup.keep_one(docs(spark, rows)).collect()
    assert sorted(str(r.text) for r in stay) == sorted(["None", "None", "", rows[4][1], rows[7][1], rows[8][1]])
    assert dedup.duplicate_report(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_similarity(weighted):
    rng = np.random.default_rng(2)
    both, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    weights = rng.uniform(0.2, 6, 500) if weighted else np.ones(500)
    a, wa = np.concatenate([both, left]), weights[:400]
    b, wb = np.concatenate([both, right]), np.concatenate([weights[:300], weights[400:]])
    true = weights[:300].sum() / weights.sum()
    k = 2_000
    x = dedup.signature(a, wa if weighted else None, k)
    y = dedup.signature(b, wb if weighted else None, k)
    assert abs((x == y).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    assert len(np.unique(x)) > 0.9 * min(k, k)


def test_large_weights_count_whole():
    e, k = np.arange(1, 3, dtype=np.uint64), 1_500
    for x, y in ((128.0, 512.0), (70.0, 90.5), (1.0, 300.0)):
        a, b = dedup.signature(e, np.array([x, 1.0]), k), dedup.signature(e, np.array([y, 1.0]), k)
        true = (x + 1) / (y + 1)
        assert abs((a == b).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5 + 1e-9


def test_signature_ignores_the_order_and_short_sets_fill_up():
    e = np.arange(1, 4, dtype=np.uint64)
    assert (dedup.signature(e) == dedup.signature(e[::-1].copy())).all()
    assert (dedup.signature(e[:1]) != 0).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (20, 21), (5, 30)]
    got = {r.row: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 30: 1, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20}


def test_merging_in_turns_gives_the_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    labels = None
    for part in (edges[:20], edges[20:21], edges[21:]):
        labels = dedup.merge(labels, spark.createDataFrame(part, "a long, b long"))
    want = {r.row: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r.row: r.label for r in labels.collect()} == want


def test_pairs_that_meet_only_in_large_buckets(spark):
    """Texts on one template, similar to each other by less than 0.8 but for one pair, which shares nothing but the template."""
    rng = random.Random(5)
    texts = []
    for group in range(6):
        write = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
        template = write(200)
        sizes = [rng.randrange(32, 40) for _ in range(150)]
        sizes[70 + group], sizes[120 + group] = 20, 21
        texts += [" ".join(template + write(n)) for n in sizes]
    want = classes(texts)
    assert len(set(want)) == len(texts) - 6
    got = {r.doc_id: r.class_id for r in dedup.duplicate_report(docs(spark, enumerate(texts))).collect()}
    assert got == dict(enumerate(want))


def test_large_group_of_near_copies_whose_edges_lie_at_the_threshold(spark):
    """One text edited up to eight times: some copies reach others, some none; classes are those of all pairs."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**9)}" for _ in range(150)]
    texts = []
    for _ in range(500):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    want = classes(texts)
    assert len(set(want)) > 100 and max(want.count(c) for c in set(want)) > 150
    got = {r.doc_id: r.class_id for r in dedup.duplicate_report(docs(spark, enumerate(texts))).collect()}
    assert got == dict(enumerate(want))


def test_prefix_pairs_miss_no_pair(spark):
    """Random sets over few shingles, so that many pairs lie around the threshold."""
    rng = random.Random(4)
    sets = {}
    for k in range(300):
        base = [rng.randrange(2**31) for _ in range(rng.choice((1, 4, 9, 10, 40)))] if k % 6 == 0 else list(sets[k - k % 6])
        for _ in range(rng.randrange(4)):
            base = base[1:] if rng.random() < 0.5 and len(base) > 1 else [*base, rng.randrange(2**31)]
        sets[k] = sorted(set(base))
    rows = [(k, k, np.array(v, "<u4").tobytes()) for k, v in sets.items()]
    got = {(r.a, r.b) for r in dedup._prefix_pairs(spark.createDataFrame(rows, "row long, label long, shingles binary"), 0.8).collect()}
    true = {(a, b) for a, b in combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert true and true <= got
