"""Classifiers and the language model: held-out accuracy, brute force, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from verisect.llm import lm, quality, toxicity
from verisect.llm.common import labelled_sample, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
EDGE = [None, "", "x " * 60_000, "!!!", "one"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return source, labels


@pytest.mark.parametrize(("report", "label", "threshold"), [(quality.quality_report, "quality", 0.3), (toxicity.toxicity_report, "toxic", 0.5)])
def test_held_out_accuracy(spark, small, report, label, threshold):
    source, labels = small
    got = report(source, labels).toPandas()
    assert len(got) == source.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= threshold)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert (known.predicted == known[label]).mean() > 0.95


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_awkward_rows_and_tables(spark, small, report):
    _, labels = small
    texts = EDGE + ["a b c"] * 3
    assert report(docs(spark, texts), labels.limit(0)).count() == len(texts)
    assert report(docs(spark, texts).limit(0), labels).count() == 0
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(3, None, None), (None, 1, 1), (99, 0, 0)], LABELS)
    rows = report(docs(spark, texts).selectExpr("*", "1 as score", "'x' as y", "2 as h"), marks).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    nulls = docs(spark, texts).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    assert all(not r.held_out for r in report(nulls, marks).collect())


def test_dual_coordinate_descent_separates():
    rows = [np.array([k % 2, 2]) for k in range(20)]
    scale, norms = np.array([1.0, 1.0, 0.5]), np.ones(20)
    y = np.array([1.0 if k % 2 else -1.0 for k in range(20)])
    w = quality.dual_coordinate_descent(rows, scale, norms, y, np.full(20, 10.0))
    assert all(label * (w[at] @ scale[at] + w[-1]) >= 0.99 for at, label in zip(rows, y, strict=True))


def naive_features(text):
    """The feature places of a text by strings and sets, straight from the definition."""
    full = (1 << 64) - 1
    word_mul, next_mul, shape_mul, roll = (int(x) for x in quality.ODD)
    chunks = [c.decode("utf-8", "replace") for c in (text or "").encode().split()]
    w, s = [], []
    for k, c in enumerate(chunks):
        shape = re.sub(r"[^\W\d_]", lambda m: "U" if m[0].isupper() else "l", c)
        for pattern, by in ((r"\d+", "0"), (r"UU+", "UU"), (r"ll*", "l"), (r"([^\w\s])\1+", r"\1\1")):
            shape = re.sub(pattern, by, shape)
        w.append(xxhash.xxh64_intdigest(c.lower().strip(".,;:!?\"'()")))
        s.append(xxhash.xxh64_intdigest("shape " + shape) ^ (int(quality.SAME) if k and w[k] == w[k - 1] else 0))
    found = {x * word_mul & full for x in w} | {x * word_mul + y * next_mul & full for x, y in zip(w, w[1:], strict=False)}
    for k in range(len(s)):
        g = s[k]
        found.add(g * shape_mul & full)
        for nth in range(k + 1, min(k + 4, len(s))):
            g = g * roll + s[nth] & full
            found.add(g * shape_mul & full)
    return {x >> (64 - quality.BITS) for x in found}


def test_quality_matches_a_naive_version():
    """Features, log-count ratios, margins and scores of 50 texts, computed with dictionaries."""
    rng = random.Random(3)
    vocab = ["Alpha", "beta,", "GAMMA", "d3lta", "ee", "Zeta.", "x--y", "12:30"]
    texts = [" ".join(rng.choice(vocab[: 8 - 3 * (k % 2)]) + rng.choice(["", "!", "s"]) for _ in range(rng.randrange(40))) for k in range(50)]
    ys = [k % 2 for k in range(50)]
    make = quality.Featurizer()
    features = [make(t.encode()) for t in texts]
    assert [set(f.tolist()) for f in features] == [naive_features(t) for t in texts]
    y = np.array(ys, float)
    w, ratio = quality._train(features, y, 1.0, 4.0)
    size = 1 << quality.BITS
    counts = [Counter(p for f, own in zip(features, ys, strict=True) if own == label for p in f.tolist()) for label in (0, 1)]
    totals = [size + sum(c.values()) for c in counts]
    for p in {p for f in features for p in f.tolist()}:
        n = [c[p] for c in counts]
        want = math.log((n[1] + 1) / totals[1]) - math.log((n[0] + 1) / totals[0]) if sum(n) >= 2 else 0.0
        assert ratio[p] == pytest.approx(want, abs=1e-12)
    # The support vector machine: its weights are the dual's combination of the rows, and its duality gap is small.
    rows = [{**{p: ratio[p] for p in f.tolist()}, "bias": 1.0} for f in features]
    norms = [math.sqrt(sum(ratio[p] ** 2 for p in f.tolist())) for f in features]
    margin = [sum((w[-1] if p == "bias" else w[p]) * v for p, v in r.items()) / n if n else 0.0 for r, n in zip(rows, norms, strict=True)]
    share = sum(ys) / len(ys)
    cost = [4.0 * 0.5 / (share if label else 1 - share) for label in ys]
    primal = 0.5 * float(w @ w) + sum(c * max(0.0, 1 - (2 * label - 1) * m) for c, label, m, n in zip(cost, ys, margin, norms, strict=True) if n)
    better = [0.5 * float(v @ v) + sum(c * max(0.0, 1 - (2 * label - 1) * (sum((v[-1] if p == "bias" else v[p]) * x for p, x in r.items()) / n)) for c, label, r, n in zip(cost, ys, rows, norms, strict=True) if n) for v in (w * 1.02, w * 0.98, w + np.where(np.arange(size + 1) == size, 0.01, 0), w - np.where(np.arange(size + 1) == size, 0.01, 0))]
    assert primal <= min(better) + 1e-3
    model = quality.Model(w, ratio, 1.7, -0.2)
    for f, m in zip(features, margin, strict=True):
        assert model.margin(f) == pytest.approx(m, abs=1e-5)
        assert model.score(f) == pytest.approx(1 / (1 + math.exp(-(1.7 * m - 0.2))), abs=1e-5)


def test_shapes_count_whole():
    tail = ["aA0" * 20 + end for end in ("!", "?")]
    a, b = (set(quality.Featurizer()(t.encode()).tolist()) for t in tail)
    assert len(a & b) == 1 and len(a) == len(b) == 2  # the same word, two shapes


def test_labelled_sample_is_bounded(spark):
    """Repeated ids give one text each, and texts beyond the bytes that the driver takes stay away."""
    source = spark.createDataFrame([(i % 10, f"{i:04d}" * 10) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i % 10, i % 2, 0) for i in range(40)], LABELS)
    used = [i for i in range(10) if zlib.crc32(str(i).encode()) % 5]
    got = labelled_sample(source, marks, "quality", (100, 100), 1_000)
    assert sorted(got) == sorted((f"{i:04d}".encode() * 10, i % 2) for i in used)
    assert len(labelled_sample(source, marks, "quality", (100, 1), 1_000)) == sum(i % 2 == 0 for i in used) + 1
    few = labelled_sample(source, marks, "quality", (100, 100), 1_000, total_bytes=4 * 40)
    assert len(few) == 4 and set(few) <= set(got)


def naive_marginals(e, moves):
    """Of one text, by sums over both states in the log domain."""
    n = len(e)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = [0, e[0]]
    for t in range(1, n):
        ahead[t] = [np.logaddexp(ahead[t - 1, 0] + moves[0, j], ahead[t - 1, 1] + moves[1, j]) + j * e[t] for j in (0, 1)]
    for t in range(n - 2, -1, -1):
        back[t] = [np.logaddexp(moves[i, 0] + back[t + 1, 0], moves[i, 1] + e[t + 1] + back[t + 1, 1]) for i in (0, 1)]
    total = ahead + back
    return np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1]))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    e, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for state in range(32):
        s = [state >> k & 1 for k in range(5)]
        weight[state] = math.exp(sum(e[k] * s[k] for k in range(5)) + sum(moves[s[k], s[k + 1]] for k in range(4)))
    want = [sum(w for state, w in weight.items() if state >> k & 1) / sum(weight.values()) for k in range(5)]
    zero = np.zeros(5)
    assert toxicity.marginals(e, zero, zero, np.array([5]), np.exp(moves)) == pytest.approx(want)
    assert naive_marginals(e, moves) == pytest.approx(want)


@pytest.mark.parametrize("window", [3, 64, 500])
def test_marginals_of_long_texts_reach_across_windows(monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    rng = np.random.default_rng(4)
    counts = np.array([0, 130, 1, 64, 0, 65, 1_000, 128])
    own, moves = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2)) * 2
    zero = np.zeros_like(own)
    got = toxicity.marginals(own, zero, zero, counts, np.exp(moves))
    want = np.concatenate([naive_marginals(x, moves) for x in np.split(own, np.cumsum(counts)[:-1]) if len(x)])
    assert got == pytest.approx(want, abs=1e-9)


def test_document_scores_and_spans_match_a_naive_version(spark):
    """Scores and spans of a fitted field, recomputed word by word from its weights."""
    texts = ["you idiot friend " * 3, "a fine day", "", "one idiot moron and " + "calm words " * 80 + "idiot"] * 20
    sample = [(t.encode(), int("idiot" in t)) for t in texts]
    field = toxicity.fit_texts(sample)
    for r in toxicity.score(docs(spark, texts[:4]), field).collect():
        ws = [w.decode() for w in words(texts[r.doc_id].encode())]
        weight = lambda name: float(field.weight[xxhash.xxh64_intdigest(name) >> (64 - toxicity.BITS)])
        e = []
        for k, w in enumerate(ws):
            own = [f"w:{w}", *(f"{n}:{w[:n]}" for n in (4, 5) if len(w) > n), "bias"]
            e.append(sum(map(weight, own)) + (weight(f"before:{ws[k - 1][:4]}") if k else 0) + (weight(f"after:{ws[k + 1][:4]}") if k + 1 < len(ws) else 0))
        m = naive_marginals(np.array(e), field.moves) if ws else np.zeros(0)
        top, total = (min(max(m.max(), 1e-6), 1 - 1e-6), m.sum()) if ws else (1e-6, 0.0)
        z = field.final @ [math.log(top / (1 - top)), math.log1p(total), 1.0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        runs, text = [], texts[r.doc_id]
        for k, x in enumerate(re.finditer(r"[0-9A-Za-z]+", text)):
            if m[k] >= 0.5:
                if runs and runs[-1][2] == k - 1:
                    runs[-1] = (runs[-1][0], x.end(), k)
                else:
                    runs.append((x.start(), x.end(), k))
        assert [(x.start, x.end) for x in r.spans] == [(a, b) for a, b, _ in runs]


def test_toxic_spans_are_code_points(spark):
    texts = ["é𝄞 you idiot friend", "a fine day"] * 40
    marks = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(80)], LABELS)
    rows = toxicity.toxicity_report(docs(spark, texts), marks).collect()
    for r in rows:
        assert r.predicted == 1 - r.doc_id % 2
        assert bool(r.spans) == (r.doc_id % 2 == 0)


    text = "é𝄞 you idiot moron friend İdiot"
    found = toxicity.spans(text.encode(), np.array([0.1, 0.2, 0.9, 0.8, 0.1, 0.7]))
    assert [(text[x["start"] : x["end"]], x["p"]) for x in found] == [("idiot moron", 0.9), ("İdiot", 0.7)]


def brute_lm(texts, train, depth, head_share, context_share, edge_share, rare_share, gain_bits, rare_gain_bits):
    """The tree by dictionaries, straight from its definition."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    toks = [split(t) for t in texts]
    learn = [t for t, use in zip(toks, train, strict=True) if use]
    c = Counter(w for t in learn for w in t)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (n + v + 1)
    head = {w for w in c if c[w] >= max(1.0, head_share * n)}
    least = max(2.0, context_share * n)
    nodes = {}

    def node(edges, total, prob):
        mass = 1 - sum(m - lm.DISCOUNT for m in edges.values()) / total
        return {w: (m - lm.DISCOUNT) / total + mass * prob(w) for w, m in edges.items()}, mass

    def gain(edges, total, prob):
        return sum(m * math.log2(m / total / prob(w)) for w, m in edges.items())

    def prob(ctx, w):
        if ctx in nodes:
            edges, mass = nodes[ctx]
            return edges.get(w) or mass * prob(ctx[1:], w)
        return prob(ctx[1:], w) if ctx else root(w)

    candidates = {(w,): c[w] for w in head if c[w] >= least and w != "\n"}
    for k in range(1, depth + 1):
        grams = Counter(tuple(t[p - k : p + 1]) for t in learn for p in range(k, len(t)) if set(t[p - k : p + 1]) <= head)
        fresh, longer = {}, {}
        for ctx, total in candidates.items():
            edges = {g[-1]: m for g, m in grams.items() if g[:-1] == ctx and m >= max(2.0, edge_share * n)}
            if edges and gain(edges, total, lambda w, ctx=ctx: prob(ctx[1:], w)) >= gain_bits:
                fresh[ctx] = node(edges, total, lambda w, ctx=ctx: prob(ctx[1:], w))
                longer |= {(*ctx, w): m for w, m in edges.items() if m >= least and w != "\n"}
        nodes |= fresh
        candidates = longer
    rare, total = {}, Counter(w for t in learn for w in t[:-1])
    for q in c:
        if (q not in head or c[q] < min(rare_share * n, least)) and q != "\n":
            edges = {w: m for w, m in Counter(b for t in learn for a, b in zip(t, t[1:], strict=False) if a == q).items() if m >= 2}
            if edges and gain(edges, total[q], root) >= rare_gain_bits:
                rare[q] = node(edges, total[q], root)
    out = []
    for t in toks:
        tree = 0.0
        for p, w in enumerate(t):
            if p and t[p - 1] in rare:
                edges, mass = rare[t[p - 1]]
                tree += math.log10(edges.get(w) or mass * root(w))
                continue
            back = []
            for q in range(p - 1, max(-1, p - 1 - depth), -1):
                if t[q] not in head:
                    break
                back.insert(0, t[q])
            states = {tuple(back[k:]) for k in range(len(back))} & set(nodes)
            tree += math.log10(prob(tuple(back), w) if w in head else root(w) * math.prod(nodes[x][1] for x in states))
        out.append((len(t), sum(c[w] > 0 for w in t), sum(math.log10(root(w)) for w in t), tree))
    return n, out, nodes, rare


RARE = "the cat sat on the hat " * 6


@pytest.mark.parametrize(
    ("head_share", "context_share", "rare_share", "gain_bits", "rare_gain_bits", "depth"),
    [(0.0, 0.01, 1.0, 2.0, 4.0, 2), (0.02, 0.01, 1.0, 2.0, 4.0, 2), (0.0, 0.01, 1.0, 1e9, 1e9, 2), (0.0, 0.1, 0.03, 2.0, 2.0, 2), (0.0, 0.001, 0.001, 1.0, 1.0, 4), (0.03, 0.05, 0.04, 0.5, 1.0, 3), (1.0, 1.0, 0.0, 1.0, 1.0, 1)],
)
def test_suffix_tree_matches_brute_force(spark, head_share, context_share, rare_share, gain_bits, rare_gain_bits, depth):
    rng = random.Random(1)
    more = [" ".join(rng.choice("uvwxyz") * rng.randrange(1, 3) for _ in range(60)) for _ in range(8)]
    texts = [None, "", "The cat sat on the mat\tthe END", RARE, "a dog sat on the mat ünder É", "the cat ran", "cat cat cat", *more, "rare pair here", "a rare pair there", "unseen things only", RARE + more[0] + " rare pair", "ünder É"]
    train = [True] * (len(texts) - 3) + [False] * 3
    share = {"depth": depth, "head_share": head_share, "context_share": context_share, "edge_share": 0.002, "rare_share": rare_share, "gain_bits": gain_bits, "rare_gain_bits": rare_gain_bits}
    source = docs(spark, texts)
    model = lm.fit(source.where(f"doc_id < {len(texts) - 3}"), **share)
    got = {r.id: r for r in lm.score(source, model).collect()}
    n, want, nodes, rare = brute_lm(texts, train, **share)
    assert sum(len(x.keys) for x in model.tree.levels) == len(nodes)
    assert model.rare.count() == sum(1 + len(edges) for edges, _ in rare.values())
    for i, (length, known, base, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (length, known, n)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].score == pytest.approx(score, abs=1e-9), texts[i]


def test_rare_contexts_grow_with_the_corpus(spark):
    """Twice the corpus, with other rare words, has twice the rare nodes; texts that occur twice score higher than texts that occur once."""
    rng = random.Random(2)
    common = [f"c{k}" for k in range(20)]
    write = lambda k: " ".join(x for j in range(10) for x in (rng.choice(common), f"r{k}q{j}", rng.choice(common)))
    texts = [write(k) for k in range(120)]
    sizes = []
    for n in (60, 120):
        source = docs(spark, [t for t in texts[:n] for _ in range(2)])
        model = lm.fit(source, context_share=0.01, rare_share=0.01)
        sizes.append(model.rare.count())
    assert 1.8 < sizes[1] / sizes[0] < 2.2
    source = docs(spark, [*texts, *texts[:30]])
    got = {r.id: r.score / r.n_tokens for r in lm.score(source, lm.fit(source, context_share=0.01, rare_share=0.01)).collect()}
    assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 120))


def test_every_word_is_a_context(spark):
    """Words with a share between 2e-6 and 1e-4, which used to be no contexts, are nodes by default."""
    common = " ".join(f"c{k % 7}" for k in range(500))
    source = docs(spark, [common + f" m{k % 40} n{k % 40}" for k in range(160)])
    model = lm.fit(source)
    assert 2e-6 < 4 / model.tree.total < 1e-4
    assert model.rare.count() == 2 * 2 * 40  # each m and n: the node and its one next word, n's being the end
    got = {r.id: r for r in lm.score(source, model).collect()}
    bare = {r.id: r for r in lm.score(source, lm.fit(source, rare_share=2e-6)).collect()}
    assert all(got[k].score > bare[k].score + 2 for k in range(160))


def test_bitmaps_and_hashes(spark):
    keys = [5, -7, 2**62 + 3, -(2**63), 1 << 26]
    bits = lm._bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    asked = np.array([*keys, 6, 8, -9], np.int64).view(np.uint64)
    assert lm._has(bits, asked).tolist() == [True] * 5 + [False] * 3
    words_ = [b"", b"a", "ü".encode(), b"x" * 100]
    rows = spark.createDataFrame([(bytearray(w),) for w in words_], "word binary")
    assert [r[0] for r in rows.selectExpr("xxhash64(word)").collect()] == np.array([lm.word_hash(w) for w in words_], np.uint64).view(np.int64).tolist()


def test_language_model_beats_its_root_on_unseen_texts(spark, small):
    source, _ = small
    got = lm.lm_report(source).toPandas()
    assert len(got) == source.count()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert lm.lm_report(source.limit(0)).count() == 0
    alone = lm.lm_report(docs(spark, EDGE + EDGE[4:])).collect()
    assert len(alone) == len(EDGE) + 1
    clash = docs(spark, ["b a b a"] * 9).selectExpr("*", "1 as id", "2 as word", "3 as n", "4 as row", "5 as base", "6 as key", "7 as keys", "8 as held_out", "9 as score")
    rows = lm.lm_report(clash).collect()
    assert len(rows) == 9 and len({r.score for r in rows}) == 1 and all(r.n_tokens == 5 for r in rows)  # ties and repeats


def test_models_ignore_clashing_columns_and_repeats(spark):
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], LABELS).selectExpr("*", "1 as id", "2 as y", "3 as text")
    source = docs(spark, [("Good Words here " if i % 2 else "bad bad ") * 5 for i in range(30)]).selectExpr("*", "1 as y", "2 as h", "3 as held_out", "4 as spans", "5 as quality", "6 as toxic")
    for report in (quality.quality_report, toxicity.toxicity_report):
        rows = report(source.unionByName(source.where("doc_id < 9")), marks).collect()
        assert len(rows) == 39 and all(len({r.score for r in rows if r.doc_id == i}) == 1 for i in range(9))
        assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_words():
    assert words("É-Two x3_y".encode()) == ["É".encode(), b"two", b"x3", b"y"] and words(None) == []


def test_spans_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 16_000):
        text = ("für böse " * (n // 2)).encode()
        began = time.process_time()
        found = toxicity.spans(text, np.tile([0.9, 0.1], n // 2))
        took.append(time.process_time() - began + 1e-3)
        assert len(found) == n // 2 and found[-1]["start"] == 9 * (n // 2 - 1) and found[-1]["end"] == found[-1]["start"] + 3
    assert took[1] < 30 * took[0]
