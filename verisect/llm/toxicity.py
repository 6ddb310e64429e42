"""Toxic spans by a linear-chain conditional random field over words.

Labelled tokens come from labelled documents: a word or word prefix whose texts are toxic but for one in fifty, more of them
than chance explains among so many names, and that explains texts which no earlier one does, marks its tokens as toxic
(greedy cover).  The field has two states; its features are the word, its prefixes, and the prefixes of its neighbours.
Forward-backward over the whole text gives each word's marginal: texts are worked in windows of WINDOW words side by side,
and each window passes its message on to the next, so results don't depend on WINDOW.  A document's score is a sigmoid of
its largest marginal and its expected number of toxic words, and runs of words with a marginal of one half or more are its
offending spans (code points).

The field is fitted on a bounded sample (`per_class` whole texts of labels 0 and 1, `max_bytes` a text); every text is
scored whole, however long.  Null and empty texts have no words and score as one without toxic words.  Without labels of
both classes every score is 0.  Rows that repeat an id each get a row; of the training rows that do, one counts.  Ties
between names go to the shorter, then the smaller one.  Empty tables of documents give empty results.  Only doc_id and
text of the documents are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, broadcast_value, fold, labelled_sample, logistic, narrow, sigmoid, slices, utf8, words

BITS, WINDOW = 18, 64
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _names(word: str) -> list[str]:
    """What may mark a word as toxic: itself and its prefixes."""
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n)]


def _place(name: str) -> int:
    return xxhash.xxh64_intdigest(name) >> (64 - BITS)


def _places(word: str) -> tuple[list[int], list[int], list[int]]:
    """Feature places of a word for itself, for the next word, and for the word before."""
    return [_place(n) for n in [*_names(word), "bias"]], [_place(f"before:{word[:4]}")], [_place(f"after:{word[:4]}")]


def lower(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


def markers(vocab: list[str], texts: list[np.ndarray], toxic: np.ndarray, least: int = 4, purity: float = 0.98, chance: float = 1e-3, depth: int = 5) -> set[str]:
    """Greedy cover of the toxic texts by names that hardly occur in others, until each text has `depth` of its names.

    texts: the places in `vocab` of each text's words.  A name's texts must be toxic more often than the sample's by a
    margin that one of all names tested reaches by chance with a probability of at most `chance` (Chernoff's bound).
    """
    places: dict[str, int] = {}
    of_word = np.array([([places.setdefault(n, len(places)) for n in _names(w)] * 3)[:3] for w in vocab], np.int32).reshape(-1, 3)
    names = list(places)
    counts = {y: np.zeros(len(names), np.int64) for y in (0, 1)}
    for ids, y in zip(texts, toxic, strict=True):
        counts[int(y)][np.unique(of_word[ids])] += 1
    own, other = counts[1], counts[0]
    share = float(np.clip(np.mean(toxic), 1e-9, 1 - 1e-9))
    seen = np.maximum(own + other, 1)
    rate = np.clip(own / seen, 1e-12, 1 - 1e-12)
    evidence = seen * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    pure = (own >= least) & (own >= purity * seen) & (evidence >= np.log(max(1, len(names)) / chance))
    left = [(depth, {names[k] for k in np.unique(of_word[ids]) if pure[k]}) for ids, y in zip(texts, toxic, strict=True) if y]
    chosen: set[str] = set()
    while True:
        gain = Counter(n for _, found in left for n in found)
        if not gain:
            return chosen
        # Of names that cover as many texts, the shortest generalises best.
        best, n = min(gain.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
        if n < least:
            return chosen
        chosen.add(best)
        # A longer or shorter name of the same words explains nothing more.
        stem = best.partition(":")[2][:4]
        left = [(k - (best in found), {x for x in found if x.partition(":")[2][:4] != stem}) for k, found in left]
        left = [(k, found) for k, found in left if k > 0 and found]


def forward(odds: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward odds of the toxic state at every word of texts that stand one after another. a[i, j] = exp(transition score).

    A step maps the odds f to odds * (f a11 + a01) / (f a10 + a00), so a window of steps is a 2 x 2 matrix.  Windows are
    columns that step together: the matrices of inner windows give what enters each window, then all are run.
    """
    n = -(-counts // WINDOW)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(counts) - counts, n) + part * WINDOW
    end = np.repeat(np.cumsum(counts), n)
    at = start[None, :] + np.arange(WINDOW)[:, None]
    real = at < end[None, :]
    o = odds[np.where(real, at, 0)]
    f = np.empty_like(o)

    def run(columns: np.ndarray, x: np.ndarray) -> None:
        f[0, columns] = x
        for t in range(1, WINDOW):
            x = o[t, columns] * (x * a[1, 1] + a[0, 1]) / (x * a[1, 0] + a[0, 0])
            f[t, columns] = x

    first = np.flatnonzero(part == 0)
    run(first, o[0, first])
    inner = np.flatnonzero((part > 0) & (start + WINDOW < end))
    p, q, r, s = (np.full(len(inner), x, o.dtype) for x in (1, 0, 0, 1))
    for t in range(WINDOW if len(inner) else 0):
        p, q, r, s = o[t, inner] * (a[1, 1] * p + a[0, 1] * r), o[t, inner] * (a[1, 1] * q + a[0, 1] * s), a[1, 0] * p + a[0, 0] * r, a[1, 0] * q + a[0, 0] * s
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    matrix = np.full(len(part), -1)
    matrix[inner] = np.arange(len(inner))
    enters, leaves = np.ones(len(part), o.dtype), f[WINDOW - 1].copy()
    order = np.argsort(part, kind="stable")
    for columns in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)[1:]:
        x = enters[columns] = leaves[columns - 1]
        m, on = matrix[columns], matrix[columns] >= 0
        m, x = m[on], x[on]
        leaves[columns[on]] = (p[m] * x + q[m]) / (r[m] * x + s[m])
    rest = np.flatnonzero(part > 0)
    x = enters[rest]
    run(rest, o[0, rest] * (x * a[1, 1] + a[0, 1]) / (x * a[1, 0] + a[0, 0]))
    out = np.empty_like(odds)
    out[at[real]] = f[real]
    return out


def messages(odds: np.ndarray, counts: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds, and backward odds times the word's own: the forward odds of the texts read backwards."""
    return forward(odds, counts, a), forward(odds[::-1], counts[::-1], a.T)[::-1]


class Field:
    """Weights by place, transition scores, and the sigmoid of a document's score."""

    def __init__(self, weight: np.ndarray, moves: np.ndarray, final: np.ndarray):
        self.weight, self.moves, self.final = weight.astype(np.float32), moves, final

    def emission(self, word: str) -> tuple[float, float, float]:
        own, before, after = _places(word)
        return float(sum(self.weight[own].tolist())), float(self.weight[before[0]]), float(self.weight[after[0]])

    def document(self, top: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return sigmoid(_summary(top, expected) @ self.final)


def _summary(top: np.ndarray, expected: np.ndarray) -> np.ndarray:
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log1p(expected), np.ones(len(top))], 1)


class Tagger:
    """Marginals of many texts at once."""

    def __init__(self, field: Field):
        self.field, self.rows = field, Rows(lambda word: field.emission(lower(word)), 3, np.float64)

    def __call__(self, tokens: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word counts of the texts, and the marginals of all their words one after another."""
        self.rows.trim()
        counts = np.array([len(t) for t in tokens], np.int64)
        if not counts.sum():
            return counts, np.zeros(0)
        at = np.concatenate([self.rows(t) for t in tokens])
        own, before, after = self.rows.table[at].T
        return counts, marginals(own, before, after, counts, np.exp(self.field.moves))


def marginals(own: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    score = own.copy()
    score[1:] += before[:-1] * _inside(counts)
    score[:-1] += after[1:] * _inside(counts)
    odds = np.exp(np.clip(score, -25, 25))
    ahead, back = messages(odds, counts, a)
    odds = ahead * back / odds
    return odds / (1 + odds)


def _inside(counts: np.ndarray) -> np.ndarray:
    """Whether word k and word k + 1 are of the same text."""
    same = np.ones(max(0, int(counts.sum()) - 1), bool)
    edge = np.cumsum(counts)[:-1] - 1
    same[edge[(edge >= 0) & (edge < len(same))]] = False
    return same


def _pooled(values: np.ndarray, counts: np.ndarray, how, empty: float = 0.0) -> np.ndarray:
    out = np.full(len(counts), empty)
    some = counts > 0
    if some.any():
        out[some] = how.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def fit_texts(sample: list[tuple[bytes, int]], steps: int = 20, rate: float = 0.5, ridge: float = 1e-4, prior: float | None = None) -> Field | None:
    """The field of the sample by AdaGrad on the exact gradient; None if it hasn't both labels. prior: the share of label 1 among all rows."""
    y = np.array([label for _, label in sample])
    if len(y) == 0 or y.min() == y.max():
        return None
    places_of: dict[bytes, int] = {}
    texts = [np.array([places_of.setdefault(w, len(places_of)) for w in words(t)], np.int32) for t, _ in sample]
    names = [lower(w) for w in places_of]
    marked = markers(names, texts, y)
    is_toxic = np.array([not marked.isdisjoint(_names(w)) for w in names] or [False])
    places = [_places(w) for w in names]
    own = np.array([(p[0] + [0, 0])[:4] for p in places]).reshape(-1, 4)
    own_n = np.array([len(p[0]) for p in places])
    before, after = (np.array([p[k][0] for p in places]) for k in (1, 2))
    del places
    ids = np.concatenate(texts)
    counts = np.array([len(t) for t in texts], np.int64)
    del texts, sample  # the driver has little room
    truth = is_toxic[ids] & np.repeat(y == 1, counts)
    inside = _inside(counts)
    weight, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    moves, seen_moves = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    mask = np.arange(4)[None, :] < own_n[:, None]
    total = len(ids)
    t = truth.astype(int)
    seen_pairs = np.bincount((t[:-1] * 2 + t[1:])[inside], minlength=4).reshape(2, 2)
    for _ in range(steps):
        e = np.where(mask, weight[own], 0).sum(1)[ids]
        e[1:] += weight[before][ids[:-1]] * inside
        e[:-1] += weight[after][ids[1:]] * inside
        odds = np.exp(np.clip(e, -25, 25)).astype(np.float32)
        a = np.exp(moves).astype(np.float32)
        f, x = messages(odds, counts, a)
        marginal = f * x / odds
        marginal = marginal / (1 + marginal)
        error = marginal - truth
        by_word = np.bincount(ids, error, len(names))
        gradient = np.zeros(1 << BITS)
        np.add.at(gradient, own[mask], np.repeat(by_word, own_n))
        np.add.at(gradient, before, np.bincount(ids[:-1], error[1:] * inside, len(names)))
        np.add.at(gradient, after, np.bincount(ids[1:], error[:-1] * inside, len(names)))
        gradient += ridge * total * 1e-3 * weight
        seen += gradient**2
        weight -= rate * gradient / np.sqrt(seen)
        # Pairs of neighbours: expected minus observed.
        ahead, back = f[:-1][inside], x[1:][inside]
        joint = np.stack([np.full(len(ahead), a[0, 0]), a[0, 1] * back, ahead * a[1, 0], ahead * a[1, 1] * back])
        joint = (joint / joint.sum(0)).sum(1, dtype=np.float64).reshape(2, 2)
        g = joint - seen_pairs + ridge * total * moves
        seen_moves += g**2
        moves = moves - rate * g / np.sqrt(seen_moves)
    field = Field(weight, moves, np.zeros(3))
    x = _summary(_pooled(marginal, counts, np.maximum), _pooled(marginal, counts, np.add))
    field.final = logistic(x, y.astype(float), ridge=0.5)
    if prior is not None and 0 < prior < 1:  # the sample holds the classes in another proportion than the table
        field.final[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = (2_400, 1_200), max_bytes: int = 50_000) -> Field | None:
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", 5) != 0)).agg(F.avg(label)).first()[0]
    return fit_texts(labelled_sample(docs, labels, label, per_class, max_bytes), prior=known)


def spans(text: bytes, marginal: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words with a marginal of at least `least`, as code points."""
    hot = marginal >= least
    out: list[dict] = []
    last = -2
    at = [m.span() for m in RUN.finditer(text)]
    # Every code point has one byte that isn't 10xxxxxx: counted once for the whole text.
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    for k in np.flatnonzero(hot):
        start, end = (int(points[p]) for p in at[k])
        if k == last + 1 and out:
            out[-1]["end"] = end
            out[-1]["p"] = max(out[-1]["p"], float(marginal[k]))
        else:
            out.append({"start": start, "end": end, "p": float(marginal[k])})
        last = k
    return out


def score(docs: DataFrame, field: Field | None, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans."""
    shared = broadcast_value(docs.sparkSession, field)
    source = narrow(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        tag = Tagger(field) if field else None
        for batch in slices(batches, 500):
            texts = utf8(batch, "text")
            if tag is None:
                s, found = np.zeros(len(texts)), [[] for _ in texts]
            else:
                counts, m = tag([words(t) for t in texts])
                s = field.document(_pooled(m, counts, np.maximum), _pooled(m, counts, np.add))
                edge = np.cumsum(counts)
                found = [spans(t, m[e - n : e]) if n and m[e - n : e].max() >= 0.5 else [] for t, n, e in zip(texts, counts, edge, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(found, SPANS)],
                ["doc_id", "held_out", "score", "predicted", "spans"],
            )

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
