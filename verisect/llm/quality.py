"""Quality classification by naive Bayes support vectors.

Features are indicators of n-grams over two views of a text: its words (1- and 2-grams) and its word shapes (1- to
4-grams; a shape keeps case pattern and punctuation, and whether the word repeats the one before).  Indicators are
hashed to 2**BITS places, scaled by the class log-count ratio of naive Bayes and brought to unit length; a linear
hinge-loss model is fitted on them by dual coordinate descent.  Margins of folds that a model hasn't seen give the
sigmoid that turns a margin into a score.

The classifier is fitted on a bounded sample (`per_class` whole texts of each label, `max_bytes` a text); every text is
scored whole, however long.  Null, empty and blank texts have no features: their margin is 0, and their score the
sigmoid of that.  Without labels of both classes the score is 1 for everything, so that nothing is rejected.  Rows that
repeat an id each get a row; of the training rows that do, one counts.  Ties in the sample's order go by id.  Empty tables
of documents give empty results.  Only doc_id and text of the documents are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, broadcast_value, fold, labelled_sample, logistic, narrow, sigmoid, slices, utf8

BITS = 20
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTERS = str.maketrans({chr(c): "U" if c < 91 else "l" for c in (*range(65, 91), *range(97, 123))})
SHAPES = [(re.compile(p), r) for p, r in ((r"\d+", "0"), (r"U{2,}", "UU"), (r"l+", "l"), (r"([^\w\s])\1+", r"\1\1"))]
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
SAME = np.uint64(0x5851F42D4C957F2D)


def _ids(chunk: bytes) -> tuple[int, int]:
    """Hashes of a word and of its shape."""
    word = chunk.decode("utf-8", "replace")
    shape = word.translate(ASCII_LETTERS) if word.isascii() else LETTER.sub(lambda m: "U" if m[0].isupper() else "l", word)
    for pattern, by in SHAPES:
        shape = pattern.sub(by, shape)
    return xxhash.xxh64_intdigest(word.lower().strip(".,;:!?\"'()")), xxhash.xxh64_intdigest("shape " + shape)


class Featurizer:
    """Text -> sorted distinct feature places."""

    def __init__(self, limit: int = 400_000):
        self.rows = Rows(_ids, 2, np.uint64, limit)

    def __call__(self, text: bytes | None) -> np.ndarray:
        chunks = (text or b"").split()
        if not chunks:
            return np.zeros(0, np.int32)
        at = self.rows(chunks)
        w, s = self.rows.table[at].T
        s[1:][w[1:] == w[:-1]] ^= SAME
        grams = [w * ODD[0], w[:-1] * ODD[0] + w[1:] * ODD[1], s * ODD[2]]
        g = s
        for n in (1, 2, 3):
            g = g[:-1] * ODD[3] + s[n:]
            grams.append(g * ODD[2])
        self.rows.trim()
        return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, norms: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """The L1-loss linear support vector machine's weights, the last of which is the bias.

    Row i has the value scale[k] / norms[i] at each of its places k, and 1 / norms[i] for the bias; rows without a norm take no
    part.  y is -1 or 1.  Values are formed at each visit, so the rows cost no more memory than their places.
    """
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    bias = len(scale)
    square = np.array([1 + 1 / n**2 if n else 0.0 for n in norms])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            if not norms[i]:
                continue
            at = rows[i]
            v = scale[at] / norms[i]
            gradient = y[i] * (float(w[at] @ v) + w[bias] / norms[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[bias] += step / norms[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Weights by place (already scaled by the ratios' share), and the sigmoid of the margin."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, slope: float, shift: float):
        self.weight, self.ratio, self.slope, self.shift = weight.astype(np.float32), ratio.astype(np.float32), slope, shift

    def margin(self, places: np.ndarray) -> float:
        x = self.ratio[places]
        norm = float(np.sqrt(x @ x))
        return float(self.weight[places] @ x + self.weight[-1]) / norm if norm else 0.0

    def score(self, places: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.slope * self.margin(places) + self.shift)))


def _train(features: list[np.ndarray], y: np.ndarray, smooth: float, cost: float) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << BITS
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for at, label in zip(features, y, strict=True):
        counts[int(label)][at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts[0] + counts[1] < 2 * smooth + 2] = 0  # seen in one text only
    norms = np.array([np.sqrt(float(ratio[at] @ ratio[at])) for at in features])
    share = y.mean()
    costs = np.where(y == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    return dual_coordinate_descent(features, ratio, norms, 2.0 * y - 1, costs), np.append(ratio, 0.0)


def fit_texts(sample: list[tuple[bytes, int]], smooth: float = 1.0, cost: float = 4.0, folds: int = 3, prior: float | None = None) -> Model | None:
    """A model of the sample; None if it hasn't both labels. prior: the share of label 1 among all rows."""
    y = np.array([label for _, label in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    make = Featurizer(50_000)
    features = [make(t) for t, _ in sample]
    del make, sample  # the driver has little room
    part = np.random.default_rng(7).permutation(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        inside = part != k
        if y[inside].min() == y[inside].max():
            continue
        model = Model(*_train([f for f, own in zip(features, inside, strict=True) if own], y[inside], smooth, cost), 1, 0)
        margins[~inside] = [model.margin(f) for f, own in zip(features, inside, strict=True) if not own]
    slope, shift = logistic(np.stack([margins, np.ones(len(y))], 1), y)
    if prior is not None and 0 < prior < 1:  # the sample holds the classes in another proportion than the table
        shift += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return Model(*_train(features, y, smooth, cost), float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3_000, max_bytes: int = 200_000) -> Model | None:
    known = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", 5) != 0)).agg(F.avg(label)).first()[0]
    return fit_texts(labelled_sample(docs, labels, label, (per_class, per_class), max_bytes), prior=known)


def _scores(shared, texts: list[bytes | None], make: Featurizer) -> np.ndarray:
    model = shared.value
    return np.array([1.0 if model is None else model.score(make(t)) for t in texts])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = broadcast_value(docs.sparkSession, model)
    source = narrow(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in slices(batches, 2_000):
            s = _scores(shared, utf8(batch, "text"), make)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that score at least `threshold`, with all their columns."""
    shared = broadcast_value(docs.sparkSession, fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in slices(batches, 2_000):
            yield batch.filter(pa.array(_scores(shared, utf8(batch, "text"), make) >= threshold))

    return docs.mapInArrow(run, docs.schema)
