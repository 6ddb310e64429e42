"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, with its own contexts and counts.  A text's code length under
a language is the sum over its bytes of -log2 p(byte | longest context in the tree), where an unseen symbol pays the escape
probability (method C: distinct / (total + distinct)) and falls to the next shorter context, down to a uniform order -1.
The statistics are frozen after training, so the code lengths are table look-ups: the contexts of all trees are numbered
together, a text's contexts are looked up once, and each language maps a number to its own longest context.

The model is fitted on a bounded sample: at most `sample_rows` whole texts a language, the smallest by hash of the id, of
`max_bytes` each.  A tree has contexts of up to `order` bytes and keeps the `nodes` most frequent of each length, or all for
None; a language's tables take at most 4 bytes for each context and byte value, whatever the other languages have.

Defined cases.  Null texts and texts without a letter are `und` with score 0; very long texts count whole.  Without training
rows everything is `und`.  Equal code lengths go to the first language by name; contexts of equal frequency to the smaller
one.  Rows that repeat an id each get a row; of the training rows that do, one counts, that with the smallest text.  An empty
table gives an empty result.  Only the named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_value, fold, materialize, narrow, slices, utf8

ORDER = 3
BROADCAST_IDS = 500_000
LETTER = regex.compile(rb"[A-Za-z]")
ANY_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(LETTER.search(text) or ANY_LETTER.search(text.decode("utf-8", "replace")))


def _stream(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 of all texts, each after `order` zeros; and which positions hold a byte."""
    joined = np.frombuffer((b"\0" * order).join([b"", *(t or b"" for t in texts)]), np.uint8)
    real = np.ones(len(joined), bool)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    starts = np.cumsum(lengths + order) - lengths
    for k in range(order):
        real[starts - 1 - k] = False
    return np.where(real, joined.astype(np.int32) + 1, 0), real


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts of the `order` bytes before each byte and the byte, by language."""
        for batch in slices(batches, 500):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = utf8(batch, "text")
            for lang in sorted(set(langs)):
                codes, real = _stream([t for t, own in zip(texts, langs, strict=True) if own == lang], order)
                gram = codes.astype(np.int64)
                for k in range(1, order + 1):
                    gram[k:] += codes[:-k].astype(np.int64) * 257**k
                values, n = np.unique(gram[real], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return run


def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 for what isn't there."""
    if not len(keys):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def _longest(contexts: list[np.ndarray], want: np.ndarray, order: int, size: int) -> np.ndarray:
    """The number of the longest suffix of each context of `order` bytes; contexts are numbered by length, then value."""
    node, base = np.zeros(len(want), np.int64), 0
    for k in range(order + 1):
        at = _find(contexts[k], want % size**k)
        node = np.where(at >= 0, at + base, node)
        base += len(contexts[k])
    return node


class Tree:
    """One language: its contexts by length, and the code length in bits of every symbol after each."""

    def __init__(self, digits: list[np.ndarray], n: np.ndarray, size: int, nodes: int | None):
        """digits[k]: the code of the byte k before, of each counted gram."""
        order = len(digits) - 1
        self.contexts: list[np.ndarray] = []
        bits = np.zeros((0, size), np.float32)
        for k in range(order + 1):
            ctx = sum((digits[j] * size ** (j - 1) for j in range(1, k + 1)), np.zeros(len(n), np.int64))
            keys, inverse = np.unique(ctx, return_inverse=True)
            if nodes is not None and len(keys) > nodes:
                often = np.bincount(inverse, n, len(keys))
                keep = np.sort(np.argsort(-often, kind="stable")[:nodes])
                place = np.full(len(keys), -1)
                place[keep] = np.arange(len(keep))
                keys, inverse = keys[keep], place[inverse]
            use = inverse >= 0
            table = np.bincount(inverse[use] * size + digits[0][use], n[use], len(keys) * size).reshape(-1, size)
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            parent = bits[_longest(self.contexts, keys % size ** (k - 1), k - 1, size)] if k else np.full((len(keys), size), 8.0, np.float32)
            with np.errstate(divide="ignore"):
                own = -np.log2(table / (total + kinds))
            level = np.where(table > 0, own, parent - np.log2(kinds / (total + kinds))).astype(np.float32)
            bits = np.concatenate([bits, level])
            self.contexts.append(keys)
        self.bits = bits.reshape(-1)


class Trees:
    """The frozen model of all languages."""

    DENSE = 3

    def __init__(self, rows: list[tuple[str, int, int]], nodes: int | None = 20_000, order: int = ORDER):
        """rows: (language, gram, count); a gram is the byte and the `order` bytes before it, in base 257."""
        if not 1 <= order <= 6:
            raise ValueError("the order is from 1 to 6")
        self.order = order
        self.langs = sorted({r[0] for r in rows})
        lang = np.searchsorted(np.array(self.langs, object), np.array([r[0] for r in rows], object)) if rows else np.zeros(0, int)
        gram, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        seen = np.unique(np.concatenate([gram // 257**k % 257 for k in range(order + 1)])) if rows else np.zeros(1, int)
        seen = seen[seen > 0]
        self.code = np.full(257, len(seen) + 1, np.int32)  # the last code: bytes never seen
        self.code[0] = 0
        self.code[seen] = np.arange(1, len(seen) + 1)
        size = self.size = len(seen) + 2
        digits = [self.code[gram // 257**k % 257].astype(np.int64) for k in range(order + 1)]
        trees = [Tree([d[lang == k] for d in digits], n[lang == k], size, nodes) for k in range(len(self.langs))]
        self.bits = [t.bits for t in trees]
        #: The contexts of all trees by length, and for each language the number of its own longest suffix of each.
        self.contexts = [np.unique(np.concatenate([np.zeros(1 - min(k, 1), np.int64), *(t.contexts[k] for t in trees)])) for k in range(order + 1)]
        self.own = [np.concatenate([_longest(t.contexts, keys, k, size) for k, keys in enumerate(self.contexts)]).astype(np.int32) for t in trees]
        dense = min(order, self.DENSE)
        self.dense = _longest(self.contexts, np.arange(size**dense, dtype=np.int64), dense, size).astype(np.int32)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """The number of the longest context before each position."""
        ctx = np.zeros(len(codes), np.int64 if self.order > self.DENSE else np.int32)
        for k in range(1, min(self.order, self.DENSE) + 1):
            ctx[k:] += codes[:-k] * ctx.dtype.type(self.size ** (k - 1))
        node = self.dense[ctx]
        base = sum(len(c) for c in self.contexts[: self.DENSE + 1])
        for k in range(self.DENSE + 1, self.order + 1):
            ctx[k:] += codes[:-k] * ctx.dtype.type(self.size ** (k - 1))
            at = _find(self.contexts[k], ctx)
            node = np.where(at >= 0, at + base, node)
            base += len(self.contexts[k])
        return node

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            codes, real = _stream(some, self.order)
            codes = self.code[codes]
            node, codes = self.lookup(codes)[real], codes[real]
            edges = np.cumsum([0, *(len(t or b"") for t in some)])
            for k, (bits, own) in enumerate(zip(self.bits, self.own, strict=True)):
                total = np.concatenate([[0.0], np.cumsum(bits[own[node] * self.size + codes], dtype=np.float64)])
                out[at : at + len(some), k] = total[edges[1:]] - total[edges[:-1]]
        return out


def fit(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", sample_rows: int = 1_000, max_bytes: int = 1_000_000, nodes: int | None = 20_000, order: int = ORDER) -> Trees:
    """Trees from the given training rows: at most `sample_rows` texts of at most `max_bytes` bytes for each language."""
    rows = narrow(docs, id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    hashed = rows.select("id", "lang", F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1 << 40)).alias("h"))
    # A hash bound leaves some four times the rows wanted, so the ranking of a language never sees all its rows.
    bound = materialize(hashed.groupBy("lang").agg((F.lit(float(4 * sample_rows << 40)) / F.count(F.lit(1))).alias("bound")), "language-bounds")
    bound = F.broadcast(bound) if bound.count() <= BROADCAST_IDS else bound
    chosen = hashed.join(bound, "lang").where(F.col("h") <= F.col("bound")).withColumn("r", rank).where(F.col("r") <= sample_rows).select("id").distinct()
    chosen = materialize(chosen, "language-sample")
    # At most sample_rows ids a language: broadcast if that is little, as it is for hundreds of languages.
    few = chosen.count() <= BROADCAST_IDS
    sample = rows.join(F.broadcast(chosen) if few else chosen, "id", "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    counts = sample.select("lang", "text").mapInArrow(_counter(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    return Trees(list(zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True)), nodes, order)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = shared.value
        for batch in slices(batches, 1_000):
            texts = utf8(batch, "text")
            lang, score, bits = [], [], []
            known = [bool(trees.langs) and has_letter(t) for t in texts]
            lengths = trees.lengths(texts) if trees.langs else np.zeros((len(texts), 1))
            best = lengths.argmin(1)
            share = np.exp2(lengths.min(1, keepdims=True) - lengths).sum(1)
            for k, ok in enumerate(known):
                lang.append(trees.langs[best[k]] if ok else "und")
                score.append(float(1 / share[k]) if ok else 0.0)
                bits.append(float(lengths[k, best[k]]) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["id", "held_out", "lang_pred", "score", "code_bits"])

    return run


def identify(docs: DataFrame, trees: Trees, id_col="doc_id", text_col="text", held_out=None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the posterior of the best language) and its code length."""
    source = narrow(docs, id=id_col, text=text_col)
    kind = dict(source.dtypes)["id"]
    source = source.select("id", "text", (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return source.mapInArrow(_scorer(broadcast_value(docs.sparkSession, trees)), f"id {kind}, held_out boolean, lang_pred string, score double, code_bits double")


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents of crc32(doc_id) mod 4 other than 2, and predicts for all."""
    trees = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, trees, held_out=F.coalesce(fold("id", 4) == 2, F.lit(False))).withColumnRenamed("id", "doc_id")
