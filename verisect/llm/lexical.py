"""Ranked lexical search over a tiered index.

Documents are indexed in shards of some SHARD_WORDS words each, a task's documents into shards of its own, so no term, however
frequent, brings its postings to one place.  In a shard, a term's postings are ordered by impact, the part of the score
that the document gives; the first tier holds the highest ones, and each row of a tier also holds a bound: the largest
impact that the term has in the tiers below.  All terms of all documents are indexed.

A search reads the first tier of its items' terms.  In a shard, what an item's unread postings may still add is at most the
sum of their bounds, so every document has a score so far and an upper bound.  Once a shard has no document whose score is
open and whose bound reaches the item's k-th best score so far (over all shards), the item's rows from that shard are exact;
items that lack this proof fall through to the next tier, in just those shards, and the last tier leaves nothing open.
So the rounds are as many as there are tiers at most, and no posting is dropped.

Scores are whole numbers.  With N documents that have a term, L their terms in all, n a document's, df a term's documents
and tf its occurrences: weight = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + 50nN div L, impact = 10^9 tf div (1000 tf + 20m).

Defined cases.  A null or empty text has no terms: such a document is never found and such an item finds nothing.  Very long
texts count whole, and are a shard of their own if need be.  Rows that repeat a document's id are documents of their own;
rows that repeat an item's id are one item with the terms of all.  Equal scores rank by ascending id, null ids first.  Empty
tables give an empty result.  Only the named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, broadcast_value, materialize, narrow, slices, utf8, words

#: Words of a shard, about; postings of a term in a shard up to which it fills the first tiers; rows of a batch out of a shard.
SHARD_WORDS, TIERS, ROWS = 1_000_000, (64, 512), 20_000
#: Tiers of the rows that list a shard's documents, and of those that tell which items are open in it.
LISTED, OPEN = -1, -2


@dataclass(frozen=True)
class TieredIndex:
    """postings: one row per shard, tier and term, and per shard one that lists its documents."""

    postings: DataFrame
    documents: int
    total: int
    tiers: int
    kind: str


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [n for text in utf8(batch, "text") if (n := len(words(text)))]
        yield pa.RecordBatch.from_pydict({"documents": [len(sizes)], "total": [sum(sizes)]})


class Shard:
    """Documents and the numbers of their terms, until they are enough for a shard."""

    def __init__(self):
        self.ids, self.found, self.words = [], [], 0
        self.numbers = Memo(lambda term: len(self.numbers))

    def add(self, doc_id, terms: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.found.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
        self.words += len(terms)

    def rows(self, shard: int, documents: int, total: int, tiers: tuple[int, ...], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        # Documents are numbered in the order of their ids, so that ties are decided by number.
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is not None, self.ids[k]))
        ids, found = [self.ids[k] for k in order], [self.found[k] for k in order]
        m = np.array([50 + 50 * len(x) * documents // total for x in found], np.int64)
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        pair, tf = np.unique(np.concatenate(found) << 32 | doc, return_counts=True)
        term, doc = pair >> 32, pair & 0xFFFFFFFF
        impact = 10**9 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.searchsorted(term, np.arange(len(self.numbers)))
        tier = np.searchsorted(np.array(tiers), np.arange(len(term)) - first[term], "right")
        start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tier[1:] != tier[:-1])])
        end = np.r_[start[1:], len(term)]
        follows = np.minimum(end, len(term) - 1)
        rest = np.where((end < len(term)) & (term[follows] == term[start]), impact[follows], 0)
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        doc, impact = (x.astype("<u4").tobytes() for x in (doc, impact))
        empty = pa.array([ids], pa.list_(kind))
        yield _batch([shard], [LISTED], pa.nulls(1, pa.string()), [len(ids)], [0], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), empty)
        for at in range(0, len(start), ROWS):
            a, b = start[at : at + ROWS], end[at : at + ROWS]
            edges = pa.py_buffer((np.r_[a, b[-1]] * 4).astype("<i8").tobytes())
            packed = (pa.Array.from_buffers(pa.large_binary(), len(a), [None, edges, pa.py_buffer(x)]).cast(pa.binary()) for x in (doc, impact))
            yield _batch(np.full(len(a), shard), tier[a], names.take(pa.array(term[a])), b - a, rest[at : at + ROWS], *packed, pa.nulls(len(a), pa.list_(kind)))


def _batch(shard, tier, term, n, rest, docs, impacts, ids) -> pa.RecordBatch:
    arrays = [pa.array(shard, pa.int64()), pa.array(tier, pa.int32()), term, pa.array(n, pa.int32()), pa.array(rest, pa.int32()), docs, impacts, ids]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "tier", "term", "n", "rest", "docs", "impacts", "ids"])


def build_index(docs: DataFrame, id_col="doc_id", text_col="text", shard_words: int = SHARD_WORDS, tiers: tuple[int, ...] = TIERS) -> TieredIndex:
    """Indexes every document, in two passes over the texts: counts, then shards; nothing is shuffled."""
    source = narrow(docs, id=id_col, text=text_col)
    kind = dict(source.dtypes)["id"]
    documents, total = (x or 0 for x in source.select("text").mapInArrow(_count, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, of = TaskContext.get().partitionId(), 0, Shard(), None
        for batch in slices(batches, 256):
            of = batch.column("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), utf8(batch, "text"), strict=True):
                if terms := words(text):
                    held.add(doc_id, terms)
                if held.words >= shard_words:
                    yield from held.rows(part << 32 | number, documents, total, tiers, of)
                    number, held = number + 1, Shard()
        if held.words:
            yield from held.rows(part << 32 | number, documents, total, tiers, of)

    schema = f"shard long, tier int, term string, n int, rest int, docs binary, impacts binary, ids array<{kind}>"
    return TieredIndex(materialize(source.mapInArrow(run, schema), "postings", "tier"), documents, total, len(tiers) + 1, kind)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """Of each item, the k best rows so far by (score, id): the smaller id is the better one, null before all."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, rows: list[tuple]) -> None:
        held = self.rows.get(item, []) + rows
        held.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        self.rows[item] = held[: self.k]

    def least(self, item: int) -> int:
        held = self.rows.get(item, ())
        return held[-1][0] if len(held) == self.k else 1


def score_shard(size: int, postings: dict[str, tuple[np.ndarray, np.ndarray, int]], terms: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a shard: the score so far, and what may be missing. postings: term -> (documents, impacts, bound of the impacts not read)."""
    score, missing = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for term, w in terms:
        if w and term in postings:
            docs, impacts, rest = postings[term]
            score[docs] += w * impacts
            if rest:
                missing += w * rest
                missing[docs] -= w * rest
    return score, missing


def _scorer(shared, k: int):
    """Rows of shards, one shard after the other -> each item's k best rows of the task, and the bounds of what is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        best, bounds, kind = Best(k), {}, pa.null()
        shard, ids, chosen, postings = None, [], None, {}

        def close() -> None:
            for item in range(len(items)) if chosen is None else chosen:
                score, missing = score_shard(len(ids), postings, items[item])
                floor = max(least.get(item, 1), best.least(item))
                unread = missing > 0
                if unread.any() and (bound := int((score + missing)[unread].max())) >= floor:
                    bounds[item, shard] = bound
                hits = np.flatnonzero(score >= floor)
                if len(hits) > k:
                    hits = hits[np.lexsort((hits, -score[hits]))[:k]]
                if len(hits):
                    best.add(item, [(int(score[d]), ids[d], shard) for d in hits])

        for batch in batches:
            kind = batch.column("ids").type.value_type
            columns = [batch.column(c).to_pylist() for c in ("shard", "tier", "term", "rest", "docs", "impacts", "ids", "items")]
            for at, tier, term, rest, docs, impacts, listed, opened in zip(*columns, strict=True):
                if at != shard:
                    if shard is not None:
                        close()
                    shard, ids, chosen, postings = at, [], None, {}
                if tier == OPEN:
                    chosen = opened
                elif tier == LISTED:
                    ids = listed
                else:
                    docs, impacts = np.frombuffer(docs, "<u4"), np.frombuffer(impacts, "<u4").astype(np.int64)
                    if term in postings:
                        docs, impacts = np.concatenate([postings[term][0], docs]), np.concatenate([postings[term][1], impacts])
                    postings[term] = docs, impacts, rest
        if shard is not None:
            close()
        rows = [(item, at, doc_id, score, None) for item, held in best.rows.items() for score, doc_id, at in held]
        rows += [(item, at, None, None, bound) for (item, at), bound in bounds.items() if bound >= max(least.get(item, 1), best.least(item))]
        types = (pa.int32(), pa.int64(), kind, pa.int64(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["item", "shard", "id", "score", "bound"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        found = [list(dict.fromkeys(words(text))) for text in utf8(batch, "text")]
        item = batch.column("item").take(pa.array([k for k, x in enumerate(found) for _ in x], pa.int64()))
        yield pa.RecordBatch.from_arrays([item, pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())], ["item", "term"])


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Each item's k best rows; tasks drop what can't be among them before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: TieredIndex, items: list[list[str]], k: int) -> DataFrame:
    """item (its place in `items`), rank, id, score and tier (how deep the item had to go in the row's shard)."""
    spark, postings = index.postings.sparkSession, index.postings
    # A block's terms are bounded.
    asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for terms in items for t in terms})], "term string"))
    held = postings.where("tier >= 0").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weights = {r["term"]: weight(index.documents, r["df"]) for r in held.collect()}
    weighted = [[(t, weights[t]) for t in terms if t in weights] for terms in items]
    done, opened, least = None, None, {}
    for tier in range(index.tiers):
        rows = postings.where(F.col("tier").between(LISTED, tier))
        rows = rows.where("tier < 0").unionByName(rows.where("tier >= 0").join(asked, "term", "left_semi")).withColumn("items", F.lit(None).cast("array<int>"))
        if opened is not None:
            where = opened.groupBy("shard").agg(F.collect_set("item").alias("items"))
            rows = rows.join(where.select("shard"), "shard", "left_semi")
            rows = rows.unionByName(where.withColumn("tier", F.lit(OPEN)), allowMissingColumns=True)
        # By a hash of the shard: a union of sides that a join has dealt by the shard itself would not be dealt again.
        dealt = rows.withColumn("deal", F.xxhash64("shard")).repartition("deal").sortWithinPartitions("shard", "tier")
        shared = broadcast_value(spark, (weighted, least))
        found = materialize(dealt.mapInArrow(_scorer(shared, k), f"item int, shard long, id {index.kind}, score long, bound long"), "found")
        scored = found.where(F.col("bound").isNull()).select("item", "shard", "id", "score", F.lit(tier).alias("tier"))
        best = _top(scored if done is None else done.unionByName(scored), k)
        least = {r["item"]: r["least"] for r in best.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
        floors = F.broadcast(spark.createDataFrame(list(least.items()), "item int, least long"))  # one row an item of the block
        opened = found.where(F.col("bound").isNotNull()).join(floors, "item", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1))).select("item", "shard")
        settled = scored.join(opened, ["item", "shard"], "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if opened.isEmpty():
            break
    return _top(done, k).drop("shard")


def search(index: TieredIndex, queries: DataFrame, k: int = 50, item_col="item_id", text_col="text", block_pairs: int = 200_000) -> DataFrame:
    """Each item's k best documents with a score above 0: item, rank, id, score, tier.

    Items are searched in blocks of some `block_pairs` pairs of item and term, so what is broadcast is bounded.
    """
    spark = queries.sparkSession
    source = narrow(queries, item=item_col, text=text_col)
    kind = dict(source.dtypes)["item"]
    pairs = materialize(source.mapInArrow(_terms, f"item {kind}, term string").distinct(), "asked")
    blocks = math.ceil(pairs.count() / block_pairs) if index.documents else 0
    out = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = mine.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        if rows:
            names = spark.createDataFrame([(at, r["item"]) for at, r in enumerate(rows)], f"at int, item {kind}")
            found = _search_block(index, [r["terms"] for r in rows], k).join(F.broadcast(names.withColumnRenamed("item", "name")), F.col("item") == F.col("at"))
            found = found.select(F.col("name").alias("item"), "rank", "id", "score", "tier")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item {kind}, rank int, id {index.kind}, score long, tier int") if out is None else out


def search_report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    found = search(build_index(docs), queries)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
