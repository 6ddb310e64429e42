"""Benchmark decontamination with suffix arrays over the training documents.

Each block of documents is a shard.  Its words become ids of the benchmark's vocabulary (0: any other word, or a
document's end), the positions that can start a match are sorted by the words that follow them, and every benchmark
suffix is binary-searched in that array.  A match of a whole window marks its words; the longest match of any suffix
and its place are kept as evidence.  Only the benchmark leaves its table: it is handed out in blocks of whole items, of at
most `block_words` words or one item.  Documents pass by the blocks one after another and carry what was found, so neither
the driver nor a task holds more than one block, documents are never shuffled, and two copies are kept at most.

Defined cases.  Null and empty texts have no words and are never contaminated; very long texts count whole.  Items with fewer
words than a window form one window of all their words; items without words form none; an item of over `block_words` words
is a block of its own, so no result depends on the blocks.  Repeated rows each give their own row.
Of equally long matches the first in the text counts, then that of the smallest item as a string (unnamed ones last).
Empty documents give an empty result, an empty benchmark no hits.  Extra columns of any name are kept by
remove_contaminated and ignored by the others.

Benchmark rows without an id mark words like any other.  Together they count as one item, which has no name: it is a
null in `items`, counts in n_items and is left out of items_sha256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import broadcast_value, materialize, narrow, release, slices, utf8, words

#: Words that a suffix is sorted by; longer matches are extended word by word.
DEPTH = 16
FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string())])
FOUND_SQL = "struct<n_words:bigint,hits:array<int>,items:array<string>,longest:int,longest_at:int,longest_item:string>"


class Probe:
    """A block of the benchmark: its vocabulary, its suffixes and its windows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.items = [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        streams = [np.array([self.vocab[w] for w in ws], np.uint32) for _, ws in items]
        gap = np.zeros(DEPTH, np.uint32)
        self.stream = np.concatenate([x for s in streams for x in (s, gap)] or [gap])
        starts = np.cumsum([0, *(len(s) + DEPTH for s in streams)])[:-1]
        self.suffix_at = np.concatenate([np.arange(a, a + len(s)) for a, s in zip(starts, streams, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.suffix_item = np.concatenate([np.full(len(s), k) for k, s in enumerate(streams)] or [np.zeros(0)]).astype(np.int64)
        left = np.concatenate([np.arange(len(s), 0, -1) for s in streams] or [np.zeros(0)]).astype(np.int64)
        whole = np.concatenate([np.full(len(s), min(len(s), window)) for s in streams] or [np.zeros(0)]).astype(np.int64)
        # A suffix of an item is a window's start if enough words are left; a short item has the one at its start.
        self.length = np.where(left >= whole, whole, 0)
        self.least = int(min((min(len(s), window) for s in streams if len(s)), default=0))
        n = np.uint64(len(self.vocab) + 1)
        a, b = self.stream[:-1].astype(np.uint64), self.stream[1:].astype(np.uint64)
        self.pairs = np.unique((a * n + b)[(a > 0) & (b > 0)])
        self.n = n
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)] = True

    def keys(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """DEPTH ids from each position, as big-endian bytes that sort like the ids."""
        wide = ">u2" if len(self.vocab) < 65_535 else ">u4"
        view = np.lib.stride_tricks.sliding_window_view(stream.astype(wide), DEPTH)
        rows = np.ascontiguousarray(view[at])
        return rows.view(f"S{rows.dtype.itemsize * DEPTH}").reshape(-1)

    def starts(self, stream: np.ndarray) -> np.ndarray:
        """Positions from which a window can match: the first two words follow each other in the benchmark."""
        if self.least < 2:
            return np.flatnonzero(stream)
        a, b = stream[:-1].astype(np.uint64), stream[1:].astype(np.uint64)
        pair = a * self.n + b
        at = np.flatnonzero((a > 0) & (b > 0) & self.bits[(pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)])
        return at[np.isin(pair[at], self.pairs)]


def _shard(probe: Probe, texts: list[bytes | None]):
    """Of a shard: each document's words and start, then of each matching window its position, length, item and longest match."""
    get = probe.vocab.get
    tokens = [words(t) for t in texts]
    counts = np.array([len(t) for t in tokens], np.int64)
    stream = np.zeros(int(counts.sum()) + len(tokens) + 2 * DEPTH, np.uint32)
    at = 0
    first = np.zeros(len(tokens), np.int64)
    for k, t in enumerate(tokens):
        first[k] = at
        stream[at : at + len(t)] = [get(w, 0) for w in t]
        at += len(t) + 1
    begin = probe.starts(stream)
    begin = begin[begin < len(stream) - DEPTH]
    none = np.zeros(0, np.int64)
    if not len(begin) or not len(probe.suffix_at):
        return counts, first, none, none, none, none
    keys = probe.keys(stream, begin)
    order = np.argsort(keys, kind="stable")
    keys, begin = keys[order], begin[order]
    tests = probe.keys(probe.stream, probe.suffix_at)
    size = tests.dtype.itemsize // DEPTH

    def found(length: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard's range of suffixes that begin with the first `length` words of each test suffix."""
        raw = np.frombuffer(tests[mine].tobytes(), np.uint8).reshape(-1, DEPTH * size)
        low, high = raw.copy(), raw.copy()
        low[:, length * size :], high[:, length * size :] = 0, 255
        return (np.searchsorted(keys, np.ascontiguousarray(x).view(tests.dtype).reshape(-1), side) for x, side in ((low, "left"), (high, "right")))

    where, lengths, whose, heads = [none], [none], [none], [none]
    for length in np.unique(probe.length[probe.length > 0]):
        if length > DEPTH:
            raise ValueError("windows are longer than the sort depth")
        mine = np.flatnonzero(probe.length == length)
        lo, hi = found(int(length), mine)
        n = hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        where.append(begin[rows])
        lengths.append(np.full(len(rows), length))
        whose.append(np.repeat(probe.suffix_item[mine], n))
        heads.append(np.repeat(probe.suffix_at[mine], n))
    where, lengths, whose, heads = (np.concatenate(x) for x in (where, lengths, whose, heads))
    # The longest verbatim match of each: extended word by word while both streams agree.
    longest, live = lengths.copy(), np.arange(len(where))
    while len(live):
        a, b = where[live] + longest[live], heads[live] + longest[live]
        same = (a < len(stream)) & (b < len(probe.stream))
        same[same] = (stream[a[same]] > 0) & (stream[a[same]] == probe.stream[b[same]])
        live = live[same]
        longest[live] += 1
    return counts, first, where, lengths, whose, longest


def _named(item: str | None) -> tuple[bool, str]:
    """Items in order: by name, unnamed ones last."""
    return item is None, item or ""


def _found(probe: Probe, texts: list[bytes | None], before: list[dict] | None) -> list[dict]:
    """What is known of each text: its words, hits, items and longest match, of this block and of those before."""
    counts, first, where, lengths, whose, longest = _shard(probe, texts)
    out = before or [{"n_words": int(n), "hits": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None} for n in counts]
    doc = np.searchsorted(first, where, "right") - 1
    order = np.argsort(doc, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
        d = int(doc[mine[0]])
        at, known = where[mine] - first[d], out[d]
        mark = np.zeros(counts[d] + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + lengths[mine], -1)
        hits = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        top = mine[longest[mine] == longest[mine].max()]
        top = top[where[top] == where[top].min()]
        item = min((probe.items[k] for k in whose[top]), key=_named)
        best = [(int(longest[top[0]]), int(where[top[0]] - first[d]), item)]
        if known["longest"]:
            best.append((known["longest"], known["longest_at"], known["longest_item"]))
        best = min(best, key=lambda b: (-b[0], b[1], _named(b[2])))
        out[d] = {
            "n_words": known["n_words"],
            "hits": np.union1d(np.array(known["hits"], np.int64), hits).tolist(),
            "items": sorted({*known["items"], *(probe.items[k] for k in whose[mine])}, key=_named),
            "longest": best[0],
            "longest_at": best[1],
            "longest_item": best[2],
        }
    return out


def _probes(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Probe]:
    """The benchmark in blocks of whole items, of at most `block_words` words or one item; the rows come one partition at a time."""
    block, total = [], 0
    for row in narrow(benchmark, item=item_col, text=text_col).toLocalIterator():
        ws = words(row["text"].encode() if row["text"] is not None else None)
        if block and total + len(ws) > block_words:
            yield Probe(block, window)
            block, total = [], 0
        block.append((None if row["item"] is None else str(row["item"]), ws))
        total += len(ws)
    yield Probe(block, window)


def _search(docs: DataFrame, text: str, probes: Iterator[Probe], rows: int, finish: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch], schema: StructType) -> DataFrame:
    """Passes the documents by every block; `finish` makes the result of a batch and what all blocks have found in it."""
    spark, width = docs.sparkSession, len(docs.columns)
    state = next(f"found{k}" for k in count() if f"found{k}" not in {c.lower() for c in docs.columns})
    carried = StructType([*docs.schema.fields, StructField(state, spark.createDataFrame([], f"x {FOUND_SQL}").schema["x"].dataType)])

    def step(shared, begun: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, rows):
                known = _found(shared.value, utf8(batch, text), batch.column(width).to_pylist() if begun else None)
                own = batch.select(list(range(width)))
                yield finish(own, known) if last else pa.RecordBatch.from_arrays([*own.columns, pa.array(known, FOUND)], [*own.schema.names, state])

        return run

    begun, probe, source = False, next(probes), docs
    for following in probes:
        shared, done = broadcast_value(spark, probe), docs
        docs = materialize(docs.mapInArrow(step(shared, begun, False), carried), "searched")
        shared.destroy()
        if done is not source:  # what the block before has written isn't read again
            release(done)
        begun, probe = True, following
    return docs.mapInArrow(step(broadcast_value(spark, probe), begun, True), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = 13, block_words: int = 2_000_000, rows: int = 2_000) -> DataFrame:
    """One row per document: id, n_words, hits (word positions, sorted), items (sorted strings, then a null for rows without an id) and the longest verbatim match (words, its place in words from 0, its item).

    The longest match is the longest that holds a window of its item; shorter ones are no evidence, and give 0 and nulls.
    """
    if window > DEPTH:
        raise ValueError(f"windows have at most {DEPTH} words")
    source = narrow(docs, id=id_col, text=text_col)
    names = [FOUND.field(k).name for k in range(FOUND.num_fields)]

    def finish(batch: pa.RecordBatch, known: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *pa.array(known, FOUND).flatten()], ["id", *names])

    schema = docs.sparkSession.createDataFrame([], f"id {dict(source.dtypes)['id']}, {FOUND_SQL.removeprefix('struct<').removesuffix('>').replace(':', ' ')}").schema
    return _search(source, "text", _probes(benchmark, item_col, item_text_col, window, block_words), rows, finish, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of find_contamination()."""
    return find_contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.size("hits") > 0) & (F.lit(20) * F.size("hits") >= F.col("n_words"))).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000, rows: int = 2_000) -> DataFrame:
    """The rows whose `text` isn't contaminated, with all their columns."""

    def finish(batch: pa.RecordBatch, known: list[dict]) -> pa.RecordBatch:
        return batch.filter(pa.array([not k["hits"] or 20 * len(k["hits"]) < k["n_words"] for k in known], pa.bool_()))

    return _search(docs, "text", _probes(benchmark, "item_id", "text", 13, block_words), rows, finish, docs.schema)
