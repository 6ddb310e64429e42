"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document is cut into full windows and a remainder.  Only the histogram of remainder lengths (at most `window`
counts) reaches the driver.  There, the longest length left opens a window, and a subset-sum dynamic program over
bitsets picks the multiset of lengths that fills the rest of the window closest to capacity; counts come from
backtracking.  A multiset is used as often as the counts allow, so the plan has few patterns whatever the number of
documents.  Pieces find their place by their rank among pieces of the same length: ranks are per-partition
counters plus a running total of the (partition, length) counts, so no length, however common, meets in one task.

Defined cases.  A null text counts as empty; an empty text is one piece that holds the end id alone; a very long text gives
as many full windows as it fills.  Repeated rows are packed as documents of their own.  Pieces of one length are
interchangeable: which of them goes where follows their place in the table, and a plan with equal slack takes the longer
lengths first.  An empty table gives an empty result.  Only the two named columns are read, so extra columns of any name
do no harm.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, broadcast_value, materialize, narrow, slices, utf8


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths and counts, the multiset with the largest sum that is at most `room`.

    Bit s of the reachable set says that some multiset sums to s.  Counts are split into binary parts, each a bitset
    shift; going back through the parts from the best sum tells which were taken.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if counts[n] and n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places by rank, and the number of sequences.

    A row (length, first rank, ranks, copies, first sequence, offset) says: the ranks from `first rank` on go, `copies` to a sequence,
    to consecutive sequences from `first sequence`, side by side from `offset`.
    """
    left, used = {n: c for n, c in histogram.items() if c > 0}, dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items()}
        chosen = fill(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n in sorted(chosen, reverse=True):
            c = chosen[n]
            rows.append((n, used[n], times * c, c, sequence, offset))
            offset += n * c
            used[n] += times * c
            left[n] -= times * c
            if not left[n]:
                del left[n]
        sequence += times
    return rows, sequence


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for a byte: itself if printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}


class Encoder:
    """Text -> little-endian 32-bit ids; each chunk between spaces and line feeds is encoded once.

    The tokenizer drops white space and never joins what it separates, so encoding chunk by chunk gives the ids of the
    whole.  It also never joins letters and marks: a chunk of Latin letters and trailing marks is put together from both,
    and the lower-case letters go straight to its merges.  All other chunks go through the whole tokenizer.
    """

    PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.end = np.array([end], "<u4").tobytes()
        self.memo, self.cores, self.marks = Memo(self._chunk, 500_000), Memo(self._core, 500_000), Memo(self._whole, 50_000)

    def _whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: str) -> bytes:
        text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(text)])

    def _chunk(self, chunk: bytes) -> bytes:
        parts = self.PLAIN.fullmatch(chunk)
        if parts:
            word = parts[1].decode("utf-8")
            # Below U+0250 lower case goes letter by letter and composed letters stay, but for the dotted I.
            if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                return self.cores[word.lower()] + (self.marks[parts[2]] if parts[2] else b"")
        return self._whole(chunk)

    def __call__(self, text: bytes | None) -> bytes:
        chunks = (text or b"").replace(b"\n", b" ").split(b" ")
        out = b"".join(map(self.memo.__getitem__, chunks)) + self.end
        for memo in (self.memo, self.cores, self.marks):
            memo.trim()
        return out


PIECE = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _cutter(path: str | None, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = Encoder(path or public_tokenizers.path("word_bpe_49k.json"), end)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in slices(batches, 1_000):
            texts = utf8(batch, "text")
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for k, text in enumerate(texts):
                ids = encode(text)
                n = len(ids) // 4
                for at in range(0, n, window):
                    size = min(window, n - at)
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    nth.append(seen[size])
                    seen[size] += 1
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())], ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, copies, sequence, offset = shared.value
        code = lengths.astype(np.int64) << 44 | first
        for batch in slices(batches, 50_000):
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(code, n.astype(np.int64) << 44 | rank, "right") - 1
            times, slot = np.divmod(rank - first[at], copies[at])
            kept = [batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + times, pa.int64()), pa.array(offset[at] + slot * n, pa.int64())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 4096, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a vocabulary file's path on the executors."""
    source = narrow(docs, id=id_col, text=text_col)
    kind = dict(source.dtypes)["id"]
    # Written once: the counters `part` and `nth` of a piece must not change if a task runs again later.
    pieces = materialize(source.mapInArrow(_cutter(tokenizer, end, window), PIECE.format(kind=kind)), "pieces")
    groups = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per (length, partition): the running total gives each partition's first rank.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = groups.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(histogram, window)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 6)
    shared = broadcast_value(docs.sparkSession, (table[:, 0], table[:, 1], table[:, 3], table[:, 4], table[:, 5]))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(shared), out)


def packing_report(docs: DataFrame) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")


def padding(packed: pd.DataFrame, window: int = 4096) -> float:
    """The share of the sequences' places that no piece holds."""
    return 1 - packed["length"].sum() / (window * packed["sequence_id"].nunique())
