"""WARC archives and the external merge of their capture indexes.

Writing: every page becomes a record, gzipped as a member of its own; a payload that an earlier page (a smaller id)
already holds becomes a revisit record.  Each writer task sorts the captures it buffers by URL key and time, so an
archive is a locally sorted run.  Archives are rows of a table in the shared folder, which any executor can read back.

Reading: records are inflated piece by piece, parsed, and their payloads hashed again.  Merging: the index lines are dealt
by ranges of (URL key, time, page) that hold some RANGE lines each, however many captures there are, and in each range the
runs of all archives go through a loser tree, which yields one ordered capture history; a capture's position in the whole
history is its place in its range after the captures of the ranges before.

Defined cases.  Null html counts as an empty payload, a null URL as an empty one.  Ids of any type that a cast from text
restores are kept; null ids sort first.  Rows that repeat a page with the same payload give records of their own of the same
type, and stand next to each other in the history.  Of equal payloads the smallest page is the response.  Very long pages
are one record and one archive.  An empty table gives an empty history.  Only the three named columns are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow, utf8

EPOCH = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
ARCHIVE = "archive string, body binary"
INDEX_ARROW = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("at", pa.int64())])
INDEX = "page_id string, url string, url_key string, captured string, record_type string, refers_to string, payload_bytes long, payload_digest string, archive string, at long"
#: Lines of a range of the merge, about; bytes that are inflated at once.
RANGE, PIECE = 100_000, 1 << 14


def url_key(url: str) -> str:
    """The URL with its host reversed, so that pages of a site and its subdomains sort together."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    path = parts.path or "/"
    return f"{','.join(reversed(host.split('.')))}){path}" + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: str | None) -> str:
    """The pages have no capture time; a whole-number id, or another id's checksum, in seconds stands in for it."""
    seconds = int(page_id) if page_id and re.fullmatch(r"-?\d+", page_id) else zlib.crc32((page_id or "").encode())
    return (EPOCH + datetime.timedelta(seconds=seconds % 10**9 if page_id else 0)).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'-' if page_id is None else '=' + quote(page_id)}>",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": capture_time(page_id),
        "WARC-Payload-Digest": f"sha1:{sha1}",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:={quote(refers_to)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records have equal bytes."""
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record of an archive of gzip members; each byte is looked at once or twice."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpack, data, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(view):
                raise ValueError(f"the record at {at} is cut off")
            data.append(unpack.decompress(view[end : end + PIECE]))
            end += PIECE
        end = min(end, len(view)) - len(unpack.unused_data)
        head, _, rest = b"".join(data).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, fields, rest[: int(fields["Content-Length"])]
        at = end


def _page(field: str | None) -> str | None:
    text = (field or "<urn:page:->")[len("<urn:page:") : -1]
    return None if text == "-" else unquote(text[1:])


def _writer(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            nonlocal number, size
            held.sort(key=lambda x: x[:3])
            row = [[f"captures-{part:05d}-{number:05d}.warc.gz"], [b"".join(x[3] for x in held)]]
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), pa.array(row[1], pa.binary())], ["archive", "body"])

        for batch in batches:
            ids, names, urls, firsts = (batch.column(c).to_pylist() for c in ("page_id", "name", "url", "first"))
            for page_id, name, url, first, payload in zip(ids, names, urls, firsts, utf8(batch, "html"), strict=True):
                payload = payload or b""
                data = member(record(name, url or "", payload, digest(payload), first))
                held.append((url_key(url or ""), capture_time(name), () if page_id is None else (page_id,), data))
                size += len(data)
                if size >= max_bytes:
                    yield archive()
        if held:
            yield archive()

    return run


def write_archives(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 0, max_archive: int = 16 << 20) -> DataFrame:
    """A table of archives (archive, body) in the shared folder. Payloads under `min_bytes` bytes are always responses.

    Who revisits whom is found on ids and digests alone; pages meet that by (digest, id), so a payload that is very
    common brings its pages to no single task.
    """
    source = narrow(pages, page_id=id_col, url=url_col, html=html_col)
    source = source.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    known = source.where(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    firsts = known.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    revisits = known.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("sha").alias("sha_of"), F.col("page_id").alias("page_of"), F.col("first").cast("string").alias("first")).distinct()
    dealt = source.join(revisits, (F.col("sha") == F.col("sha_of")) & F.col("page_id").eqNullSafe(F.col("page_of")), "left")
    return materialize(dealt.select("page_id", F.col("page_id").cast("string").alias("name"), "url", "html", "first").mapInArrow(_writer(max_archive), ARCHIVE), "warc")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """One index line per record, in each archive's own order; digests and sizes come from the payloads read back. id_type: the SQL type of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("archive").to_pylist(), batch.column("body").to_pylist(), strict=True):
                lines = []
                for at, head, block in records(body):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    refers_to, sha1 = _page(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if refers_to is None and (digest(payload) != sha1 or len(payload) != size):
                        raise ValueError(f"damaged record at {at} of {name}")
                    url = head["WARC-Target-URI"]
                    lines.append((_page(head["WARC-Record-ID"]), url, url_key(url), head["WARC-Date"], head["WARC-Type"], refers_to, size, sha1, name, at))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), INDEX_ARROW.types, strict=True)], INDEX_ARROW.names)

    return archives.mapInArrow(run, INDEX).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


class LoserTree:
    """Merges k sorted runs: inner nodes keep the losers of their matches, so a pop replays one path from leaf to root."""

    END = (1,)

    def __init__(self, runs: list[list[tuple]]):
        """The runs hold keys; a key's row is told by the run and the place in it."""
        self.runs, self.k = runs, max(1, len(runs))
        self.place = [0] * self.k
        self.head = [self._key(r) for r in range(self.k)]
        self.loser = [0] * self.k
        winner = [0] * (2 * self.k)
        for r in range(self.k):
            winner[self.k + r] = r
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            if self.head[b] < self.head[a]:
                a, b = b, a
            winner[node], self.loser[node] = a, b
        self.top = winner[1] if self.k > 1 else 0

    def _key(self, run: int) -> tuple:
        rows = self.runs[run] if self.runs else []
        return (0, rows[self.place[run]], run) if self.place[run] < len(rows) else self.END

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.head[self.top] is not self.END:
            run = self.top
            yield run, self.place[run]
            self.place[run] += 1
            self.head[run] = self._key(run)
            node, best = (self.k + run) // 2, run
            while node:
                if self.head[self.loser[node]] < self.head[best]:
                    best, self.loser[node] = self.loser[node], best
                node //= 2
            self.top = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by archive and place, that is run after run; they leave by URL key, time and page, numbered."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), (() if p is None else (p,) for p in table["page_id"].to_pylist()), strict=True))
    archive = table["archive"].combine_chunks()
    edges = np.flatnonzero(pc.not_equal(archive[1:], archive[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(archive) > 1 else []
    starts = [0, *(int(k) for k in edges)] if len(keys) else []
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = np.fromiter((starts[run] + place for run, place in LoserTree(runs)), np.int64, len(keys))
    merged = table.take(pa.array(order)).append_column("part", pa.array(np.full(len(keys), TaskContext.get().partitionId(), np.int64))).append_column("nth", pa.array(np.arange(len(keys))))
    yield from merged.combine_chunks().to_batches(max_chunksize=10_000)


def merge_indexes(index: DataFrame) -> DataFrame:
    """The index lines of all archives in the order of URL key, time and page, over ranges of these; part and nth tell a line's range and its place there."""
    kind = dict(index.dtypes)["page_id"]
    index = materialize(index, "captures")
    ranges = max(1, index.count() // RANGE)
    dealt = index.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("archive", "at")
    schema = ", ".join(f"{name} {kind if name in ('page_id', 'refers_to') else t}" for name, t in (c.split() for c in INDEX.split(", ")))
    return dealt.mapInArrow(_merge, f"{schema}, part long, nth long")


def capture_report(pages: DataFrame) -> DataFrame:
    """The capture history: one row per page, with its position in the whole order from 0."""
    kind = dict(narrow(pages, page_id="page_id").dtypes)["page_id"]
    merged = materialize(merge_indexes(read_archives(write_archives(pages), kind)), "history")
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = merged.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", (F.col("before") + F.col("nth")).alias("position"), "archive", "at")
