"""Interleaved document sequences: ordered text and media references, with payloads joined by digest.

parse_pages() turns HTML into one row per item, in document order: text blocks, and media references with their
captions.  resolve() joins references with a media table by digest, so a payload is stored once however many documents
refer to it, and positions and captions stay where they were.  assemble() gives the array of structs back.

Media payloads are stored as 8-bit greyscale PNG images, 192 samples a row, which is lossless.  Digests that a large
share of all references have are dealt to several tasks.

Defined cases.  Null and empty texts are a payload of one row of spaces; very long texts are one image.  Null and empty pages
have no items.  References whose digest no payload has keep a null payload.  Repeated rows give rows of their own; media
that repeat a digest count once, so equal digests are no tie.  Empty tables give empty results.  Extra columns of any name
are ignored; columns of `media` that are named like an item's (pos, kind, text, ref, caption, n_bytes) or kept column are an error.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow, slices, utf8

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())])
ITEM_SQL = "struct<pos:int,kind:string,text:string,ref:string,caption:string,n_bytes:bigint>"


def pad(data: bytes) -> bytes:
    return data + b" " * (ROW - len(data) if len(data) < ROW else -len(data) % ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png(payload: bytes) -> bytes:
    """The payload's bytes as samples of a greyscale image; its length is a positive multiple of ROW."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)  # each line opens with filter type 0
    lines[:, 1:] = samples
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of such an image; its checksums and size are tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, b"", (0, 0)
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, sum, share of the most frequent sample, and mean step between neighbours, in whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum())
    return f"{ROW}x{len(x) // ROW};sum={int(counts @ np.arange(256))};kinds={int((counts > 0).sum())};mode={int(counts.argmax())}:{int(counts.max())};step={step}"


# HTML's own element names.
BLOCKS = {"p", "div", "li", "ul", "ol", "td", "th", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "aside", "main", "blockquote", "pre", "figure", "br", "hr", "body", "title"}
MEDIA = {"img", "video", "audio", "source", "embed", "iframe"}
HIDDEN = {"script", "style", "noscript", "template"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.begun: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None, "n_bytes": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                n = found.get("data-bytes") or ""
                self.items.append({"pos": len(self.items), "kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt") or None, "n_bytes": int(n) if n.isdecimal() else None})
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.begun.append(len(self.items))

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.begun[-1] if self.begun else 0 :]:
                if item["kind"] == "media":
                    item["caption"] = text or item["caption"]
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.begun:
                self.begun.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def items(page: str | None) -> list[dict]:
    """Text blocks and media references of a page, in order."""
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def parse_pages(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """One row per page: id and its sequence, an array of (pos, kind, text, ref, caption, n_bytes)."""
    source = narrow(pages, id=id_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            found = [items(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(ITEM))], ["id", "sequence"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, sequence array<{ITEM_SQL}>")


def media_digest(ref: Column) -> Column:
    """The digest in a reference `media:<sha256>`; null for others."""
    return F.nullif(F.regexp_extract(ref, r"^media:([0-9a-f]{64})$", 1), F.lit(""))


#: A digest is hot from this share of all references on, so at most 1 / HOT_SHARE are; its references go to SPREAD tasks.
HOT_SHARE, SPREAD = 0.001, 32


def hot_digests(references: DataFrame) -> DataFrame:
    """(digest) of those that many of the references (digest) have: at most 1 / HOT_SHARE rows."""
    counts = references.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = references.count()
    return counts.where((F.col("digest").isNotNull()) & (F.col("n") > max(1.0, HOT_SHARE * total))).select("digest")


def resolve(sequences: DataFrame, media: DataFrame, *keep: str, hot: DataFrame | None = None) -> DataFrame:
    """One row per item with the columns `keep` and what `media` (digest, ...; one row a digest) holds for its reference.

    Text items and references without a digest stay out of the join.  hot: the digests of hot_digests(); what the media hold
    for them is repeated, and their references are spread over the repetitions.
    """
    clash = (set(media.columns) - {"digest"}) & {"pos", "kind", "text", "ref", "caption", "n_bytes", *keep}
    if clash:
        raise ValueError(f"media columns are named like columns of items: {sorted(clash)}")
    flat = sequences.select(*keep, F.explode("sequence").alias("item")).select(*keep, "item.*").withColumn("digest", media_digest(F.col("ref")))
    linked = flat.where(F.col("digest").isNotNull())
    if hot is None:
        linked = linked.join(media, "digest", "left")
    else:
        few = F.broadcast(hot.withColumn("__hot", F.lit(True)))
        turn = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0)).cast("long")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("__hot"), F.lit(SPREAD - 1)).otherwise(F.lit(0)).cast("long")))
        left = linked.join(few, "digest", "left").withColumn("__turn", turn).drop("__hot")
        right = media.join(few, "digest", "left").withColumn("__turn", copies).drop("__hot")
        linked = left.join(right, ["digest", "__turn"], "left").drop("__turn")
    return linked.unionByName(flat.where(F.col("digest").isNull()), allowMissingColumns=True)


def assemble(resolved: DataFrame, key: str) -> DataFrame:
    """The sequences again, in order, one row per key."""
    rest = [c for c in resolved.columns if c != key and c != "pos"]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("sequence"))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        pages, images, digests = [], [], []
        for text in utf8(batch, "text"):
            data = text or b""
            image = png(pad(data))
            digests.append(hashlib.sha256(image).hexdigest())
            images.append(image)
            first, _, rest = data.partition(b"\n")
            pages.append(f'<article><h1>{rest.count(10) + 1 if rest else 1} lines</h1><figure><img src="media:{digests[-1]}" data-bytes="{len(data)}"><figcaption>{html.escape(first.decode("utf-8", "ignore"))}</figcaption></figure></article>')
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["doc_id", "html", "digest", "media"])


def store_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Writes each text as an image and a page that refers to it: doc_id, html, digest, media."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    return materialize(source.mapInArrow(_store, f"doc_id {dict(source.dtypes)['doc_id']}, html string, digest string, media binary"), "media")


def media_features(store: DataFrame) -> DataFrame:
    """What the stored images hold, decoded: one row per digest. A task decodes a digest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in slices(batches, 500):
            if len(known) > 200_000:
                known.clear()
            fresh = [d is not None and d not in known and not known.add(d) for d in batch.column("digest").to_pylist()]
            batch, rows = batch.filter(pa.array(fresh, pa.bool_())), []
            for image in batch.column("media").to_pylist():
                payload = samples(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").dropDuplicates(["digest"])


def media_report(docs: DataFrame) -> DataFrame:
    """Each document as a page that refers to its text's image, captioned with its first line; the references are resolved from the images read back."""
    store = store_texts(docs)
    sequences = parse_pages(store, "doc_id", "html")
    hot = materialize(hot_digests(store.select("digest")), "hot-digests")
    resolved = resolve(sequences, media_features(store), "id", hot=hot).where(F.col("kind") == "media")
    return resolved.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
