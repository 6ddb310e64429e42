"""Byte-level BPE: encoding by contiguous rank arrays, and decoding.

A text is cut at the added tokens' strings, each piece is split into words by the vocabulary's pattern, and each distinct
word is merged once a task.  A short word is an array of parts and, beside it, an array of the ranks of neighbouring
parts: the smallest rank is looked up by a scan, its boundary goes, and only the two ranks next to it are taken anew.
A long word (over `SHORT` bytes) keeps its boundaries in a heap and a chain instead, so that one very long run takes time
in proportion to n log n; both give the same parts.

Defined cases.  A null text counts as empty and an empty one has no tokens; a very long text is encoded whole.  Rows that
repeat an id or a text give rows of their own, equal texts equal tokens, and equal ranks merge from the left.  An empty
table gives an empty result.  Only the named columns are read, so extra columns of any name do no harm.  Ids that the
vocabulary doesn't have decode to nothing, and bytes that aren't UTF-8 to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, narrow, slices
from .packing import byte_letters

#: Bytes of a word up to which its smallest rank is found by a scan; rows of a batch; the rank of parts that never merge.
SHORT, ROWS, NEVER = 128, 256, 1 << 60

# Fixed value: the split of byte-level vocabularies into words; {L}, {N} and {S} stand for letters, numbers and white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def narrow_split(limit: int) -> re.Pattern:
    """The split for texts of characters below `limit`, with their classes written out."""
    chars = [chr(c) for c in range(limit)]
    kinds = {kind: [re.escape(c) for c in chars if unicodedata.category(c)[0] == kind] for kind in "LN"}
    kinds["S"] = [re.escape(c) for c in chars if c.isspace() and not "\x1c" <= c <= "\x1f"]
    return re.compile(SPLIT.format(**{kind: "".join(found) for kind, found in kinds.items()}))


class Words:
    """Text -> its words.

    Characters below U+0250 have classes of long standing, and so has every character that this Python knows; a text with
    others, whose classes depend on the edition of Unicode, is split by the library itself.
    """

    def __init__(self):
        import regex
        from tokenizers import pre_tokenizers

        self.plain, self.latin = narrow_split(0x80), narrow_split(0x250)
        self.whole = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=r"\s"))
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        chars = set(text)
        if max(chars) < "ɐ":
            return self.latin.findall(text)
        new = chars - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        self.known |= new
        return self.whole.findall(text)


class Vocabulary:
    """A byte-level BPE vocabulary file, its encoder and its decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, before = said["model"], said["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or said["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} holds no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        vocab, letters = model["vocab"], byte_letters()
        #: Of two neighbouring parts: the rank of their merge.
        self.ranks: dict[tuple[int, int], int] = {}
        #: Of a rank: the part that its merge makes.
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.bytes = [vocab[letters[b]] for b in range(256)]
        back = {letter: b for b, letter in letters.items()}
        self.tokens = {i: bytes(map(back.__getitem__, token)) if set(token) <= back.keys() else token.encode() for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens |= {i: content.encode() for content, i in self.added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.memo = Memo(self._word)

    words = cached_property(lambda self: Words())

    def _word(self, word: str) -> bytes:
        parts = [self.bytes[b] for b in word.encode()]
        return np.array(self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts), "<u4").tobytes()

    def merge(self, parts: list[int]) -> list[int]:
        """The parts after all merges; the list is used up."""
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            at = ranks.index(least)
            parts[at] = self.made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """As merge(): boundaries wait in a heap by (rank, place); one whose parts have changed meanwhile is passed over."""
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, at) for at, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            least, at = heapq.heappop(waiting)
            right = after[at]
            if parts[at] < 0 or right >= n or rank((parts[at], parts[right])) != least:
                continue
            parts[at], parts[right], after[at] = self.made[least], -1, after[right]
            if after[right] < n:
                before[after[right]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (r := rank((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(waiting, (r, left))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        out, at, memo = [], 0, self.memo
        for found in self.cut.finditer(text) if self.cut else ():
            out += map(memo.__getitem__, self.words(text[at : found.start()]))
            out.append(self.added[found[0]].to_bytes(4, "little"))
            at = found.end()
        out += map(memo.__getitem__, self.words(text[at:] if at else text))
        memo.trim()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str | None) -> Vocabulary:
    """One a process. path: the file's place on the executors; None: the public byte-level vocabulary."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))


def encode(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None, packed: bool = False) -> DataFrame:
    """One row per document: id and ids, an array of int, or if `packed` a binary of little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer)
        for batch in slices(batches, ROWS):
            found = [bpe.encode(text or "") for text in batch.column("text").to_pylist()]
            if packed:
                ids = pa.array(found, pa.binary())
            else:
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    source = narrow(docs, id=id_col, text=text_col)
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, tokenizer: str | None = None, *kept: str) -> DataFrame:
    """Of rows of encode(): id and text, and the columns `kept`; null ids count as none."""
    packed = dict(encoded.dtypes)["ids"] == "binary"
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer)
        for batch in slices(batches, ROWS):
            texts = [bpe.decode(np.frombuffer(ids, "<u4").tolist() if packed else ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *kept)), pa.array(texts, pa.string())], ["id", *kept, "text"])

    out = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *kept))
    return encoded.select("id", *kept, "ids").mapInArrow(run, f"{out}, text string")


def encoding_report(docs: DataFrame) -> DataFrame:
    """Per document: the number of tokens, and digests of the ids and of the text that they decode to."""
    found = encode(docs, packed=True).select("id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode(found, None, "n_tokens", "ids_sha256").select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
