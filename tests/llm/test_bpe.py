"""Byte-level BPE against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verisect.llm import bpe, queries

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = bpe.vocabulary(None)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "I'll  don't 'S", "a<|endoftext|>b  <|endoftext|> c", "<|endoftext|", "\r\n\t x \x1c\x85\xa0", "Ünïcödé ñandú ½²", "漢字かな交じり文 и кириллица", "🙂👩‍👩‍👧 \U0001cd50՘", "a" * 5_000, " " * 3_000 + "x", "ab" * 2_000 + "!?" * 900, "\x00\x7f﻿"])
def test_texts(text):
    same(text)


def test_every_narrow_character():
    for c in map(chr, range(0x260)):
        same(f"a{c}1{c}{c} !{c} x {c}")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_short_and_long_words_merge_alike():
    draw = random.Random(3)
    for _ in range(300):
        word = "".join(draw.choice("abcehinorst") for _ in range(draw.randint(1, 120)))
        parts = [OWN.bytes[b] for b in word.encode()]
        assert OWN.merge(list(parts)) == OWN.merge_long(list(parts))


def test_a_long_word_takes_time_in_proportion():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(n)) for n in (20_000, 160_000)]
    took = []
    for word in words:
        began = time.process_time()
        OWN.merge_long([OWN.bytes[b] for b in word.encode()])
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_ids_outside_the_vocabulary_and_broken_bytes():
    broken = LIBRARY.encode("漢", add_special_tokens=False).ids[:1]
    for ids in ([999_999], broken, [*broken, 64]):
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_arrays_and_packed_ids(spark):
    rows = [(1, "one two", 5), (None, "<|endoftext|>", 6), (3, None, 7), (3, "", 8), (4, "x " * 30_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for packed in (False, True):
        found = bpe.encode(docs, packed=packed)
        got = [(r["id"], np.frombuffer(r["ids"], "<u4").tolist() if packed else r["ids"]) for r in found.collect()]
        assert got == [(i, LIBRARY.encode(text or "", add_special_tokens=False).ids) for i, text, _ in rows]
        assert [tuple(r) for r in bpe.decode(found).collect()] == [(i, text or "") for i, text, _ in rows]
    assert bpe.encode(docs.limit(0)).collect() == []


def test_query_over_the_whole_table(spark, sf_dir):
    got = {tuple(r) for r in queries.op12_bpe(spark, sf_dir).collect()}
    want = set()
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
