"""Packing, archives and media: exact round trips and brute force."""

import hashlib
import heapq
import os
import random
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verisect.llm import common, media, packing, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", "Hello  world\n\nagain", "a\x1cb \x85c İstanbul ΟΔΟΣ", "word " * 30_000, "<|endoftext|> x", "same", "same"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 5), max_size=7), st.integers(0, 60))
def test_fill_is_the_closest_multiset(counts, room):
    chosen = packing.fill(counts, room)
    assert all(0 < c <= counts[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == best_sum(counts, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_places_every_rank_once(histogram):
    rows, sequences = packing.plan(histogram, 64)
    cells, ranks = set(), Counter()
    for length, first, n, copies, sequence, offset in rows:
        for r in range(n):
            ranks[length, first + r] += 1
            for x in range(length):
                cell = (sequence + r // copies, offset + r % copies * length + x)
                assert cell not in cells and cell[1] < 64
                cells.add(cell)
    assert ranks == Counter({(n, r): 1 for n, c in histogram.items() for r in range(c)})
    assert {s for s, _ in cells} == set(range(sequences))


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_round_trip(spark):
    check_packing(packing.packing_report(docs(spark, TEXTS)).collect(), TEXTS)


def test_packing_ignores_clashing_columns(spark):
    source = docs(spark, TEXTS[:4] * 2).selectExpr("*", "1 as id", "2 as start", "3 as part", "4 as nth", "5 as length", "6 as rank", "7 as base", "8 as sequence_id")
    check_packing(packing.packing_report(source).collect(), TEXTS[:4] * 2)


def test_packing_whole_table(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in source.orderBy("doc_id").collect()]
    packed = packing.packing_report(source)
    check_packing(packed.collect(), texts)
    assert packing.padding(packed.toPandas()) < 0.02
    assert packing.packing_report(source.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def check_captures(rows, source):
    first = {}
    for page_id, _, html in source:
        first[html or ""] = min(page_id, first.get(html or "", page_id))
    assert Counter(r.page_id for r in rows) == Counter(p for p, _, _ in source)
    html = {p: h or "" for p, _, h in source}
    for r in rows:
        data = html[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == warc.digest(data) and len(r.payload_digest) == 32
        want = first[html[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if want == r.page_id else ("revisit", want))


def test_archives_round_trip(spark, sf_dir):
    rows = [(5, "http://www.a.org/x?y=1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "bad url", None), (7, "https://b.a.org", ""), (8, "http://[", "z" * 300_000), (8, "http://[", "z" * 300_000)]
    check_captures(warc.capture_report(pages(spark, rows)).collect(), rows)
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    check_captures(warc.capture_report(table).collect(), [tuple(r) for r in table.select("page_id", "url", "html").collect()])
    assert warc.capture_report(table.limit(0)).count() == 0


def test_ids_of_other_types_nulls_repeats_and_clashing_columns(spark):
    rows = [("b/1 é", "http://a.org", "x"), ("a", "http://a.org", "x"), (None, "http://a.org", "x"), ("a", "http://a.org", "x"), ("c", None, None), (None, None, "y")]
    source = spark.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", "1 as sha", "2 as first", "3 as archive", "4 as at", "5 as n", "6 as part")
    got = warc.capture_report(source).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([("b/1 é", "revisit", "a"), ("a", "response", None), ("a", "response", None), (None, "revisit", "a"), ("c", "response", None), (None, "response", None)], key=str)


def test_reading_takes_time_in_proportion():
    one = warc.member(warc.record("1", "http://a.org", random.Random(1).randbytes(3_000), "A" * 32, None))
    took = []
    for n in (1_000, 8_000):
        began = time.process_time()
        assert sum(1 for _ in warc.records(one * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 0.2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(one[:-20]))


def test_many_ranges_give_one_history(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 50)
    rows = [(k * 7 % 501, f"http://s{k % 7}.org/{k % 3}?q={k % 2}#f", f"page {k % 11}") for k in range(501)]
    got = warc.capture_report(pages(spark, rows)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(501))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and {r.page_id for r in got} == set(range(501))
    check_captures(got, rows)


def test_small_payloads_stay_responses(spark):
    index = warc.read_archives(warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3, max_archive=1))
    assert {r.page_id: r.record_type for r in index.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert index.select("archive").distinct().count() == 4


def test_history_is_in_global_order(spark):
    rows = [(k, f"http://s{k % 7}.org/{k % 3}", f"page {k % 11}") for k in range(500)]
    archives = warc.write_archives(pages(spark, rows).repartition(5), max_archive=2_000)
    assert archives.count() > 5
    got = [(r.url_key, r.captured, r.page_id) for r in warc.merge_indexes(warc.read_archives(archives)).collect()]
    assert got == sorted(got) and len(got) == 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9))), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    merged = [runs[r][p] for r, p in warc.LoserTree(runs)]
    assert merged == list(heapq.merge(*runs))


@given(st.binary(max_size=2_000))
def test_images_are_lossless(data):
    assert media.samples(media.png(media.pad(data))) == media.pad(data)
    assert len(media.pad(data)) % 192 == 0 and media.pad(data)


def test_media_round_trip(spark, sf_dir):
    table = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    texts = [*TEXTS, *table]
    rows = {r.doc_id: r for r in media.media_report(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        payload = media.pad((text or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.png(payload)).hexdigest() and r.media_bytes == len(media.png(payload))
    assert media.media_report(docs(spark, TEXTS).limit(0)).count() == 0


def test_captions_are_whole_lines_and_hot_media_are_spread(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_SHARE", 0.1)
    line = "a <long> & \"quoted\" line " * 40
    texts = [line + "\nsecond", "one", *["copy"] * 60, None, "", " two  spaces "]
    source = docs(spark, texts).selectExpr("*", "1 as html", "2 as digest", "3 as media", "4 as id", "5 as payload_bytes").repartition(3)
    rows = media.media_report(source).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        want = " ".join((texts[r.doc_id] or "").split("\n")[0].split())
        assert (r.caption or "") == want and r.pos == 1
        assert r.media_sha256 == hashlib.sha256(media.png(media.pad((texts[r.doc_id] or "").encode()))).hexdigest()
    store = spark.createDataFrame([("d", "x")], "digest string, text string")
    with pytest.raises(ValueError, match="named like"):
        media.resolve(media.parse_pages(pages(spark, [(1, "u", "x")])), store, "id")


def test_interleaved_sequences_keep_positions_and_captions(spark):
    first, second = (hashlib.sha256(x).hexdigest() for x in (b"1", b"2"))
    page = f"""<title>T</title><script>no</script><p>One <b>bold</b></p><figure><img src="media:{first}" alt="alt"><figcaption>Cap &amp; more</figcaption></figure>
      two<img src="http://x/y.png"><div>three</div><img src="media:{second}" alt="only alt">"""
    store = spark.createDataFrame([(first, b"1"), ("unused", b"3")], "digest string, payload binary")
    source = pages(spark, [(1, "u", page), (2, "u", None), (3, "u", "<p>plain"), (1, "u", page)]).selectExpr("page_id", "html", "'clash' as sequence")
    parsed = media.parse_pages(source)
    got = [r.sequence for r in parsed.where("id = 1").collect()]
    assert got[0] == got[1] and len(got) == 2
    listed = [(i.kind, i.text or i.ref[:6], i.caption) for i in got[0]]
    assert listed == [("text", "T", None), ("text", "One bold", None), ("media", "media:", "Cap & more"), ("text", "two", None), ("media", "http:/", None), ("text", "three", None), ("media", "media:", "only alt")]
    whole = media.assemble(media.resolve(parsed.dropDuplicates(["id"]), store, "id"), "id").collect()
    items = next(r.sequence for r in whole if r.id == 1)
    assert [i.pos for i in items] == list(range(7))
    assert [bytes(i.payload) if i.payload else None for i in items] == [None, None, b"1", None, None, None, None]


def test_cleanup_deletes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(common, "WRITTEN", [])
    kept = common.materialize(spark.range(3), "kept")
    assert kept.count() == 3 and len(common.WRITTEN) == 1
    path = common.WRITTEN[0].removeprefix("file://")
    assert os.path.isdir(path)
    common.cleanup(spark)
    assert not os.path.exists(path) and not common.WRITTEN


def test_encoder_agrees_with_the_tokenizer_on_noise():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    rng = random.Random(5)
    alphabet = "abcXYZ  \n\t\x1c\x85 ́é'sΣςİß1234.,|%"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) + rng.choice(["", "word<|endoftext|>", "<|ENDOFTEXT|>", "Straße!!", "É.", "don't"])
        want = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert encode(text.encode()) == b"".join(x.to_bytes(4, "little") for x in want), repr(text)
