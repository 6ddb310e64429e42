"""Cascading erasure against a plain version that sorts, cuts and filters lists."""

import datetime
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest

from verisect.llm import erasure, queries

NAMES = ("clients", "clicks", "sales", "sale_lines")
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def brute(tables, share, files):
    """tables: name -> (columns, rows). Yields (name, file_no, columns, survivors, erased)."""
    at = {n: {c: k for k, c in enumerate(columns)} for n, (columns, _) in tables.items()}
    get = lambda n, row, c: row[at[n][c]]
    clients, clicks, sales = (tables[n][1] for n in ("clients", "clicks", "sales"))
    owners = {(get("clients", r, "client_id"), get("clients", r, "master_id")) for r in clients if get("clients", r, "master_id") is not None}
    n_clicks = {}
    for r in clicks:
        c = get("clicks", r, "client_id")
        n_clicks[c] = n_clicks.get(c, 0) + 1
    per_master = {}
    for c, m in owners:
        per_master[m] = per_master.get(m, 0) + (n_clicks.get(c, 0) if c is not None else 0)
    masters = {m for m in per_master if crc(m) % share == 0} | set(sorted(per_master, key=lambda m: (-per_master[m], m))[:1])
    ids = {c for c, m in owners if m in masters and c is not None}
    sold = {get("sales", r, "sale_id") for r in sales if get("sales", r, "client_id") in ids} - {None}
    sale = {}
    for r in sales:
        s, c = get("sales", r, "sale_id"), get("sales", r, "client_id")
        if c is not None:
            sale[s] = min(c, sale.get(s, c))
    gone = {
        "clients": lambda r: get("clients", r, "client_id") in ids or get("clients", r, "master_id") in masters,
        "clicks": lambda r: get("clicks", r, "client_id") in ids,
        "sales": lambda r: get("sales", r, "client_id") in ids,
        "sale_lines": lambda r: get("sale_lines", r, "sale_id") in sold,
    }
    whose = {n: (lambda r, n=n: get(n, r, "client_id")) for n in NAMES[:3]}
    whose["sale_lines"] = lambda r: None if get("sale_lines", r, "sale_id") is None else sale.get(get("sale_lines", r, "sale_id"))
    for n, (columns, rows) in tables.items():
        rows = sorted(rows, key=lambda r: (crc(whose[n](r)), [(x is not None, x if x is not None else 0) for x in r]))
        size = 1 + len(rows) // files
        for k, start in enumerate(range(0, len(rows), size)):
            held = rows[start : start + size]
            left = [r for r in held if not gone[n](r)]
            if left:
                yield n, k, columns, left, len(held) - len(left)


def check(got, tables, share, files):
    want = {(n, k): (columns, left, erased) for n, k, columns, left, erased in brute(tables, share, files)}
    assert {(r["table_name"], r["file_no"]) for r in got} == set(want)
    folders = set()
    for r in got:
        columns, left, erased = want[r["table_name"], r["file_no"]]
        money = columns.index(MONEY[r["table_name"]])
        assert (r["n_rows"], r["n_erased"], r["rewritten"]) == (len(left), erased, erased > 0)
        assert r["columns"] == ",".join(columns)
        assert r["cents"] == sum(math.floor(100 * x[money] + 0.5) for x in left if x[money] is not None)
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in left).encode()).hexdigest()
        path = r["path"].removeprefix("file://")
        file = pq.ParquetFile(path)
        assert [tuple(x.values()) for x in file.read().to_pylist()] == left
        for g in range(file.metadata.num_row_groups):
            for c in range(len(columns)):
                stats, values = file.metadata.row_group(g).column(c).statistics, [x[c] for x in left if x[c] is not None]
                if stats.has_min_max and file.metadata.num_row_groups == 1:
                    assert (stats.min, stats.max) == (min(values), max(values))
        folders.add(os.path.dirname(os.path.dirname(path)))
    assert len(folders) <= 1
    for folder in folders:  # no other data files
        there = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_"))}
        assert there == {r["path"].removeprefix("file://") for r in got}


def plain(frames):
    return {n: (df.columns, [tuple(r) for r in df.collect()]) for n, df in frames.items()}


def test_query_over_the_whole_tables(spark, sf_dir):
    got = queries.op13_erasure(spark, sf_dir).collect()
    assert len({r["path"] for r in got}) == len(got) and any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    check(got, plain({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES}), 400, 350)


T = datetime.datetime(1700, 1, 2, 3, 4, 5, 678901)
BIG = 9_007_199_254_740_993  # no double holds it


def awkward(spark):
    """Nulls in all columns, ids that doubles can't hold, repeated rows and sales, extra columns of clashing names."""
    clients = [(1, 7, 1.005, "a", T), (2, 7, None, "b", None), (BIG, 8, -2.5, None, T), (BIG + 1, None, 3.0, "", T), (None, 7, 1.0, "x", T), (5, 9, 2.0, "é" * 100_000, T), (6, 10, 0.0, "q", T), (6, 10, 0.0, "q", T), (None, None, None, None, None)]
    clicks = [(k, [1, 2, None, BIG, BIG + 1, 5, 77][k % 7], k / 8, [None, k][k % 2]) for k in range(40)] + [(3, None, None, None)] * 3
    sales = [(1, 1, 1.5, True), (1, 5, 1.5, True), (2, BIG, None, None), (3, BIG + 1, 0.125, False), (None, 1, 2.0, False), (4, None, 1.0, True), (5, 6, 1.0, True)]
    lines = [([1, 2, 3, 4, None, 99, 5][k % 7], [None, k][k % 3 > 0], k * 0.01, b"\xff\x00", datetime.date(2024, 1, 1 + k % 28)) for k in range(30)]
    return {
        "clients": spark.createDataFrame(clients, "client_id long, master_id long, balance double, rank string, place timestamp_ntz"),
        "clicks": spark.createDataFrame(clicks, "click_id long, client_id long, value double, file_no int"),
        "sales": spark.createDataFrame(sales, "sale_id long, client_id long, total double, first boolean"),
        "sale_lines": spark.createDataFrame(lines, "sale_id long, client_id long, amount double, c0 binary, chunk date"),
    }


@pytest.mark.parametrize("share, files, chunk", [(2, 4, 2), (1, 3, 100), (10**9, 40, 3)])
def test_awkward_rows(spark, monkeypatch, share, files, chunk):
    monkeypatch.setattr(erasure, "CHUNK", chunk)
    frames = awkward(spark)
    check(erasure.erase_masters(*(frames[n] for n in NAMES), share=share, files=files).collect(), plain(frames), share, files)


def test_no_rows_and_no_masters(spark):
    frames = {n: df.limit(0) for n, df in awkward(spark).items()}
    assert erasure.erase_masters(*(frames[n] for n in NAMES)).collect() == []
    frames = awkward(spark)
    frames["clients"] = frames["clients"].where("master_id is null")
    got = erasure.erase_masters(*(frames[n] for n in NAMES)).collect()
    assert not any(r["rewritten"] for r in got)
    check(got, plain(frames), 400, 350)


def test_a_second_run_writes_a_folder_of_its_own(spark):
    frames = awkward(spark)
    a, b = (erasure.erase_masters(*(frames[n] for n in NAMES), share=2).collect() for _ in range(2))
    assert not {r["path"] for r in a} & {r["path"] for r in b}
    assert sorted(r["ids_sha256"] for r in a) == sorted(r["ids_sha256"] for r in b)
