"""Every query with an SQL oracle gives the oracle's rows."""

import math
import os

import pytest

from verisect.plans import registry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def listed(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([plain(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    got = listed(df.collect(), df.columns)
    answer = duck.execute(registry.ORACLES[name])
    want = listed(answer.fetchall(), [d[0] for d in answer.description])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert want[1], "the oracle has no rows"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
