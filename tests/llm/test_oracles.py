"""The contract's queries that SQL can express, against DuckDB; and the columns that the contract asks for."""

import pytest

from tests.test_oracle import listed
from verisect.llm import queries

DIR = "/root/testdata/sf0.01"
COLUMNS = {
    2: "doc_id held_out score predicted",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    4: "doc_id held_out n_tokens n_known train_tokens base_score score",
    5: "page_id payload_bytes payload_digest record_type refers_to",
    6: "doc_id held_out score predicted",
    7: "doc_id n_words n_hit n_items items_sha256 contaminated",
    8: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    9: "doc_id held_out lang_pred score",
    10: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "item_id rank doc_id score",
    12: "doc_id n_tokens ids_sha256 decoded_sha256",
    13: "file_no n_rows n_erased cents rewritten table_name ids_sha256 columns path",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    df = queries.QUERIES[name](spark, DIR)
    answer = con.execute(queries.ORACLES[name])
    assert listed(df.collect(), df.columns) == listed(answer.fetchall(), [d[0] for d in answer.description])


def test_one_query_per_operator_with_the_contract_columns(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    for name, run in queries.QUERIES.items():
        wanted = COLUMNS.get(int(name[2:].split("_")[0]), "doc_id class_id").split()
        columns = run(spark, "/root/testdata/sf0.001").columns
        assert set(wanted) <= set(columns) and len(columns) == len(set(columns))
