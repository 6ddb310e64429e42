"""How queries are registered, and literal rows that Spark and the oracles share.

A query is registered under a name that opens with the identifier of the operator it exercises (a1_, j11_, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, t) -> DataFrame, where t("orders") reads a driver table; sql is its oracle."""

    def add(f: Callable) -> Callable:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


class Fixture:
    """Literal rows that Spark and the oracle share, for inputs that the driver tables don't have."""

    def __init__(self, name: str, schema: str, rows: Sequence[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def cte(self) -> str:
        """`name(columns) AS (VALUES ...)` with the columns cast to their types."""
        fields = [f.strip().rsplit(" ", 1) for f in self.schema.split(",")]
        kinds = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        body = ", ".join("(" + ", ".join(self._literal(v) for v in row) + ")" for row in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {body}) AS raw({', '.join(n for n, _ in fields)}))"

    @staticmethod
    def _literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return repr(value)


def expect(schema: str, *rows: tuple) -> str:
    """An oracle that states the expected rows."""
    return f"WITH {Fixture('expected', schema, rows).cte()} SELECT * FROM expected"
