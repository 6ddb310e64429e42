"""All queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisect.plans import citations, graded, quotations, ranking, relational, reports, rules, spans, state, textual, widened, written
from verisect.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "PLANS", "QUERIES", "flagship"]

PLANS = (relational, ranking, textual, citations, quotations, spans, rules, reports, state, written, graded, widened)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents, by language and source, that hold a run of twelve words of a reference passage."""
    return QUERIES["q13_gold_equivalent_by_source"](spark, sf_dir)
