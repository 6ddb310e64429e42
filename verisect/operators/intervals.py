"""Joins of spans along a text: pairs of rows whose half-open intervals [start, end) meet.

Each span is dealt to the bins that it covers, so spans meet by equality of text and bin and not as the product of a text's
rows; a pair that shares several bins is told in the first of them only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], span: tuple[str, str] = ("start", "end"), other: tuple[str, str] = ("start", "end"), width: int = 256) -> DataFrame:
    """Pairs of equal keys whose spans share a place, each once: left's columns and right's as the struct `met`.

    An empty span counts as the place it stands at.  Rows with a null bound meet nothing.
    """
    held = [c for c in right.columns if c not in keys]

    def binned(df: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.col(end) - 1, F.col(start))
        floor = lambda place: F.floor(place / width)
        spread = df.withColumns({"_s": F.col(start), "_e": last + 1}).where(F.col("_s").isNotNull() & F.col(end).isNotNull())
        return spread.withColumn("_bin", F.explode(F.sequence(floor(F.col(start)), floor(last))))

    a = binned(left, *span)
    b = binned(right.select(*keys, F.struct(*held).alias("met"), F.col(other[0]).alias("_from"), F.col(other[1]).alias("_to")), "_from", "_to")
    b = b.select(*keys, "met", "_bin", F.col("_s").alias("_s2"), F.col("_e").alias("_e2"))
    met = a.join(b, [*keys, "_bin"]).where("_s < _e2 AND _s2 < _e").where(F.col("_bin") == F.floor(F.greatest("_s", "_s2") / width))
    return met.drop("_bin", "_s", "_e", "_s2", "_e2")
