"""Aggregations of evaluation results: micro-averaged rates, guarded means, intervals, order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micro_rate(numerator: str | Column, denominator: str | Column) -> Column:
    """sum / sum over all rows of a group; null where the denominator is 0."""
    return F.sum(as_column(numerator)).cast("double") / F.nullif(F.sum(as_column(denominator)).cast("double"), F.lit(0.0))


def flag_mean(flag: str | Column) -> Column:
    """Mean of a 0/1 flag over all rows; a missing flag counts as 0."""
    return F.sum(F.coalesce(as_column(flag), F.lit(0))).cast("double") / F.count(F.lit(1))


def guarded_mean(value: str | Column) -> Column:
    """Mean over all rows; null unless every row has the value."""
    c = as_column(value)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c).cast("double") / F.count(F.lit(1)))


def filtered_mean(value: str | Column, keep: Column) -> Column:
    """Mean over the rows that satisfy `keep`, a missing value counting as 0; null for none."""
    return F.avg(F.when(keep, F.coalesce(as_column(value).cast("double"), F.lit(0.0))))


def list_total(items: str | Column, guarded: bool = False) -> Column:
    """Sum of array lengths; a null array counts as 0, or, guarded, makes the sum null."""
    n = F.size(as_column(items))
    total = F.coalesce(F.sum(F.when(as_column(items).isNotNull(), n)), F.lit(0)).cast("long")
    return F.when(F.count(as_column(items)) == F.count(F.lit(1)), total) if guarded else total


def run_facts(answers: DataFrame, *keys: str, error: Column, cost: Column, latency: Column, calls: Column) -> DataFrame:
    """Answers, errors, total cost, mean latency and mean tool calls of each run."""
    n = F.count(F.lit(1))
    return answers.groupBy(*keys).agg(
        n.alias("answers"),
        F.count_if(error).alias("errors"),
        F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"),
        (F.sum(F.coalesce(latency, F.lit(0.0))) / n).alias("latency"),
        (F.sum(F.coalesce(calls, F.lit(0))).cast("double") / n).alias("tools"),
    )


def all_of(condition: Column) -> Column:
    return F.bool_and(condition)


def any_of(condition: Column) -> Column:
    return F.bool_or(condition)


def first_present(value: str | Column, order: str | Column) -> Column:
    """The first non-null value in the group's order."""
    c = as_column(value)
    return F.min_by(c, F.when(c.isNotNull(), as_column(order)))


def frequency_map(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """keys, and a map from kind to its count. Counts are aggregated before the map, which holds one entry a kind."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def precision_recall(found: Column, gold: Column, tp: Column, pred: Column) -> tuple[Column, Column, Column]:
    """Precision over predictions, recall over gold spans, and F1; each 0 where its denominator is 0."""
    r, p = ratio(found, gold), ratio(tp, pred)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96, clip: bool = False) -> tuple[Column, Column]:
    """The Wilson score interval. n = 0 gives NaN, or with `clip` 0 and 0; `clip` also keeps the bounds in [0, 1]."""
    k, n = k.cast("double"), n.cast("double")
    some = F.nullif(n, F.lit(0.0))
    p, scale = k / some, 1 + z * z / some
    centre = p + z * z / (2 * some)
    half = z * F.sqrt(p * (1 - p) / some + z * z / (4 * some * some))
    empty = F.lit(0.0 if clip else float("nan"))
    low, high = (centre - half) / scale, (centre + half) / scale
    if clip:
        low, high = (F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) for x in (low, high))
    return F.coalesce(low, empty), F.coalesce(high, empty)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, **ranks) -> DataFrame:
    """keys, n, and for each name the value at the 0-based rank that ranks[name](n) gives.

    Values are counted first, so a group costs its distinct values, however many rows it has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    placed = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
    pick = [F.min(F.when(F.col("upto") > rank(F.col("n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *pick)


def nearest_rank(p: float):
    """round(p * (n - 1)), halves to even."""
    return lambda n: F.bround(F.lit(p) * (n - 1), 0).cast("long")


def floor_rank(p: float):
    """floor(p * n), at most n - 1."""
    return lambda n: F.least(n - 1, F.floor(F.lit(p) * n))


def upper_median(n: Column) -> Column:
    """The upper of the two middles."""
    return F.floor(n / 2)


def class_table(graded: DataFrame, kind: str = "class", passed: str = "passed", control: str = "control") -> DataFrame:
    """Rows per class, `traps` (all classes but the control), the control, and `total`: n, passed, missed.

    One pass over grouping sets; the sub-total comes from a second, coarser key.
    """
    keyed = graded.select(F.when(F.col(kind) == control, F.lit("control")).otherwise(F.lit("traps")).alias("part"), F.col(kind).alias("kind"), F.col(passed).cast("int").alias("ok"))
    rolled = keyed.rollup("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").cast("long").alias("passed"), F.grouping_id().alias("level"))
    name = F.when(F.col("level") == 3, F.lit("total")).when(F.col("level") == 1, F.col("part")).otherwise(F.col("kind"))
    # The control's own row and its sub-total are the same row.
    rows = rolled.where(~((F.col("level") == 0) & (F.col("part") == "control")))
    return rows.select(name.alias("row"), F.col("level").cast("int").alias("level"), "n", "passed", (F.col("n") - F.col("passed")).alias("missed"))


def latest_per_id(log: DataFrame, key: str, order: Column, tombstone: Column) -> DataFrame:
    """The last row of each id in an append-only log; ids whose last row is a tombstone are gone."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest, tombstone.alias("_gone")), order).alias("r"))
    return last.where(~F.coalesce(F.col("r._gone"), F.lit(False))).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def verdict_precision(df: DataFrame, *keys: str, verdict: str = "verdict") -> DataFrame:
    """Counts of right, wrong, unsure and missing verdicts, precision and its Wilson interval."""
    v = F.col(verdict)
    counts = df.groupBy(*keys).agg(*(F.count_if(v == x).alias(x) for x in ("right", "wrong", "unsure")), F.count_if(v.isNull()).alias("todo"))
    n = F.col("right") + F.col("wrong")
    low, high = wilson(F.col("right"), n, clip=True)
    return counts.withColumns({"precision": F.col("right").cast("double") / F.nullif(n, F.lit(0)), "low": low, "high": high})


def multiset_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left rows that a right row takes away, and those that stay: each right row takes one equal left row, the first."""
    l_keys = Window.partitionBy(*keys).orderBy("ord")
    numbered = left.withColumn("nth", F.row_number().over(l_keys))
    takes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("takes"))
    met = numbered.join(takes, list(keys), "left")
    taken = F.col("nth") <= F.coalesce("takes", F.lit(0))
    return met.where(taken).drop("nth", "takes"), met.where(~taken).drop("nth", "takes")
