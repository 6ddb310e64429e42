"""Ranking, quotas and samples.

Every draw is decided by an arithmetic hash of the row's id and the seed, so it doesn't depend on partitions, and any SQL
engine can repeat it.  Ranks are taken within strata; `row_number() <= k` lets each task drop what can't be in the top k
before the shuffle, so a stratum's size is no limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.operators.joins import small
from verisect.sources.tables import stored

# Multipliers of a key's low and high part, and modulus of the draw.
MULTIPLIER, HIGH, MODULUS = 2654435761, 2246822519, 4294967296


def draw(key: str | Column, seed: int = 0) -> Column:
    """A number from 0 to 2**32 - 1 for an integer key; what exceeds 2**30 in it is mixed in by itself."""
    k = (F.col(key) if isinstance(key, str) else key) + F.lit(seed)
    low, high = F.pmod(k, F.lit(MODULUS // 4)), F.pmod(F.floor(k / F.lit(MODULUS // 4)), F.lit(MODULUS // 4))
    return F.pmod(F.pmod(low * F.lit(MULTIPLIER), F.lit(MODULUS)) + F.pmod(high * F.lit(HIGH), F.lit(MODULUS)), F.lit(MODULUS))


def best_per_group(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def spread_top(df: DataFrame, stratum: Sequence[str], spread: Sequence[str], k: int, *order: Column) -> DataFrame:
    """Up to k rows per stratum: first one of each distinct spread key, then the rest, both in the given order; with `pick` from 1."""
    inner = Window.partitionBy(*stratum, *spread).orderBy(*order)
    outer = Window.partitionBy(*stratum).orderBy(F.col("_again"), *order)
    # Rows beyond the k-th of their spread key can't be chosen.
    first = df.withColumn("_nth", F.row_number().over(inner)).where(F.col("_nth") <= k).withColumn("_again", F.col("_nth") > 1)
    return first.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= k).drop("_nth", "_again")


def quota(df: DataFrame, stratum: str, quotas: DataFrame, size: str, *order: Column) -> DataFrame:
    """All rows of strata with a quota, and `chosen`: whether the row is among the first `size` of its stratum."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.join(small(quotas), stratum).withColumn("_rank", F.row_number().over(w)).withColumn("chosen", F.col("_rank") <= F.col(size)).drop("_rank")


def round_robin(df: DataFrame, groups: Sequence[str], *order: Column) -> DataFrame:
    """With `turn`: the rows' place when the groups take turns; order by (turn, group)."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def alternate(df: DataFrame, labels: Sequence[str], name: str, stratum: Sequence[str], *order: Column) -> DataFrame:
    """Labels in turn along each stratum."""
    at = F.pmod(F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)) - 1, F.lit(len(labels)))
    return df.withColumn(name, F.element_at(F.array(*(F.lit(x) for x in labels)), at + 1))


def ranges_for(df: DataFrame) -> int:
    """Ranges of some 64 MB for what the plan expects of the rows."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(64, size >> 26), 1_000_000)


def numbered(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """With `place`: the row's 0-based place in the whole order, without bringing all rows to one task.

    Rows are dealt into ranges, as many as their size asks for, and numbered within them; only the ranges' counts are
    summed in one place.  The numbered rows are written once, since the ranges of another run could differ.
    """
    parts = parts or ranges_for(df)
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    local = stored(dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "numbered")
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # At most `parts` rows are broadcast.
    return local.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def sequential_ids(df: DataFrame, name: str, pattern: str, *order: Column) -> DataFrame:
    """Ids like q0001 in the given order."""
    return numbered(df, *order).withColumn(name, F.format_string(pattern, F.col("place") + 1)).drop("place")


def systematic(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The rows at places int(i * rows / n) for i below n; all rows if there are no more than n."""
    placed = numbered(df, *order)
    rows = placed.count()
    if rows <= n:
        return placed.drop("place")
    # Each row tells by itself whether some i leads to it: only those around place / step can.
    step = rows / n
    near = F.floor(F.col("place") / F.lit(step))
    hit = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < n) & (F.floor(i * F.lit(step)) == F.col("place")))
    return placed.where(hit).drop("place")


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """`total` rows in proportion to the strata: rounded quotas, the drift on the largest stratum, rows by draw."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    rounded = sizes.withColumn("_q", F.bround(F.col("_n") * F.lit(total) / F.sum("_n").over(Window.partitionBy()), 0).cast("long"))
    largest = Window.partitionBy().orderBy(F.desc("_n"), stratum)
    drift = F.lit(total) - F.sum("_q").over(Window.partitionBy())
    quotas = rounded.withColumn("_q", F.col("_q") + F.when(F.row_number().over(largest) == 1, drift).otherwise(0)).select(stratum, "_q")
    return quota(df, stratum, quotas, "_q", draw(key, seed), F.col(key)).where("chosen").drop("chosen", "_q")


def bad_share(df: DataFrame, stratum: str, bad: str, n: int, share: float, *order: Column) -> DataFrame:
    """n rows a stratum: round(n * share) bad ones first, as far as there are, the rest good ones."""
    limit = round(n * share)
    w = Window.partitionBy(stratum, bad).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    have = ranked.where(F.col(bad)).groupBy(stratum).agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("_bad"))
    room = F.when(F.col(bad), F.lit(limit)).otherwise(F.lit(n) - F.coalesce("_bad", F.lit(0)))
    return ranked.join(have, stratum, "left").where(F.col("_rank") <= room).drop("_rank", "_bad")


def largest_remainder(weights: Mapping[str, float], pools: Mapping[str, int], total: int) -> dict[str, int]:
    """`total` shared in proportion to the weights, nowhere more than the pool: whole parts first, then the largest remainders, again for what capped pools leave.

    Works on a run table of a few dozen rows on the driver.
    """
    share = dict.fromkeys(weights, 0)
    open_ = [r for r in weights if pools.get(r, 0) > 0]
    left = total
    while left > 0 and open_:
        whole = sum(weights[r] for r in open_)
        if not whole:
            break
        exact = {r: left * weights[r] / whole for r in open_}
        for r in open_:
            part = min(int(exact[r]), pools[r] - share[r])
            share[r] += part
            left -= part
        for r in sorted(open_, key=lambda r: int(exact[r]) - exact[r]):
            if left > 0 and share[r] < pools[r]:
                share[r] += 1
                left -= 1
        open_ = [r for r in open_ if share[r] < pools[r]]
    return share


def similar_pairs(rows: DataFrame, key: str, tokens: str, limit: float) -> DataFrame:
    """(a, b), a < b, of rows whose distinct tokens overlap by the Jaccard share `limit` or more, by an exact prefix join.

    Tokens are ordered from rare to common.  The first token that two rows share stands, in both, where enough tokens are
    left for the overlap they need; so only the rare front of each row is joined.
    """
    flat = rows.select(F.col(key).alias("_k"), F.explode(F.array_distinct(tokens)).alias("_t"))
    often = flat.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    sets = flat.join(often, "_t").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_s"))
    sets = sets.select("_k", F.transform("_s", lambda x: x["_t"]).alias("_s"), F.size("_s").alias("_size"))
    front = sets.select("_k", "_size", F.posexplode(F.slice("_s", F.lit(1), (F.col("_size") - F.ceil(F.col("_size") * limit - 1e-9) + 1).cast("int"))).alias("_at", "_t"))
    x, y = front.alias("x"), front.alias("y")
    room = F.least(F.col("x._size") - F.col("x._at"), F.col("y._size") - F.col("y._at"))
    fits = room * (1 + limit) >= (F.col("x._size") + F.col("y._size")) * limit - 1e-6
    met = x.join(y, (F.col("x._t") == F.col("y._t")) & (F.col("x._k") < F.col("y._k")) & fits).select(F.col("x._k").alias("a"), F.col("y._k").alias("b")).distinct()
    whole = sets.select("_k", "_s")
    both = met.join(whole.toDF("a", "_x"), "a").join(whole.toDF("b", "_y"), "b").withColumn("_both", F.size(F.array_intersect("_x", "_y")))
    return both.where(F.col("_both") >= limit * (F.size("_x") + F.size("_y") - F.col("_both")) - 1e-9).select("a", "b")


def first_of_similar(rows: DataFrame, key: str, tokens: str, limit: float = 0.5) -> DataFrame:
    """The rows that a greedy pass in the order of the key keeps: it drops a row that overlaps a kept one by `limit` or more.

    Rows without a similar row before them are kept, those next to them go, and what is left is looked at again, so the
    pass takes as many rounds as its longest chain of decisions, not one step a row.
    """
    left, gone = stored(similar_pairs(rows, key, tokens, limit), "greedy"), None
    while left.head(1):
        kept = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = stored(left.join(kept, "a", "left_semi").select(F.col("b").alias("_gone")).distinct(), "greedy")
        gone = now if gone is None else gone.unionByName(now)
        left = stored(left.join(now, F.col("a") == F.col("_gone"), "left_anti").join(now, F.col("b") == F.col("_gone"), "left_anti"), "greedy")
    return rows if gone is None else rows.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def widening_draw(pool: DataFrame, key: str, tokens: str, n: int, multiple: int, rank: str, seed: int = 0, taken: DataFrame | None = None) -> DataFrame:
    """n rows drawn from the top n * multiple of a ranked pool, without near-copies, the top doubling while it doesn't do: key and `pick` from 1.

    A row is tried when the top first reaches it, and within that step by its draw, so all steps are stretches of one
    order.  A greedy choice only depends on what came before it: it is made on the first rows of the order, twice as many
    each time, until n are chosen.  taken: tokens of rows that were chosen before and mustn't be come near to.
    """
    reached = F.greatest(F.ceil(F.log2(F.col(rank) / F.lit(n * multiple)) - 1e-12), F.lit(0))
    drawn = pool.select(key, F.col(tokens).alias("_tokens"), reached.alias("_step"), draw(F.col(rank), seed).alias("_d"))
    placed = numbered(drawn, F.col("_step"), F.col("_d"), F.col(key)).select(key, "_tokens", "place")
    before = None if taken is None else taken.select((-1 - F.monotonically_increasing_id()).alias("place"), F.col(tokens).alias("_tokens"))
    before = None if before is None else stored(before, "taken")
    rows, first = placed.count(), 2 * n
    while True:
        tried = placed.where(F.col("place") < first).select("place", "_tokens")
        kept = first_of_similar(tried if before is None else tried.unionByName(before), "place", "_tokens").where("place >= 0").select("place")
        chosen = stored(kept.orderBy("place").limit(n), "drawn")
        if first >= rows or chosen.count() >= n:
            break
        first *= 2
    return placed.join(chosen, "place").withColumn("pick", F.row_number().over(Window.orderBy("place"))).select(key, "pick")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, joined: Column) -> DataFrame:
    """With `island`: spans in order, of which each continues the one before it if `joined` holds; _prev_end is that one's end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    stepped = df.withColumn("_prev_end", F.lag(end).over(w))
    fresh = F.when(F.col("_prev_end").isNull() | ~joined, 1).otherwise(0)
    return stepped.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w)).drop("_new", "_prev_end")


def longest_common_run(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, run, start_a, start_b: the longest run of equal words of two word arrays, the first of the longest in a, then b."""
    from verisect.functions.udfs import longest_run

    return pairs.select(key, longest_run(a, b).alias("r")).select(key, "r.*").where("run > 0")
