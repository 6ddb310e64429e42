"""Joins, rule chains and set operations of the evaluation pipelines.

Names of work columns open with an underscore; callers' columns keep theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a side that a caller calls small is broadcast; above, the join is shuffled.
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, or as there are cores: a scan makes one of each row group, however dear a row is."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: what texts and nested values are long, and eight for each other column."""

    def one(field) -> Column:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            return F.octet_length(F.col(f"`{field.name}`"))
        return F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))) if kind in ("array", "map", "struct") else F.lit(8)

    return reduce(lambda a, b: a + b, (F.coalesce(one(f), F.lit(0)) for f in df.schema.fields), F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = SMALL_ROWS, most: int = SMALL_BYTES) -> DataFrame:
    """With a broadcast hint if it has at most `rows` rows of together at most `most` bytes; looking stops right after that many rows."""
    n, size = df.limit(rows + 1).select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds, or null."""
    chain = None
    for name, condition in rules:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return F.lit(None).cast("string") if chain is None else chain


def year_fits(year: Column, low: Column, high: Column, slack: int) -> Column:
    """Whether the year lies in the band, widened by `slack`: no band passes, no year in a band fails."""
    return F.when(low.isNull() | high.isNull(), F.lit(True)).otherwise(F.coalesce(year.between(low - slack, high + slack), F.lit(False)))


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, 0 if none: how a text is ordered as a number."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def stems(word: Column) -> Column:
    """The word, and what is left without one, two or three last letters, or with -ed turned into -e."""
    cut = [F.substring(word, F.lit(1), F.length(word) - k) for k in (1, 2, 3)]
    past = F.when(word.endswith("ed"), F.concat(cut[1], F.lit("e"))).otherwise(word)
    return F.array(word, *cut, past)


def unknown_words(docs: DataFrame, key: str, text: str, dictionary: DataFrame, least: int = 3, known: Sequence[str] = ()) -> DataFrame:
    """Distinct (key, word) of words none of whose stems is in dictionary(word); words `known` count as they are, not by their stems."""
    found = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word")).distinct()
    if known:
        found = found.where(~F.col("word").isin(*known))
    # The dictionary is looked up once for each word of the corpus, not for each text that has it.
    vocabulary = found.select("word").distinct()
    stemmed = vocabulary.select("word", F.explode(stems(F.col("word"))).alias("_stem")).join(dictionary.select(F.col("word").alias("_stem")), "_stem", "left_semi").select("word")
    return found.join(stemmed, "word", "left_anti").select(key, "word")


def shares_token(a: Column, b: Column, generic: Sequence[str], least: int = 4) -> Column:
    """Whether two texts share a word of at least `least` letters that isn't generic."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.arrays_overlap(F.array_except(tokens(a), F.array(*(F.lit(g) for g in generic))), tokens(b))


def todo(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of `work` that aren't done yet."""
    return work.join(done, list(keys), "left_anti")


def with_default(rows: DataFrame, dimension: DataFrame, key: str, **defaults) -> DataFrame:
    """Left join of a dimension; its missing columns get the given defaults."""
    out = rows.join(small(dimension), key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def pair_arms(rows: DataFrame, keys: Sequence[str], arm: str, left: str, right: str, values: Sequence[str]) -> DataFrame:
    """One row per key that both arms have, with <value>_<arm> columns. One shuffle: the arms meet by aggregation."""
    of = lambda a, v: F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{v}_{a}")
    has = [F.bool_or(F.col(arm) == a).alias(f"_{k}") for k, a in enumerate((left, right))]
    return rows.where(F.col(arm).isin(left, right)).groupBy(*keys).agg(*has, *(of(a, v) for a in (left, right) for v in values)).where("_0 AND _1").drop("_0", "_1")


def interpolate(rows: DataFrame, at: str, anchors: DataFrame, x: str, y: str, name: str, most: int = 10_000) -> DataFrame:
    """Piecewise linear values between sorted anchors; rows outside of them have none and go.

    The anchors are a short rule table: their segments are broadcast, and more than `most` of them are an error.
    """
    order = Window.orderBy("_x0")
    if anchors.limit(most + 1).count() > most:
        raise ValueError(f"over {most} anchors: interpolate takes a short rule table")
    segments = anchors.select(F.col(x).alias("_x0"), F.col(y).alias("_y0")).withColumns({"_x1": F.lead("_x0").over(order), "_y1": F.lead("_y0").over(order)})
    met = rows.join(F.broadcast(segments), (F.col(at) >= F.col("_x0")) & (F.col(at) < F.col("_x1")))
    return met.withColumn(name, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(at) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))).drop("_x0", "_x1", "_y0", "_y1")


def band_median(rows: DataFrame, keys: Sequence[str], at: str, value: str, reach: int, least: int) -> DataFrame:
    """n and mid: the upper median of the values at most `reach` away in the same group, null for fewer than `least`. `at` is a whole number.

    Equal values are counted first, and each count goes to the 2 * reach + 1 places that it is near to; so a place costs
    its distinct values, however many rows it has.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(at).cast("long").alias("_at"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    near = counts.withColumn("_at", F.explode(F.sequence(F.col("_at") - reach, F.col("_at") + reach))).groupBy(*keys, "_at", "_v").agg(F.sum("_c").alias("_c"))
    place = Window.partitionBy(*keys, "_at")
    ranked = near.withColumns({"_upto": F.sum("_c").over(place.orderBy("_v")), "_n": F.sum("_c").over(place)})
    half = F.floor(F.col("_n") / 2)
    mids = ranked.groupBy(*keys, "_at").agg(F.max("_n").cast("int").alias("n"), F.min(F.when(F.col("_upto") > half, F.col("_v"))).alias("_mid"))
    out = rows.withColumn("_at", F.col(at).cast("long")).join(mids, [*keys, "_at"], "left").drop("_at")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "mid": F.when(F.col("n") >= least, F.col("_mid"))}).drop("_mid").select(*rows.columns, "n", "mid")


def nearest_before(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], at: str, anchor_at: str, reach: int, carry: Sequence[str]) -> DataFrame:
    """For each row the nearest anchor of the same keys strictly before it, at most `reach` away: delta and its columns.

    Rows and anchors are merged into one sorted stream a key, so a key costs its rows, never the product.
    """
    cells = lambda df, spot, kind, fields: df.select(*keys, F.col(spot).alias("_at"), F.lit(kind).alias("_kind"), F.struct(*fields).alias("_row") if fields else F.lit(None).alias("_row"))
    own = rows.columns
    left = cells(rows, at, 0, own)
    right = anchors.select(*keys, F.col(anchor_at).alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col(anchor_at).alias("_spot"), *carry).alias("_anchor"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Rows come before anchors of the same place, so that an anchor never serves its own place.
    before = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_last", F.last("_anchor", ignorenulls=True).over(before)).where("_kind = 0")
    delta = F.col("_at") - F.col("_last._spot")
    out = seen.select("_row.*", delta.alias("delta"), *(F.col(f"_last.{c}").alias(c) for c in carry))
    return out.where(F.col("delta") <= reach)


def holders(rows: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Each row with the number of rows that share its key and their smallest member. Aggregated first, so hot keys don't meet."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("holders"), F.min(member).alias("first_holder"))
    return rows.join(counts, list(keys))


def shared_members(rows: DataFrame, owner: str, keys: Sequence[str]) -> DataFrame:
    """(a, b, shared): pairs of owners, a < b, and how many keys they share; owners that share none don't pair up."""
    a, b = (rows.select(*keys, F.col(owner).alias(x)) for x in "ab")
    return a.join(b, list(keys)).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def first_twin(rows: DataFrame, owner: str, keys: Sequence[str]) -> DataFrame:
    """owner, twin, shared: of owners that share a key with another one, the smallest other and the number of shared keys.

    The two smallest owners of a key tell every owner's smallest other, so a key costs its rows however many own it.
    """
    held = rows.select(*keys, owner).distinct()
    first = held.groupBy(*keys).agg(F.min(owner).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = held.join(first, list(keys))
    second = met.where(F.col(owner) != F.col("_first")).groupBy(*keys).agg(F.min(owner).alias("_second"))
    other = F.when(F.col(owner) == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return met.join(second, list(keys)).groupBy(owner).agg(F.min(other).alias("twin"), F.count(F.lit(1)).alias("shared"))


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def union_first_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows, but of a key in several parts only that of the earliest part."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(n))
        out = p if out is None else out.unionByName(p)
    rest = [c for c in out.columns if c not in (key, "_src")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "_src").alias("_r")).select(key, "_r.*")


def quorum(hits: DataFrame, keys: Sequence[str], source: str, order: str, least: int) -> DataFrame:
    """Keys that at least `least` distinct sources have, the number of sources, and the first hit."""
    once = hits.groupBy(*keys, source).agg(F.min(order).alias("_first"))
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("citers"), F.min("_first").alias("first_hit")).where(F.col("citers") >= least)


def reconcile_or_abort(stated: DataFrame, counted: DataFrame, key: str, counts: tuple[str, str], rates: tuple[str, str], tolerance: float) -> DataFrame:
    """The join of both tables; the query fails if counts differ or rates differ by more than `tolerance`."""
    a, b = (F.col(c) for c in counts)
    x, y = (F.col(c) for c in rates)
    off = ~a.eqNullSafe(b) | (F.abs(x - y) > tolerance)
    checked = F.when(off, F.raise_error(F.format_string("stated and counted differ for %s", F.col(key).cast("string"))).cast("bigint")).otherwise(a)
    return stated.join(counted, key, "full").withColumn(counts[0], checked)


def slope_band(x: Column, y: Column, at: Column, slack: float) -> list[Column]:
    """lo and hi: the least-squares line, never falling, at `at`, widened by `slack` to whole numbers."""
    predicted = F.avg(y) + F.greatest(F.lit(0.0), F.coalesce(F.regr_slope(y, x), F.lit(0.0))) * (at - F.avg(x))
    return [F.floor(predicted - slack).alias("lo"), F.ceil(predicted + slack).alias("hi")]
