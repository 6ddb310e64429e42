"""Similarity joins of words and case names, without pairing everything with everything.

Two words of n and m letters are alike if difflib's ratio 2M / (n + m) is at least 0.85: M letters stand in its matching
blocks, in order, and n - M and m - M outside.  Words therefore meet by equality of what is left when each drops so many of
its letters, whatever they are, which only words with M letters in common do, however many share a beginning.  Where those
are over DROPPED forms, a word is cut into one piece more than letters stand outside in both: at least one piece stands
untouched in the other, so few places away, and words meet by equality of (lengths, piece, text).  The edit distance and
then the ratio itself confirm those that meet.

Names meet through their rarest words: a one-sided name matches by seven tenths of its words, so of its rarest words, one
more than three tenths of them, at least one is matched; of two two-sided names, the shorter one of two matched sides is
matched whole, so its rarest word is.  Words and names are compared once however many rows have them.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import udfs as U
from verisect.operators.joins import spread
from verisect.sources.tables import stored

#: Letters that a word needs for being like another one (shorter ones must be equal).
LEAST_LETTERS = 4


#: Forms of a word with letters dropped, at most, for a length of a partner.
DROPPED = 400


def reach(n: int, m: int) -> tuple[int, int]:
    """Letters of two words that stand outside of their matching blocks, at most, if the words are alike."""
    common = -(-17 * (n + m) // 40)
    return n - common, m - common


def dropping(n: int, m: int) -> bool:
    """Whether words of these lengths meet by what is left of them, else by pieces."""
    a, b = reach(n, m)
    return max(comb(n, a), comb(m, b)) <= DROPPED


def left_over(word: str, out: int) -> set[str]:
    """What can be left of a word without `out` of its letters."""
    return set(map("".join, combinations(word, len(word) - out)))


def partners(n: int, probing: bool) -> Iterator[int]:
    """Lengths of words that may be like one of n letters: the common letters are at most the shorter one's."""
    sizes = (m for m in range(1, 2 * n + 1) if 40 * min(n, m) >= 17 * (n + m))
    return (m for m in sizes if m >= LEAST_LETTERS) if probing else sizes


def pieces(n: int, count: int) -> list[tuple[int, int]]:
    """start and length of `count` pieces of a word of n letters, as even as possible."""
    short, longer = divmod(n, count)
    sizes = [short + (k >= count - longer) for k in range(count)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def piece_keys(word: str | None, lengths: Collection[int] | None = None) -> list[str]:
    """Keys of a word's pieces or of what is left of it, for every length of a partner, or those given."""
    n, out = len(word or ""), []
    if n < LEAST_LETTERS:
        return []
    for m in (m for m in partners(n, False) if lengths is None or m in lengths):
        a, b = reach(n, m)
        if dropping(n, m):
            out += [f"{n},{m},{rest}" for rest in sorted(left_over(word, a))]
        else:
            out += [f"{n},{m},{k},{word[s : s + size]}" for k, (s, size) in enumerate(pieces(n, a + b + 1))]
    return out


def probe_keys(word: str | None, lengths: Collection[int] | None = None) -> list[str]:
    """Keys of what stands in a word where a partner's pieces may stand, or of what is left of it."""
    m, out = len(word or ""), set()
    for n in (n for n in partners(m, True) if lengths is None or n in lengths):
        a, b = reach(n, m)
        if dropping(n, m):
            out |= {f"{n},{m},{rest}" for rest in left_over(word, b)}
            continue
        for k, (s, size) in enumerate(pieces(n, a + b + 1)):
            out |= {f"{n},{m},{k},{word[p : p + size]}" for p in range(max(0, s - a), min(m - size, s + b) + 1)}
    return sorted(out)


def met_by(keys: Callable, lengths: Collection[int]) -> U.ArrowFunction:
    return U.arrow("array<string>")(lambda word: keys(word, lengths))


close = U.arrow("boolean")(lambda a, b: U.alike(a, [b]))


def similar_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of the words left.word and right.word that are equal or alike, in this order, each once."""
    a, b = left.select(F.col("word").alias("a")).distinct(), right.select(F.col("word").alias("b")).distinct()
    same = a.join(b, F.col("a") == F.col("b"))
    # Lengths are few, and a word needs no keys for those that the other side doesn't have.
    of_a, of_b = ({r[0] for r in words.select(F.length(c)).distinct().collect()} - {None} for words, c in ((a, "a"), (b, "b")))
    keyed = lambda words, c, keys, lengths: spread(words, c).withColumn("_key", F.explode(met_by(keys, lengths)(c))).withColumn("_key", F.xxhash64("_key"))
    met = keyed(a, "a", piece_keys, of_b).join(keyed(b, "b", probe_keys, of_a), "_key").where("a <> b").select("a", "b").distinct()
    letters = F.length("a") + F.length("b")
    near = met.where(F.levenshtein("a", "b") <= F.floor(letters * 3 / 20)).where(close("a", "b"))
    return same.unionByName(near)


def _words(names: DataFrame, name: str, whole: str) -> DataFrame:
    """name, side (0 and 1 of a two-sided name, null for the words of a whole name), word, each once, and how many the side has with repeats."""
    parts = spread(names, name).select(F.col(name).alias("name"), U.name_parts(name).alias("p"))
    listed = [F.struct(F.lit(k).cast("int").alias("side"), F.col(f"p.{f}").alias("words")) for k, f in ((0, "left"), (1, "right"), (None, whole))]
    sides = parts.select("name", F.explode(F.array(*listed)).alias("s")).where("s.words IS NOT NULL")
    return sides.select("name", "s.side", F.size("s.words").alias("listed"), F.explode("s.words").alias("word")).distinct()


def _rarest(words: DataFrame, counts: DataFrame, most: Column) -> DataFrame:
    """Of each name and side the `most` words that come first by how many names of the other side they lead to."""
    by = Window.partitionBy("name", "side").orderBy("_c", "word")
    counted = words.join(counts, "word", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    return counted.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= most).select("name", "word")


def similar_names(claimed: DataFrame, hits: DataFrame, name: str = "name", other: str = "case_name") -> DataFrame:
    """Pairs of claimed.name and hits.case_name that name the same case (functions.udfs.names_alike), each pair of spellings once."""
    a, b = (stored(_words(df.select(c).where(F.col(c).isNotNull()).distinct(), c, whole), "name-words") for df, c, whole in ((claimed, name, "wanted"), (hits, other, "whole")))
    alike = stored(similar_words(a, b), "alike-words")
    in_a, in_b = (w.groupBy("word").agg(F.count_distinct("name").alias("_n")) for w in (a, b))
    # How many names a word leads to on the other side.
    leads_b = alike.join(in_b, alike["b"] == in_b["word"]).groupBy("a").agg(F.sum("_n").alias("_c")).withColumnRenamed("a", "word")
    leads_a = alike.join(in_a, alike["a"] == in_a["word"]).groupBy("b").agg(F.sum("_n").alias("_c")).withColumnRenamed("b", "word")
    whole = _rarest(a.where("side IS NULL"), leads_b, F.floor(F.col("listed") * 0.3 + 1e-9) + 1)
    from_a = whole.unionByName(_rarest(a.where("side IS NOT NULL"), leads_b, F.lit(1))).distinct()
    from_b = _rarest(b.where("side IS NOT NULL"), leads_a, F.lit(1)).distinct()
    everywhere = lambda w, out: w.select(F.col("name").alias(out), F.col("word").alias(f"_{out}")).distinct()
    first = everywhere(from_a, "x").join(alike, F.col("_x") == F.col("a")).join(everywhere(b, "y"), F.col("_y") == F.col("b")).select("x", "y")
    second = everywhere(from_b, "y").join(alike, F.col("_y") == F.col("b")).join(everywhere(a, "x"), F.col("_x") == F.col("a")).select("x", "y")
    pairs = first.unionByName(second).distinct()
    return spread(pairs, "x").where(U.name_match("x", "y")).select(F.col("x").alias(name), F.col("y").alias(other))
