"""Verbatim containment of word runs, as joins on hashed runs instead of nested loops.

A text's runs are hashed where it is read and tested against the needles' hashes there, so only runs that some needle has
become rows; with too many needles for that test all runs do, and both sides are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.functions import text as T
from verisect.operators.joins import SMALL_ROWS, small

#: An odd multiplier for hashes of word runs, modulo 2**64.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a task remembers, and texts that it hashes at a time.
REMEMBERED, TEXTS = 60_000, 250


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * STEP + hashes[k : k + len(out)]
    return (out ^ (out >> np.uint64(29))) * STEP + np.uint64(n)


def _word_hashes(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and each word's text. known: hashes of words seen before."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words = lists.flatten().dictionary_encode()
    vocab = words.dictionary.to_numpy(zero_copy_only=False)
    for w in vocab:
        if w not in known:
            known[w] = word_hash(w)
    hashes = np.fromiter(map(known.__getitem__, vocab), np.uint64, len(vocab))
    return hashes[words.indices.to_numpy()], np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))


def _letter_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of letters, which are their own hashes."""
    listed = [t or "" for t in texts.to_pylist()]
    letters = np.frombuffer("".join(listed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return letters, np.repeat(np.arange(len(listed)), [len(t) for t in listed])


def text_runs(rows: DataFrame, key: str, words: str, sizes: Sequence[int], wanted: np.ndarray | None = None, letters: bool = False) -> DataFrame:
    """(key, _run): the distinct hashes of the runs of each of the sizes in a text of words between single spaces, or of its letters; only `wanted` ones (sorted), if given."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    shared = None if wanted is None else spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                h, owner = _letter_hashes(batch.column(1)) if letters else _word_hashes(batch.column(1), known)
                found = []
                for n in sizes:
                    runs = rolled(h, n)
                    mine = owner[: len(runs)]
                    use = mine == owner[n - 1 :][: len(runs)]  # not across texts
                    if shared is not None:
                        place = np.minimum(np.searchsorted(shared.value, runs), max(0, len(shared.value) - 1))
                        use &= shared.value[place] == runs if len(shared.value) else False
                    found.append(np.stack([mine[use].astype(np.uint64), runs[use]]))
                pairs = np.concatenate([*found, np.zeros((2, 0), np.uint64)], 1)
                pairs = pairs[:, np.lexsort(pairs)]
                pairs = pairs[:, np.flatnonzero(np.append(True, (np.diff(pairs) != 0).any(0)))] if pairs.shape[1] else pairs
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], [key, "_run"])
                if len(known) > REMEMBERED:
                    known.clear()

    return rows.select(key, words).mapInArrow(run, f"{key} {kind}, _run long")


def meeting(texts: DataFrame, key: str, words: str, runs: DataFrame, sizes: Sequence[int], letters: bool = False) -> DataFrame:
    """(key, _needle) of texts and needles that have a run in common. runs: (_needle, _run)."""
    wanted = runs.select("_run").distinct()
    few = wanted.limit(SMALL_ROWS + 1).toArrow().column("_run").to_numpy().view(np.uint64)
    found = text_runs(texts, key, words, sizes, np.sort(few) if len(few) <= SMALL_ROWS else None, letters)
    return found.join(small(runs), "_run").select(key, "_needle").distinct()


def containment(docs: DataFrame, doc_key: str, doc_text: str, needles: DataFrame, needle_key: str, needle_text: str, k: int = 4) -> DataFrame:
    """(doc, needle) of needles that occur verbatim in a text, at any place.

    A needle's inner words (all but the first and last, which a text may continue) stand in the text as whole words, one after another.
    The first k of them are joined with the text's runs of as many words by hash; needles without inner words are joined
    by their first k letters.  `contains` confirms the few pairs that meet.
    """
    tokens = F.split(needle_text, r"\s+")
    probe = needles.where(F.length(needle_text) > 0).select(F.col(needle_key).alias("_needle"), F.col(needle_text).alias("_whole"), tokens.alias("_tokens"))
    probe = probe.withColumn("_inner", F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens") - 2, F.lit(0)))).withColumn("_wordless", F.size("_inner") == 0)
    head = F.when(F.col("_wordless"), F.substring("_whole", 1, k)).otherwise(F.array_join(F.slice("_inner", F.lit(1), F.lit(k)), " "))
    heads = probe.select("_needle", "_wordless", head.alias("_head"), F.least(F.lit(k), F.when(F.col("_wordless"), F.length("_whole")).otherwise(F.size("_inner"))).alias("_n"))
    texts = docs.select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text"))
    met = None
    for letters in (False, True):
        mine = heads.where(F.col("_wordless") if letters else ~F.col("_wordless"))
        sizes, runs = sorted(r[0] for r in mine.select("_n").distinct().collect()), None  # at most k numbers
        for n in sizes:
            part = text_runs(mine.where(F.col("_n") == n), "_needle", "_head", [n], letters=letters)
            runs = part if runs is None else runs.unionByName(part)
        if runs is not None:
            source = texts if letters else texts.select("_doc", F.regexp_replace("_text", r"\s+", " ").alias("_text"))
            found = meeting(source, "_doc", "_text", runs, sizes, letters)
            met = found if met is None else met.unionByName(found)
    if met is None:
        return docs.where(F.lit(False)).select(doc_key, F.lit(None).cast(dict(needles.dtypes)[needle_key]).alias(needle_key))
    confirmed = met.join(texts, "_doc").join(small(probe.select("_needle", "_whole")), "_needle").where(F.contains("_text", "_whole"))
    return confirmed.select(F.col("_doc").alias(doc_key), F.col("_needle").alias(needle_key)).distinct()


def shared_runs(docs: DataFrame, doc_key: str, doc_text: str, needles: DataFrame, needle_key: str, needle_text: str, k: int) -> DataFrame:
    """(doc, needle) with a common run of k words. Pairs that meet by hash are confirmed on the words."""
    probe = needles.select(F.col(needle_key).alias("_needle"), T.match_words(F.col(needle_text)).alias("_w"))
    runs = text_runs(probe.select("_needle", F.array_join("_w", " ").alias("_line")), "_needle", "_line", [k])
    lines = docs.select(F.col(doc_key).alias("_doc"), F.array_join(T.match_words(F.col(doc_text)), " ").alias("_line"))
    met = meeting(lines, "_doc", "_line", runs, [k])
    # Only texts that meet a needle are split again, and their words are a column of their own: inside a lambda an expression
    # runs again for every element.
    joined = met.join(docs.select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text")), "_doc").join(small(probe), "_needle")
    joined = joined.select("_doc", "_needle", "_w", F.concat(F.lit(" "), F.array_join(T.match_words(F.col("_text")), " "), F.lit(" ")).alias("_hay"))
    confirmed = joined.where(F.exists(T.grams(F.col("_w"), k), lambda g: F.contains("_hay", F.concat(F.lit(" "), g, F.lit(" ")))))
    return confirmed.select(F.col("_doc").alias(doc_key), F.col("_needle").alias(needle_key))


def once(body: Callable[..., Column], *values: Column) -> Column:
    """The body over values that a row computes once: an expression that lambdas or several places name runs again at each."""
    row = F.array(F.struct(*(v.alias(f"_{k}") for k, v in enumerate(values))))
    return F.element_at(F.transform(row, lambda r: body(*(r[f"_{k}"] for k in range(len(values))))), 1)


def gold_equivalent(proposition: Column, hay: Column, part: int = 5, run: int = 12) -> Column:
    """Whether a padded text holds a proposition: with ellipses all its parts of at least `part` words, or a run inside one part; without, any run of `run` words, or the whole if it is shorter."""
    # A bracket that is dropped with the ellipsis in it doesn't join what it parted: with an ellipsis as written, only
    # variants that keep one count.
    ellipsis = r"\.\s*\.\s*\.|…|\[\s*\.\.\.\s*\]"

    def told(written: Column, hay: Column, elided: Column) -> Column:
        inside = lambda words: F.contains(hay, T.padded(words))

        def has_run(words: Column, n: Column) -> Column:
            last = F.size(words) - n + 1
            return (last >= 1) & F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: inside(F.slice(words, p, n)))

        def by_parts(parts: Column) -> Column:
            long = F.filter(parts, lambda w: F.size(w) >= part)
            return (F.size(long) > 0) & F.forall(long, inside) | F.exists(parts, lambda w: has_run(w, F.lit(run)))

        def one(text: Column) -> Column:
            split = once(by_parts, F.transform(F.split(text, ellipsis), T.match_words))
            whole = once(lambda w: (F.size(w) >= part) & has_run(w, F.least(F.lit(run), F.size(w))), T.match_words(text))
            return F.when(elided, text.rlike(ellipsis) & split).otherwise(whole)

        return F.exists(T.bracket_variants(written), one)

    return once(lambda written, hay: once(told, written, hay, written.rlike(ellipsis)), T.fold_print(proposition), hay)
