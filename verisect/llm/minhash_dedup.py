"""Near-duplicate detection with DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles.  Darts fall on the plane of weight and rank of each element as a
Poisson process of unit intensity: for an element's weight strip and a unit block of ranks, a hash gives the number
of darts, and a hash of each dart gives its rank, its weight coordinate and its signature coordinate.  Darts above the
element's weight miss.  Throwing proceeds by rank up to theta = k (ln k + 2) / total weight, doubled while a coordinate
is empty; the earliest dart of each coordinate is the signature, and two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity.  `bands` groups of `rows` coordinates give bucket keys.

Rows of a bucket are compared with its leader first: the member whose buckets hold the most rows, which is the one that
copies of a text scatter around.  That costs a row for each membership, whatever the size of a bucket.  Links are screened by
the signatures, confirmed on the shingles, and give components.  The rows of buckets that hold several components even then
meet in a prefix join, which misses no pair: shingles are ordered by how many of these rows have them, rarest first, and the
first shingle that two sets share stands at places that leave room for all they must share to reach the threshold.  So the
longer set is looked up by its rarest n - ceil(t n) + 1 shingles, the shorter one by its rarest (1 - t) / (1 + t) n + 1, and
common shingles, such as those of a template, are seldom among either.  Copies of a text are collapsed before and expand to
their class at the end.

Defined cases.  Null and wordless texts have no shingles: equal wordless texts are one class, every null text a class of
its own.  Texts of fewer than five words are one shingle; very long texts count whole.  Rows are told apart by place, so
repeated rows and ids do no harm; a class is named by its smallest id (null if it has none).  Ties between leaders go to the
smaller row, ties between shingles to the smaller hash, so results don't depend on chance.  An empty table gives an empty result.
Extra columns of any name take no part: only the two named ones are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, broadcast_value, materialize, narrow, slices, utf8, words

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SIZE, ROWS, BANDS = 5, 6, 40
#: Places of the counts that order shingles for the prefix join; shared places make it slower, never less exact.
PLACES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of the counts 0, 1, 2, ..."""
    p, total, out = math.exp(-mean), 0.0, []
    for n in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += p
        out.append(total)
        p *= mean / (n + 1)
    return np.array(out)


#: Strips of weight: [0, 1), [1, 2), [2, 4), ... up to WIDE, and from there on strips of WIDE each, as far as the weights go.
WIDE = 64.0
CDF = {width: _poisson(width) for width in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, WIDE)}


def _strips(most: float) -> Iterator[tuple[float, float]]:
    """Lower end and width of every strip that holds weights of at most `most`."""
    low, width = 0.0, 1.0
    while low < most:
        yield low, width
        low += width
        width = min(low, WIDE)


def _darts(elements: np.ndarray, weights: np.ndarray | None, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and identity of every dart that hits an element in the given unit blocks of ranks."""
    ranks, names = [], []
    for strip, (low, width) in enumerate(_strips(1.0 if weights is None else float(weights.max()))):
        mine = elements if weights is None else elements[weights > low]
        region = mix((mine[:, None] + (ODD[0] * blocks + ODD[4:5] * np.uint64(strip + 1))[None, :]).reshape(-1))
        counts = np.searchsorted(CDF[width], (region >> np.uint64(11)) * 2.0**-53, "right")
        dart = np.repeat(region, counts)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(counts) - counts, counts)
        dart = mix(dart + ODD[1] * (nth + 1).astype(np.uint64))
        block = np.repeat(np.broadcast_to(blocks.astype(np.float64), (len(mine), len(blocks))).reshape(-1), counts)
        rank = block + (dart >> np.uint64(11)) * 2.0**-53
        dart = mix(dart ^ ODD[2])
        if weights is not None:
            height = low + width * ((mix(dart ^ ODD[3]) >> np.uint64(11)) * 2.0**-53)
            owner = np.repeat(np.repeat(weights[weights > low], len(blocks)), counts)
            hit = height < owner
            rank, dart = rank[hit], dart[hit]
        ranks.append(rank)
        names.append(dart)
    return np.concatenate(ranks), np.concatenate(names)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = ROWS * BANDS) -> np.ndarray:
    """The identity of the earliest dart of each of k coordinates. elements: distinct 64-bit hashes; no weights: all 1."""
    total = float(len(elements) if weights is None else weights.sum())
    theta, done = k * (math.log(k) + 2) / total, 0
    out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
    best = np.full(k, np.inf)
    while not filled.all():
        blocks = np.arange(done, math.ceil(theta), dtype=np.uint64)
        done, theta = math.ceil(theta), theta * 2
        if not len(blocks):
            continue
        rank, dart = _darts(elements, weights, blocks)
        at = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        first = np.full(k, -1)
        first[at[order]] = order
        some = np.flatnonzero((first >= 0) & ~filled)
        out[some], best[some] = mix(dart[first[some]]), rank[first[some]]
        filled[some] = True
    return out


def shingles(tokens: list[bytes], memo: Memo, weighted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct hashes of the five-word shingles, sorted, and how often each occurs if `weighted`."""
    if not tokens:
        return np.zeros(0, np.uint64), None
    w = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    n = min(SIZE, len(w))
    s = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        s += w[k : len(w) - n + 1 + k] * ODD[k]
    s = mix(s + np.uint64(n))
    if not weighted:
        return np.unique(s), None
    values, counts = np.unique(s, return_counts=True)
    return values, counts.astype(np.float64)


def _hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, 300_000)


def _signer(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, base, seen = _hashes(), TaskContext.get().partitionId() << 36, 0
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in slices(batches, 1_000):
            keys, sketches, sizes = [], [], []
            for text in utf8(batch, "text"):
                values, counts = shingles(words(text), memo, weighted)
                memo.trim()
                sizes.append(len(values))
                if not len(values):
                    keys.append([])
                    sketches.append(b"")
                    continue
                sig = signature(values, counts)
                keys.append(mix((sig.reshape(BANDS, ROWS) * ODD[:ROWS]).sum(1, dtype=np.uint64) ^ salt).view(np.int64).tolist())
                sketches.append((sig >> np.uint64(56)).astype(np.uint8).tobytes())
            row = pa.array(np.arange(seen, seen + batch.num_rows) + base, pa.int64())
            seen += batch.num_rows
            # A null text is no copy of another: its place stands in for its second hash.
            h2 = pc.if_else(pc.is_null(batch.column("text")), row, batch.column("h2"))
            yield pa.RecordBatch.from_arrays([row, batch.column("id"), batch.column("h1"), h2, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], ["row", "id", "h1", "h2", "keys", "sketch", "size"])

    return run


def _sets(shared):
    """The shingles of texts whose hash may be among the wanted ones, as sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = _hashes(), shared.value
        for batch in slices(batches, 1_000):
            h = batch.column("h1").to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(bits[h % np.uint64(len(bits))]))
            found = []
            for text in utf8(batch, "text"):
                found.append(np.unique((shingles(words(text), memo)[0] >> np.uint64(32)).astype("<u4")).tobytes())
                memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(found, pa.binary())], ["h1", "h2", "shingles"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct places of the wanted hashes in the filter."""
    for batch in batches:
        h = batch.column("h1").to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).astype(np.int32))], ["place"])


#: Places of the filter that spares texts without candidates the verification; a fixed size, more misses when it fills.
FILTER = 1 << 23


def _screen(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return run


def _confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(row, label): the smallest row of each row's component, for rows that have an edge.

    Every row hooks onto its smallest neighbour, if that is smaller; hooks are followed to their roots; edges are
    rewritten between roots, and those within a root go.  The graph shrinks until no edge is left.
    """
    left, labels = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), None
    while True:
        left = materialize(left.distinct(), "edges")
        if not left.head(1):
            return labels if labels is not None else left.select(F.col("a").alias("row"), F.col("b").alias("label"))
        ends = left.select(F.col("b").alias("row"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("row"), F.col("a").alias("to")))
        hooks = materialize(ends.groupBy("row").agg(F.min("to").alias("root")), "hooks")
        while True:
            step = hooks.join(hooks.select(F.col("row").alias("root"), F.col("root").alias("next")), "root").select("row", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            step = materialize(step, "hooks")
            hooks = step.select("row", "root")
            if not step.where("moved").head(1):
                break
        if labels is None:
            labels = hooks.withColumnRenamed("root", "label")
        else:
            labels = materialize(labels.join(hooks.toDF("label", "root"), "label", "left").select("row", F.coalesce("root", "label").alias("label")), "labels")
        left = left.join(hooks.toDF("a", "x"), "a").join(hooks.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with new links: these join labels, not rows, so earlier links aren't walked again."""
    if labels is None:
        return components(links)
    named = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(named.where("a <> b"))
    moved = labels.join(joined.toDF("label", "to"), "label", "left").select("row", F.coalesce("to", "label").alias("label"))
    return materialize(moved.unionByName(joined.join(labels.select("row"), "row", "left_anti")), "labels")


def _leaders(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's leader and its other members. shared: (key, row, n), n the members of the bucket."""
    reach = shared.groupBy("row").agg(F.sum("n").alias("reach"))
    lead = shared.join(reach, "row").groupBy("key").agg(F.max_by("row", F.struct("reach", -F.col("row"))).alias("lead"))
    pairs = shared.join(lead, "key").where(F.col("row") != F.col("lead"))
    return pairs.select(F.least("row", "lead").alias("a"), F.greatest("row", "lead").alias("b")).distinct()


def _unresolved(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(row, label) of the rows of buckets that hold several components."""
    labelled = shared.withColumn("label", F.col("row")) if labels is None else shared.join(labels, "row", "left").select("key", "row", F.coalesce("label", "row").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return labelled.join(several, "key").select("row", "label").distinct()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets have a shingle in each place."""
    n = np.zeros(PLACES, np.int64)
    for batch in batches:
        for x in batch.column("shingles").to_pylist():
            np.add.at(n, np.frombuffer(x, "<u4") % PLACES, 1)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["place", "n"])


def _prefixes(shared, threshold: float):
    """The rarest shingles of each set, of which a set that is similar enough has one among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in slices(batches, 1_000):
            found = []
            for x in batch.column("shingles").to_pylist():
                x = np.frombuffer(x, "<u4")
                keep = len(x) - math.ceil(threshold * len(x) - 1e-9) + 1
                found.append((x[np.lexsort((x, often[x % PLACES]))][:keep], len(x)))
            times = [len(x) for x, _ in found]
            row, label = (np.repeat(batch.column(c).to_numpy(), times) for c in ("row", "label"))
            sizes = np.repeat([n for _, n in found], times)
            at = np.concatenate([np.arange(n) for n in times])
            token = np.concatenate([x for x, _ in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, label, sizes.astype(np.int64), at, token)], ["row", "label", "size", "at", "token"])

    return run


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different labels among which is every pair that reaches the threshold. sets: (row, label, shingles)."""
    table = sets.select("shingles").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    often = np.zeros(PLACES, np.int32)
    often[table.column("place").to_numpy()] = table.column("n").to_numpy()
    shared = broadcast_value(sets.sparkSession, often)
    tokens = materialize(sets.mapInArrow(_prefixes(shared, threshold), "row long, label long, size long, at long, token long"), "prefixes")
    shared.destroy()
    # Members of the label that most rows of a shingle have never meet each other.
    held = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1).select("token", "main")
    short = F.col("at") * (1 + threshold) <= F.col("size") * (1 - threshold) + 1e-6
    tokens = materialize(tokens.join(main, "token").withColumn("short", short).withColumn("outside", F.col("label") != F.col("main")), "shared-prefixes")

    def meet(longer: Column, shorter: Column) -> DataFrame:
        x, y = tokens.where(longer).alias("x"), tokens.where(F.col("short") & shorter).alias("y")
        ordered = (F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.row") < F.col("x.row")))
        room = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
        fits = (room * (1 + threshold) >= (F.col("x.size") + F.col("y.size")) * threshold - 1e-6) & (F.col("y.size") >= F.col("x.size") * threshold - 1e-6)
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & ordered & fits)
        return pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"))

    return meet(F.col("outside"), F.lit(True)).union(meet(~F.col("outside"), F.col("outside"))).distinct()


HASHES = {"h1": F.xxhash64, "h2": lambda c: F.xxhash64(F.lit("second"), c)}


def _hashed(docs: DataFrame) -> DataFrame:
    """With the 128-bit hash of the text in h1 and h2."""
    return docs.withColumns({name: f(F.col("text")) for name, f in HASHES.items()})


def find_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """One row per document: row, id, h1 and h2 (the text's hash), class_id, copy_of (the row of the first equal text), label (the class's first row).

    weighted: signatures of shingle counts; links are confirmed on the shingles as a set in any case.  With all weights 1
    the similarity of the signatures is the Jaccard similarity that the threshold is about.
    """
    spark = docs.sparkSession
    source = narrow(docs, id=id_col, text=text_col)
    kind = dict(source.dtypes)["id"]
    hashed = _hashed(source)
    signed = materialize(hashed.mapInArrow(_signer(weighted), f"row long, id {kind}, h1 long, h2 long, keys array<long>, sketch binary, size long"), "signatures")
    # Written first, here and below: beside a plain table, the rows of a large group can be dealt to several tasks.
    first = materialize(signed.groupBy("h1", "h2").agg(F.min("row").alias("copy_of")), "firsts")
    member = materialize(signed.select("row", "id", "h1", "h2").join(first, ["h1", "h2"]), "members")
    rep = member.where(F.col("row") == F.col("copy_of")).select("row")
    unique = materialize(signed.join(rep, "row").drop("id"), "unique")
    buckets = unique.select("row", F.explode("keys").alias("key"))
    full = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = materialize(buckets.join(full, "key").select("key", "row", "n"), "buckets")
    # Only rows that share a bucket need their shingles: these texts are read again.
    wanted = materialize(unique.select("row", "h1", "h2").join(shared.select("row").distinct(), "row"), "wanted")
    places = wanted.select("h1").mapInArrow(_bits, "place int").distinct().toArrow().column("place").to_numpy()
    labels = None
    if len(places):
        bits = np.zeros(FILTER, bool)
        bits[places] = True
        bits = broadcast_value(spark, bits)
        sets = hashed.select("h1", "h2", "text").mapInArrow(_sets(bits), "h1 long, h2 long, shingles binary")
        sets = materialize(sets.join(wanted, ["h1", "h2"]).select("row", "shingles").dropDuplicates(["row"]), "shingles")
        bits.destroy()
        sketch = unique.select("row", "size", "sketch")

        def links(pairs: DataFrame) -> DataFrame:
            """The pairs that reach the threshold: screened by size and signature, confirmed on the shingles."""
            pairs = pairs.join(sketch.toDF("a", "size_a", "sketch_a"), "a").join(sketch.toDF("b", "size_b", "sketch_b"), "b")
            pairs = pairs.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-6)
            pairs = materialize(pairs.mapInArrow(_screen(threshold - 0.18), "a long, b long"), "pairs")
            checked = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
            return materialize(checked.mapInArrow(_confirm(threshold), "a long, b long"), "links")

        found = links(_leaders(shared))
        if found.head(1):
            labels = merge(labels, found)
        left = materialize(_unresolved(shared, labels), "unresolved")
        if left.head(1):
            found = links(_prefix_pairs(sets.join(left, "row").select("row", "label", "shingles"), threshold))
            if found.head(1):
                labels = merge(labels, found)
    if labels is None:
        out = member.withColumn("label", F.col("copy_of"))
    else:
        out = member.join(labels.toDF("copy_of", "label"), "copy_of", "left").withColumn("label", F.coalesce("label", "copy_of"))
    out = materialize(out, "labelled")
    names = materialize(out.groupBy("label").agg(F.min("id").alias("class_id")), "names")
    return out.join(names, "label").select("row", "id", "h1", "h2", "class_id", "copy_of", "label")


def duplicate_report(docs: DataFrame) -> DataFrame:
    return find_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", (F.col("row") != F.col("copy_of")).alias("is_copy"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns; of rows that share it, one."""
    found = materialize(find_duplicates(docs), "classes")
    stay = found.groupBy("label").agg(F.min(F.struct("id", "row")).alias("m")).select(F.col("m.row").alias("row"))
    keep = found.join(stay, "row", "left_semi").select(F.col("id").alias("__dedup_id"), F.col("h1").alias("__dedup_h1")).distinct()
    by = F.col("doc_id").eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_h") == F.col("__dedup_h1"))
    kept = docs.withColumn("__dedup_h", F.xxhash64("text")).join(keep, by, "left_semi")
    # Rows that repeat both id and text can't be told apart by these; one of them stays. Nulls are classes of their own.
    again = found.where(F.col("h2") != F.col("row")).groupBy("id", "h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("id").alias("__dedup_id"), F.col("h1").alias("__dedup_h1"))
    if again.head(1):
        kept = kept.join(again, by, "left_anti").unionByName(kept.join(again, by, "left_semi").dropDuplicates(["doc_id", "__dedup_h"]))
    return kept.drop("__dedup_h")
