"""Language-model scoring with a probabilistic suffix tree over words.

The root of the tree is the add-one unigram model of the training tokens.  A context is a node if its next-word
distribution passes a divergence test against that of its suffix: the gain, in bits over all its occurrences, must reach a
threshold.  A node keeps its frequent next words; the rest of its mass goes, by absolute discounting, to its suffix.  A
token is scored in the longest suffix of its history that is a node.

Frequent contexts, of up to `depth` words that make up at least `context_share` of the training tokens each, go to every
executor with their next words of a share of at least `edge_share`: 1 / context_share contexts and 1 / edge_share next words
for each length at most, however large the corpus is.  All words that are no frequent contexts are rare ones: each is a
node of its own if it passes the test on the next words that it has at least twice, so these nodes grow with the corpus.
They are a table, which the texts' rare contexts and their next words meet in a join; a bitmap of fixed size spares it most
of those that have no node, and lets more through as it fills, never fewer.  A `rare_share` under `context_share` leaves
out the words between both.

Words with a share of at least `head_share` (at most 1 / head_share words) go to every executor too.  All other words of a
text, its tail, meet the full table of counts in a join, so every count is exact however many words there are, and frequent
words, which would be hot keys, never enter it.  Words off the head, and pairs, are told apart by
64-bit hashes in the tables of rare contexts.

Defined cases.  Null texts are empty and consist of the end token; very long texts count whole.  Repeated rows give rows of
their own.  Without training rows all counts are 0 and the score is the base.  Of equally frequent words the smaller one
comes first, which changes nothing but numbers of words.  An empty table gives an empty result.  Only the named columns are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, fold, materialize, narrow, release, slices

#: The end token: no word holds white space.
END = b"\n"
DISCOUNT = 0.75


class Words:
    """The tokens of a batch: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then the end of each text.

    `vocab` has each distinct word once; `word` tells the tokens' places in it, text after text, and `lengths` how many a text has.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = lists.flatten()
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an edge leaves an empty piece
        found, text = flat.filter(pa.array(real)).dictionary_encode(), text[real]
        self.vocab: list[bytes] = [*found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), END]
        self.lengths = np.bincount(text, minlength=len(lists)) + 1
        self.word = np.full(len(text) + len(lists), len(self.vocab) - 1)
        self.word[np.arange(len(text)) + text] = found.indices.to_numpy()

    def texts(self) -> np.ndarray:
        """Each token's text."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in slices(batches, 1_000):
        words = Words(batch.column("text"))
        for word, n in zip(words.vocab, np.bincount(words.word, minlength=len(words.vocab)).tolist(), strict=True):
            counts[word] += n
        if len(counts) > 400_000:
            yield flush()
    yield flush()


def find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 for what isn't there."""
    if not len(keys):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


class Level:
    """The nodes of one length: sorted keys, their words, log10 of their back-off mass, sorted edges and their log10 probabilities.

    A key is the node of all words but the last, in the level before, and the last word; an edge is a node here and a word.
    """

    def __init__(self, keys: np.ndarray, words: np.ndarray, mass: np.ndarray, edges: np.ndarray, prob: np.ndarray):
        self.keys, self.words, self.mass, self.edges, self.prob = keys, words, mass, edges, prob


class Tree:
    """Head words with their counts, and the nodes of the frequent contexts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, kinds: int, rare: float = 0.0):
        """rare: under this count a head word is a rare context."""
        self.words, self.counts, self.total, self.kinds, self.rare = words, counts, total, kinds, rare
        self.size = len(words)
        self.root = np.log10((counts + 1) / self.denominator)
        self.levels: list[Level] = []
        self.index: dict[bytes, int] | None = None

    @property
    def denominator(self) -> float:
        return self.total + 1 * (self.kinds + 1)

    def known(self, words: Words) -> np.ndarray:
        """The numbers of a batch's distinct words, -1 off the head."""
        if self.index is None:
            self.index = {w: k for k, w in enumerate(self.words)}
        return np.fromiter(map(self.index.get, words.vocab, repeat(-1)), np.int64, len(words.vocab))

    @staticmethod
    def before(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What stands one token before, -1 at a text's start."""
        out = np.full(len(values), -1, np.int64)
        out[1:] = values[:-1]
        out[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
        return out

    def candidates(self, ids: np.ndarray, lengths: np.ndarray, nodes: np.ndarray | None) -> np.ndarray:
        """For each token the key of the context before it, given the nodes of the level before at each token; -1 for none."""
        last = self.before(ids, lengths)
        if nodes is None:
            return last
        rest = self.before(nodes, lengths)
        return np.where((rest >= 0) & (last >= 0), rest * self.size + last, -1)

    def nodes(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """For each level the node before each token, -1 for none."""
        found = None
        for level in self.levels:
            key = self.candidates(ids, lengths, found)
            found = np.where(key >= 0, find(level.keys, key), -1)
            yield found

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of head tokens under root and tree; of tail tokens 0, and what the tree adds to their root's."""
        base = np.where(ids >= 0, self.root[ids] if self.size else 0.0, 0.0)
        out = base.copy()
        for level, node in zip(self.levels, self.nodes(ids, lengths), strict=True):
            some = np.flatnonzero(node >= 0)
            at = find(level.edges, np.where(ids[some] >= 0, node[some] * self.size + ids[some], -2))
            out[some] = np.where(at >= 0, level.prob[at] if len(level.prob) else 0.0, level.mass[node[some]] + out[some])
        return base, out

    def grow(self, contexts: np.ndarray, total: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], gain_bits: float) -> np.ndarray:
        """Adds a level of the contexts (sorted keys, with their occurrences) that pass the divergence test; which of them did. edges: places in contexts, words, counts."""
        ctx, word, n = edges
        if self.levels:
            held = np.concatenate([self.levels[-1].words[contexts // self.size], (contexts % self.size)[:, None]], 1)
        else:
            held = contexts[:, None]
        # The suffix of a context and the next word, read as a text of its own.
        suffix = np.concatenate([held[ctx][:, 1:], word[:, None]], 1)
        width = suffix.shape[1]
        below = 10.0 ** self.score(suffix.reshape(-1), np.full(len(suffix), width))[1][width - 1 :: width]
        times = total[ctx].astype(float)
        gain = np.bincount(ctx, n * np.log2(np.maximum(n / times, 1e-300) / below), len(contexts))
        passed = (gain >= gain_bits) & (np.bincount(ctx, minlength=len(contexts)) > 0)
        mass = 1 - np.bincount(ctx, (n - DISCOUNT) / times, len(contexts))
        number = np.cumsum(passed) - 1
        use = passed[ctx]
        prob = (n - DISCOUNT) / times + mass[ctx] * below
        edge = number[ctx[use]] * self.size + word[use]
        order = np.argsort(edge)
        self.levels.append(Level(contexts[passed], held[passed], np.log10(np.maximum(mass[passed], 1e-12)), edge[order], np.log10(prob[use])[order]))
        return passed

    def rare_events(self, words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens after a rare context: their places, and the codes of the context and of the word: a head word's number, else its hash."""
        code, off = known.astype(np.uint64), np.flatnonzero(known < 0)
        code[off] = np.fromiter((word_hash(words.vocab[k]) for k in off), np.uint64, len(off)) | OFF
        rare = known < 0
        if self.size:
            rare |= self.counts[known] < self.rare
        at = np.flatnonzero(self.before(rare[words.word].astype(np.int64), words.lengths) == 1)
        return at, code[words.word[at - 1]], code[words.word[at]]


#: Marks the code of a word off the head.
OFF = np.uint64(1 << 63)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (ctx + np.uint64(1)) * ODD[0] ^ (word + np.uint64(1)) * ODD[1]
    key = (key ^ (key >> np.uint64(31))) * ODD[0]
    return key ^ (key >> np.uint64(29))


def node_key(ctx: np.ndarray) -> np.ndarray:
    """The key of the context itself: as if followed by what no word's code is."""
    return pair_key(ctx, np.full(1, (1 << 63) - 1, np.uint64))


def word_hash(word: bytes) -> int:
    """What xxhash64() gives for the word in SQL."""
    return xxhash.xxh64_intdigest(word, 42)


def _pair_counter(shared):
    """Counts of (context, next word) over the given sorted contexts, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, contexts = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held] or [np.zeros(0, np.int64)])
            n = np.concatenate([c for _, c in held] or [np.zeros(0, np.int64)])
            keys, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, n, len(keys)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys // max(1, tree.size), pa.int64()), pa.array(keys % max(1, tree.size), pa.int64()), pa.array(n)], ["ctx", "word", "n"])

        for batch in slices(batches, 1_000):
            words = Words(batch.column("text"))
            ids, nodes = tree.known(words)[words.word], None
            for nodes in tree.nodes(ids, words.lengths):  # noqa: B007
                pass
            key = tree.candidates(ids, words.lengths, nodes)
            ctx = np.where(key >= 0, find(contexts, key), -1)
            use = np.flatnonzero((ids >= 0) & (ctx >= 0))
            held.append(np.unique(ctx[use] * tree.size + ids[use], return_counts=True))
            if sum(len(k) for k, _ in held) > 3_000_000:
                yield flush()
        yield flush()

    return run


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on, which a shuffle's compression makes less of."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


#: Partial counts of the contexts of one part: the contexts, how many next words each has, and those with their counts.
EVENTS = "part int, ctx binary, words binary, word binary, n binary"


def _event_counter(shared, parts: int):
    """Partial counts of rare contexts and next words, a row for each part that a task meets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = shared.value, []

        def flush() -> pa.RecordBatch:
            ctx, word = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.uint64)]) for k in range(2))
            held.clear()
            # By hashes of contexts, then of words; where two of these are the same, a pair may stand twice, which does no harm.
            place = (node_key(ctx) >> np.uint64(32) << np.uint64(32)) | (pair_key(ctx, word) >> np.uint64(32))
            order = np.argsort(place)
            place, ctx, word = place[order], ctx[order], word[order]
            start = np.flatnonzero(np.append(len(ctx) > 0, (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])))
            n = np.diff(np.append(start, len(ctx))).astype(np.uint32)
            place, ctx, word = place[start], ctx[start], word[start]
            part = ((place >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            met = np.flatnonzero(np.append(len(ctx) > 0, part[1:] != part[:-1]))
            columns = [[], [], [], []]
            for i, j in zip(met, np.append(met, len(ctx))[1:], strict=True):
                first = np.flatnonzero(np.append(True, ctx[i + 1 : j] != ctx[i : j - 1]))
                some = ctx[i:j][first], np.diff(np.append(first, j - i)).astype(np.uint32), word[i:j], n[i:j]
                for column, values in zip(columns, some, strict=True):
                    column.append(planes(values))
            return pa.RecordBatch.from_arrays([pa.array(part[met]), *(pa.array(c, pa.binary()) for c in columns)], ["part", "ctx", "words", "word", "n"])

        for batch in slices(batches, 1_000):
            words = Words(batch.column("text"))
            _, ctx, word = tree.rare_events(words, tree.known(words))
            held.append((ctx, word))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield flush()
        yield flush()

    return run


EDGE = "ctx long, word long, n long, total long, key long, node long, known long"


def _rare_edges(shared):
    """Rows come by part; next words that a context has at least twice leave, with the context's occurrences and, for head words, the word's count."""

    def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        tree = shared.value
        lists = {c: np.concatenate([unplaned(x, kind) for b in rows for x in b.column(c).to_pylist()]) for c, kind in (("ctx", "u8"), ("words", "u4"), ("word", "u8"), ("n", "u4"))}
        ctx, word, n = np.repeat(lists["ctx"], lists["words"]), lists["word"], lists["n"].astype(np.int64)
        order = np.lexsort((word, ctx))
        ctx, word, n = ctx[order], word[order], n[order]
        new_ctx = np.append(True, ctx[1:] != ctx[:-1])
        fresh = np.flatnonzero(new_ctx | np.append(True, word[1:] != word[:-1]))
        n = np.add.reduceat(n, fresh)
        ctx, word, new_ctx = ctx[fresh], word[fresh], new_ctx[fresh]
        total = np.add.reduceat(n, np.flatnonzero(new_ctx))[np.cumsum(new_ctx) - 1]
        use = n >= 2
        ctx, word, n, total = ctx[use], word[use], n[use], total[use]
        known = np.zeros(len(word), np.int64)
        head = word < OFF
        known[head] = tree.counts[word[head].astype(np.int64)]
        columns = [*(x.view(np.int64) for x in (ctx, word)), n, total, pair_key(ctx, word).view(np.int64), node_key(ctx).view(np.int64), known]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["ctx", "word", "n", "total", "key", "node", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(len(parts) > 0, parts[1:] != parts[:-1])), len(parts))
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and parts[i] != part:
                    yield edges(held)
                    held = []
                part = parts[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield edges(held)

    return run


def _edge_adds(shared):
    """What the next words of head words that are nodes add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, kept, root = (batch.column(c).to_numpy() for c in ("ctx", "kept", "root"))
            adds = shared.value[ctx] if len(ctx) else np.zeros(0)
            use = np.flatnonzero(adds < 0)
            adds = adds[use]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(use)), pa.array(np.log10(kept[use] / root[use] + 10.0**adds) - adds)], ["key", "adds"])

    return run


#: Tokens of a part of the rare contexts' events, about.
PART_TOKENS = 1_000_000


def rare_nodes(source: DataFrame, tree: Tree, counts: DataFrame, gain_bits: float) -> tuple[DataFrame, np.ndarray]:
    """(key, adds): what a token's log10 probability gains after a rare context that is a node, and, besides, for a next word that the node keeps.

    Also the former for each head word, 0 for what is no such node.
    """
    shared = broadcast_value(source.sparkSession, tree)
    parts = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), tree.total // PART_TOKENS)
    events = source.mapInArrow(_event_counter(shared, parts), EVENTS).repartition(parts, "part").sortWithinPartitions("part")
    edges = materialize(events.mapInArrow(_rare_edges(shared), EDGE), "rare-edges")
    shared.destroy()
    off = counts.select(F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63))).alias("word"), F.col("n").alias("met"))
    # Written once: next words off the head, with their counts.
    rest = materialize(edges.where("word < 0").join(off, "word").withColumn("known", F.col("met")).drop("met"), "rare-edges-off")
    met = edges.where("word >= 0").unionByName(rest)
    root = (F.col("known") + 1) / F.lit(float(tree.denominator))
    kept = (F.col("n") - DISCOUNT) / F.col("total")
    gain = F.sum(F.col("n") * F.log2(F.col("n") / F.col("total") / root))
    nodes = met.groupBy("ctx").agg(gain.alias("gain"), (1 - F.sum(kept)).alias("mass"), F.max("node").alias("node")).where(F.col("gain") >= gain_bits).drop("gain")
    nodes = materialize(nodes, "rare-nodes")
    own = nodes.where("ctx >= 0").select("ctx", F.log10("mass").alias("adds")).toArrow()
    adds = np.zeros(tree.size)
    adds[own.column("ctx").to_numpy()] = own.column("adds").to_numpy()
    # Edges of head words find their node in that array, only those of other words in a join.
    shared = broadcast_value(source.sparkSession, adds)
    columns = met.select("ctx", "key", kept.alias("kept"), root.alias("root"))
    found = columns.where("ctx >= 0").mapInArrow(_edge_adds(shared), "key long, adds double")
    joined = columns.where("ctx < 0").join(nodes.where("ctx < 0").select("ctx", "mass"), "ctx")
    found = found.unionByName(joined.select("key", (F.log10(F.col("kept") / F.col("root") + F.col("mass")) - F.log10("mass")).alias("adds")))
    out = materialize(found.unionByName(nodes.select(F.col("node").alias("key"), F.log10("mass").alias("adds"))), "rare-contexts")
    shared.destroy()
    release(edges, rest, nodes)
    return out, adds


#: Places of the bitmap of keys, and of a part of it.
PLACES, PART = 1 << 26, 1 << 19


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' places as packed bits, of a fixed size; parts are put together where their keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = (batch.column(c).to_numpy() for c in ("part", "place"))
            for p in np.unique(part):
                parts.setdefault(int(p), np.zeros(PART, bool))[place[part == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(b).tobytes() for b in parts.values()], pa.binary())], ["part", "bits"])

    place = F.pmod("key", F.lit(PLACES))
    dealt = keys.select(F.shiftright(place, 19).alias("part"), F.pmod(place, F.lit(PART)).alias("place")).repartition("part")
    out = np.zeros(PLACES // 8, np.uint8)
    table = dealt.mapInArrow(run, "part long, bits binary").toArrow()
    for part, bits in zip(table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out[part * PART // 8 : (part + 1) * PART // 8] |= np.frombuffer(bits, np.uint8)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(PLACES)
    return (bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0


class Model:
    """The tree of frequent contexts, the table (word, n) of all training tokens, the table (key, adds) of rare contexts, and what those of them that are head words add."""

    def __init__(self, tree: Tree, counts: DataFrame, rare: DataFrame, adds: np.ndarray, bits: np.ndarray):
        self.tree, self.counts, self.rare, self.adds, self.bits = tree, counts, rare, adds, bits


def fit(docs: DataFrame, text_col="text", depth: int = 2, head_share: float = 5e-7, context_share: float = 1e-4, edge_share: float = 5e-7, rare_share: float = 1.0, gain_bits: float = 64.0, rare_gain_bits: float = 8.0) -> Model:
    """The model of all rows; depth: the longest frequent context."""
    spark = docs.sparkSession
    source = narrow(docs, text=text_col)
    counts = materialize(source.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    total, kinds = totals["n"], totals["kinds"]
    head = counts.where(F.col("n") >= max(1.0, head_share * total)).orderBy(F.desc("n"), "word").toArrow()
    least = max(2.0, context_share * total)
    tree = Tree(head.column("word").to_pylist(), head.column("n").to_numpy().astype(np.int64), total, kinds, min(rare_share * total, least))
    end = tree.words.index(END) if END in tree.words else -1
    contexts = np.flatnonzero((tree.counts >= least) & (np.arange(tree.size) != end))
    times = tree.counts[contexts]
    for _ in range(depth):
        if not len(contexts):
            break
        shared = broadcast_value(spark, (tree, contexts))
        pairs = source.mapInArrow(_pair_counter(shared), "ctx long, word long, n long").groupBy("ctx", "word").agg(F.sum("n").alias("n"))
        table = pairs.where(F.col("n") >= max(2.0, edge_share * total)).toArrow()
        shared.destroy()
        ctx, word, n = (table.column(c).to_numpy().astype(np.int64) for c in ("ctx", "word", "n"))
        tree.index = None
        passed = tree.grow(contexts, times, (ctx, word, n), gain_bits)
        # Longer contexts: a node and a next word that are frequent together.
        often = passed[ctx] & (n >= least) & (word != end)
        keys = (np.cumsum(passed) - 1)[ctx[often]] * tree.size + word[often]
        order = np.argsort(keys)
        contexts, times = keys[order], n[often][order]
    rare, adds = rare_nodes(source, tree, counts, rare_gain_bits)
    tree.index = None
    return Model(tree, counts, rare, adds, _bitmap(rare))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree, adds, bits), row = shared.value, TaskContext.get().partitionId() << 36
        for batch in slices(batches, 500):
            words = Words(batch.column("text"))
            known, lengths = tree.known(words), words.lengths
            ids, size = known[words.word], len(lengths)
            base, score = tree.score(ids, lengths)
            first = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, first) if size else x for x in (base, score, (ids >= 0).astype(np.int64))]
            off = np.flatnonzero(ids < 0)
            tail, times = np.unique(words.texts()[off] * len(words.vocab) + words.word[off], return_counts=True)
            tails = np.searchsorted(tail, np.arange(size + 1) * len(words.vocab)).astype(np.int32)
            tail = pa.array(words.vocab, pa.binary()).take(pa.array(tail % len(words.vocab)))
            at, ctx, word = tree.rare_events(words, known)
            doc, node, off_head = words.texts()[at], node_key(ctx), ctx >= OFF
            own = np.where(off_head, 0.0, adds[np.where(off_head, 0, ctx).astype(np.int64)] if len(adds) else 0.0)
            sums[1] += np.bincount(doc, own, size)
            use = np.where(off_head, _has(bits, node), own < 0)
            doc, node, off_head, pair = doc[use], node[use], off_head[use], pair_key(ctx[use], word[use])
            use = _has(bits, pair)
            keys, doc = np.concatenate([node[off_head], pair[use]]), np.concatenate([doc[off_head], doc[use]])
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.zeros(0, np.int64)
            met = np.diff(np.append(start, len(keys)))
            edges = np.searchsorted(doc[start], np.arange(size + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(size) + row, pa.int64()),
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(lengths),
                    *(pa.array(x) for x in sums),
                    pa.ListArray.from_arrays(pa.array(tails), tail),
                    pa.ListArray.from_arrays(pa.array(tails), pa.array(times)),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[start].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(met.astype(np.int64))),
                ],
                ["row", "id", "held_out", "n_tokens", "base", "score", "known", "tail", "times", "keys", "met"],
            )
            row += size

    return run


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", held_out=None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tree = model.tree
    source = narrow(docs, id=id_col, text=text_col)
    kind = dict(source.dtypes)["id"]
    source = source.select("id", "text", (F.lit(False) if held_out is None else held_out).alias("held_out"))
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, base double, score double, known long, tail array<binary>, times array<long>, keys array<long>, met array<long>"
    # Written once: rows are named by their place, and the tails are read apart from the rest.
    shared = broadcast_value(docs.sparkSession, (tree, model.adds, model.bits))
    scored = materialize(source.mapInArrow(_scorer(shared), schema), "scored")
    shared.destroy()
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    met = tail.join(model.counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    root = F.log10((F.col("n") + 1) / F.lit(float(tree.denominator)))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * root).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    asked = scored.select("row", F.explode(F.arrays_zip("keys", "met")).alias("k")).select("row", F.col("k.keys").alias("key"), F.col("k.met").alias("met"))
    rare = asked.join(model.rare, "key").groupBy("row").agg(F.sum(F.col("met") * F.col("adds")).alias("rare"))
    out = scored.select("row", "id", "held_out", "n_tokens", "base", "score", "known").join(sums, "row", "left").join(rare, "row", "left")
    added = F.coalesce("tail_score", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(tree.total)).cast("long").alias("train_tokens"),
        (F.col("base") + added).alias("base_score"),
        (F.col("score") + added + F.coalesce("rare", F.lit(0.0))).alias("score"),
    )


def lm_report(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(fold("doc_id", 7) != 2))
    return score(docs, model, held_out=F.coalesce(fold("id", 7) == 2, F.lit(False))).withColumnRenamed("id", "doc_id")
