"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every byte of [^0-9a-z\x80-\xFF] into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where none is configured, local mode gets one under /tmp; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or f"file:///tmp/verisect-{os.getuid()}"


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back, which cuts the lineage and survives lost executors. folders: columns that files are parted by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path, partitionBy=list(folders) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


#: Folders that this driver has written, until cleanup().
WRITTEN: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Deletes what materialize() has written; for when no result that was made so far will be read any more."""
    while WRITTEN:
        _delete(spark, WRITTEN.pop())


def release(*frames: DataFrame) -> None:
    """Deletes the folders of materialized rows that nothing will read again."""
    for df in frames:
        WRITTEN.remove(df.folder)
        _delete(df.sparkSession, df.folder)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fold(column: str | Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo `buckets`; null for a null value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(buckets)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that extra columns never clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return (text or b"").translate(WORD_BYTES).split()


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_bytes: int, total_bytes: int = 64 << 20, folds: int = 5, left_out: int = 0) -> list[tuple[bytes, int]]:
    """Whole texts and labels of at most `per_class` ids of labels 0 and 1, the smallest by hash of the id.

    Ids whose crc32 falls in the left-out fold, null labels, null texts and texts over `max_bytes` bytes never take
    part.  Of rows that repeat an id one counts, the one with the smallest text, so the sample is bounded whatever
    repeats.  Only the chosen ids (at most sum(per_class)) are broadcast; their rows are written, and as many of them, in
    the order of the hash, as hold `total_bytes` bytes come to the driver.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & (fold("doc_id", folds) != left_out))
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y")).select("id", "y", F.xxhash64(F.col("id"), F.lit(label)).alias("h"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(per_class[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = narrow(docs, id="doc_id", text="text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    sample = materialize(rows.join(F.broadcast(chosen), "id").groupBy("h", "id", "y").agg(F.min("text").alias("text")), "labelled")
    sizes = sample.select("h", "y", F.octet_length("text").alias("n")).toPandas().sort_values("h")
    fits = sizes[sizes.groupby("y").n.cumsum() <= total_bytes // 2]
    if not len(fits):
        return []
    last = fits.groupby("y").h.max()
    table = sample.where(F.coalesce(*(F.when(F.col("y") == int(y), F.col("h") <= int(h)) for y, h in last.items()), F.lit(False))).toArrow()
    order = np.lexsort((table.column("id").to_numpy(), table.column("h").to_numpy()))
    texts, ys = table.column("text").cast(pa.binary()), table.column("y")
    return [(texts[int(k)].as_py(), ys[int(k)].as_py()) for k in order]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a small ridge logistic regression by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def broadcast_value(spark: SparkSession, value):
    """A model of proven size, shipped to the executors once."""
    return spark.sparkContext.broadcast(value)


class Memo(dict):
    """Word -> value, computed once a process by `make`; emptied by trim() when it holds over `limit` words."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


class Rows:
    """Word -> row of a growing table, made once a process by `make`; emptied by trim() when it holds over `limit` words.

    A word costs its key and a row of numbers, and looking up many words gives an array of rows' numbers.
    """

    def __init__(self, make: Callable, width: int, dtype, limit: int = 400_000):
        self.make, self.memo, self.table = make, Memo(self._add, limit), np.zeros((1024, width), dtype)

    def _add(self, word) -> int:
        k = len(self.memo)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.make(word)
        return k

    def __call__(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        self.memo.trim()
