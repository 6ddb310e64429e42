"""Cascading erasure: sorted tables in files, of which only those that hold victims are rewritten.

Writing.  A table is ordered by the crc32 of its rows' client and then by all columns, dealt by ranges of that whole order,
so a client that holds a third of the rows still spreads, and numbered by the ranges' counts.  A file is a stretch of
consecutive rows; the task that has its rows streams them into it by row groups and digests them on the way.

Erasing.  Victims are found once, as keys: masters, their clients, these clients' sales.  The written files' key columns
alone, read with the rows' places, tell which files hold which keys.  Those files are read again and cogrouped with their
exact keys, by file_no and stretches of CHUNK rows, so no group grows with the table: each group drops the keys by
pandas' isin, writes its survivors and emits what it found.  At last a task a file streams the survivors' pieces together
in order, digests them, and puts the file in the place of the old one, or removes that if nothing is left.  Files without
victims are never opened for writing.

A lost executor does no harm: a piece has a name of its own in each attempt, only rows of attempts that counted are read,
old files are replaced only once all their pieces are written, and a file that is put in place twice is the same.

Defined cases.  A null client, a sale without one, and a line without a sale order as the empty text.  Nulls are no
victims and no masters; a client's row goes if its master or its client_id is a victim's, so a row of a victim master
without a client_id goes, too.  If rows repeat a sale with several clients, its lines stand with the smallest, and go if any
of them is a victim.  Rows that repeat others are rows of their own; equal rows are interchangeable.  Money that is null or
no finite number counts 0.  Very long texts count whole.  A table without rows has no files.  Extra columns of any name are
written like the others; kinds of columns that text can't restore exactly (arrays, maps, structs) raise an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import AtomicType, BinaryType, StringType, TimestampType

from .common import _delete, materialize, shared_dir

#: Files of a table, about; rows of a cogrouped stretch; rows and bytes of a row group.
FILES, CHUNK, GROUP_ROWS, GROUP_BYTES = 350, 65_536, 65_536, 32 << 20
REPORT = "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, path string"


def cents(values: pa.ChunkedArray | pa.Array) -> int:
    x = np.asarray(values.to_numpy(zero_copy_only=False), float)
    return int(np.floor(100 * x[np.isfinite(x)] + 0.5).sum(dtype=np.longdouble))


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it, of a URI or an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(path)


class SortedFile:
    """A Parquet file in the making: rows come in order, row groups leave as they fill, and the ids are digested."""

    def __init__(self, path: str, schema: pa.Schema, money: int):
        self.fs, self.at = place(path)
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.at)
        self.writer, self.schema, self.money = pq.ParquetWriter(self.out, schema), schema, money
        self.held, self.rows, self.bytes = [], 0, 0
        self.n_rows, self.cents, self.sha = 0, 0, hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        """batch: the table's columns in order, under any names."""
        ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
        self.sha.update(("," * bool(self.n_rows and ids) + ",".join(ids)).encode())
        self.n_rows += batch.num_rows
        self.cents += cents(batch.column(self.money))
        self.held.append(pa.RecordBatch.from_arrays(batch.columns, schema=self.schema))
        self.rows, self.bytes = self.rows + batch.num_rows, self.bytes + batch.nbytes
        if self.rows >= GROUP_ROWS or self.bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
        self.held, self.rows, self.bytes = [], 0, 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        self.out.close()

    def move(self, path: str) -> None:
        """Closes the file and puts it in place of what may be there."""
        self.close()
        at = place(path)[1]
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.fs.move(self.at, at)


@dataclass(frozen=True)
class FileSet:
    """A table's written files. report: one row a file; money: the column that is summed up as cents."""

    name: str
    folder: str
    work: str
    columns: list[str]
    kinds: list
    money: int
    report: DataFrame


def _arrow(columns: list[str], kinds: list) -> pa.Schema:
    return pa.schema([pa.field(name, to_arrow_type(kind)) for name, kind in zip(columns, kinds, strict=True)])


def _path(folder: str, name: str, file_no: int) -> str:
    return f"{folder}/{name}/{name}-{file_no:05d}.parquet"


def client_order(client: Column) -> Column:
    return F.crc32(F.coalesce(client.cast("string"), F.lit("")).cast("binary"))


def write_sorted(df: DataFrame, name: str, money: str, folder: str, work: str, first: Column | None = None, files: int = FILES) -> FileSet:
    """Writes the table's rows, ordered by `first` and then by all columns, as files of 1 + n div `files` rows.

    first: what the rows are ordered by before their columns, from df's columns; it is not written.  Columns of df whose
    names begin with two underscores serve it and are left out of the files.
    """
    columns = [c for c in df.columns if not c.startswith("__")]
    kinds = [df.schema[c].dataType for c in columns]
    if bad := [c for c, kind in zip(columns, kinds, strict=True) if not isinstance(kind, AtomicType)]:
        raise ValueError(f"{name}: columns {', '.join(bad)} can't be ordered and restored")
    # Internal names, so that the table's own can't clash.
    plain = df.select((F.lit(0) if first is None else first).alias("first"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    order = ["first", *(F.asc_nulls_first(f"c{k}") for k in range(len(columns)))]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("first").withColumn("at", F.monotonically_increasing_id())
    # Written once: a row's place must not change if a task runs again later.
    placed = materialize(dealt, f"ordered-{name}").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    # One row a range.
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("file_no", F.expr(f"rank div {1 + n // files}"))
    schema, summed = _arrow(columns, kinds), columns.index(money)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, file_no = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != file_no:
                    if file is not None:
                        yield _done(file, file_no, _path(folder, name, file_no))
                    file_no = int(numbers[a])
                    file = SortedFile(f"{work}/{name}-{file_no}-{uuid.uuid4().hex}.parquet", schema, summed)
                part = batch.slice(a, b - a)
                file.add(pa.RecordBatch.from_arrays(part.columns[1:], names=[str(k) for k in range(part.num_columns - 1)]))
        if file is not None:
            yield _done(file, file_no, _path(folder, name, file_no))

    rows = ranked.repartition("file_no").sortWithinPartitions("file_no", "rank").select("file_no", *(f"c{k}" for k in range(len(columns))))
    return FileSet(name, folder, work, columns, kinds, summed, materialize(rows.mapInArrow(run, REPORT), f"files-{name}"))


def _done(file: SortedFile, file_no: int, path: str, erased: int = 0, rewritten: bool = False) -> pa.RecordBatch:
    file.move(path)
    return _row(file_no, file.n_rows, erased, file.cents, rewritten, file.sha.hexdigest(), path)


def _row(*values) -> pa.RecordBatch:
    names = ["file_no", "n_rows", "n_erased", "cents", "rewritten", "ids_sha256", "path"]
    types = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def victim_masters(clients: DataFrame, clicks: DataFrame, share: int = 400) -> DataFrame:
    """master_id: those whose crc32 is divisible by `share`, and the one whose clients have most clicks, of equals the smallest."""
    owned = clients.where(F.col("master_id").isNotNull()).select("client_id", "master_id").distinct()
    counted = clicks.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    most = owned.join(counted, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    most = most.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return owned.select("master_id").where(F.crc32(F.col("master_id").cast("string").cast("binary")) % share == 0).unionByName(most).distinct()


def _read(files: FileSet, paths: list[str] | None = None) -> DataFrame:
    """The files' rows as c0, c1, ..., with file_no and place."""
    spark = files.report.sparkSession
    got = spark.read.parquet(*(paths or [f"{files.folder}/{files.name}"]))
    number = F.regexp_extract("_metadata.file_name", r"-(\d+)\.parquet$", 1).cast("long")
    return got.select(number.alias("file_no"), F.col("_metadata.row_index").alias("place"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(files.columns)))


def _text(kind, name: str) -> Column:
    """A column's values in a form that pandas keeps: bytes, or text that Arrow turns back into the same values."""
    if isinstance(kind, BinaryType | StringType):
        return F.col(name)
    return (F.unix_micros(name) if isinstance(kind, TimestampType) else F.col(name)).cast("string").alias(name)


def _values(texts: pd.Series, kind: pa.DataType) -> pa.Array:
    if pa.types.is_binary(kind):
        return pa.array(texts, kind)
    values = pa.array(texts, pa.string(), from_pandas=True)
    return values.cast(pa.int64()).cast(kind) if pa.types.is_timestamp(kind) and kind.tz else values.cast(kind)


def erase(files: FileSet, victims: dict[str, DataFrame]) -> DataFrame:
    """Rewrites the files that hold victims; one row a file that is left, as in REPORT.

    victims: column -> a DataFrame with that column; a row goes if any of its columns holds a victim's value.
    """
    if files.report.isEmpty():
        return files.report
    chunk = F.expr(f"place div {CHUNK}").alias("chunk")
    keys = None
    for nth, (column, values) in enumerate(victims.items()):
        at = f"c{files.columns.index(column)}"
        # A stretch's clients are few, since rows are ordered by client; each counts once before the join.
        there = _read(files).where(F.col(at).isNotNull()).select("file_no", chunk, F.col(at).alias("key")).distinct()
        # An inner join: a semi-join would be moved before the distinct, where a client's rows meet.
        found = there.join(values.select(F.col(column).alias("key")).distinct(), "key").select("file_no", "chunk", F.lit(nth).alias("nth"), F.col("key").cast("string").alias("key"))
        keys = found if keys is None else keys.unionByName(found)
    keys = materialize(keys, f"victims-{files.name}")
    hit = sorted(r[0] for r in keys.select("file_no").distinct().collect())  # the files of a table are bounded
    if not hit:
        return files.report
    places, schema, money = [files.columns.index(c) for c in victims], _arrow(files.columns, files.kinds), files.money
    folder, work, name = files.folder, files.work, files.name
    rows = _read(files, [_path(folder, name, k) for k in hit])
    rows = rows.select("file_no", chunk, "place", *(_text(kind, f"c{k}") for k, kind in enumerate(files.kinds)))

    def strike(group: tuple, rows: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        gone = np.zeros(len(rows), bool)
        for nth, k in enumerate(places):
            gone |= rows[f"c{k}"].isin(keys.key[keys.nth == nth]).to_numpy(bool)
        left = rows[~gone].sort_values("place")
        piece = None
        if len(left):
            piece = f"{work}/{name}-{group[0]}-{group[1]}-{uuid.uuid4().hex}.parquet"
            file = SortedFile(piece, schema, money)
            file.add(pa.RecordBatch.from_arrays([_values(left[f"c{k}"], kind) for k, kind in enumerate(schema.types)], schema=schema))
            file.close()
        return pd.DataFrame({"file_no": [group[0]], "chunk": [group[1]], "n_erased": [int(gone.sum())], "piece": [piece]})

    pieces = rows.groupBy("file_no", "chunk").cogroup(keys.groupBy("file_no", "chunk")).applyInPandas(strike, "file_no long, chunk long, n_erased long, piece string")
    pieces = materialize(pieces, f"pieces-{files.name}")  # no old file is touched before all pieces are written
    whole = pieces.groupBy("file_no").agg(F.sum("n_erased").alias("n_erased"), F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("chunk", "piece")))).alias("pieces"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, erased, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                path = _path(folder, name, file_no)
                if not parts:
                    fs, old = place(path)
                    if fs.get_file_info(old).type != pyarrow.fs.FileType.NotFound:
                        fs.delete_file(old)
                    continue
                file = SortedFile(f"{work}/{name}-{file_no}-{uuid.uuid4().hex}.parquet", schema, money)
                for part in parts:
                    fs, piece = place(part["piece"])
                    with fs.open_input_file(piece) as source:
                        for got in pq.ParquetFile(source).iter_batches(batch_size=8_192):
                            file.add(got)
                yield _done(file, file_no, path, erased, True)

    rewritten = materialize(whole.repartition("file_no").select("file_no", "n_erased", "pieces").mapInArrow(assemble, REPORT), f"rewritten-{files.name}")
    return files.report.where(~F.col("file_no").isin(hit)).unionByName(rewritten)


def erase_masters(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, share: int = 400, files: int = FILES) -> DataFrame:
    """Writes the four tables into a new folder and erases the victims of victim_masters() from them; one row a file that is left."""
    spark = clients.sparkSession
    run = uuid.uuid4().hex
    folder, work = (f"{shared_dir(spark).rstrip('/')}/{x}-{run}" for x in ("erasure", "erasure-work"))
    owner = sales.where(F.col("sale_id").isNotNull()).groupBy(F.col("sale_id").alias("__sale")).agg(F.min("client_id").alias("__client"))
    owner = materialize(owner, "owners")  # read plainly on both sides, so that Spark can split a sale that very many lines have
    lines = sale_lines.join(owner, F.col("sale_id") == F.col("__sale"), "left").drop("__sale")
    masters = materialize(victim_masters(clients, clicks, share), "victim-masters")
    ids = materialize(clients.join(masters, "master_id", "left_semi").where(F.col("client_id").isNotNull()).select("client_id").distinct(), "victim-clients")
    sold = sales.join(ids, "client_id", "left_semi").where(F.col("sale_id").isNotNull()).select("sale_id").distinct()
    jobs = [
        (clients, "clients", "balance", client_order(F.col("client_id")), {"client_id": ids, "master_id": masters}),
        (clicks, "clicks", "value", client_order(F.col("client_id")), {"client_id": ids}),
        (sales, "sales", "total", client_order(F.col("client_id")), {"client_id": ids}),
        (lines, "sale_lines", "amount", client_order(F.col("__client")), {"sale_id": sold}),
    ]
    out = None
    for df, name, money, first, victims in jobs:
        written = write_sorted(df, name, money, folder, work, first, files)
        left = erase(written, victims).withColumns({"table_name": F.lit(name), "columns": F.lit(",".join(written.columns))})
        out = left if out is None else out.unionByName(left)
    report = materialize(out, "erased")
    _delete(spark, work)
    return report


def erasure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("clients", "clicks", "sales", "sale_lines"))
    return erase_masters(*tables)
