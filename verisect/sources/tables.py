"""Tables with keys on plain Parquet: upsert, insert-if-absent, append, document patches and schema evolution.

A table is a folder of numbered versions; a write adds a version with its own rows, and a version counts once Spark has
committed it (its _SUCCESS file is there).  Readers and lost executors never see half a write, two writers never have the
same number, and older versions stay as snapshots.  All paths go through Spark's file systems.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def workspace(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is configured, local mode gets one under /tmp; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or f"file:///tmp/verisect-{os.getuid()}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: what is used several times survives lost executors."""
    path = scratch(df.sparkSession, name)
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that stored() has written, until cleanup().
WRITTEN: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Deletes what stored() has written; for when no result that was made so far will be read any more."""
    while WRITTEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it doesn't exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


ENTRY = re.compile(r"v(\d{6,})(?:-(base|upsert|insert|append))?")
MERGED = ("_version", "_kind")


class Table:
    """A keyed table of a fixed schema; older versions may lack columns, which read as null.

    A version is a whole table (`v000001`), or a delta: rows to upsert, to insert if absent, or to append.  Reading merges
    the deltas since the last whole table into it, in the order of their versions; compact() writes that down.  So a write
    costs its own rows, and a reader pays for the deltas until they are compacted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = spark.createDataFrame([], schema).schema

    def entries(self) -> list[tuple[int, str]]:
        """version and kind of every committed write, in order; a compacted table comes after the delta that it ends with."""
        found = [(int(m[1]), m[2] or "whole", n) for n in listing(self.spark, self.path) if (m := ENTRY.fullmatch(n))]
        found = [(v, kind) for v, kind, n in found if exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(found, key=lambda e: (e[0], e[1] == "base"))

    def versions(self) -> list[int]:
        return sorted({v for v, _ in self.entries()})

    def _folder(self, version: int, kind: str) -> str:
        return f"{self.path}/v{version:06d}" + ("" if kind == "whole" else f"-{kind}")

    def _load(self, version: int, kind: str) -> DataFrame:
        stored = self.spark.read.parquet(self._folder(version, kind))
        return stored.select(*(F.col(f.name).cast(f.dataType) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its latest version, or of a given one, in its schema."""
        known = [e for e in self.entries() if version is None or e[0] <= version]
        if version is not None and version not in {v for v, _ in known}:
            raise ValueError(f"{self.path} has no version {version}")
        whole = next((k for k in range(len(known) - 1, -1, -1) if known[k][1] in ("whole", "base")), None)
        base = self.spark.createDataFrame([], self.schema) if whole is None else self._load(*known[whole])
        # A delta that is older than the table it was compacted into is in it already.
        deltas = [e for e in known[(whole + 1 if whole is not None else 0) :] if whole is None or e[0] > known[whole][0]]
        return self._merged(base, deltas) if deltas else base

    def _merged(self, base: DataFrame, deltas: list[tuple[int, str]]) -> DataFrame:
        """The base with deltas: a key's last upsert replaces what came before; an insert counts only where nothing did."""
        names = self.schema.names
        if all(kind == "append" for _, kind in deltas):
            out = base
            for v, kind in deltas:
                out = out.unionByName(self._load(v, kind))
            return out
        changes = None
        for v, kind in deltas:
            part = self._load(v, kind).withColumns({MERGED[0]: F.lit(v), MERGED[1]: F.lit(kind)})
            changes = part if changes is None else changes.unionByName(part)
        of_key = Window.partitionBy(*self.keys)
        upserted = F.coalesce(F.max(F.when(F.col(MERGED[1]) == "upsert", F.col(MERGED[0]))).over(of_key), F.lit(0))
        changes = changes.withColumns({"_upserted": upserted, "_first": F.min(MERGED[0]).over(of_key)})
        live = changes.where(f"{MERGED[0]} >= _upserted AND ({MERGED[1]} <> 'insert' OR {MERGED[0]} = _first)")
        others = live.where(f"{MERGED[1]} <> 'insert'").select(*names)
        inserted = live.where(f"{MERGED[1]} = 'insert'").select(*names)
        kinds = {kind for _, kind in deltas}
        kept = base.join(changes.where("_upserted > 0").select(*self.keys).distinct(), self.keys, "left_anti").select(*names) if "upsert" in kinds else base
        out = kept.unionByName(others)
        return out.unionByName(inserted.join(base.select(*self.keys), self.keys, "left_anti").select(*names)) if "insert" in kinds else out

    def _claim(self) -> int:
        """A version number of this writer's own: whoever makes its mark first has it, and others take the next one."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims")
        files = marks.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(marks)
        taken = [int(n) for n in listing(self.spark, f"{self.path}/_claims") if n.isdigit()]
        version = max([0, *taken, *(int(m[1]) for n in listing(self.spark, self.path) if (m := ENTRY.fullmatch(n)))]) + 1
        while True:
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{version}")
            try:
                files.create(mark, False).close()
                return version
            except Exception:  # taken meanwhile, if it is there now
                if not files.exists(mark):
                    raise
                version += 1

    def _write(self, rows: DataFrame, kind: str) -> None:
        rows.select(*self.schema.names).write.mode("error").parquet(self._folder(self._claim(), kind))

    def replace(self, rows: DataFrame) -> None:
        """A new version with exactly these rows."""
        self._write(rows, "whole")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with the same keys; of several new rows of a key one counts, and which isn't defined."""
        self._write(rows.dropDuplicates(self.keys), "upsert")

    def insert_absent(self, rows: DataFrame) -> None:
        """Only rows whose keys aren't there yet, at their turn among all writes."""
        self._write(rows, "insert")

    def append(self, rows: DataFrame) -> None:
        """All rows, whatever their keys."""
        self._write(rows, "append")

    def compact(self) -> None:
        """Writes down what the versions up to now make together; writers may go on meanwhile.

        Only versions before the first one that is claimed but not committed are taken in, so that no write gets lost.
        """
        entries = self.entries()
        done = {v for v, _ in entries}
        waiting = sorted(int(n) for n in listing(self.spark, f"{self.path}/_claims") if n.isdigit() and int(n) not in done)
        upto = max((v for v in done if not waiting or v < waiting[0]), default=0)
        if upto and (upto, "base") not in entries and (upto, "whole") not in entries:
            self.read(upto).write.mode("error").parquet(self._folder(upto, "base"))

    def abandon(self, version: int) -> None:
        """Gives up a version whose writer is known to be dead, so that compact() doesn't wait for it."""
        if version not in self.versions():
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{version}")
            mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(mark, False)

    def patch_map(self, column: str, patch: DataFrame) -> None:
        """Merges `patch` (keys and a map) into a map column: its entries win, null values remove a key. Only patched rows are written."""
        rows = self.read().join(patch.withColumnRenamed(column, "_patch"), self.keys)
        none = F.expr("cast(map() as map<string,string>)")
        base, new = F.coalesce(column, none), F.coalesce("_patch", none)
        merged = F.map_filter(F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new), lambda k, v: v.isNotNull())
        self.upsert(rows.withColumn(column, merged).drop("_patch"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
