"""The same state as a stream: verdict logs folded to the latest row, grades upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from verisect.operators.metrics import latest_per_id
from verisect.sources.tables import Table, latest_by


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """An append-only folder of JSON lines as a stream; a bad line is fatal."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_stream(stream: DataFrame, table: Table, order: Column, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Upserts each batch's last row per key. A batch that runs again writes the same rows, so the table ends the same."""

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(latest_by(prepare(batch), table.keys, order))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current_verdicts(table: Table) -> DataFrame:
    """The verdicts that stand: ids whose last row is `clear` are gone."""
    rows = table.read()
    return latest_per_id(rows, table.keys[0], F.col("ts"), F.col("verdict") == "clear")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by time window and keys; rows later than `late` behind the newest are left out of closed windows.

    An addition for streams: batch pipelines have no event time.
    """
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
