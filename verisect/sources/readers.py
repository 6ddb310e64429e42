"""Scans: JSON lines, documents, separated values, files by id, markdown tables, examples, cached replies and paged texts."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verisect.functions.udfs import arrow
from verisect.operators.sampling import numbered
from verisect.sources.tables import exists

#: Where a file's rows come from: path, and the row's place in it.
FILE_ID = r"([^/]+?)\.[A-Za-z]+$"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per line; blank lines are skipped and a bad line is fatal."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The same, but a missing file has no rows."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, keep: Column | None = None) -> DataFrame:
    """Tab-separated values with a header, columns by position, filtered."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    return rows if keep is None else rows.where(keep)


def read_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """id, path, body: whole text files, named by their id."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return texts.select(F.regexp_extract("path", FILE_ID, 1).alias("id"), "path", "body")


def latest_files(files: DataFrame) -> DataFrame:
    """One file per id: the one with the last path."""
    return files.groupBy("id").agg(F.max("path").alias("path"), F.max_by("body", "path").alias("body"))


def matching_files(bodies: DataFrame, inputs: DataFrame, current: DataFrame) -> DataFrame:
    """id and body of saved replies whose saved input is still the current passage. current: id, text."""
    saved = inputs.select("id", F.trim("body").alias("_input"))
    return bodies.select("id", "body").join(saved, "id").join(current.select("id", F.trim("text").alias("_now")), "id").where("_input = _now").select("id", "body")


def read_answers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """id and answer of answer files and folders of them: the last line of an id wins, in the order of paths, then lines; rows without an answer don't count."""
    out = None
    for k, path in enumerate(paths):
        # Places within a file follow its bytes; files of a folder follow their names.
        lines = spark.read.text(path).select(F.lit(k).alias("k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
        out = lines if out is None else out.unionByName(lines)
    parsed = out.withColumn("j", F.from_json("value", "id string, answer string")).where(F.col("j.id").isNotNull() & F.get_json_object("value", "$.answer").isNotNull())
    return parsed.groupBy(F.col("j.id").alias("id")).agg(F.max_by(F.col("j.answer"), F.struct("k", "file", "block", "line")).alias("answer"))


def import_examples(rows: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """Examples with stable ids from their order, the source told by digits-only file names, and gold pairs as a map.

    rows: filename, text, spans (array of struct<span, type>).
    """
    placed = numbered(rows, *order)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    gold = F.map_from_entries(F.transform(F.array_distinct(F.transform("spans", lambda s: s["span"])), lambda name: F.struct(name, F.get(F.filter("spans", lambda s: s["span"] == name), F.lit(0))["type"])))
    return placed.select(F.format_string(prefix + "-%04d", F.col("place") + 1).alias("id"), "filename", F.when(stem.rlike("^[0-9]+$"), "brief").otherwise("dahl").alias("source"), "text", gold.alias("gold"))


def select_split(examples: DataFrame, ids: DataFrame) -> DataFrame:
    """The examples whose id is listed in a text file's lines."""
    listed = ids.select(F.trim("value").alias("id")).where("id <> '' AND NOT startswith(id, '#')").distinct()
    return examples.join(listed, "id", "left_semi")


def markdown_rows(text: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows of the first table of each text whose header has all the wanted columns; columns by their header's name.

    text: id, body.
    """
    lines = text.select("id", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("cells", cells)
    has_all = reduce(lambda a, b: a & b, (F.array_contains("cells", w) for w in wanted))
    header = rows.where(has_all).groupBy("id").agg(F.min(F.struct("at", "cells")).alias("h"))
    body = rows.join(header, "id").where((F.col("at") > F.col("h.at")) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$")) & (F.size("cells") == F.size("h.cells")))
    return body.select("id", F.col("at").alias("place"), *(F.get("cells", (F.array_position("h.cells", w) - 1).cast("int")).alias(w) for w in wanted))


def cache_key(tool: Column, args: Column) -> Column:
    """The content address of a call: the SHA-1 of its canonical JSON. args: a struct, whose fields are sorted by the caller's schema."""
    return F.sha1(F.to_json(F.struct(tool.alias("tool"), args.alias("args"))).cast("binary"))


def to_fetch(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct calls that the cache (key, body) doesn't hold."""
    return calls.dropDuplicates(["key"]).join(cache, "key", "left_anti")


def assemble_pages(pages: DataFrame, key: str, most: int = 4) -> DataFrame:
    """key and the text of paged replies: at most `most` pages, joined in the order of their offsets."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("offset", "text"))), 1, most)
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))


def inflate(column: str = "z") -> Column:
    """Texts stored as zlib or raw deflate blobs."""

    def unpack(blob: bytes | None) -> str | None:
        if blob is None:
            return None
        try:
            return zlib.decompress(blob).decode("utf-8", "replace")
        except zlib.error:
            return zlib.decompress(blob, -15).decode("utf-8", "replace")

    return arrow("string")(unpack)(column)


def load_settings(path: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a local file on the driver; the environment wins."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, mark, value = line.strip().partition("=")
                if mark and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    environment = os.environ if environment is None else environment
    return found | {k: environment[k] for k in found if k in environment}


def load_models(path: str) -> dict:
    """A JSON table of models on the driver."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)
