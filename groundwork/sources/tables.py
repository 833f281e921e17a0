"""Scans and sinks: Parquet tables, JSON lines with quarantined rows, front matter, resumable appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import sse_blocks
from groundwork.sources.shared import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows with file name and text) of JSON-lines files; the schema is given, never inferred."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # The corrupt column alone can't be filtered on a raw JSON scan, so rows are parsed from text.
    lines = spark.read.text(paths).where(F.length(F.trim("value")) > 0).select("value", F.input_file_name().alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    return parsed.where(~broken).select(*(F.col(f"row.{f.name}") for f in schema.fields)), parsed.where(broken).select("file", "value")


def event_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, seq, event, data) of landed files of server-sent events, one answer in a file, whole when it lands.

    As a stream the same rows come as files do; which files have been read is the source's offset, so
    it goes on after a restart. A last block counts though no empty line ends it.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(sse_blocks(F.regexp_replace("value", r"\r\n?", "\n"), ended=True)).alias("seq", "block")).select("file", "seq", "block.event", "block.data")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of Markdown files that begin with `key: value` lines between two lines of dashes."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(": "))
    meta = F.map_from_arrays(F.transform(pairs, lambda x: F.split_part(x, F.lit(": "), F.lit(1))), F.transform(pairs, lambda x: F.regexp_replace(x, r"^[^:]*: ", "")))
    return files.select("path", meta.alias("meta"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def unfinished(golden: DataFrame, partial: DataFrame, key: str) -> DataFrame:
    """Rows of a run that a partial result does not hold yet."""
    return golden.join(partial.select(key).distinct(), key, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """current with the rows of changes in place of those with the same key.

    Of changes that repeat a key the one with the largest `at` counts (a null one least), of several such, or
    without `at`, the largest row, column by column; changes without a key are left out.
    """
    row = F.struct(*([F.col(at).alias("at")] if at else []), F.struct(*changes.columns).alias("row"))
    once = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("last")).select("last.row.*")
    return current.join(once.select(key), key, "left_anti").unionByName(once)


def flat_keys(bundles: DataFrame, lang: str, body: str, levels: int = 6) -> DataFrame:
    """(lang, key, value) of JSON bundles: nested keys joined by dots, as deep as they go.

    `levels` of nesting are undone in one plan; only where some are left is the rest settled and gone on with.
    """
    level = bundles.select(lang, F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))
    inner = F.coalesce(F.col("value").startswith("{"), F.lit(False))
    leaves = []
    while True:
        for _ in range(levels):
            leaves.append(level.where(~inner))
            below = level.where(inner).select(lang, F.col("key").alias("up"), F.explode(F.from_json("value", "map<string,string>")).alias("under", "value"))
            level = below.select(lang, F.concat_ws(".", "up", "under").alias("key"), "value")
        if level.where(inner).isEmpty():
            return reduce(DataFrame.unionByName, [*leaves, level])
        level = settled(level, "keys")


def sniffed_extension(content: Column, content_type: Column) -> Column:
    """File type by leading bytes, else by the declared content type."""
    lead = F.hex(F.substring(content, 1, 8))
    return (
        F.when(lead.startswith("25504446"), "pdf")
        .when(lead.startswith("D0CF11E0A1B11AE1"), "hwp")
        .when(lead.startswith("504B0304"), "zip")
        .when(content_type.contains("html"), "html")
        .when(content_type.contains("json"), "json")
        .otherwise("html")
    )
