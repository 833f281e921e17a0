"""Queries that run as streams over the given tables to their end, through keyed state and a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.plans.event_queries import EVENT_ORDER, PARTIAL_JSON
from groundwork.sources.shared import new_folder
from groundwork.sources.tables import table
from groundwork.streaming import stateful as S
from groundwork.streaming.events import drained


def arriving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream; the path is a pattern, since the source takes a plain one for a folder, and a table may be one file."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def ended(stream: DataFrame, kind: str) -> DataFrame:
    """All that the stream gives over what is there now."""
    folder = new_folder(stream.sparkSession, kind)
    drained(stream, f"{folder}/rows", f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_fields(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit("B").alias("tier"), F.col("text").alias("answer")))
    pieces = arriving(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(F.regexp_extract_all(body, F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "piece"))
    found = ended(S.extracted_field_stream(pieces, "id", "seq", "piece", "answer"), "fields")
    return found.groupBy("id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "added"))), lambda x: x["added"]), ""), 256).alias("sha256"))


def stream_order(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 17 == 0, "invalidate").otherwise("token").alias("kind")
    rows = arriving(spark, sf, "events").select("user_id", "event_id", kind, (F.col("event_id") % 10).cast("string").alias("payload"))
    return S.latest(ended(S.shown_text_stream(rows, "user_id", "event_id"), "order"), "user_id")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")


SESSIONS = """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS fresh FROM events),
s AS (SELECT user_id, ts, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k
"""

QUERIES = {"q_stream_fields": (stream_fields, PARTIAL_JSON), "q_stream_order": (stream_order, EVENT_ORDER), "q_sessions": (sessions, SESSIONS)}
