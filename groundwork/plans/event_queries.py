"""Queries over events: freshness, caches, order, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.rules import latest_quote
from groundwork.sources.tables import table
from groundwork.streaming import events as S


def latest_rate(spark: SparkSession, sf: str) -> DataFrame:
    quotes = table(spark, sf, "events").groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    return latest_quote(quotes, ["event_type"], "ts", "value").select("event_type", "value", "ts")


LATEST_RATE = "SELECT event_type, max_by(value, ts) AS value, max(ts) AS ts FROM (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1"


def ttl_last_good(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return S.last_good(rows, "user_id", "ts", "value", 24)


TTL_LAST_GOOD = """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events),
g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'t': ts, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM e)
SELECT event_id, user_id, CASE WHEN ts <= l.t + INTERVAL 24 HOURS THEN l.v END AS value, v IS NULL AND ts <= l.t + INTERVAL 24 HOURS AS reused FROM g
"""


def ttft(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_token_delay(table(spark, sf, "events"), "user_id", "ts", "event_type", "click", "view")


TTFT = """
WITH b AS (SELECT user_id, min(ts) AS begun FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, epoch_us(min(ts)) - epoch_us(any_value(begun)) AS micros FROM events JOIN b USING (user_id) WHERE event_type = 'view' AND ts >= begun GROUP BY 1
"""


def daily_cache(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_of_day(table(spark, sf, "events"), "event_type", "ts")


DAILY_CACHE = "SELECT event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id, count(*) AS hits FROM events GROUP BY 1, 2"


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "1 day")


WINDOW_COUNTS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def partial_json(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit("B").alias("tier"), F.col("text").alias("answer")))
    pieces = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(F.regexp_extract_all(body, F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "piece"))
    return S.extracted_field(pieces, "id", "seq", "piece", "answer").groupBy("id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "added"))), lambda x: x["added"]), ""), 256).alias("sha256"))


PARTIAL_JSON = "SELECT conv_id || '-' || turn AS id, sha256(text) AS sha256 FROM conversations"


def event_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 17 == 0, "invalidate").otherwise("token").alias("kind"), (F.col("event_id") % 10).cast("string").alias("payload"))
    return S.event_order(rows, "user_id", "event_id")


EVENT_ORDER = """
WITH c AS (SELECT user_id, max(event_id) FILTER (event_id % 17 = 0) AS cut FROM events GROUP BY 1)
SELECT user_id, string_agg(CAST(event_id % 10 AS VARCHAR), '' ORDER BY event_id) AS text FROM events JOIN c USING (user_id) WHERE event_id % 17 <> 0 AND (cut IS NULL OR event_id > cut) GROUP BY 1
"""

QUERIES = {
    "q_latest_rate": (latest_rate, LATEST_RATE), "q_ttl_last_good": (ttl_last_good, TTL_LAST_GOOD), "q_ttft": (ttft, TTFT), "q_daily_cache": (daily_cache, DAILY_CACHE),
    "q_window_counts": (window_counts, WINDOW_COUNTS), "q_partial_json": (partial_json, PARTIAL_JSON), "q_event_order": (event_order, EVENT_ORDER),
}
