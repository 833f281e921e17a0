"""Event order, freshness and incremental extraction: batch forms and their streaming twins."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_good(quotes: DataFrame, by: str, at: str, value: str, ttl_hours: int) -> DataFrame:
    """Each event's value, or the last one that was good, with `reused`; null once it is older than the limit."""
    before = Window.partitionBy(by).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    good = F.last(F.when(F.col(value).isNotNull(), F.struct(at, value)), ignorenulls=True).over(before)
    rows = quotes.withColumn("_good", good)
    fresh = F.col(at) <= F.col(f"_good.{at}") + F.expr(f"INTERVAL {ttl_hours} HOURS")
    return rows.select("event_id", by, F.when(fresh, F.col(f"_good.{value}")).alias("value"), (F.col(value).isNull() & fresh).alias("reused"))


def first_of_day(events: DataFrame, kind: str, at: str) -> DataFrame:
    """One event for each kind and day: what a daily cache would fetch."""
    return events.groupBy(kind, F.to_date(at).alias("day")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("hits"))


def first_token_delay(events: DataFrame, key: str, at: str, kind: str, start: str, token: str) -> DataFrame:
    """Seconds from a key's first `start` to its first `token` after it."""
    begun = events.where(F.col(kind) == start).groupBy(key).agg(F.min(at).alias("begun"))
    after = events.where(F.col(kind) == token).join(begun, key).where(F.col(at) >= F.col("begun"))
    return after.groupBy(key).agg(F.min(at).alias("first"), F.first("begun").alias("begun")).select(key, (F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))).alias("micros"))


def windowed_counts(events: DataFrame, at: str, kind: str, length: str, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows; on a stream with `late` as its watermark."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if late else rows
    out = rows.groupBy(F.window(at, length), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet, and wait for its end."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet").awaitTermination()


class FieldReader:
    """Reads one string field of a JSON object that comes in pieces of any size."""

    ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, field: str) -> None:
        self.head, self.buffer, self.inside, self.done = json.dumps(field), "", False, False

    def feed(self, piece: str) -> str:
        """What the piece adds to the field's text."""
        if self.done:
            return ""
        self.buffer += piece
        if not self.inside:
            at = self.buffer.find(self.head)
            rest = self.buffer[at + len(self.head) :].lstrip() if at >= 0 else ""
            if not rest.startswith(":") or not rest[1:].lstrip().startswith('"'):
                return ""
            self.inside, self.buffer = True, rest[1:].lstrip()[1:]
        out, k = [], 0
        while k < len(self.buffer):
            c = self.buffer[k]
            if c == '"':
                self.done = True
                break
            if c != "\\":
                out.append(c)
                k += 1
                continue
            size = 2 if self.buffer[k + 1 : k + 2] != "u" else 6
            if self.buffer[k + 2 : k + 4].lower() in ("d8", "d9", "da", "db") and size == 6:
                size = 12  # the first half of a surrogate pair waits for the second
            if len(self.buffer) < k + size:
                break
            part = self.buffer[k : k + size]
            out.append(json.loads(f'"{part}"') if size > 2 else self.ESCAPES.get(part[1], part[1]))
            k += size
        self.buffer = self.buffer[k:]
        return "".join(out)


def extracted_field(chunks: DataFrame, key: str, seq: str, chunk: str, field: str) -> DataFrame:
    """(key, seq, added): what each piece of a stream adds to a field, the pieces of a key in order.

    A key's pieces are one answer, so they fit one group; a piece that is null adds nothing.
    """

    @F.pandas_udf("array<string>")
    def added(pieces: pd.Series) -> pd.Series:
        def read(answer: Iterable[str | None]) -> list[str]:
            reader = FieldReader(field)
            return [reader.feed(x) if isinstance(x, str) else "" for x in answer]

        return pieces.map(read)

    # Many answers go to Python in one batch, not one by one.
    in_order = F.array_sort(F.collect_list(F.struct(F.col(seq).isNull().alias("last"), F.col(seq).alias("seq"), F.col(chunk).alias("chunk"))))
    answers = chunks.groupBy(key).agg(in_order.alias("pieces")).select(key, "pieces", added(F.transform(F.col("pieces"), lambda x: x["chunk"])).alias("added"))
    return answers.select(key, F.explode(F.arrays_zip("pieces", "added")).alias("x")).select(key, F.col("x.pieces.seq").alias(seq), "x.added")


def event_order(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The text a reader sees at last: tokens in order, all before the last `invalidate` retracted."""
    cut = events.groupBy(key).agg(F.max(F.when(F.col("kind") == "invalidate", F.col(seq))).alias("cut"))
    shown = events.join(cut, key).where((F.col("kind") == "token") & (F.col("cut").isNull() | (F.col(seq) > F.col("cut"))))
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "payload"))), lambda x: x["payload"]), "").alias("text"))
