"""Keyed state over arriving answers: field extraction, ordered events with retraction, and de-duplication in time.

Each operator has a batch twin in ``events``; however the stream is cut into micro-batches, and
wherever it is stopped and started again from its checkpoint, the rows at its end are the twin's.
State lives in Spark's state store (RocksDB), one entry for each key and held-back piece.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundwork.streaming import events
from groundwork.streaming.events import FieldReader

# Spark starts the process that sets up a stream's processors without the driver's module path: they travel whole.
cloudpickle.register_pickle_by_value(events)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class _Field(StatefulProcessor):
    """Pieces of a key go to its reader in the order of seq; a piece that came before its turn waits in the map."""

    def __init__(self, key: str, seq: str, chunk: str, field: str, patience_ms: int) -> None:
        self.names, self.field, self.patience = (key, seq, chunk), field, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reader = handle.getValueState("reader", "buffer string, inside boolean, done boolean, next long, waiting long")
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Every call of the store is a message to the JVM: pieces whose turn comes in this call do not go through it."""
        _, seq, chunk = self.names
        reader, turn, stored = self._open()
        out, came = [], {}
        for frame in rows:
            for n, piece in zip(frame[seq].tolist(), frame[chunk].tolist(), strict=True):
                if n >= turn:  # one that has had its turn is a repeat of it
                    came[int(n)] = piece if isinstance(piece, str) else ""
        while True:
            if stored and self.waiting.containsKey((turn,)):
                piece = came.pop(turn, None)  # of a repeated piece the one that came last
                piece = self.waiting.getValue((turn,))[0] if piece is None else piece
                self.waiting.removeKey((turn,))
                stored -= 1
            elif turn in came:
                piece = came.pop(turn)
            else:
                break
            out.append((turn, reader.feed(piece)))
            turn += 1
        for n, piece in came.items():
            stored += not (stored and self.waiting.containsKey((n,)))
            self.waiting.updateValue((n,), (piece,))
        self._close(reader, turn, stored)
        if self.patience:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Nothing has come for too long: what waits is read without the pieces that are missing, and the key is forgotten."""
        reader, *_ = self._open()
        waiting = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        out = [(n, reader.feed(piece)) for n, piece in waiting]
        self.waiting.clear()
        self.reader.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _open(self) -> tuple[FieldReader, int, int]:
        """The key's reader, the piece whose turn it is, and how many wait."""
        reader, turn, stored = FieldReader(self.field), 0, 0
        if (held := self.reader.get()) is not None:
            reader.buffer, reader.inside, reader.done, turn, stored = held
        return reader, turn, stored

    def _close(self, reader: FieldReader, turn: int, stored: int) -> None:
        self.reader.update((reader.buffer if not reader.done else "", reader.inside, reader.done, turn, stored))

    def _frame(self, key: tuple, out: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({self.names[0]: pd.Series([key[0]] * len(out), dtype=object), self.names[1]: [n for n, _ in out], "added": pd.Series([t for _, t in out], dtype=object)})


def extracted_field_stream(chunks: DataFrame, key: str, seq: str, chunk: str, field: str, at: str | None = None, patience_ms: int = 0) -> DataFrame:
    """``events.extracted_field`` over a stream of pieces, numbered from 0 without gaps in each key.

    A piece that comes early waits for those before it; a repeated piece is left out. With an
    event time `at` (under a watermark) and `patience_ms`, a key of which nothing has come for so
    long after the watermark gives out what waits, without the missing pieces, and its state goes.
    """
    with_state_store(chunks.sparkSession)
    kinds, timed = dict(chunks.dtypes), bool(at and patience_ms)
    rows = chunks.select(key, F.col(seq).cast("long").alias(seq), chunk, *([at] if timed else []))
    processor = _Field(key, seq, chunk, field, patience_ms if timed else 0)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kinds[key]}, {seq} long, added string", "Append", "EventTime" if timed else "None")


class _Shown(StatefulProcessor):
    """What a reader sees: the tokens after the last `invalidate`, by seq; each change is a row of a higher version."""

    def __init__(self, key: str, seq: str) -> None:
        self.names = (key, seq)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "cut long, version long, shown boolean")
        self.tokens = handle.getMapState("tokens", "seq long", "payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.head.get()
        cut, version, shown = held if held is not None else (-(1 << 62), 0, False)
        before, came = cut, {}
        for frame in rows:
            for n, kind, payload in zip(frame[self.names[1]].tolist(), frame["kind"].tolist(), frame["payload"].tolist(), strict=True):
                if kind == "invalidate":
                    cut = max(cut, n)
                elif kind == "token" and n > cut:
                    came[int(n)] = payload if isinstance(payload, str) else ""
        # Every call of the store is a message to the JVM: tokens that this call retracts do not go through it.
        came = {n: payload for n, payload in came.items() if n > cut}
        tokens = {k[0]: v[0] for k, v in self.tokens.iterator()} if shown else {}
        for n in [n for n in tokens if n <= cut]:
            self.tokens.removeKey((n,))
            del tokens[n]
        for n, payload in came.items():
            self.tokens.updateValue((n,), (payload,))
        tokens |= came
        text, any_token = "".join(v for _, v in sorted(tokens.items())), bool(tokens)
        self.head.update((cut, version + 1, any_token))
        # A text that was shown and is no more is retracted by an empty one.
        if any_token or shown:
            yield pd.DataFrame({self.names[0]: pd.Series([key[0]], dtype=object), "version": [version + 1], "text": pd.Series([text], dtype=object), "retracted": [shown and cut > before], "empty": [not any_token]})

    def close(self) -> None:
        pass


def shown_text_stream(events: DataFrame, key: str, seq: str) -> DataFrame:
    """``events.event_order`` over a stream of (key, seq, kind, payload): (key, version, text, retracted, empty), the highest version holds.

    Events may come in any order and more than once. `retracted` marks a version that takes back
    text shown before, `empty` one after which nothing is shown (such a key is not in the batch result).
    """
    with_state_store(events.sparkSession)
    kinds = dict(events.dtypes)
    rows = events.select(key, F.col(seq).cast("long").alias(seq), "kind", "payload")
    return rows.groupBy(key).transformWithStateInPandas(_Shown(key, seq), f"{key} {kinds[key]}, version long, text string, retracted boolean, empty boolean", "Append", "None")


def latest(versions: DataFrame, key: str) -> DataFrame:
    """(key, text) as the highest version of each key has it."""
    return versions.groupBy(key).agg(F.max_by(F.struct("text", "empty"), "version").alias("v")).where("not v.empty").select(key, "v.text")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n): a key's events no further than `gap` apart; on a stream with `late` as its watermark."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if late else rows
    out = rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def first_of_day_stream(events: DataFrame, kind: str, at: str, late: str) -> DataFrame:
    """(kind, day): what a daily cache would fetch, once for each kind and day, from a stream; state goes with the watermark.

    The day is the event time itself, so that a repeat within the day is told however late it comes within `late`.
    """
    day = F.date_trunc("day", F.col(at).cast("timestamp"))
    return events.select(kind, day.alias("day")).withWatermark("day", late).dropDuplicatesWithinWatermark([kind, "day"]).select(kind, F.col("day").cast("date").alias("day"))
