"""Streams with keyed state give the batch rows however they are cut, also when stopped and started again."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundwork.streaming import events as E
from groundwork.streaming import stateful as S

PIECES, EVENTS = "id string, seq int, piece string", "id long, seq long, kind string, payload string"


def land(spark, rows, schema, path, sizes):
    """rows in files of the given numbers of rows, one after the other."""
    start = 0
    for n in sizes:
        spark.createDataFrame(rows[start : start + n], schema).coalesce(1).write.mode("append").parquet(path)
        start += n


def arriving(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def answers():
    rng, rows = random.Random(7), []
    texts = ['say "hi"\n\\ done', "héé 😀   end", "", "plain", "tail \\u0041 " * 20]
    for k, text in enumerate(texts):
        body = json.dumps({"tier": "A", "answer": text, "more": "x"}, ensure_ascii=k % 2 == 0)
        at = n = 0
        while at < len(body):
            size = rng.randint(1, 7)
            rows.append((f"k{k}", n, body[at : at + size]))
            at, n = at + size, n + 1
    rows += [("none", 0, None), ("none", 1, '{"answer"'), ("none", 2, ': "q')]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cuts", [(1000,), (40, 3, 60, 1000)])
def test_field_extraction(spark, tmp_path, cuts):
    rows = answers()
    rows += rows[:5]  # repeats that come later
    path = f"file://{tmp_path}"
    want = sorted(map(tuple, E.extracted_field(spark.createDataFrame(rows[:-5], PIECES), "id", "seq", "piece", "answer").collect()))
    run = lambda: E.drained(S.extracted_field_stream(arriving(spark, PIECES, f"{path}/in"), "id", "seq", "piece", "answer"), f"{path}/out", f"{path}/checkpoint")
    start = 0
    for n in cuts:  # stopped after each file, and started again from the checkpoint
        land(spark, rows[start : start + n], PIECES, f"{path}/in", [n])
        start += n
        run()
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == want


def test_missing_pieces_time_out(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "id string, seq int, piece string, at timestamp"
    rows = [("a", 0, '{"answer": "x', 0), ("a", 2, 'z"}', 0), ("b", 0, '{"answer": "b"}', 600), ("b", 1, " ", 1200), ("b", 2, " ", 1800)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "id string, seq int, piece string, at int").select("id", "seq", "piece", F.timestamp_seconds(F.col("at") + 1_000_000).alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = arriving(spark, schema, f"{path}/in").withWatermark("at", "10 seconds")
    E.drained(S.extracted_field_stream(stream, "id", "seq", "piece", "answer", "at", 60_000), f"{path}/out", f"{path}/checkpoint")
    got = {(r.id, r.seq): r.added for r in spark.read.parquet(f"{path}/out").collect()}
    assert got[("a", 0)] == "x" and got[("a", 2)] == "z" and got[("b", 0)] == "b"


def test_shown_text(spark, tmp_path):
    rng, path = random.Random(2), f"file://{tmp_path}"
    rows = [(k, n, "invalidate" if rng.random() < 0.1 else "token" if rng.random() < 0.9 else "meta", f"{n % 10}") for k in range(12) for n in range(k * 3)] + [(99, 1, "token", "a"), (99, 2, "invalidate", None)]
    rng.shuffle(rows)
    rows += rows[:7]
    want = {r.id: r.text for r in E.event_order(spark.createDataFrame(list(dict.fromkeys(rows)), EVENTS), "id", "seq").collect()}
    start = 0
    for n in (50, 1, 90, len(rows)):
        land(spark, rows[start : start + n], EVENTS, f"{path}/in", [n])
        start += n
        E.drained(S.shown_text_stream(arriving(spark, EVENTS, f"{path}/in"), "id", "seq"), f"{path}/out", f"{path}/checkpoint")
    out = spark.read.parquet(f"{path}/out")
    assert {r.id: r.text for r in S.latest(out, "id").collect()} == want and 99 not in want
    assert out.where("retracted").count() > 0


def test_sessions_and_daily_cache(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "event_id long, ts timestamp, user_id long, event_type string"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    far = spark.sql("SELECT 0L event_id, timestamp'2100-01-01' ts, 0L user_id, 'end' event_type")
    events.repartitionByRange(3, "ts").write.parquet(f"{path}/in")
    far.coalesce(1).write.mode("append").parquet(f"{path}/in")
    E.drained(S.sessions(arriving(spark, schema, f"{path}/in"), "user_id", "ts", "1 hour", "3650 days"), f"{path}/sessions", f"{path}/c1")
    got = spark.read.parquet(f"{path}/sessions").where("start < '2099-01-01'")
    want = S.sessions(events, "user_id", "ts", "1 hour")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    E.drained(S.first_of_day_stream(arriving(spark, schema, f"{path}/in"), "event_type", "ts", "3650 days"), f"{path}/days", f"{path}/c2")
    days = spark.read.parquet(f"{path}/days").where("event_type <> 'end'")
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, E.first_of_day(events, "event_type", "ts").select("event_type", "day").collect()))


def test_event_files(spark, tmp_path):
    """Landed event files give the same rows in a batch and as a stream, which goes on after a restart."""
    from groundwork.sources.tables import event_files

    (tmp_path / "in").mkdir()
    texts = ['event: meta\ndata: {"tier": "A"}\n\nevent: token\ndata: {"t": "hé"}\n\n', 'event: token\r\ndata: {"t": 1}\r\n\r\nevent: token\ndata: {broken\n\ndata: {}\n\nevent: done\ndata: {}', "", "event: x\n\n"]
    path = f"file://{tmp_path}"
    for half in (texts[:2], texts[2:]):
        for text in half:
            n = len(list((tmp_path / "in").iterdir()))
            (tmp_path / "in" / f"answer{n}.txt").write_bytes(text.encode())
        E.drained(event_files(spark, f"{path}/in", stream=True), f"{path}/out", f"{path}/checkpoint")
    want = sorted(map(tuple, event_files(spark, f"{path}/in").collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == want
    assert [(r[0], r[2]) for r in want] == [("answer0.txt", "meta"), ("answer0.txt", "token"), ("answer1.txt", "token"), ("answer1.txt", "done")]


class _Store:
    """A map or value state that counts what goes through it."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self.held[k] = v

    def containsKey(self, k):  # noqa: N802
        self.calls += 1
        return k in self.held

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self.held[k]

    def removeKey(self, k):  # noqa: N802
        self.calls += 1
        del self.held[k]

    def iterator(self):
        self.calls += 1
        return iter(list(self.held.items()))

    def keys(self):
        self.calls += 1
        return iter(list(self.held))


def test_calls_of_the_store():
    """Pieces and tokens that are done with in one call do not go through the store; what waits does, each piece once."""
    field = S._Field("id", "seq", "piece", "answer", 0)
    field.reader, field.waiting = _Store(), _Store()
    text = '{"answer": "' + "ab" * 200 + '"}'
    pieces = [(k, text[k * 7 : k * 7 + 7]) for k in range(-(-len(text) // 7))]

    def feed(some):
        frame = pd.DataFrame(some, columns=["seq", "piece"])
        return "".join("".join(f["added"]) for f in field.handleInputRows(("k",), iter([frame]), None))

    assert feed(pieces) == "ab" * 200
    assert field.reader.calls <= 3 and field.waiting.calls == 0
    field.reader, field.waiting = _Store(), _Store()
    assert feed(pieces[30:40][::-1]) == "" and feed(pieces[35:50]) == "" and len(field.waiting.held) == 20
    assert feed(pieces[:30]) + feed(pieces[48:]) == "ab" * 200 and not field.waiting.held
    shown = S._Shown("user", "seq")
    shown.head, shown.tokens = _Store(), _Store()
    frame = pd.DataFrame([(k, "invalidate" if k == 90 else "token", str(k)) for k in range(100)], columns=["seq", "kind", "payload"])
    (got,) = shown.handleInputRows(("u",), iter([frame]), None)
    assert got["text"].tolist() == ["".join(map(str, range(91, 100)))] and shown.tokens.calls == 9
