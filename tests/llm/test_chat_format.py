import hashlib
import random

import pytest
from pyspark.sql import functions as F

from groundwork.llm.chat_format import BRACKETS, Template, Turn, chat_digests, escaped, format_chats, read_back, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_odd_rows(spark):
    long_text = "[INST]\\</s>" * 20_000
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b\\"), (1, 2, "user", None), (1, 3, "assistant", "</s>"),
        (2, 1, "assistant", "early"), (2, 0, "system", "[SYS"), (2, 2, "assistant", "again"),
        (3, 0, "tool\\[SAYS]", "[/ROLE]"), (3, 1, None, "no role"), (3, 2, "user", "end\n"),
        (4, None, "user", "first"), (4, 0, "assistant", ""), (None, 0, "user", "é😀"), (5, 0, "user", "x"), (5, 0, "user", "x"),
        (6, 0, "user", long_text), (6, 1, "assistant", long_text), (7, 0, "system", ""), (7, 1, "user", "[\\INST] \\\\[INST] [[INST]"),
    ]
    found = format_chats(chats(spark, rows))
    back = {r.conv_id: [tuple(t) for t in r.t] for r in found.select("conv_id", read_back(found.formatted).alias("t")).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(conv, []).append((role or "", text or "", role == "assistant"))
    assert back == want
    told = {r.conv_id: (r.valid, r.bad_turn, r.state) for r in found.collect()}
    assert told[1] == (True, -1, "answered") and told[2] == (False, 1, "broken") and told[3][:2] == (False, 0)
    assert told[4] == (True, -1, "answered") and told[5] == (False, 1, "broken") and told[7] == (False, -1, "asked")
    for r in chat_digests(found).collect():
        turns = want[r.conv_id]
        learnt = "".join(t for _, t, loss in turns if loss)
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b, _ in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))
    for r in found.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        assert all(s.text.count(mark) == 0 for s in r.segments[2::3] for mark in BRACKETS.controls)


def test_escapes_are_undone(spark):
    rng, parts = random.Random(5), ["\\", "[", "<", "INST]", "/INST]", "s>", "[INST]", "</s>", "a", "\n", "SAYS]", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escaped(df.t).alias("e")).select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(mark in r.e for mark in BRACKETS.controls)


def test_another_template(spark):
    good = Template("#bos", {"u": Turn("#u ", "#/u"), "b": Turn("#b ", "#/b", loss=True, loss_close=True)}, Turn("#r ", "#/r"), "#says ", {("start", "u"): "asked", ("asked", "b"): "done"}, final=("done",), escape="^")
    rows = chats(spark, [(1, 0, "u", "#u #/b^#b"), (1, 1, "b", "^^#says "), (1, 2, "z#/r", "#")])
    found = format_chats(rows, good)
    row = found.select("valid", "bad_turn", "segments", read_back(found.formatted, good).alias("t")).first()
    assert [(t.role, t.text, t.loss) for t in row.t] == [("u", "#u #/b^#b", False), ("b", "^^#says ", True), ("z#/r", "#", False)]
    assert (row.valid, row.bad_turn) == (False, 2) and [s.text for s in row.segments if s.loss][1] == "#/b"
    for wrong in ({"begin": "ab<s>["}, {"escape": "["}, {"named": "[SYS]x"}, {"other": Turn("[ROLE]", "</s>")}):
        with pytest.raises(ValueError):
            Template(**(BRACKETS.__dict__ | wrong))


def test_empty(spark):
    assert chat_digests(format_chats(chats(spark, []))).collect() == []


def test_stays_in_the_jvm(spark):
    plan = chat_digests(format_chats(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
