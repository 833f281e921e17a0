"""Running sums, ranks and as-of joins over ranges against plain Python, however rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import ordered as O
from groundwork.sources.tables import flat_keys, upsert


@pytest.fixture(params=("1", "3", "16"))
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums(parts):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 1, 2, 5])) for k in range(200)]
    got = {r.k: (r.s, r.n) for r in O.running_sums(parts.createDataFrame([(*r, 1) for r in rows], "g string, k long, v long, part int"), ["g"], ["k"], {"s": "v", "n": "part"}).collect()}
    assert got == {k: (sum(x[2] or 0 for x in rows if x[0] == g and x[1] <= k), sum(x[0] == g and x[1] <= k for x in rows)) for g, k, _ in rows}
    whole = O.running_sums(parts.range(50).select("id", F.lit(2).alias("v")), [], ["id"], {"s": "v"}).collect()
    assert {r.id: r.s for r in whole} == {k: 2 * k + 2 for k in range(50)}


def test_as_of(parts):
    rng = random.Random(2)
    left = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for k in range(150)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(5, 60, 3)]), float(rng.randint(1, 9)) if k % 9 else None) for k in range(40)]
    a, b = parts.createDataFrame(left, "at long, g string, day int"), parts.createDataFrame(right, "g string, quoted int, rate double")

    def latest(g, day):
        known = [r for r in right if r[0] == g and r[1] is not None and day is not None and r[1] <= day]
        return max(known, key=lambda r: (r[1], -1 if r[2] is None else r[2]), default=None)

    got = {r["at"]: None if r.q is None else tuple(r.q) for r in O.as_of(a, b, ["g"], "day", "quoted", "q").collect()}
    assert got == {k: latest(g, day) for k, g, day in left}
    assert O.as_of(a, b.limit(0), ["g"], "day", "quoted", "q").where("q is not null").count() == 0 and O.as_of(a.limit(0), b, ["g"], "day", "quoted", "q").count() == 0


def test_as_of_meets_no_row_with_every_earlier_one(spark):
    a, b = spark.range(10).select("id", F.col("id").alias("day")), spark.range(10).select(F.col("id").alias("quoted"))
    plan = O.as_of(a, b, [], "day", "quoted", "q")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranks(parts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, 1.5, 2.0, 2.0, 7.25, 9.0])) for _ in range(100)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95}
    got = {r.g: (r.n, r.p0, r.p50, r.p95) for r in O.ranks_of(parts.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    for g in ("a", "b"):
        values = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g] == (len(values), *(values[int(len(values) * s)] for s in shares.values()))


def test_keys_of_any_depth(spark):
    deep = '"x"'
    for k in range(15):
        deep = f'{{"k{k}": {deep}, "n{k}": {k}}}'
    got = {r.key: r.value for r in flat_keys(spark.createDataFrame([("ko", deep)], "lang string, body string"), "lang", "body").collect()}
    assert len(got) == 16 and got[".".join(f"k{k}" for k in reversed(range(15)))] == "x" and got["n14"] == "14"


def test_upsert_takes_the_latest(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    changes = spark.createDataFrame([(2, "z", 5), (2, "c", 9), (3, "d", None), (3, "e", 0), (None, "n", 1)], "k int, v string, at int")
    assert sorted(map(tuple, upsert(now, changes, "k", "at").collect())) == [(1, "a", 1), (2, "c", 9), (3, "e", 0)]
    assert sorted(map(tuple, upsert(now, changes, "k").collect())) == [(1, "a", 1), (2, "z", 5), (3, "e", 0)]
