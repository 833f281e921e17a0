import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import topk as T


def brute(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = max(v, queries.get(i, v))
    out = []
    for q, a in queries.items():
        c = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(c)]
    return sorted(out)


def result(df, **kw):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(df, **kw).collect())


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert result(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(600)]
    monkeypatch.setattr(T, "BLOCK", 37)
    monkeypatch.setattr(T, "QUERY_BLOCK", 5)
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (20, [0.5, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0]), (7, [1.0, -2.0]), (7, [1.0, -2.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0, 3.0]), (8, [1e6, -1e6])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert result(df) == brute(rows)
    assert result(df, k=2) == brute(rows, k=2)
    assert T.top_k(df.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=6, max_size=6), min_size=2, max_size=60), st.integers(1, 5))
def test_phases_keep_the_answer(vectors, k):
    v = np.array(vectors, np.int64)
    row = {"ids": np.arange(len(v), dtype="<i8").tobytes(), "vectors": v.astype("<i8").tobytes(), "dims": 6} | {"q_ids": np.arange(2, dtype="<i8").tobytes(), "q_vectors": v[:2].astype("<i8").tobytes(), "q_dims": 6}
    pair = T.Pair(row)
    scores, tops = T.gathered(pair, k)
    cutoffs = np.array([x[k - 1] if x.shape[0] >= k and x[k - 1] != T.NEVER else T.ALL for x in scores], np.int64)
    r, c, score, n = T.resolved(pair, cutoffs, tops, T.active_lists(tops, cutoffs))
    best = T.firsts(r, c, score, k)
    for q in range(2):
        want = sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:k]
        assert [(i, s) for x, i, s in zip(r[best].tolist(), c[best].tolist(), score[best].tolist()) if x == q] == [(i, -s) for s, i in want]
    assert len(r) <= n <= 2 * (len(v) - 1)


def _pair(v, queries):
    return T.Pair({"ids": np.arange(len(v), dtype="<i8").tobytes(), "vectors": v.astype("<i8").tobytes(), "dims": v.shape[1], "q_ids": np.arange(queries, dtype="<i8").tobytes(), "q_vectors": v[:queries].astype("<i8").tobytes(), "q_dims": v.shape[1]})


def test_thresholds_leave_out_work():
    """The cutoff keeps most vectors from being completed, whole lists and blocks from being looked at, and decides what is found."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (20, 64))
    v = centres[rng.integers(0, 20, 4000)] + rng.integers(-8, 9, (4000, 64))
    pair, k = _pair(v, 50), 20
    scores, tops = T.gathered(pair, k)
    cutoffs = scores[:, k - 1]
    active = T.active_lists(tops, cutoffs)
    r, c, score, n = T.resolved(pair, cutoffs, tops, active)
    full = (v[:50] @ v.T).astype(np.int64)
    full[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    assert n < 0.3 * full.size and len(r) <= n
    assert sorted(zip(r.tolist(), c.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(full >= cutoffs[:, None]))))
    # Lists without a high enough part are not computed: what they miss is completed for the yielded vectors alone.
    one = active.copy()
    one[:, 1:] = False
    r1, c1, score1, n1 = T.resolved(pair, cutoffs, tops, one)
    assert 0 < n1 < n and (score1 == full[r1, c1]).all()
    # No vector passes a cutoff above all scores; none is left out by the lowest one.
    high = np.full(50, int(full.max()) + 1)
    assert not T.active_lists(tops, high + 10**6).any() and len(T.resolved(pair, high, tops, np.ones_like(active))[0]) == 0
    low = np.full(50, T.ALL)
    assert T.resolved(pair, low, tops, T.active_lists(tops, low))[3] == 50 * 3999
