import random
from collections import defaultdict

import numpy as np

from groundwork.llm import near_dup
from groundwork.llm.components import components, forest
from groundwork.llm.near_dup import near_duplicates, shingles, signatures


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)
    pairs = {(a, b) for ks in by_shingle.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = root(rows[a][0]), root(rows[b][0])
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())


def chain(rng, base, n, edits):
    out, words = [], base[:]
    for _ in range(n):
        words = words[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_stars(spark):
    rng = random.Random(1)
    texts = []
    for c in range(6):
        base = [f"w{c}_{k}" for k in range(120)]
        texts += chain(rng, base, 15, 3)  # each near the next, far from the first
        texts += [x for _ in range(25) for x in chain(rng, base, 1, rng.choice((1, 2, 3, 4)))]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(100)]
    texts = [x for _ in range(90) for x in chain(rng, base, 1, rng.choice((1, 3, 4, 5)))]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 1 < len({r[2] for r in want}) < 90
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "A B\tc  D"), (8, "a b c d e"), (9, "x " * 9000), (10, "x x x x x"), (11, "é ö ü ß ñ"), (12, "É ö ü ß ñ"), (13, "a\x1cb c"), (14, "a\xa0b c")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, component_id string, kept int")
    assert result(df) == brute(rows)
    assert near_duplicates(df.limit(0)).collect() == []
    twice = near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.component_id, r.kept) for r in twice) == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((4, 3), (40, 30), (800, 500)):
        est = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))[: 2 * n]
            rng.shuffle(x)
            a, b = x[:n], np.concatenate((x[:shared], x[n : 2 * n - shared]))
            s = signatures([a, b])
            assert (s != np.uint64(2**64 - 1)).all()
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - shared / (2 * n - shared)) < 0.03


def test_shingles():
    assert len(shingles(b"a b c d e a b c d e")) == 5 and len(shingles(b"a b")) == 1 and len(shingles(None)) == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 400) if k % 50] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    roots, nodes = forest(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert got == dict(zip(nodes, roots))


def test_every_pair_compared_finds_the_same(spark, monkeypatch):
    """The last round with all pairs compared on their sets links what the signatures' filter leaves, and what brute force links."""
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 5))):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    exact = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, fewest=0).collect())
    assert exact == result(df) == brute(rows)
