import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from groundwork.llm import lm_score as S


def base(rows):
    toks = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, t in toks.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    return [((rows[k][0] is not None, rows[k][0] or 0), held[k], len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for k, t in toks.items()]


def compare(df, rows):
    got = sorted(S.scores(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.base_score))
    want = sorted(base(rows), key=lambda r: (*r[0], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert ((g.doc_id is not None, g.doc_id or 0), g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and math.isfinite(g.score) and g.score < 0
    return got


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = compare(docs, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    print("held out, bits of a token: base", -sum(r.base_score for r in held) / n / math.log10(2), "model", -sum(r.score for r in held) / n / math.log10(2))
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.03 * n


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b A B"), (3, "a b A B"), (None, "a\x1cb é É"), (4, "z " * 20_000), (6, "zz"), (11, "never seen words"), (15, "b a")]
    compare(spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, word string"), rows)
    assert S.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_probabilities_sum_to_one(spark):
    rows = [(i, f"a b c d{i} e{i} f") for i in range(40)]
    counts, model = S.counted(spark.createDataFrame(rows, "doc_id long, text string"))
    model.weights = np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)
    numbers, starts = model.numbered([[b"a", b"b", b"q", b"\n"]])
    p = model.probabilities(model.features(numbers, starts))
    assert p.sum(axis=1) == pytest.approx(1, rel=1e-5)
    inside = model.unknown.copy()
    for k, (w, c) in enumerate(zip(model.names, model.counts.tolist())):
        inside[model.classes[k]] += (c + 0.5) / model.z / model.mass[model.classes[k]]
    used = model.mass > 1e-11
    assert inside[used] == pytest.approx(1, rel=1e-6)


def test_scores_against_brute_force(spark, monkeypatch):
    """`score` is the product, token by token, of class softmax and share in the class, whatever the weights are."""
    every = S.most_frequent
    monkeypatch.setattr(S, "most_frequent", lambda counts: every(counts)[:20])
    held = {}

    def trained(docs, model):
        model.weights = np.random.default_rng(1).normal(0, 0.3, model.weights.shape).astype(np.float32)
        held["model"] = model
        return model

    monkeypatch.setattr(S, "trained", trained)
    rows = [(i, f"the cat {i % 7} sat on mat{i} the end é{i % 3}") for i in range(60)] + [(70, None), (71, "never Seen words"), (76, "mat1 the")]
    got = {r.doc_id: r.score for r in S.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m = held["model"]
    assert len(m.names) == 20
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in S.tokens((t or "").encode()))
    for i, text in rows:
        toks, total = S.tokens((text or "").encode()), 0.0
        numbers, starts = m.numbered([toks])
        f = m.features(numbers, starts)
        for k, w in enumerate(toks):
            z = np.log(m.mass) + sum(m.weights[x[k]].astype(float) for x in f)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            c = m.names.index(w) if w in m.names[: S.OWN] else S.OWN + w[-1] % S.BUCKETS
            total += math.log10(p[c] * (counts[w] + 0.5) / m.z / m.mass[c] if w in counts else float(p @ m.unknown))
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_frequent_words_come_by_whole_counts(spark, monkeypatch):
    counts = spark.createDataFrame([(bytearray(f"w{k}".encode()), c, 0) for k, c in enumerate([100, 90, 40, 40, 3, 3, 3, 1])], "name binary, c long, bucket int")
    for most, want in ((8, 8), (7, 7), (6, 4), (3, 2), (1, 1)):
        monkeypatch.setattr(S, "FREQUENT", most)
        assert len(S.most_frequent(counts)) == want


def test_context_chooses_within_a_class(spark):
    """Two words as frequent and with the same last byte are told apart by the word before them."""
    filler = [f"f{chr(97 + k)}" for k in range(S.OWN)]
    rows = [(i, " ".join(filler * 8 + ["left", "ka"] * 6 + filler * 8 + ["right", "la"] * 6)) for i in range(200)]
    ask = [(1000, "left ka"), (1001, "left la"), (1002, "right la"), (1003, "right ka")]
    got = {r.doc_id: r for r in S.scores(spark.createDataFrame(rows + ask, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score, abs=0.01)
    assert got[1000].score > got[1001].score + 0.3 and got[1002].score > got[1003].score + 0.3


def test_whole_probabilities_sum_to_one(spark):
    words = [f"{a}{b}{c}" for a in "uvw" for b in "xyz" for c in "pq\u00e9"]
    _, model = S.counted(spark.createDataFrame([(i, " ".join(words[i % 5 :] + ["s", "to", f"n{i}"])) for i in range(40)], "doc_id long, text string"))
    rng = np.random.default_rng(2)
    model = model.with_tables([rng.normal(size=t.shape).astype(np.float32) for t in model.tables()])
    for context in ([b"to", words[0].encode()], [b"never", b"seen"]):
        numbers, starts = model.numbered([[*context, w] for w in model.names])
        p = model.probabilities(model.features(numbers, starts)).astype(float)
        each = p[np.arange(len(numbers)), model.classes[numbers]]
        each *= (np.append(model.counts, np.zeros(S.FREQUENT))[np.minimum(numbers, len(model.names))] + 0.5) / model.z / model.mass[model.classes[numbers]]
        inside, found = model.steps(numbers, model.before(numbers, starts))
        assert len(inside) and len(found) == 2
        for k, (rows, start, way) in enumerate(found):
            q = model.step_probabilities(k, rows, start)
            each[inside] *= q[np.arange(len(q)), way] / np.maximum(np.exp(model.shares[k][start, way]), 1e-30)
        last = starts[1:] - 1
        assert each[last].sum() + p[last[0]] @ model.unknown == pytest.approx(1, rel=1e-4)


def test_words_of_a_batch_are_the_tokens_of_its_texts():
    """All texts of a batch are cut and hashed together."""
    rng = random.Random(3)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x00", "a", "B", "Z", "[", "@", "é", "É", "中", "z" * 70, "Q" * 9, "abcdefgh", "x"]
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.choice([0, 1, 2, 7]))]
        words = S.Words.of(pa.array([" no part of it ", None, *texts], pa.string()).slice(2))
        want = [S.tokens(None if t is None else t.encode()) for t in texts]
        flat = [w for t in want for w in t]
        assert words.bytes_of(np.arange(len(words.begin))).to_pylist() == flat
        assert words.starts.tolist() == np.cumsum([0, *map(len, want)]).tolist()
        assert words.endings(np.arange(len(flat))).tolist() == [S.ending(w) for w in flat]
        hashes = words.hashes().tolist()
        assert hashes == S.Words.listed(flat).hashes().tolist() and len(set(hashes)) == len(set(flat))


def test_words_are_numbered_without_a_call_for_each(monkeypatch):
    model = S.Model([b"the", b"a"], np.array([3, 2]), 5, 2, np.full(S.CLASSES, 1 / S.CLASSES), np.zeros(S.CLASSES), np.zeros((S.HASHED, S.CLASSES), np.float32), [], [])
    want = [S.FREQUENT + S.ending(b"w%d" % k) for k in range(500)]
    calls = []
    monkeypatch.setattr(S, "ending", lambda word: calls.append(word) or 0)
    numbers, _ = model.numbered([[b"a", *[b"w%d" % k for k in range(500)], b"the"]])
    assert numbers.tolist() == [1, *want, 0] and not calls


def test_update_against_a_plain_one():
    """One step of a task's training, compared with the same in double precision and log weights."""
    rng = np.random.default_rng(4)
    mass = rng.dirichlet(np.ones(S.CLASSES))
    shares = [S.log_shares(rng.integers(0, 3, (n, S.BUCKETS))) for n in (S.BUCKETS, S.BUCKETS**2)]
    tables = [rng.normal(0, 0.5, (rows, k)).astype(np.float32) for rows, k in zip((S.HASHED, *S.INNER), (S.CLASSES, S.BUCKETS, S.BUCKETS))]
    model = S.Model([b"w%d" % k for k in range(40)], np.arange(40, 0, -1), 820, 40, mass, np.zeros(S.CLASSES), tables[0], shares, tables[1:])
    n = 600
    features = [rng.integers(0, rows, n).astype(np.uint16) for rows in (3, 200, S.HASHED)]
    target = rng.integers(0, S.CLASSES, n)
    own = S.Training(model)
    own.descend(0, features, target)
    z = np.log(mass) + sum(tables[0][f].astype(float) for f in features)
    d = np.exp(z - z.max(axis=1, keepdims=True))
    d /= d.sum(axis=1, keepdims=True)
    d[np.arange(n), target] -= 1
    g = np.zeros(tables[0].shape)
    for f in features:
        np.add.at(g, f, d)
    want = -S.RATE * g / np.sqrt((g**2).mean(axis=1, keepdims=True) + 1)
    assert own.changed()[0] == pytest.approx(want, abs=1e-4) and np.abs(want).max() > 0.1
    start, way = rng.integers(0, S.BUCKETS, n), rng.integers(0, S.BUCKETS, n)
    z = shares[0][start] + sum(tables[1][f].astype(float) for f in features[:2])
    q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p, other = S.chosen(model.factors()[1], features[:2], way, np.exp(shares[0]), start, np.ones(S.BUCKETS, np.float32))
    assert p == pytest.approx(q[np.arange(n), way], rel=1e-4, abs=1e-12) and other == pytest.approx(1, rel=1e-5)
