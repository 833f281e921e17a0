import random

import numpy as np
import pytest

from groundwork.llm import decontamination as D

WORDS = [f"{a}{b}{c}" for a in ("th", "on", "re", "ba") for b in ("e", "in", "ou") for c in ("r", "st", "ly", "")]


def semi_global(pattern, text):
    """Least edits of the whole pattern against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    k = np.arange(len(text) + 1)
    for c in pattern:
        new = np.minimum(np.append(row[0] + 1, row[:-1] + (t != c)), row + 1)
        row = np.minimum.accumulate(new - k) + k
    return int(row.min())


def brute(docs, items):
    fold = lambda s: (s or "").encode().translate(D.FOLD_TABLE)
    out = {}
    for i, t in docs:
        for k, x in items:
            p, n = fold(x), 0
            for a, m in D.regions(len(p)):
                n += semi_global(p[a : a + m], fold(t)) <= D.budget(m)
            if n:
                out[i, k] = n
    return out


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice(([], ["#"], [s[k], "%"]))
    return "".join(s)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 3000)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(rng.choice((3, 8, 14, 20, 40)))) for k in range(15)] + [(90, None), (91, ""), (92, "abc"), (93, "Éa " * 30)]
    docs = []
    for i in range(120):
        x = rng.choice(items[:15])[1]
        a = rng.randrange(len(x) // 2) if i % 3 == 0 else 0
        part = edited(rng, x[a:], rng.choice((0, 1, 2, 4, 8, 14, 20)))
        docs.append((i, text(rng.randrange(60)) + rng.choice((" ", "\n", "")) + rng.choice((part, part.upper(), part.replace(" ", "\n"))) + " " + text(rng.randrange(60))))
    docs += [(200 + i, text(150)) for i in range(30)] + [(300, None), (301, ""), (302, "x"), (303, "éA " * 40)]
    df = spark.createDataFrame([(*d, 0, "y") for d in docs], "doc_id long, text string, start int, item_id string").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    rows = D.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id): r.regions for r in rows} == brute(docs, items)
    for r in rows:
        assert 0 <= r.start < r.stop <= len(dict(docs)[r.doc_id].encode()) and r.regions <= r.regions_of_item
    bad = {r.doc_id for r in rows}
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - bad


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect() if r.edits == 0 and r.regions == r.regions_of_item}
    assert got == want
    monkeypatch.setattr(D, "BLOCK", 3000)
    again = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect() if r.edits == 0 and r.regions == r.regions_of_item}
    assert again == want


@pytest.mark.parametrize("n", [8, 9, 15, 16, 31, 80])
def test_budget_leaves_a_shared_gram(n):
    assert n + 1 - D.Q * (D.budget(n) + 1) >= 1


def test_edges(spark):
    some = spark.createDataFrame([(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, "THE QUICK\nbrown fox jumps over")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "the quick brown fox jumps over")], "item_id long, text string")
    assert len(D.contaminated(some, bench).collect()) == 3 and D.clean_documents(some, bench).collect() == []
    assert D.contaminated(some.limit(0), bench).collect() == [] == D.contaminated(some, bench.limit(0)).collect()
    assert D.clean_documents(some, bench.limit(0)).count() == 3


def test_excerpts_and_short_items(spark):
    rng = random.Random(11)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    bench = spark.createDataFrame([(1, item), (2, "qz-7"), (3, "qz-7"), (4, "é!"), (5, "never")], "item_id long, text string")
    docs = [(a, "0123 " * 30 + item[a : a + 72] + " 4567" * 30) for a in range(129)] + [(500, "x" * 9), (501, "QZ-7"), (502, "is é! or QZ-7 or qz-7"), (503, "é"), (504, "qz-"), (505, "7qz")]
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), bench).collect()
    assert {r.doc_id for r in rows if r.item_id == 1} == set(range(129))
    assert sorted((r.doc_id, r.item_id, r.start, r.stop, r.edits, r.regions, r.regions_of_item) for r in rows if r.item_id != 1) == [
        (501, 2, 0, 4, 0, 1, 1), (501, 3, 0, 4, 0, 1, 1), (502, 2, 10, 14, 0, 1, 1), (502, 3, 10, 14, 0, 1, 1), (502, 4, 3, 6, 0, 1, 1),
    ]


def test_texts_do_not_touch(spark):
    """An item whose halves end one text and begin the next is in neither, and rows do not depend on who shares a batch."""
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghij ") for _ in range(80))
    index = D.Index.build([("s", item)])
    one, two = b"xyz " * 9 + item[:40].encode(), item[40:].encode() + b" xyz" * 9
    assert D.matches_of(index, [one, two]) == [] == D.matches_of(index, [one]) == D.matches_of(index, [two])
    texts = [edited(rng, item, n).encode() for n in (0, 1, 3, 6, 9, 12)] + [item[3:].encode(), item[:-4].encode(), b"", None, one, two]
    each = [[(k, *m[1:]) for m in D.matches_of(index, [t])] for k, t in enumerate(texts)]
    for order in (texts, texts[::-1]):
        got = sorted(D.matches_of(index, order))
        assert got == sorted((k if order is texts else len(texts) - 1 - k, *m[1:]) for rows in each for k, *_ in [r[:1] for r in rows] for m in rows)
