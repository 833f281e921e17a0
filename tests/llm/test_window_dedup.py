import hashlib
import random

import pytest

from groundwork.llm import substring_dedup, suffix_dedup, windows


def brute_bytes(rows, length):
    first, out = {}, []
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], (i, k))
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] != (i, k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, length):
    first, out = {}, []
    rows = sorted((i, (t or "").encode().split()) for i, t in rows)
    for i, w in rows:
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    for i, w in rows:
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] != i:
                gone[k : k + length] = b"\1" * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone)), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def hot(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(windows, "HOT_IN_BATCH", 2)
        monkeypatch.setattr(windows, "HOT_ROWS", 2)
        monkeypatch.setattr(windows, "STRETCH", 700)
        monkeypatch.setattr(windows, "CHUNK_BYTES", 2000)


def mixed(seed):
    rng = random.Random(seed)
    passages = [" ".join(f"{rng.choice('abcdé')}{rng.randrange(900)}" for _ in range(rng.choice((20, 60, 90)))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split(" ")
            a = rng.randrange(len(p) // 2)
            parts += [" ".join(p[a:]), f"x{rng.randrange(10**6)}"]
        rows.append((i * 2, " ".join(parts)))
    rows += [(500 + i, rows[3 * i][1]) for i in range(10)] + [(600, "ab" * 400), (601, "q " * 300), (602, "q\n" * 300), (603, "ab" * 90)]
    rng.shuffle(rows)
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(suffix_dedup.dedup(docs)) == brute_bytes(rows, 100)
    assert result(substring_dedup.dedup(docs)) == brute_words(rows, 50)


def test_mixed(spark, hot):
    rows = mixed(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(suffix_dedup.dedup(df)) == brute_bytes(rows, 100)
    assert result(substring_dedup.dedup(df)) == brute_words(rows, 50)


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(200))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, long), (6, " " + long.replace(" ", "\t\n")), (7, "é" * 80), (8, "x" + "é" * 80)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, at int, fresh string")
    assert result(suffix_dedup.dedup(df)) == brute_bytes(rows, 100)
    assert result(substring_dedup.dedup(df)) == brute_words(rows, 50)
    assert result(suffix_dedup.dedup(df.limit(0))) == [] == result(substring_dedup.dedup(df.limit(0)))
    twice = spark.createDataFrame([(4, long), (4, long), (None, long)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup(twice).collect()] == [0, 0, 0]
    texts = {r.doc_id: r.text for r in suffix_dedup.dedup_texts(df).collect()}
    assert texts[1] is None and texts[4] == long and texts[5] == "" and set(texts[8]) <= {"x", "é"}


@pytest.mark.parametrize("batches, once", [(2000, 1), (2000, 99), (3, 1), (3, 99)])
def test_hot_in_some_batches(spark, monkeypatch, batches, once):
    """A passage that one batch holds often and others once or twice is one passage everywhere."""
    monkeypatch.setattr(windows, "HOT_IN_BATCH", 3)
    monkeypatch.setattr(windows, "HOT_ROWS", batches)
    passage = " ".join(f"p{k}" for k in range(120))

    def part(ids, held=passage):
        return [(i, " ".join([*(f"a{i}x{k}" for k in range(9)), held, *(f"z{i}x{k}" for k in range(9))])) for i in ids]

    rare = passage.replace("p", "r")
    parts = [part(range(10, 16)), part([once]), part([30, 31]), part([40, 41], rare), part([42], rare), part([43, 44], rare)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda rows: rows), "doc_id long, text string")
    rows = sum(parts, [])
    assert result(suffix_dedup.dedup(df)) == brute_bytes(rows, 100)
    assert result(substring_dedup.dedup(df)) == brute_words(rows, 50)


@pytest.mark.parametrize("partitions", [1, 2, 7, 50])
@pytest.mark.parametrize("rows_to_be_hot", [1000, 5])
def test_any_partitioning(spark, monkeypatch, partitions, rows_to_be_hot):
    """Passages and copies that crowd in one partition and are rare in others give the same result however rows are dealt."""
    monkeypatch.setattr(windows, "HOT_IN_BATCH", 8)
    monkeypatch.setattr(windows, "HOT_ROWS", rows_to_be_hot)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(70))
    around = lambda i: " ".join(f"u{i}x{rng.randrange(99)}" for _ in range(9))
    rows = [(i, f"{around(i)} {passage} {around(i)}") for i in range(2, 40)]
    rows += [(1000, f"{around(1000)} {passage}"), (1, f"{passage} {around(1)}"), (900, "no copy " + around(900))]
    copy = " ".join(f"c{k}" for k in range(80))
    rows += [(2000 + i, copy) for i in range(20)] + [(50, copy)]
    dealt = [[] for _ in range(partitions)]
    for k, r in enumerate(rows):
        dealt[0 if k < 30 else k % partitions].append(r)
    df = spark.createDataFrame(spark.sparkContext.parallelize(dealt, partitions).flatMap(lambda x: x), "doc_id long, text string")
    assert result(suffix_dedup.dedup(df)) == brute_bytes(rows, 100)
    assert result(substring_dedup.dedup(df)) == brute_words(rows, 50)


def test_clashing_names(spark):
    """Columns of the caller that are named like the operator's own, in any case, come back as they were."""
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(1, long, 5, "a", 7), (2, long, 6, "b", 8), (None, long, 9, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int, fresh string, key int")
    got = suffix_dedup.dedup_texts(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.RUNS, r.fresh, r.key) for r in got.collect())) == [(0, 9, "c", 1), (1, 5, "a", 7), (2, 6, "b", 8)]


def test_repeats_inside_documents(spark, hot):
    """A window's later places in the first document that has it stay, in later documents none stays."""
    rng = random.Random(11)
    words = [f"t{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(words[:2]) if rng.random() < 0.3 else words[k % (3 + i % 4)] for k in range(rng.randrange(200)))) for i in range(30)]
    rows += [(100 + i, " ".join(words[:10] * 40)) for i in range(9)] + [(90, " ".join(words[:10] * 25 + ["end"] + words[:10] * 25))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(substring_dedup.dedup(df)) == brute_words(rows, 50)


def test_a_bucket_gets_a_row_for_each_string_and_batch(spark):
    """Documents of one line over and over: what meets at a hash is bounded by batches, not by places."""
    from pyspark.sql import functions as F

    line = " ".join(f"w{k}" for k in range(10)) + "\n"
    docs = spark.createDataFrame([(i, line * 600) for i in range(40)], "doc_id long, text string").repartition(20)
    s = substring_dedup.spec()
    found = windows.candidates(docs, s)
    sent = windows.packed_runs(docs.join(found, "doc_id"), "runs", s)
    most = sent.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 20 * 10  # ten different strings of a hash at most, once for each batch
