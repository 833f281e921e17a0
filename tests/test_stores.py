"""The index on disk equals a rebuilt one after updates; a run that dies and is resumed equals an unbroken one."""

import pytest
from pyspark.sql import functions as F

from groundwork.operators import retrieval as R
from groundwork.sources.index_store import IndexStore, ModelMismatch
from groundwork.sources.result_sink import ResultSink

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def snapshots(spark):
    """The corpus, and what it was before: a tenth with other texts, some not there yet, some that are gone now."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    old = docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("older "), "text")).otherwise(F.col("text")))
    gone = docs.where("doc_id < 5").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    return docs, old.unionByName(gone)


def embed(docs):
    return docs.select("doc_id", F.array(F.length("text").cast("double") + 1, F.lit(1.0), (F.col("doc_id") % 7).cast("double")).alias("embedding"))


def test_updates_equal_a_rebuild(spark, tmp_path):
    docs, before = snapshots(spark)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet")
    store = IndexStore(spark, f"file://{tmp_path}/index", "doc_id")
    assert store.current() == (0, None, []) and store.mismatches("m1").count() == 0
    assert store.build(before, "m1", embed) == 1
    assert store.update(docs, "m1", embed) == 2
    _, model, segments = store.current()
    assert model == "m1" and len(segments) == 2
    changes = {r.status: r.n for r in store._read(segments[1], "changes").groupBy("status").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    assert changes == {"changed": n // 10, "new": n // 10, "removed": 5}
    assert store._read(segments[1], "postings").select("doc_id").distinct().count() <= n // 5  # the rest is not read again
    want = rows(R.bm25(asked, docs, "item_id", "doc_id"))
    assert rows(store.search(asked, "item_id").select("item_id", "doc_id", "score", "rank")) == want
    near = embed(docs.where("doc_id < 20")).withColumnRenamed("doc_id", "q")
    want_near = rows(R.dense(near, embed(docs), "q", "doc_id", "embedding", others_only=False))
    assert rows(store.nearest(near, "q")) == want_near
    assert store.update(docs, "m1", embed) == 2  # nothing changed, nothing written
    assert store.compact() == 3 and len(store.current()[2]) == 1
    assert rows(store.search(asked, "item_id").select("item_id", "doc_id", "score", "rank")) == want
    assert rows(store.nearest(near, "q")) == want_near
    assert rows(store.documents().select("doc_id", "sha256")) == rows(docs.select("doc_id", F.sha2("text", 256)))


def test_another_model(spark, tmp_path):
    docs, before = snapshots(spark)
    store = IndexStore(spark, f"file://{tmp_path}/index", "doc_id")
    store.build(before, "m1")
    assert [tuple(r) for r in store.mismatches("m2").collect()] == [(1, "m1", "m2")] and store.mismatches("m1").count() == 0
    with pytest.raises(ModelMismatch):
        store.update(docs, "m2")
    assert store.build(docs, "m2") == 2 and store.mismatches("m2").count() == 0


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    docs, before = snapshots(spark)
    store = IndexStore(spark, f"file://{tmp_path}/index", "doc_id")
    store.build(before, "m1")

    def broken(rows):
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        store.update(docs, "m1", broken)
    assert store.current()[0] == 1 and store.documents().count() == before.count()
    assert store.update(docs, "m1") == 2 and store.documents().count() == docs.count()


def test_odd_documents(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", "doc_id")
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, dl string, segment string")
    store.build(df([]), "m")
    assert store.documents().count() == 0
    assert store.update(df([(1, None, "x", "y"), (2, "alpha beta", "x", "y"), (None, "alpha", "x", "y")]), "m") == 2
    asked = spark.createDataFrame([(7, "alpha gamma")], "q long, text string")
    assert [(r.q, r.doc_id) for r in store.search(asked, "q").collect()] == [(7, 2)]
    assert store.update(df([]), "m") == 3 and store.documents().count() == 0 and store.search(asked, "q").count() == 0


def golden(spark):
    return spark.range(100).select((F.col("id") * 7 % 100).alias("qid"), F.col("id").alias("place"))


def scored(part):
    return part.select("qid", (F.col("qid") * 2).alias("points"))


def test_resumed_run(spark, tmp_path):
    calls = []

    def dies(part):
        calls.append(1)
        if len(calls) == 3:
            return part.select("qid", F.raise_error(F.lit("died")).cast("long").alias("points"))
        return scored(part)

    whole, broken = (ResultSink(spark, f"file://{tmp_path}/{n}", "qid") for n in ("whole", "broken"))
    whole.run(golden(spark), scored, 6)
    with pytest.raises(Exception, match="died"):
        broken.run(golden(spark), dies, 6)
    left = broken.remaining(golden(spark)).count()
    assert 0 < left < 100
    with pytest.raises(ValueError):
        broken.report(golden(spark), "place", lambda r: r.agg(F.sum("points").alias("total")))
    seen = []
    broken.run(golden(spark), lambda part: (seen.append(part.count()), scored(part))[1], 6)
    assert sum(seen) == left  # only what was left is scored
    a, b = ([tuple(r) for r in s.ordered(golden(spark), "place").collect()] for s in (whole, broken))
    assert a == b and [r[2] for r in a] == list(range(100))
    first = broken.report(golden(spark), "place", lambda r: r.agg(F.sum("points").alias("total"))).collect()
    again = broken.report(golden(spark), "place", lambda r: r.agg(F.lit(0).alias("total"))).collect()
    assert first == again and first[0].total == 9900


def test_stream_epochs_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    sink = ResultSink(spark, f"{path}/sink", "qid")
    for k in range(3):
        scored(golden(spark).where(f"qid % 3 = {k}")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        scored(golden(spark).where("qid = 5")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("qid long, points long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        sink.drain(stream, f"{path}/checkpoint")
    assert rows(sink.written().select("qid", "points")) == rows(scored(golden(spark)))
    sink.write(scored(golden(spark).where("qid % 3 = 0")), 0)  # the first epoch once more
    assert rows(sink.written().select("qid", "points")) == rows(scored(golden(spark)))


def test_common_words_are_not_met_by_every_question(spark):
    """The best sums are those over all pairs, from a small part of the pairs."""
    import random

    rng = random.Random(6)
    weight = spark.createDataFrame([(t, d, rng.random() * (0.02 if t.startswith("c") else 3)) for d in range(3000) for t in ["c1", "c2", "c3", *rng.sample([f"r{j}" for j in range(300)], 3)]], "term string, id long, w double")
    asked = spark.createDataFrame([(q, t, 1 + q % 2) for q in range(15) for t in ["c1", "c2", "c3", f"r{q}", f"r{q + 20}"]], "q long, term string, qf int")
    pairs = asked.join(weight, "term")
    every = pairs.groupBy("q", "id").agg(F.round(F.sum(F.col("qf") * F.col("w")), 6).alias("score")).collect()
    want = [(q, r.id, r.score, k) for q in range(15) for k, r in enumerate(sorted((r for r in every if r.q == q), key=lambda r: (-r.score, r.id))[:10], 1)]
    assert rows(R.best_sums(asked, weight, "q", "id", 10).select("q", "id", "score", "rank")) == sorted(want)
    blocks = R.in_blocks(weight)
    bounds = blocks.groupBy("term", "block").agg(F.max("w").alias("top"), F.count("*").alias("n"))
    assert R.candidate_pairs(asked, blocks, bounds, "q", "id", 10).count() < 0.05 * len(every)
    few = asked.where("q < 2").withColumn("term", F.when(F.col("term") == "c1", "none").otherwise(F.col("term")))
    assert R.best_sums(few, weight.where("id < 5"), "q", "id", 10).count() <= 10 and R.best_sums(asked.limit(0), weight, "q", "id", 10).count() == 0
