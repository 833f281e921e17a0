"""Rerankers and embedders: contract, order, held-out quality."""

import numpy as np
from pyspark.sql import functions as F

from groundwork.operators import retrieval as R
from groundwork.operators import scorers as S

SF = "/root/testdata/sf0.001"


def backends():
    """Two of a user's own, made here so that they travel to the workers whole."""

    class TooFew:
        enabled = True

        def score(self, query, texts):
            return [1.0] * (len(texts) - 1)

    class ByLength:
        enabled = True

        def score(self, query, texts):
            return [float(len(t)) for t in texts]

    return TooFew(), ByLength()


def pool(spark, n=25):
    found = spark.createDataFrame([(1, k, k + 1, 1.0 / (k + 1), "x") for k in range(n)] + [(2, 0, 1, 0.5, "x")], "q long, d long, position int, rrf double, passage string")
    docs = spark.createDataFrame([(k, "a" * (k % 7), "y") for k in range(n - 1)] + [(n - 1, None, "y")], "d long, text string, pool string")
    return found, spark.createDataFrame([(1, "a b"), (2, None)], "q long, text string"), docs


def order(df, q=1):
    return [r.d for r in df.where(F.col("q") == q).orderBy("position").collect()]


def test_order_and_tail(spark):
    (found, questions, docs), (too_few, by_length) = pool(spark), backends()
    out = S.rerank(found, questions, docs, by_length, "q", "d")
    assert order(out) == sorted(range(20), key=lambda k: (-(k % 7), k)) + [20, 21, 22, 23, 24]
    assert out.where("rerank_score is null").count() == 5 and order(out, 2) == [0]
    for backend in (S.NullReranker(), too_few):
        same = S.rerank(found, questions, docs, backend, "q", "d")
        assert order(same) == list(range(25)) and same.where("rerank_score is not null").count() == 0
    assert S.rerank(found.limit(0), questions, docs, by_length, "q", "d").count() == 0


def test_confidence():
    values = [S.confidence(x) for x in (-800.0, -2.0, 0.0, 2.0, 800.0)]
    assert values == sorted(values) and values[2] == 0.5 and 0 <= values[0] and values[-1] <= 1


def test_fitted_reranker(spark):
    """Trained on beginnings of documents against their own and other texts, held out on other documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400")
    asked = docs.select(F.col("doc_id").alias("q"), F.substring("text", 40, 90).alias("query"))
    texts = docs.select("doc_id", "text")
    good = asked.join(texts, F.col("q") == F.col("doc_id")).select("q", "query", "text", F.lit(True).alias("good"))
    bad = asked.join(texts, (F.col("doc_id") - F.col("q")).isin(1, 2)).where("substr(text, 1, 300) not like concat('%', query, '%')").select("q", "query", "text", F.lit(False).alias("good"))
    pairs = good.unionByName(bad)
    model = S.LinearReranker.fitted(pairs.where("q % 2 = 0"))
    assert model == S.LinearReranker.fitted(pairs.where("q % 2 = 0").repartition(5))
    rows = pairs.where("q % 2 = 1").collect()
    right = [(model.score(r.query, [r.text])[0] > 0) == r.good for r in rows]
    assert np.mean(right) > 0.9


def test_embedders(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = S.SubspaceEmbedder.fitted(docs, most=150)
    rows = {r.doc_id: np.array(r.embedding) for r in S.embedded(docs.unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string")), model, "doc_id").collect()}
    assert len(rows) == docs.count() + 1 and all(v.shape == (32,) for v in rows.values()) and not rows[-1].any()
    # A part of a text is nearest to its own text for nearly all texts.
    asked = S.embedded(docs.where("length(text) > 600").select(F.col("doc_id").alias("q"), F.substring("text", 1, 500).alias("text")), model, "q", "query")
    best = R.dense(asked, S.embedded(docs, model, "doc_id"), "q", "doc_id", "embedding", k=5, others_only=False)
    assert best.where("q = doc_id").count() > 0.8 * asked.count()
    null = S.embedded(docs, S.NullEmbedder(), "doc_id")
    assert null.first().embedding == [0.0] * 8 and R.dense(asked.limit(0), null, "q", "doc_id", "embedding").count() == 0


def test_rerank_in_the_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = S.SubspaceEmbedder.fitted(docs, most=100)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    questions = asked.join(S.embedded(asked, model, "item_id", "query"), "item_id")
    vectors = S.embedded(docs, model, "doc_id")
    plain = R.hybrid(questions, docs, vectors, "item_id", "doc_id", n=20)
    best = R.hybrid(questions, docs, vectors, "item_id", "doc_id", reranker=S.OverlapReranker())
    rows = best.collect()
    assert max(r.position for r in rows) == 5 and all(r.rerank_score is not None for r in rows)
    margins = {r.item_id: r.margin for r in plain.collect()}
    assert all(abs(r.margin - margins[r.item_id]) < 1e-12 for r in rows)
