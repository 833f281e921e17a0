"""Queries over stored state: an index that is built, updated and asked; a run taken up again; a reranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import retrieval as R
from groundwork.operators import scorers
from groundwork.plans.answer_queries import BM25_CTE, BM25_TOPK
from groundwork.sources.index_store import IndexStore
from groundwork.sources.result_sink import ResultSink
from groundwork.sources.shared import new_folder
from groundwork.sources.tables import table


def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical index over documents, built from what they were before and updated by what changed since."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    before = docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("older "), "text")).otherwise(F.col("text")))
    store = IndexStore(spark, new_folder(spark, "index"), "doc_id")
    store.build(before.unionByName(docs.where("doc_id % 100 = 7").select((-F.col("doc_id") - 1).alias("doc_id"), "text")), "words")
    store.update(docs, "words")
    return store.search(table(spark, sf, "benchmark"), "item_id").select("item_id", "doc_id", "score", "rank")


def lexical_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The six longest words of each question alone, by blocks of weights and floors."""
    words = F.slice(F.sort_array(F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 6)
    asked = table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(words, lambda x: x["w"]), " ").alias("text"))
    return R.bm25(asked, table(spark, sf, "documents"), "item_id", "doc_id", prune=True)


LEXICAL_PRUNED = "WITH " + BM25_CTE.replace("FROM benchmark", "FROM (SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(text, ' ')), lambda w: {'n': -length(w), 'w': w}))[1:6], lambda x: x.w), ' ') AS text FROM benchmark)") + " SELECT item_id, doc_id, score, rank FROM lex WHERE rank <= 20 AND score > 0"


def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored in waves by a run that had stopped after some of them."""
    golden = table(spark, sf, "documents").select("doc_id", "text", F.row_number().over(_by_hash()).alias("place"))
    score = lambda part: part.select("doc_id", F.length("text").alias("chars"))
    sink = ResultSink(spark, new_folder(spark, "run"), "doc_id")
    sink.write(score(golden.where("doc_id % 4 = 1")), 0)
    sink.run(golden, score, 4)
    return sink.ordered(golden, "place").select("doc_id", "chars", "place")


def _by_hash():
    from pyspark.sql import Window

    return Window.orderBy(F.md5(F.col("doc_id").cast("string")))


RESUMED_RUN = "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS INTEGER) AS place FROM documents"


def reranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical search's pool in the order of the deterministic reranker."""
    asked, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    found = R.bm25(asked, docs, "item_id", "doc_id").withColumnRenamed("rank", "position")
    out = scorers.rerank(found, asked, docs, scorers.OverlapReranker(), "item_id", "doc_id")
    return out.select("item_id", "doc_id", "position", F.round("rerank_score", 6).alias("rerank_score"))


RERANKED_SEARCH = rf"""
WITH {BM25_CTE},
m AS (SELECT item_id, doc_id, rank FROM lex WHERE rank <= 20 AND score > 0),
a AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS words FROM benchmark),
h AS (SELECT m.*, len(list_intersect(words, regexp_split_to_array(lower(d.text), '[^\p{{L}}\p{{N}}]+'))) / greatest(1, len(words)) AS share FROM m JOIN a USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY share DESC, rank) AS INTEGER) AS position, round(1 / (1 + exp(-share)), 6) AS rerank_score FROM h
"""

QUERIES = {"q_lexical_pruned": (lexical_pruned, LEXICAL_PRUNED), "q_index_update": (index_update, BM25_TOPK), "q_resumed_run": (resumed_run, RESUMED_RUN), "q_reranked_search": (reranked_search, RERANKED_SEARCH)}
