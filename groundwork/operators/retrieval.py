"""Hybrid retrieval for many questions at once: BM25, vectors, rank fusion, scope, gate, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.sources.shared import settled

# BM25, fusion and pool sizes, gate thresholds, staleness.
K1, B, RRF, TOP_K, TOP_N, LEAST_SCOPED, POOL = 1.5, 0.75, 60, 20, 5, 3, 20
THRESHOLDS, DEFAULT_THRESHOLD = {"ko": 0.8246, "en": 0.8445, "vi": 0.8321}, 0.851
STALE_DAYS = 90
#: Parts into which the holders of a word fall by weight.
BLOCKS = 64
#: Rows of a question's word and a document that a task sums up.
PAIRS = 1 << 20


def postings(docs: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, dl): the lexical index as a table."""
    words = docs.select(key, T.tokens(F.col("text")).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, key: str) -> DataFrame:
    """(term, df, cf): how many keys have a word, and how often it stands in all texts.

    Texts are brought together by key, so that each key's words are counted where they are; what is shuffled
    after that is added up by word first.
    """
    texts = docs.groupBy(key).agg(F.collect_list("text").alias("texts"))
    words = texts.select(key, F.sort_array(F.flatten(F.transform("texts", T.tokens))).alias("w"))
    first = lambda x, i: F.col(key).isNotNull() & ((i == 0) | (F.get("w", i - 1) != x))
    each = words.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("term"), first(x, i).alias("first")))).alias("x"))
    return each.groupBy("x.term").agg(F.count_if("x.first").alias("df"), F.count("*").alias("cf"))


def index_stats(posts: DataFrame, docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((term, df), one row of n and avgdl)."""
    lengths = docs.select(F.size(T.tokens(F.col("text"))).alias("dl"))
    return posts.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(questions: DataFrame, docs: DataFrame, query: str, key: str, k: int = TOP_K, prune: bool = False) -> DataFrame:
    """(query, key, score, rank): the k best documents of each question by Okapi BM25, positive scores only.

    The always-positive idf ln(1 + (N - df + 1/2) / (df + 1/2)); repeated question words count as
    often. A document is tokenized once: its words are cut down to those that questions ask for, and
    a row without a word carries its length to N and the mean. Keys are unique. `prune` is for short
    questions with rare words, see `best_sums`; scores and ranks are the same.
    """
    return bm25_of(*indexed(questions, docs, query, key), query, key, k, prune)


def indexed(questions: DataFrame, docs: DataFrame, query: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `bm25_of` takes: the questions' words, the documents' rows of these words, and their number and mean length."""
    asked = settled(asked_words(questions, query), "asked")
    terms = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit(None).cast("string").alias("term")))
    words = docs.select(key, T.tokens(F.col("text")).alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(None).cast("string"))).alias("word"))
    hit = words.join(terms, F.col("word").eqNullSafe(F.col("term")), "left_semi").groupBy(F.col("word").alias("term"), key, "dl").agg(F.count("*").alias("tf"))
    hit = settled(hit, "postings")
    totals = hit.where("term is null").agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("x"))
    return asked, hit.where("term is not null"), totals


def bm25_and_overlap(questions: DataFrame, docs: DataFrame, query: str, key: str, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """((query, key, score, rank) by BM25, the same by how many of a question's distinct words a document holds).

    Texts are tokenized once and the pairs of a question and a document summed once for both; what is stored
    of them is 2 k rows for each question.
    """
    asked, hit, totals = indexed(questions, docs, query, key)
    scored = pairs_of(asked, hit, totals, key).groupBy(query, key).agg(F.round(F.sum(F.col("qf") * F.col("w")), 6).alias("words"), F.count("*").cast("double").alias("overlap"))
    each = scored.select(query, key, F.explode(F.create_map(F.lit("words"), "words", F.lit("overlap"), "overlap")).alias("signal", "score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(query, "signal").orderBy(F.desc("score"), key)))
    ranked = settled(ranked.where(F.col("rank") <= k), "ranked")
    first, second = (ranked.where(F.col("signal") == s).select(query, key, "score", "rank") for s in ("words", "overlap"))
    return first.where("score > 0"), second


def asked_words(questions: DataFrame, query: str) -> DataFrame:
    """(query, term, qf): the words of each question and how often it has them."""
    return questions.select(query, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))


def bm25_of(asked: DataFrame, hit: DataFrame, totals: DataFrame, query: str, key: str, k: int, prune: bool = False) -> DataFrame:
    """The k best of each question over (term, key, dl, tf) rows of all asked words, and one row x of n and avgdl.

    hit is read more than once, so it is best a stored table.
    """
    if prune:
        return best_sums(asked, weights(hit, totals, key), query, key, k)
    return ranked_sums(pairs_of(asked, hit, totals, key), query, key, k)


def weights(hit: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(term, key, w): the BM25 weight of each word of a document."""
    hit = hit.join(hit.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("x", totals.scalar())
    idf = F.log(1 + (F.col("x.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return hit.select("term", key, (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("x.avgdl")))).alias("w"))


def pairs_of(asked: DataFrame, hit: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """asked with the weight of each document that has the word.

    A document's words come together first: its sums are then whole, and the best of its task known, before they are
    shuffled. There are as many tasks as the pairs ask for, since each holds sums of all its documents and questions.
    """
    return asked.join(weights(hit, totals, key).repartition(pair_tasks(asked, hit), key), "term")


def pair_tasks(asked: DataFrame, hit: DataFrame) -> int:
    """Among how many tasks the pairs of a question and a document that share a word are dealt: PAIRS rows for each, or fewer."""
    each = asked.groupBy("term").agg(F.count("*").alias("questions"))
    rows = hit.groupBy("term").agg(F.count("*").alias("documents")).join(each, "term").agg(F.sum(F.col("questions") * F.col("documents")).alias("n")).first().n
    return max(asked.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // PAIRS))


def ranked_sums(pairs: DataFrame, query: str, key: str, k: int) -> DataFrame:
    scored = pairs.groupBy(query, key).agg(F.round(F.sum(F.col("qf") * F.col("w")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0))


def best_sums(asked: DataFrame, weight: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key, score, rank): the k largest sums of qf * w of each question, sums above 0 only, without
    meeting every holder of a common word.

    asked: query, term, qf; weight: term, key, w. A word's holders fall into blocks by weight, each
    with its largest. The heads of the lists give each question a score that its k-th best reaches at
    least (`floors`), which rules out the lists of its common words and blocks of others
    (`candidate_pairs`); what the documents that are left hold of the question's words is looked up.
    """
    blocks = settled(in_blocks(weight), "weights")
    bounds = blocks.groupBy("term", "block").agg(F.max("w").alias("top"), F.count("*").alias("n"))
    candidates = settled(candidate_pairs(asked, blocks, settled(bounds, "bounds"), query, key, k), "candidates")
    return ranked_sums(candidates.join(asked, query).join(blocks.select("term", key, "w"), ["term", key]), query, key, k)


def in_blocks(weight: DataFrame) -> DataFrame:
    """weight with a block number: equal parts of the way from 0 to the word's largest weight."""
    top = weight.groupBy("term").agg(F.max("w").alias("most"))
    return weight.join(top, "term").select("term", key_of(weight), "w", F.greatest(F.ceil(BLOCKS * F.col("w") / F.col("most")), F.lit(1)).cast("int").alias("block"))


def key_of(weight: DataFrame) -> str:
    return next(c for c in weight.columns if c not in ("term", "w"))


def floors(asked: DataFrame, blocks: DataFrame, bounds: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, least): a score that the question's k-th best reaches; 0 if too few documents were seen.

    The k documents with the largest sums over the heads of the words' lists are looked up whole.
    """
    before = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    first = bounds.withColumn("seen", F.coalesce(before, F.lit(0))).where(F.col("seen") < k).select("term", "block")
    part = asked.join(blocks.join(first, ["term", "block"], "left_semi"), "term").groupBy(query, key).agg(F.sum(F.col("qf") * F.col("w")).alias("s"))
    by = Window.partitionBy(query)
    best = part.withColumn("place", F.row_number().over(by.orderBy(F.desc("s")))).where(F.col("place") <= k).select(query, key)
    whole = best.join(asked, query).join(blocks.select("term", key, "w"), ["term", key]).groupBy(query, key).agg(F.sum(F.col("qf") * F.col("w")).alias("s"))
    # What rounding may take from a sum, or its order of summing, is kept off.
    kth = whole.groupBy(query).agg(F.count("*").alias("n"), F.min("s").alias("s")).where(F.col("n") >= k).select(query, (F.col("s") * (1 - 1e-9) - 1e-6).alias("least"))
    return asked.select(query).distinct().join(kth, query, "left").select(query, F.coalesce("least", F.lit(0.0)).alias("least"))


def candidate_pairs(asked: DataFrame, blocks: DataFrame, bounds: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key) of the documents in blocks that could bring one to the floor of a question.

    A question's words of least reach that cannot make up the floor together are passed over: what has
    those words alone stays below it. Of the other words a block counts if its largest weight could reach the
    floor beside the most that all other words give.
    """
    reach = asked.join(bounds.groupBy("term").agg(F.max("top").alias("most")), "term").withColumn("reach", F.col("qf") * F.col("most"))
    by = Window.partitionBy(query)
    summed = reach.withColumns({"upto": F.sum("reach").over(by.orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("reach").over(by)})
    needed = summed.join(floors(asked, blocks, bounds, query, key, k), query).where(F.col("upto") >= F.col("least"))
    opened = needed.join(bounds, "term").where(F.col("qf") * F.col("top") + F.col("all") - F.col("reach") >= F.col("least"))
    return opened.select(query, "term", "block").join(blocks.select("term", "block", key), ["term", "block"]).select(query, key).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(block, ids, vectors): `size` vectors at most in a row, packed, each of length one and all of one number of components.

    Null vectors and those without a direction, or with a component null or not finite, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, n = TaskContext.get().partitionId() << 33, 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([np.nan if c is None else c for c in v or [0.0]], np.float64)
                norm = np.sqrt((x * x).sum())
                if i is not None and np.isfinite(norm) and norm > 0:
                    held.setdefault(len(x), []).append((i, x / norm))
                    n += 1
                if n == size:
                    for number, part in enumerate(held.values(), number):
                        yield _packed(number, *zip(*part, strict=True))
                    number, n, held = number + 1, 0, {}
        for number, part in enumerate(held.values(), number):
            yield _packed(number, *zip(*part, strict=True))

    return rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "block long, ids binary, vectors binary")


def _packed(number: int, ids: tuple[int, ...], held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": number, "ids": np.array(ids, "<i8").tobytes(), "vectors": np.array(held, "<f8").tobytes()}])


def dense(questions: DataFrame, vectors: DataFrame, query: str, key: str, vector: str, k: int = TOP_K, others_only: bool = True) -> DataFrame:
    """(query, key, score, rank): the k nearest vectors of each question by cosine, exact; with others_only none of the question's own key.

    A stated set of questions against all vectors: both come in packed blocks, each two blocks meet
    in one matrix product, and of a block only the k best of each question go on. A question meets
    the vectors that have as many components as its own, no others.
    """
    asked = vector_blocks(questions, query, vector, 1024).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("block").alias("q_block"))
    numbers = asked.agg(F.collect_list("q_block").alias("numbers"))  # one number for 1,024 questions
    met = vector_blocks(vectors, key, vector, 4096).withColumn("numbers", numbers.scalar()).select("ids", "vectors", F.explode("numbers").alias("q_block")).join(asked, "q_block")
    bytes_of = lambda c: F.octet_length(c).cast("long")
    met = met.where(bytes_of("vectors") * bytes_of("q_ids") == bytes_of("q_vectors") * bytes_of("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, i = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                score = np.round(np.frombuffer(row["q_vectors"], "<f8").reshape(len(q), -1) @ np.frombuffer(row["vectors"], "<f8").reshape(len(i), -1).T, 6)
                if others_only:
                    score[q[:, None] == i[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(i, score.shape), -score), axis=1)[:, :k]
                found = np.take_along_axis(score, best, 1)
                real = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, real.sum(axis=1))), pa.array(i[best[real]]), pa.array(found[real])], [query, key, "score"])

    scored = met.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(run, f"{query} long, {key} long, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def hybrid(questions: DataFrame, docs: DataFrame, vectors: DataFrame, query: str, key: str, scoped: bool = False, n: int = TOP_N, reranker: object = None) -> DataFrame:
    """Hybrid search: vectors and words, rank fusion, scope with relaxation, reranking if a backend of ``scorers`` is given, the n best with position, margin and top1.

    questions: query, text, embedding and, if scoped, wanted (null: no filter); docs: key, text and,
    if scoped, scope; vectors: key, embedding. top1 is the best vector score among the n
    selected, 0 where none of them came by its vector.
    """
    near = dense(questions, vectors, query, key, "embedding", others_only=False)
    found = fused(near, bm25(questions, docs, query, key), query, key).withColumn("relaxed", F.lit(False))
    if scoped:
        found = found.drop("relaxed").join(docs.select(key, "scope"), key).join(questions.select(query, "wanted"), query)
        found = in_scope(found, query, F.col("scope"), F.col("wanted")).drop("scope", "wanted")
    if reranker is None:
        best = selected(found, query, key, n)
    else:
        from groundwork.operators.scorers import rerank

        # The margin is one of fused scores, so it is taken before any order changes.
        best = rerank(selected(found, query, key, max(n, POOL)), questions, docs, reranker, query, key, n).where(F.col("position") <= n)
    return best.withColumn("top1", F.max(F.coalesce("first_score", F.lit(0.0))).over(Window.partitionBy(query)))


def fused(first: DataFrame, second: DataFrame, query: str, key: str, weight: float = 1.0) -> DataFrame:
    """(query, key, first_rank, second_rank, first_score, rrf): reciprocal-rank fusion; a rank may be missing."""
    a = first.select(query, key, F.col("rank").alias("first_rank"), F.col("score").alias("first_score"))
    b = second.select(query, key, F.col("rank").alias("second_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return a.join(b, [query, key], "full").withColumn("rrf", F.round(part("first_rank") + weight * part("second_rank"), 9))


def in_scope(found: DataFrame, query: str, scope: Column, wanted: Column, least: int = LEAST_SCOPED) -> DataFrame:
    """The rows whose scope is open or holds what is wanted; if fewer than `least` of a question would
    stay, all of them, with `relaxed`."""
    keep = (F.size(scope) == 0) | F.array_contains(scope, wanted) | F.array_contains(scope, F.lit("ALL"))
    marked = found.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    many = F.count_if("_keep").over(Window.partitionBy(query)) >= least
    return marked.withColumn("relaxed", ~many).where(F.col("_keep") | F.col("relaxed")).drop("_keep")


def selected(found: DataFrame, query: str, key: str, n: int = TOP_N) -> DataFrame:
    """The n best of each question by fused score, with position and margin (first less third, 0 below three)."""
    by = Window.partitionBy(query)
    ranked = found.withColumn("position", F.row_number().over(by.orderBy(F.desc("rrf"), F.col("first_rank").asc_nulls_last(), key)))
    at = lambda k: F.max(F.when(F.col("position") == k, F.col("rrf"))).over(by)
    return ranked.withColumn("margin", F.round(F.coalesce(at(1) - at(3), F.lit(0.0)), 9)).where(F.col("position") <= n)


def reranked(found: DataFrame, query: str, score: str, n: int = TOP_N) -> DataFrame:
    """Positions after re-sorting the first max(n, 20) of each question by `score`; the tail keeps its order."""
    pool = F.col("position") <= max(n, POOL)
    order = Window.partitionBy(query).orderBy(pool.desc(), F.when(pool, F.col(score)).desc_nulls_last(), "position")
    return found.withColumn("position", F.row_number().over(order))


def gate(results: DataFrame, lang: str, top: str) -> Column:
    """Whether a question's best score passes its language's threshold; no result never does."""
    limits = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
    return F.coalesce(F.col(top) >= F.coalesce(limits[F.col(lang)], F.lit(DEFAULT_THRESHOLD)), F.lit(False))


def context(found: DataFrame, query: str, today: Column) -> DataFrame:
    """One row for each question: refs, block, has_stale, all_government over its selected evidence.

    found: query, position, title, publisher_type, verified_at (text), text.
    """
    old = T.stale(F.col("verified_at"), today, STALE_DAYS)
    body = F.when(F.col("text").startswith("["), F.regexp_replace("text", r"\A[^\n]*\n", "")).otherwise(F.col("text"))
    rows = found.withColumn("stale", old).withColumn("entry", F.format_string("[%d] %s\n%s", F.col("position"), F.col("title"), body))
    entries = F.array_sort(F.collect_list(F.struct("position", "entry")))
    return rows.groupBy(query).agg(
        F.count("*").alias("n_refs"), F.array_join(F.transform(entries, lambda x: x["entry"]), "\n\n").alias("block"),
        F.bool_or("stale").alias("has_stale"), F.bool_and(F.col("publisher_type") == "government").alias("all_government"),
    )
