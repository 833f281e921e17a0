"""Exact top-k search (operator 5) by a three-phase uniform threshold.

A vector's score for a query is the sum of m parts, one for each group of dimensions; each
group of a block of vectors is a list of part scores for each query.

Phase 1  Each block gathers, for every query, the k best entries of each list, sums the parts of
         these vectors alone, and reports the k best sums and each list's highest part. The k-th
         best sum over all blocks is a safe cutoff T: at least k vectors reach it.
Phase 2  The cutoffs go to the blocks. A list whose highest part is below T / m has nothing to
         yield, a block whose highest parts add up to less than T has no answer, and a pair of
         blocks in which this holds for all queries is not met again. Every other list yields
         its entries of at least T / m: a vector that none of the m lists yields has a sum below T.
Phase 3  Yielded vectors that could still reach T (known parts, and the other lists' highest) have
         their missing parts computed, theirs alone; sums of at least T go on, at most k for each
         query and block, and the k best over all blocks are the answer.

Vectors travel in blocks of bounded size; a block of queries meets every block of vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, in_arrow, settle

#: Vectors in a block, queries in a block, groups of dimensions.
BLOCK, QUERY_BLOCK, GROUPS = 4096, 1024, 4

BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def scaled(values: list[float | None] | None, scale: float) -> list[int] | None:
    """floor(scale * x) of every component; none for a vector that takes no part."""
    if values is None or any(x is None for x in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    y = np.floor(x * scale)
    return [int(v) for v in y.tolist()] if np.isfinite(y).all() else None


def packed(ids: list[int], vectors: np.ndarray) -> dict[str, list]:
    """A block row: the ids, and the vectors as integers of the least width that holds them."""
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return {"n": [len(ids)], "dims": [vectors.shape[1]], "ids": [np.array(ids, "<i8").tobytes()], "vectors": [vectors.astype(kind).tobytes()]}


def blocks(vectors: DataFrame, scale: float, size: int) -> DataFrame:
    """block, n, dims, ids, vectors: the rows that take part, `size` at most in a row, shorter vectors filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, rows = TaskContext.get().partitionId() << 33, [], []

        def out() -> pa.RecordBatch:
            nonlocal number
            dims = max(map(len, rows))
            full = np.array([r + [0] * (dims - len(r)) for r in rows], object).reshape(len(rows), dims)
            if dims and max(abs(full.max()), abs(full.min())) >= 1 << 62:
                raise ValueError("a component times the scale passes 62 bits")
            row = arrow_table(packed(ids, full.astype(np.int64)) | {"block": [number]}, BLOCKS)
            number += 1
            return row

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is not None and (v := scaled(v, scale)) is not None:
                    ids.append(i)
                    rows.append(v)
                    if len(ids) == size:
                        yield out()
                        ids, rows = [], []
        if ids:
            yield out()

    return in_arrow(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), run, "block long, n int, dims int, ids binary, vectors binary")


def opened(ids: bytes, vectors: bytes, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a block row, with `width` dimensions."""
    i = np.frombuffer(ids, "<i8")
    v = np.zeros((len(i), width), np.int64)
    if dims:
        v[:, :dims] = np.frombuffer(vectors, f"<i{len(vectors) // (len(i) * dims)}").reshape(len(i), dims)
    return i, v


#: Below every score, and the cutoff of a query with fewer than k candidates, all of which are answers.
NEVER, ALL = -(2**63), -(2**62)
#: Entries whose missing parts are computed at a time.
ENTRIES = 1 << 16


class Pair:
    """A block of queries and a block of vectors, and the lists of part scores between them."""

    def __init__(self, row: dict) -> None:
        width = max(row["q_dims"], row["dims"], 1)
        self.queries, q = opened(row["q_ids"], row["q_vectors"], row["q_dims"], width)
        self.ids, v = opened(row["ids"], row["vectors"], row["dims"], width)
        order = np.argsort(self.ids, kind="stable")
        self.ids, v = self.ids[order], v[order]
        most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * width
        # Sums of products are exact while they stay below the mantissa; beyond that, in Python's integers.
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if most >= 1 << 63:
            raise ValueError("a score passes 63 bits")
        self.q, self.v = q.astype(kind), v.astype(kind)
        self.cuts = np.array_split(np.arange(width), min(GROUPS, width))
        self.own = self.queries[:, None] == self.ids[None, :]

    def part(self, g: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """List g of some queries: the part score of every vector, below all others for a query's own."""
        c = self.cuts[g]
        p = self.q[rows][:, c] @ self.v[:, c].T
        own = self.own[rows]
        if own.any():
            p[own] = -np.inf
        return p


def gathered(pair: Pair, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 of a pair: for each query the k best sums among the lists' best entries, and each list's highest part."""
    parts = [pair.part(g) for g in range(len(pair.cuts))]
    n = len(pair.ids)
    best = [np.argsort(-p, axis=1, kind="stable")[:, :k] if p.dtype == object else np.argpartition(p, max(0, n - k), axis=1)[:, max(0, n - k) :] for p in parts]
    picked = np.sort(np.concatenate(best, axis=1), axis=1)
    total = sum(np.take_along_axis(p, picked, 1) for p in parts)
    total[:, 1:][picked[:, 1:] == picked[:, :-1]] = -np.inf
    scores = np.sort(total, axis=1)[:, ::-1][:, :k]
    return whole(scores), whole(np.stack([p.max(axis=1) for p in parts], axis=1))


def whole(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what is no score is NEVER."""
    known = x != -np.inf
    return np.where(known, np.where(known, x, 0).astype(np.int64), NEVER)


def active_lists(tops: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Phase 2 before any score: which lists of which queries have entries to yield (queries x lists)."""
    m = tops.shape[1]
    can = (tops != NEVER).all(axis=1)
    bound = np.where(can[:, None], tops, 0).sum(axis=1)
    return (tops >= floors(cutoffs, m)[:, None]) & (can & (bound >= cutoffs))[:, None]


def floors(cutoffs: np.ndarray, m: int) -> np.ndarray:
    """The least whole number of at least cutoff / m."""
    return -(-cutoffs // m)


def resolved(pair: Pair, cutoffs: np.ndarray, tops: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3 of a pair: query positions, vector positions and exact scores of the vectors that reach
    the cutoff, and how many vectors were completed for that."""
    m, floor = len(pair.cuts), floors(cutoffs, len(pair.cuts))
    rows = np.flatnonzero(active.any(axis=1))
    place = np.zeros(len(active), np.int64)
    lists, yielded = [], np.zeros((len(rows), len(pair.ids)), bool)
    for g in range(m):
        mine = np.flatnonzero(active[rows, g])
        p = pair.part(g, rows[mine])
        yielded[mine] |= p >= floor[rows[mine], None]
        place[:] = -1
        place[rows[mine]] = np.arange(len(mine))
        lists.append((p, place.copy()))
    r, c = np.nonzero(yielded)
    r = rows[r]
    total, bound = np.zeros(len(r), pair.q.dtype), np.zeros(len(r), np.int64)
    for g, (p, place) in enumerate(lists):
        known = active[r, g]
        total[known] += p[place[r[known]], c[known]]
        bound[~known] += tops[r[~known], g]
    keep = total + bound >= cutoffs[r]
    r, c, total = r[keep], c[keep], total[keep]
    for g, cut in enumerate(pair.cuts):
        missing = np.flatnonzero(~active[r, g])
        for a in range(0, len(missing), ENTRIES):
            e = missing[a : a + ENTRIES]
            total[e] += (pair.q[r[e]][:, cut] * pair.v[c[e]][:, cut]).sum(axis=1)
    reach = total >= cutoffs[r]
    return r[reach], c[reach], total[reach].astype(np.int64), len(keep)


def firsts(r: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to the smaller vector position (its smaller id)."""
    order = np.lexsort((c, -score, r))
    begin = np.flatnonzero(np.diff(r[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


LISTS = pa.schema([("q_block", pa.int64()), ("block", pa.int64()), ("scores", pa.binary()), ("tops", pa.binary())])
SCORES = pa.schema([("query_id", pa.int64()), ("score", pa.int64())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, exact.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with
    another vec_id. Components become floor(scale * x). Ties go to the smaller vec_id; with
    fewer than k candidates all are returned. Vectors that are null or hold a null or
    non-finite component, and rows without vec_id, take no part. Vectors of unequal length
    score as if the shorter were filled up with zeros; an empty vector scores 0. Rows that
    repeat a vec_id are candidates each for itself; a repeated query is answered once, by
    the row with the largest vector. An empty table gives an empty result. Other columns are not read.
    """
    known = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    cands = settle(blocks(known, scale, BLOCK), "vectors")
    asked = known.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    asked = settle(asked, "asked")
    asked = asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)))
    queries = settle(blocks(asked, scale, QUERY_BLOCK), "queries").select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    numbers = [r.q_block for r in queries.select("q_block").collect()]  # one for about QUERY_BLOCK queries
    met = cands.withColumn("q_block", F.explode(F.from_json(F.lit(json.dumps(numbers)), "array<bigint>"))).join(queries, "q_block")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                scores, tops = gathered(Pair(row), k)
                yield arrow_table({"q_block": [row["q_block"]], "block": [row["block"]], "scores": [scores.astype("<i8").tobytes()], "tops": [tops.astype("<i8").tobytes()]}, LISTS)

    lists = settle(in_arrow(met, gather, "q_block long, block long, scores binary, tops binary"), "lists")
    ids = queries.select("q_block", "q_ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_scores, packed_ids in zip(batch.column("scores").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
                query = np.frombuffer(packed_ids, "<i8")
                score = np.frombuffer(packed_scores, "<i8").reshape(len(query), -1)
                real = score != NEVER
                yield arrow_table({"query_id": np.repeat(query, real.sum(axis=1)), "score": score[real]}, SCORES)

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    gathered_scores = in_arrow(lists.select("q_block", "scores").join(ids, "q_block"), spread, "query_id long, score long")
    cutoffs = gathered_scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    # Fewer than k candidates: everything is part of the answer. One row for each query block.
    owner = in_arrow(ids, _ids_of_blocks, "q_block long, query_id long")
    by_block = owner.join(cutoffs, "query_id", "left").groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", F.when(F.col("n") >= k, F.col("score")).otherwise(F.lit(ALL).cast("long"))))).alias("cutoffs")
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = dict(row["cutoffs"])
                cut = np.array([known[q] for q in np.frombuffer(row["q_ids"], "<i8").tolist()], np.int64)
                if active_lists(np.frombuffer(row["tops"], "<i8").reshape(len(cut), -1), cut).any():
                    yield arrow_table({"q_block": [row["q_block"]], "block": [row["block"]], "scores": [cut.astype("<i8").tobytes()], "tops": [row["tops"]]}, LISTS)

    again = in_arrow(lists.select("q_block", "block", "tops").join(ids, "q_block").join(by_block, "q_block"), choose, "q_block long, block long, scores binary, tops binary")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                pair, cut = Pair(row), np.frombuffer(row["scores"], "<i8")
                tops = np.frombuffer(row["tops"], "<i8").reshape(len(cut), -1)
                r, c, score, _ = resolved(pair, cut, tops, active_lists(tops, cut))
                best = firsts(r, c, score, k)
                yield arrow_table({"query_id": pair.queries[r[best]], "vec_id": pair.ids[c[best]], "score": score[best]}, FOUND)

    found = in_arrow(again.join(cands, "block").join(queries, "q_block"), resolve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("q_block", pa.int64()), ("query_id", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["q_ids"], "<i8")
            yield arrow_table({"q_block": np.full(len(ids), row["q_block"]), "query_id": ids}, schema)
