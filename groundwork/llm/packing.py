"""Best-fit packing (operator 7): a configuration linear program over the length histogram.

Pieces of documents go into sequences of `capacity` tokens. Which piece stands where matters
only through its length, so the plan is made on the histogram of lengths, which has at most
`capacity` entries however large the corpus is:

1.  A configuration is a multiset of lengths that fit one sequence. The linear program asks
    for the fewest configurations that cover the histogram. It is solved by multiplicative
    weights to a fractional solution: each length has a weight (its share of a sequence, times a
    factor that falls exponentially as the length gets covered), and pricing - the configurations
    of largest weight - is an unbounded knapsack, solved by dynamic programming over the capacity.
    Prices also give a lower bound of the program's value (`Program.bound`).
2.  Rounding takes each configuration's multiplicity down to a whole number, then once more
    those whose rest is large and whose pieces are still there; what is left is placed by best
    fit, longest first, again on the histogram (equal sequences are handled as one).
3.  The plan gives each length a list of slots. Spark numbers the pieces of a length - a
    range partitioning by length, then per-partition counts - and piece r takes slot r.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.chunk_cache import chunk_ids
from groundwork.llm.common import arrow_table, in_arrow, settle, slices, utf8

#: Pricings at most, how fast weights fall as a length gets covered, and the share of a length that one round
#: may cover (one piece at least).
ROUNDS, ETA, STEP = 100, 4.0, 0.25
#: Of configurations that fill a sequence alike, those of longer pieces are worth a little more: short
#: pieces fit anywhere, so they are kept for last.
BONUS = 0.5

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, cut only where they pass `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_ids(path).encode, end_id.to_bytes(4, "little")
        for batch in slices(batches, "text", 2000, 8 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            yield arrow_table(dict(zip(PIECES.names, map(list, zip(*rows)))), PIECES)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def priced(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over all capacities: the largest total weight that fits each, and the length placed last for it.

    weights[s] is that of length s, negative infinity where there is none to place.
    """
    capacity = len(weights) - 1
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = weights[1 : c + 1] + best[c - 1 :: -1]
        s = int(value.argmax())
        if value[s] > best[c - 1]:
            best[c], took[c] = value[s], s + 1
        else:
            best[c] = best[c - 1]
    return best, took


def traced(took: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths behind a knapsack's value at a capacity."""
    found: dict[int, int] = defaultdict(int)
    while capacity > 0:
        if took[capacity]:
            found[int(took[capacity])] += 1
            capacity -= int(took[capacity])
        else:
            capacity -= 1
    return found


@dataclass
class Program:
    """A fractional solution: configurations (length, copies) with their multiplicities, what they leave of each
    length, and a lower bound of the program's value from the prices seen."""

    x: dict[tuple[tuple[int, int], ...], float]
    left: dict[int, float]
    bound: float


def fractional(counts: dict[int, int], capacity: int) -> Program:
    """The configuration program by multiplicative weights.

    A round prices all lengths by one knapsack and takes from it, for each length still to be
    covered, the best configuration that holds it. Only configurations that fill their sequence
    are taken: at the prices s / capacity, under which no sequence is worth more than 1, they lose
    nothing, so what they cover is covered at the least cost. A round covers a length by at
    most STEP of its count; then weights fall with the coverage.
    """
    n, share = np.zeros(capacity + 1), np.arange(capacity + 1) / capacity
    for s, k in counts.items():
        n[s] = k
    left, x = n.copy(), defaultdict(float)
    bound = float((n * share).sum())
    for _ in range(ROUNDS):
        free = left > 0
        weights = np.where(free, share * (1 + BONUS * share) * np.exp(-ETA * (1 - left / np.maximum(n, 1))), -np.inf)
        best, took = priced(weights)
        if best[capacity] <= 0:
            break
        bound = max(bound, float((np.where(free, weights, 0) * n).sum() / best[capacity]))
        room, before = np.minimum(np.maximum(STEP * n, 1), left), len(x)
        taken = 0.0
        for s in np.flatnonzero(free)[::-1].tolist():
            inside = traced(took, capacity - s)
            inside[s] += 1
            part = min(room[t] / a for t, a in inside.items())
            if part > 0 and sum(t * a for t, a in inside.items()) == capacity:
                taken += part
                x[tuple(sorted(inside.items()))] += part
                for t, a in inside.items():
                    room[t] -= part * a
                    left[t] = max(0.0, left[t] - part * a)
        if taken < 1 and len(x) == before:
            break
    return Program(dict(x), {int(s): float(left[s]) for s in np.flatnonzero(left)}, bound)


def rounded(program: Program, counts: dict[int, int]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole multiplicities, and what they leave of the counts.

    First every multiplicity rounded down; then, by falling rest, configurations once more of
    which the program has a half at least and whose pieces are all still there.
    """
    left, times = dict(counts), {inside: int(v) for inside, v in program.x.items()}
    for inside, k in times.items():
        for s, a in inside:
            left[s] -= a * k
    for inside, v in sorted(program.x.items(), key=lambda item: (item[1] % 1, item[0]), reverse=True):
        if v % 1 >= 0.5 and all(left[s] >= a for s, a in inside):
            times[inside] += 1
            for s, a in inside:
                left[s] -= a
    return [(dict(inside), k) for inside, k in times.items() if k], {s: k for s, k in left.items() if k}


def best_fit(counts: dict[int, int], capacity: int, opened: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling length, whole groups of equal sequences at a time; `opened` may have room left."""
    groups: dict[int, list[list]] = defaultdict(list)  # room -> [contents, how many sequences]
    full = []
    for inside, times in opened:
        room = capacity - sum(s * a for s, a in inside.items())
        groups[room].append([inside, times])
    full += groups.pop(0, [])
    rooms = sorted(groups)
    for s in sorted(counts, reverse=True):
        todo = counts[s]
        while todo:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                group, room = [{}, -(-todo // (capacity // s))], capacity
            else:
                room = rooms[k]
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            inside, times = group
            each = room // s
            whole = min(times, todo // each)
            parts = [(each, whole)]
            if whole < times and todo % each and todo // each == whole:
                parts.append((todo % each, 1))
            todo -= sum(a * m for a, m in parts)
            parts.append((0, times - sum(m for _, m in parts)))
            for a, m in parts:
                if m and (a or inside):
                    after, gap = dict(inside), room - a * s
                    if a:
                        after[s] = after.get(s, 0) + a
                    if not gap:
                        full.append([after, m])
                        continue
                    if gap not in groups:
                        insort(rooms, gap)
                    groups[gap].append([after, m])
    return [(inside, times) for inside, times in [*full, *(g for many in groups.values() for g in many)]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(contents of a sequence by length, how many such sequences), covering the counts exactly."""
    used, left = rounded(fractional(counts, capacity), counts)
    return best_fit(left, capacity, used)


def slots(packed: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays over the configurations that hold it: pieces placed before, copies in each
    sequence, first sequence_id, offset of the first copy."""
    found: dict[int, list] = defaultdict(list)
    placed: dict[int, int] = defaultdict(int)
    first = 0
    for inside, times in packed:
        at = 0
        for s in sorted(inside, reverse=True):
            found[s].append((placed[s], inside[s], first, at))
            placed[s] += inside[s] * times
            at += inside[s] * s
        first += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in found.items()}


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack the documents' token ids into sequences of at most `capacity`.

    Result per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    documents longer than `capacity` are cut. Null or empty text: one piece with the end id.
    A null doc_id is kept; repeated rows are packed each for itself; an empty table gives an
    empty result. Ties between pieces of one length go by doc_id, piece and checksum.
    Other columns are not read.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    cut = settle(pieces(docs, path, end_id, capacity), "pieces")
    ranked = settle(
        cut.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "ranked",
    )
    # A row for each length, and one more for each border between partitions.
    runs = ranked.groupBy("length", "part").agg(F.count("*").alias("n"), F.min("place").alias("place")).collect()
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(runs):
        before[r.length, r.part] = counts[r.length] - r.place
        counts[r.length] += r.n
    table = docs.sparkSession.sparkContext.broadcast((before, slots(plan(dict(counts), capacity))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, by_length = table.value
        for batch in batches:
            length, part, place = (batch.column(c).to_numpy() for c in ("length", "part", "place"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(length) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(length)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                s = int(length[a])
                rank = place[a:b] + before[s, int(part[a])]
                seen, copies, first, at = by_length[s]
                k = np.searchsorted(seen, rank, "right") - 1
                times, copy = np.divmod(rank - seen[k], copies[k])
                sequence[a:b], offset[a:b] = first[k] + times, at[k] + copy * s
            yield arrow_table({c: batch.column(c) for c in PIECES.names} | {"sequence_id": sequence, "offset": offset}, PLACED)

    return in_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
