"""MinHash near-dedup (operator 6) with SuperMinHash signatures.

1.  Every text becomes its set of 64-bit shingle hashes. Texts with equal sets form a class,
    and one document, the smallest doc_id, stands for it from here on.
2.  SuperMinHash: each element draws a random permutation of the signature's slots, one rank
    at a time; the slot at rank j is offered j plus a random fraction. The ranks of an element
    are correlated (no slot twice), which lowers the variance against plain MinHash. A set
    stops as soon as no slot is empty: later ranks offer larger values everywhere.
3.  Banding: sets that agree in all slots of a band meet in its bucket. In each bucket every
    class is compared with the smallest one, so a bucket of n classes gives n - 1 pairs.
4.  Verification on the full sets, then union-find. Buckets whose classes ended in different
    components are taken up again, first with a member of the least component that each bucket
    draws, then pair by pair between components, inside groups of bounded size that send
    only links, so that no pair of a bucket that could still unite two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import GOLD, arrow_table, in_arrow, mix, settle, slices, unused, utf8, word_hashes
from groundwork.llm.components import components

#: Slots of a signature and slots of a band: at similarity 0.75 a pair shares no band once in 200,000 times.
SLOTS, ROWS = 128, 4
WORDS, PERCENT = 5, 75
EMPTY = np.uint64(2**64 - 1)
#: Slots in which a pair at the limit agrees at least, five standard deviations below its mean of 96.
FEWEST = 71
#: Elements of sets signed at a time, classes of a bucket that are compared in one group.
ELEMENTS, BLOCK = 120_000, 1024

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; one for a shorter text, none without words."""
    h = word_hashes(text.lower().split()) if text else np.empty(0, np.uint64)
    if len(h) == 0:
        return h
    n = max(1, len(h) - words + 1)
    total = np.full(n, np.uint64(min(len(h), words)))
    for k in range(min(words, len(h))):
        total = mix(total ^ h[k : k + n])
    return np.unique(total)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, all sets rank by rank together."""
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * slots, EMPTY)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    places = None
    for rank in range(slots):
        drawn = mix(element + np.array([rank], np.uint64) * GOLD)
        pick = rank + ((drawn & low) * np.uint64(slots - rank) >> half).astype(np.int64)
        if places is None:
            slot = pick
        else:
            row = np.arange(len(element))
            slot = places[row, pick].astype(np.int64)
            places[row, pick] = places[row, rank]
        np.minimum.at(out, owner * slots + slot, np.uint64(rank) << half | drawn >> half)
        open_sets = (out.reshape(-1, slots) == EMPTY).any(axis=1)
        if not open_sets.any():
            break
        if places is None:
            keep = open_sets[owner]
            element, owner, pick = element[keep], owner[keep], pick[keep]
            places = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
            places[np.arange(len(element)), pick] = 0
        elif (keep := open_sets[owner]).mean() < 0.7:
            element, owner, places = element[keep], owner[keep], places[keep]
    return out.reshape(-1, slots)


def band_keys(signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    slots = signs.shape[1] // rows * rows
    parts = signs[:, :slots].reshape(len(signs), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = mix(key ^ parts[:, :, k])
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit fingerprint of the set), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 2 << 20):
            sets = [shingles(t) for t in utf8(batch, "text")]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            at = 0
            while at < len(full):
                stop, size = at, 0
                while stop < len(full) and (stop == at or size + len(sets[full[stop]]) <= ELEMENTS):
                    size += len(sets[full[stop]])
                    stop += 1
                for k, keys in zip(full[at:stop], band_keys(signatures([sets[k] for k in full[at:stop]]))):
                    bands[k] = keys
                at = stop
            yield arrow_table({"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "set_a": prints[:, 0].copy(), "set_b": prints[:, 1].copy(), "bands": bands}, FEATURES)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the packed set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 4 << 20):
            yield arrow_table({"node": batch.column("doc_id"), "shingles": [shingles(t).tobytes() for t in utf8(batch, "text")]}, SETS)

    return in_arrow(docs, run, "node long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, on whole sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = int((np.diff(np.sort(np.concatenate((a, b)))) == 0).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), with `linked`: whether their full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "one", 500, 4 << 20):
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("one", "two"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([similar(x, y) for x, y in zip(one, two)], pa.bool_())], names=["a", "b", "linked"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    return in_arrow(joined.select("a", "b", "one", "two"), run, "a long, b long, linked boolean")


def mixed_buckets(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node, component, least: the buckets whose classes lie in several components so far."""
    labelled = buckets.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return labelled.join(mixed.select("bucket", "least"), "bucket")


def links_of(docs: DataFrame, buckets: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """Verified links (a, b) that join exactly the classes which chains of similar sets join.

    buckets: (bucket, node), a class in each of its bands' buckets.
    """
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = settle(buckets.join(shared.select("bucket", "leader"), "bucket"), "buckets")
    ids = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(shingle_sets(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id")), "sets")
    # First every class of a bucket with the bucket's smallest class.
    pairs = buckets.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    done = settle(verified(pairs, sets), "verified")
    buckets = buckets.select("bucket", "node")
    # Where that leaves several components in a bucket: the classes outside the least one with
    # a class of it that each bucket draws anew, so that a class meets others in each of its buckets.
    mixed = settle(mixed_buckets(buckets, components(done.where("linked"))), "mixed")
    if mixed.isEmpty():
        return done.where("linked").select("a", "b")
    drawn = mixed.where("component = least").groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("x"))
    pairs = drawn.join(mixed.where("component <> least"), "bucket").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = settle(verified(pairs.join(done, ["a", "b"], "left_anti"), sets), "verified")
    done = done.union(more)
    # What a bucket still holds apart, class by class, without a row for a pair.
    mixed = mixed_buckets(mixed.select("bucket", "node"), components(done.where("linked")))
    return done.where("linked").select("a", "b").union(apart_links(mixed, sets, fewest))


def apart_links(mixed: DataFrame, sets: DataFrame, fewest: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket and differ in component.

    A bucket is cut into blocks of about BLOCK classes; each two blocks of a bucket meet in one
    group, which looks at all its pairs and sends only links.
    """
    sizes = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    rows = mixed.select("bucket", "node", "component").join(sizes, "bucket").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in slices(batches, "shingles", 500, 4 << 20):
            for bucket, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, low, high) != last:
                    if len(held) > 1:
                        yield table(last, held)
                    held, last = [], (bucket, low, high)
                held.append(row)
        if len(held) > 1:
            yield table(last, held)

    def table(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        links = list(block_links(*key, rows, fewest))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return in_arrow(met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high"), run, "a long, b long")


def block_links(bucket: int, low: int, high: int, rows: list[tuple], fewest: int = FEWEST) -> Iterator[tuple[int, int]]:
    """Links between the classes (block, node, component, shingles) of two blocks of a bucket.

    Pairs of one component, pairs whose first common band is another bucket, and pairs whose
    signatures agree in fewer slots than `fewest` need no comparison of their sets.
    """
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    signs = np.concatenate([signatures(sets[a : a + 256]) for a in range(0, len(sets), 256)])
    bands = band_keys(signs)
    shorts = (mix(signs) >> np.uint64(32)).astype(np.uint32)
    block, component = (np.array([r[k] for r in rows], np.int64) for k in (0, 2))
    band = int(np.flatnonzero((bands == bucket).any(axis=0))[0])
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    second = np.flatnonzero(block == high)
    for x in np.flatnonzero(block == low).tolist():
        ys = second[second > x] if low == high else second
        ys = ys[component[ys] != component[x]]
        ys = ys[~(bands[ys, :band] == bands[x, :band]).any(axis=1)]
        for y in ys[(shorts[ys] == shorts[x]).sum(axis=1) >= fewest].tolist():
            one, two = root(int(component[x])), root(int(component[y]))
            if one != two and similar(sets[x], sets[y]):
                up[max(one, two)] = min(one, two)
                yield min(rows[x][1], rows[y][1]), max(rows[x][1], rows[y][1])


def near_duplicates(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents grouped by chains of similar texts.

    A text's set are its distinct shingles of five words (A-Z lower-cased; a text of fewer
    words is one shingle). Two documents are linked if 100 * intersection >= 75 * union.
    component_id is the smallest doc_id reachable; kept says that it is the document's own.
    Null texts and texts without words have no shingles and stay alone. One row for each
    input row; rows that repeat a doc_id share its component. A null doc_id takes no part in
    links and gives component_id null, kept true. An empty table gives an empty result.
    Other columns are not read. Pairs of a bucket that are met in the last round are compared if
    their signatures agree in `fewest` slots at least; 0 compares all of them on their sets.
    """
    feats = settle(features(docs), "features")
    real = feats.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = settle(classes, "classes")
    links = links_of(docs, classes.select("node", F.explode("bands").alias("bucket")).distinct(), fewest)
    # Rows that repeat an id hold its classes together.
    same = real.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.union(same.where("a <> b")))
    return (
        feats.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each group: the smallest doc_id.

    Of rows that repeat that doc_id the one with the smallest text stays. Rows without doc_id stay.
    """
    found = near_duplicates(docs)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    row = unused(docs.columns, "row")
    first = own.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1)
    return first.select(docs.columns).unionByName(docs.where("doc_id is null"))
