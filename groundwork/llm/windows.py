"""Which windows of fixed length occur earlier in the corpus: the frame that the two exact
duplicate-passage operators share.

A text is a sequence of symbols (bytes or words), a window is `length` symbols in a row. The
minimiser of a window is the gram (`gram` symbols) of smallest hash in it, leftmost if equal;
it depends on the window's content alone, so equal windows have equal minimisers.
Consecutive windows that share a minimiser occurrence are a run.

1.  anchors: every run's minimiser hash. A hash that occurs once in the corpus proves all
    windows of its run unique, so only runs whose hash occurs again are candidates. The rows of
    a hash meet and are counted, and there it is decided whether the hash is hot: once, for all
    batches, by the number of different surroundings that its runs have. Runs of a batch with the
    same surroundings are one row, so copies of a document bring a row for each batch together. A
    batch that makes a hash hot by itself knows that of its own runs; it sends one row that tells
    the others, so no batch sends HOT_IN_BATCH rows of one hash to the place where they meet.
2.  runs: the candidates' packed strings travel to the bucket of their hash. A batch sends each
    distinct string once, from its first owner. Hot hashes (a passage that many documents
    hold, each in other surroundings) are spread: there each window travels alone, keyed
    by its own content, so that a bucket holds copies of few windows.
3.  A bucket decides which of its windows each first owner has first (`fresh`); the operator
    says how. All other windows of candidate runs are duplicates.
4.  Each document removes the symbols that its duplicate windows cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import MIX_1, arrow_table, in_arrow, mix, settle, slices, unused, utf8

#: Windows looked at in one go, bytes of text in a batch, bytes of distinct strings of a bucket chunk.
STRETCH, TEXT_BYTES, CHUNK_BYTES = 1 << 18, 2 << 20, 1 << 20
#: Strings cut from a text in one go.
SPANS = 8192
#: A run in one number: its start, its windows (in WINDOW_BITS bits), and whether its hash is hot.
WINDOW_BITS = 12
#: A hash is hot from so many different surroundings in one batch, or so many in all batches.
HOT_IN_BATCH, HOT_ROWS = 64, 1000
#: Bits of an anchor's mark below its surroundings' hash of 20 bits: a place and a number of windows.
PLACE_BITS = 31 + WINDOW_BITS

MORE = pa.list_(pa.struct([("doc_id", pa.int64()), ("mark", pa.int64())]))
ANCHORS = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("more", MORE)])
RUNS = pa.schema([("h", pa.int64()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32())])
FRESH = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


@dataclass(frozen=True)
class Windows:
    """The symbols of a kind of window. hashes: bytes of a text to its symbols' 64-bit hashes;
    strings: packs the symbols of [a, b) ranges of a text; gram: a power of two, at most `length`."""

    length: int
    gram: int
    hashes: Callable[[bytes], np.ndarray]
    strings: Callable[[bytes, list[tuple[int, int]]], list[bytes]]


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that starts at each symbol, by doubling."""
    width = 1
    while width < gram:
        h = mix(h[:-width] * np.uint64(0x9E6C63D0876A9A47) + h[width:])
        width *= 2
    return h


def runs_of(h: np.ndarray, ends: np.ndarray, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first window, number of windows, hash of the first and last gram) of each run, in a
    stream of texts that end at `ends`."""
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(h) - spec.length + 1, STRETCH):
        part = h[a : a + STRETCH + spec.length - 1]
        n = len(part) - spec.length + 1
        grams = gram_hashes(part, spec.gram)
        place, width, count = np.arange(len(grams), dtype=np.int32), 1, spec.length - spec.gram + 1
        low = grams
        while width < count:
            step = min(width, count - width)
            # Whole hashes are compared; of equal ones the leftmost stays.
            right = low[step:] < low[: len(low) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            low = np.where(right, low[step:], low[: len(low) - step])
            width += step
        place = place[:n].astype(np.int64)
        # A window lies in one text if no text ends inside it.
        inside = np.searchsorted(ends, np.arange(a, a + n), "right") == np.searchsorted(ends, np.arange(a, a + n) + spec.length - 1, "right")
        place[~inside] = -1
        new = np.flatnonzero(np.diff(place, prepend=-2))
        count_of = np.diff(np.append(new, n))
        new, count_of = new[place[new] >= 0], count_of[place[new] >= 0]
        around = mix(grams[new] * MIX_1 + grams[new + count_of - 1 + spec.length - spec.gram])
        out.append((grams[place[new]].view(np.int64), new + a, count_of, around))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def stream(texts: list[bytes | None], spec: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbol hashes in a row, and where each text ends."""
    parts = [spec.hashes(t or b"") for t in texts]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.cumsum([len(p) for p in parts])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text alone. Columns of the right type are taken as they are, for a cast's new name would
    hide from Spark that two shuffles of the texts are one."""
    kinds = dict(docs.dtypes)
    return docs.select(*(c if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))))


def candidates(docs: DataFrame, spec: Windows) -> DataFrame:
    """(doc_id, runs): the document's candidate runs as structs of their mark and minimiser hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 5000, TEXT_BYTES):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            h, ends = stream(utf8(batch, "text"), spec)
            key, first, windows, around = runs_of(h, ends, spec)
            if not len(key):
                continue
            row = np.searchsorted(ends, first, "right")
            at = first - (ends - np.diff(ends, prepend=0))[row]
            mark = (around >> np.uint64(44)).astype(np.int64) << PLACE_BITS | at << WINDOW_BITS | windows
            # Runs of one hash in one kind of surroundings: the first one's row carries the others.
            order = np.lexsort((mark, key))
            key, mark, doc = key[order], mark[order], ids[row[order]]
            lead = np.ones(len(key), bool)
            lead[1:] = (key[1:] != key[:-1]) | (mark[1:] >> PLACE_BITS != mark[:-1] >> PLACE_BITS)
            lead = np.flatnonzero(lead)
            size = np.diff(np.append(lead, len(key)))
            h = key[lead]
            _, where, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = count[where] >= HOT_IN_BATCH
            marks = np.unique(h[hot])
            none = np.zeros(len(marks), np.int64)
            salt = np.where(hot, 1 + (mix((doc[lead] * 7919 + mark[lead]).astype(np.uint64)) % np.uint64(1 << 20)).astype(np.int64), 0)
            rest = np.ones(len(key), bool)
            rest[lead] = False
            ends_of = np.cumsum(np.concatenate((size - 1, none)))
            nulls = pa.array(np.concatenate((size == 1, none == 0)))
            more = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends_of)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(doc[rest]), pa.array(mark[rest])], ["doc_id", "mark"]), mask=nulls
            )
            yield arrow_table({"h": np.concatenate((h, marks)), "salt": np.concatenate((salt, none)), "doc_id": np.concatenate((doc[lead], none)), "mark": np.concatenate((mark[lead], none - 1)), "more": more}, ANCHORS)

    rows = in_arrow(docs, run, "h long, salt int, doc_id long, mark long, more array<struct<doc_id: long, mark: long>>")
    # A row of mark -1 is a batch that makes its hash hot alone. Rows of salt 0 are counted by their different surroundings.
    by = "partition by h, salt"
    fresh = rows.withColumn("other", F.expr(f"mark >> {PLACE_BITS} is distinct from lag(mark >> {PLACE_BITS}) over ({by} order by mark)"))
    counted = fresh.withColumns({"n": F.expr(f"count(*) over ({by})"), "held": F.expr(f"sum(if(mark < 0, {HOT_ROWS}, int(other))) over ({by})")}).where("mark >= 0 and (salt > 0 or n > 1 or more is not null)")
    hot = F.expr(f"salt > 0 or held >= {HOT_ROWS}").cast("long")
    each = counted.select("h", hot.alias("hot"), F.explode(F.concat(F.array(F.struct("doc_id", "mark")), F.coalesce("more", F.array()))).alias("x"))
    mark = F.expr(f"(x.mark & {(1 << PLACE_BITS) - 1}) << 1 | hot")
    return each.groupBy("x.doc_id").agg(F.collect_list(F.struct(mark.alias("mark"), "h")).alias("runs"))


def packed_runs(base: DataFrame, name: str, spec: Windows) -> DataFrame:
    """h, packed, doc_id, at of the candidate runs: each batch sends a distinct string once, from its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, TEXT_BYTES):
            ids, texts, runs = batch.column("doc_id").to_pylist(), utf8(batch, "text"), batch.column(name)
            begin, values = np.asarray(runs.offsets) - runs.offsets[0].as_py(), runs.flatten()
            mark, key = (values.field(k).to_numpy() for k in (0, 1))
            best: dict[tuple[int, bytes], tuple[int, int]] = {}
            size = 0
            for r in sorted(range(len(ids)), key=lambda r: ids[r]):
                mine = begin[r] + np.argsort(mark[begin[r] : begin[r + 1]])
                at, windows, hot = (x.tolist() for x in _unpacked(mark[mine]))
                spans, keys = [], []
                for x, n, alone, k in zip(at, windows, hot, key[mine].tolist()):
                    if alone:
                        spans += [(x + j, x + j + spec.length) for j in range(n)]
                        keys += [None] * n
                    else:
                        spans.append((x, x + n + spec.length - 1))
                        keys.append(k)
                for a in range(0, len(spans), SPANS):
                    part = spans[a : a + SPANS]
                    for k, (x, _), packed in zip(keys[a : a + SPANS], part, spec.strings(texts[r] or b"", part)):
                        if k is None:
                            k = int(np.uint64(hash_of(packed)).view(np.int64))
                        if (k, packed) not in best:
                            best[k, packed] = (ids[r], x)
                            size += len(packed)
                    # Windows that travel alone are many times their text: what was gathered goes off in between.
                    if size >= TEXT_BYTES:
                        yield table(best)
                        best, size = {}, 0
            yield table(best)

    def table(best: dict[tuple[int, bytes], tuple[int, int]]) -> pa.RecordBatch:
        rows = [(k, packed, *owner) for (k, packed), owner in best.items()]
        return arrow_table(dict(zip(RUNS.names, map(list, zip(*rows)) if rows else ([], [], [], []))), RUNS)

    return in_arrow(base, run, "h long, packed binary, doc_id long, at int")


def _unpacked(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and whether hot, of each mark."""
    return mark >> WINDOW_BITS + 1, mark >> 1 & (1 << WINDOW_BITS) - 1, mark & 1


def hash_of(packed: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(packed)


#: A bucket: its hash, and each distinct string with its first owner (doc_id, at).
Bucket = tuple[int, dict[bytes, tuple[int, int]]]


def fresh_windows(runs: DataFrame, decide: Callable[[list[Bucket]], list[tuple[int, int, int]]]) -> DataFrame:
    """(doc_id, at, n): stretches of windows that are their content's first, as `decide` finds them for whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[Bucket] = []
        size = 0
        last: int | None = None
        for batch in slices(batches, "packed", 5000, 4 << 20):
            for h, packed, doc_id, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last:
                    if size >= CHUNK_BYTES:
                        yield table(buckets)
                        buckets, size = [], 0
                    buckets.append((h, {}))
                    last = h
                strings = buckets[-1][1]
                owner = strings.get(packed)
                size += len(packed) if owner is None else 0
                if owner is None or (doc_id, at) < owner:
                    strings[packed] = (doc_id, at)
        if buckets:
            yield table(buckets)

    def table(buckets: list[Bucket]) -> pa.RecordBatch:
        rows = decide(buckets)
        return arrow_table(dict(zip(FRESH.names, map(list, zip(*rows)) if rows else ([], [], []))), FRESH)

    return in_arrow(runs.repartition("h").sortWithinPartitions("h"), run, "doc_id long, at int, n int")


#: Of a document: marks of its candidate runs, first windows and numbers of windows of its fresh stretches.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def found_in(batch: pa.RecordBatch, runs_name: str, fresh_name: str) -> Iterator[Found]:
    """What each row's runs and fresh windows are, as arrays; a null list is empty."""
    runs, fresh = batch.column(runs_name), batch.column(fresh_name)
    mark, at, n = runs.values.field("mark").to_numpy(), fresh.values.field("at").to_numpy(), fresh.values.field("n").to_numpy()
    r, f = runs.offsets.to_numpy(), fresh.offsets.to_numpy()
    for k in range(batch.num_rows):
        yield mark[r[k] : r[k + 1]], at[f[k] : f[k + 1]], n[f[k] : f[k + 1]]


def duplicated(n: int, found: Found, spec: Windows, again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Which of a text's n symbols the duplicate windows cover.

    Places told to be fresh are of a window's first occurrence. Where later ones in the same text are to
    stay too, again(fresh places, places left) says which of those left are like a fresh one.
    """
    marks, fresh_at, fresh_n = found
    covered = np.zeros(n + 1, np.int64)
    count = n - spec.length + 1
    if len(marks) and count > 0:
        at, windows, _ = _unpacked(marks)
        edge = np.zeros(count + 1, np.int64)
        np.add.at(edge, np.minimum(at, count), 1)
        np.add.at(edge, np.minimum(at + windows, count), -1)
        window = np.cumsum(edge)[:-1] > 0
        fresh = np.zeros(count, bool)
        for a, k in zip(fresh_at.tolist(), fresh_n.tolist()):
            fresh[a : a + k] = True
        window &= ~fresh
        w = np.flatnonzero(window)
        if again is not None and fresh.any() and len(w):
            w = w[~again(np.flatnonzero(fresh), w)]
        covered[w] += 1
        covered[w + spec.length] -= 1
    return np.cumsum(covered)[:-1] > 0


def alike(h: np.ndarray, symbols: list, length: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For `duplicated`: which places of a text (its symbols and their hashes) hold the window of some known place; hashes propose, symbols decide."""

    def again(known: np.ndarray, places: np.ndarray) -> np.ndarray:
        width = 1 << length.bit_length() - 1
        grams = gram_hashes(h, width)
        whole = mix(grams[: len(h) - length + 1] * MIX_1 + grams[length - width :])
        first: dict[int, list[int]] = {}
        for k, key in zip(known.tolist(), whole[known].tolist()):
            first.setdefault(key, []).append(k)
        same = np.isin(whole[places], whole[known])
        for j in np.flatnonzero(same).tolist():
            k = int(places[j])
            same[j] = any(symbols[x : x + length] == symbols[k : k + length] for x in first[int(whole[k])])
        return same

    return again


def marked(docs: DataFrame, spec: Windows, decide: Callable) -> tuple[DataFrame, list[str]]:
    """The rows of docs with two columns more, which `found_in` reads, and those columns' names: runs and fresh,
    or what is free beside the columns of docs.

    Both joins with the texts read the same shuffle of docs by doc_id, so texts are dealt out
    once; that is why rows without doc_id go their own way.
    """
    key, runs, last = (unused(docs.columns, x) for x in ("key", "runs", "fresh"))
    own = docs.where("doc_id is not null")
    found = settle(candidates(keyed(own), spec), "candidates").select(F.col("doc_id").alias(key), F.col("runs").alias(runs))
    strings = packed_runs(own.join(found, own["doc_id"] == found[key]), runs, spec)
    fresh = fresh_windows(strings, decide).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias(last)).withColumnRenamed("doc_id", key)
    out = own.join(found, own["doc_id"] == found[key], "left").drop(key).join(fresh, own["doc_id"] == fresh[key], "left").drop(key)
    rest = docs.where("doc_id is null")
    return out.unionByName(rest.select("*", *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in (runs, last)))), [runs, last]
