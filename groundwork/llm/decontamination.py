"""Benchmark decontamination (operator 4) by q-gram lemma filtering.

Each benchmark item is cut into overlapping regions. A region of n bytes that occurs in a text
with at most e edits shares at least n + 1 - q (e + 1) q-grams with it, all of them on
neighbouring diagonals (text position minus item position). So:

1.  Every q-gram of a text is looked up among the benchmark's.
2.  Shared q-grams are counted in coarse cells of diagonals and positions; cells around which too few
    lie to reach the bound go. Then they are counted for each region in overlapping bands of
    diagonals, and bands that meet the bound stay.
3.  What stays is verified: a region all of whose grams lie on one diagonal stands there without an edit,
    any other whose halves pass a bit-parallel count of edits is aligned inside the band and must occur within its
    edit budget. Texts lie side by
    side with more bytes of no text between them than any budget has edits, so no match crosses them.

A verbatim passage of an item is found from 72 bytes on, wherever it starts: some region begins less
than STRIDE before it, and the at most 8 bytes of the region that it lacks are edits in its budget.
Items below Q bytes have no gram and are looked up whole.

Texts and items are compared as UTF-8 bytes with A-Z lower-cased and every blank or control as a
space, so an item is found in any letter case and across line breaks; offsets are those of the
text itself. Items of the same text are looked for once. The benchmark is broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, in_arrow, settle, slices, utf8

#: Bytes of a gram (as many as one 64-bit integer holds), of a region, and between region starts; edits for so many bytes.
Q, REGION, STRIDE, BYTES_PER_EDIT = 8, 80, 8, 10
#: Width of a band of diagonals before its overlap, and of a coarse cell of positions.
BAND, CELL = 16, 128
#: Bits of the table that tells grams of the benchmark from others at once, and of that of cells.
GRAM_BITS, CELL_BITS = 22, 20
#: Bytes of benchmark text that one broadcast holds, and bytes of text looked at in one go.
BLOCK, STRETCH = 4 << 20, 1 << 20

RESULT = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64()), ("regions", pa.int64()), ("regions_of_item", pa.int64())])

#: A-Z become a-z, every control and blank a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[:33] = 32
FOLD_TABLE = FOLD.tobytes()
#: No byte of UTF-8: stands between items, and so often between texts that no edit budget bridges it.
GAP = b"\xff"
GAPS = GAP * (REGION // BYTES_PER_EDIT + 8)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def budget(n: int) -> int:
    """Edits allowed in a region of n bytes: fewer where the bound would not ask for a shared gram."""
    return max(0, min(n // BYTES_PER_EDIT, (n + 1) // Q - 1 - (not (n + 1) % Q)))


def regions(n: int) -> list[tuple[int, int]]:
    """(start, length) of an item's regions; an item that is shorter than a region is one."""
    if n <= REGION:
        return [(0, n)] if n else []
    return [(a, REGION) for a in sorted({*range(0, n - REGION, STRIDE), n - REGION})]


def grams(data: bytes) -> np.ndarray:
    """The 64-bit integer of the Q bytes from each place on."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)) if len(data) >= Q else np.empty(0, "<u8")


@dataclass
class Index:
    """The benchmark's regions (number of the item, start and length in `text`) and where each gram stands."""

    text: bytes
    items: list[str]
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    of_item: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray
    places: np.ndarray
    known: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple[str, str]]) -> Index:
        text, rows, first, short = bytearray(GAP), [], [], defaultdict(list)
        for k, (_, t) in enumerate(items):
            data = t.encode().translate(FOLD_TABLE)
            first.append(len(text))
            if 0 < len(data) < Q:
                short[len(data)].append((int.from_bytes(data, "little"), len(rows)))
            rows += [(k, len(text) + a, n) for a, n in regions(len(data))]
            text += data + GAP
        item, start, length = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        g = grams(bytes(text))
        inside = np.zeros(len(text) + 1, np.int64)
        np.add.at(inside, start[length >= Q], 1)
        np.add.at(inside, (start + length - Q + 1)[length >= Q], -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(g)] > 0)
        order = np.argsort(g[at], kind="stable")
        keys, counts = np.unique(g[at], return_counts=True)
        known = np.zeros(1 << GRAM_BITS, bool)
        known[keys * SPREAD >> np.uint64(64 - GRAM_BITS)] = True
        return Index(bytes(text), [i for i, _ in items], item, start, length, np.array(first, np.int64), np.bincount(item, minlength=len(items)), keys, np.append(0, np.cumsum(counts)), at[order], known, {n: (np.array([g for g, _ in x], np.uint64), np.array([r for _, r in x], np.int64)) for n, x in ((n, sorted(x)) for n, x in short.items())})

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(text place, item place) of every gram that both hold."""
        g = grams(data)
        if not len(g) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.known[g * SPREAD >> np.uint64(64 - GRAM_BITS)])
        found = g[at]
        k = np.searchsorted(self.keys, found)
        k[k == len(self.keys)] = 0
        real = self.keys[k] == found
        at, k = at[real], k[real]
        n = self.offsets[k + 1] - self.offsets[k]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.places[np.repeat(self.offsets[k], n) + within]

    def bands(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(region, band) pairs whose shared grams meet the bound, and (region, text place) of those that stand
        there as they are; a band that holds such a place is not among the pairs."""
        if not len(i):
            return (np.empty(0, np.int64),) * 4
        # A region's grams lie in at most 2 x 2 coarse cells: one of these has a quarter of them.
        length = self.length[self.length >= Q]
        least = int(min((length + 1 - Q * (np.array([budget(n) for n in length.tolist()]) + 1)).clip(1), default=1))
        d = i - j + len(self.text)
        none = np.empty(0, np.int64)

        def cell(dd: np.ndarray, ii: np.ndarray) -> np.ndarray:
            return ((dd.astype(np.uint64) << np.uint64(32) | ii.astype(np.uint64)) * SPREAD) >> np.uint64(64 - CELL_BITS)

        if -(-least // 4) > 1:
            dense = np.bincount(cell(d // BAND + 1, i // CELL + 1).view(np.int64), minlength=1 << CELL_BITS) >= -(-least // 4)
            near = np.zeros(len(i), bool)
            for a in (0, 1, 2):
                for b in (0, 1, 2):
                    near |= dense[cell(d // BAND + a, i // CELL + b)]
            j, d = j[near], d[near]
        # The regions that a gram lies in are neighbours in the list, sorted by start.
        after = np.searchsorted(self.start, j, "right")
        pairs = []
        for back in range(1, -(-REGION // STRIDE) + 2):
            r = after - back
            ok = (r >= 0) & ((self.start + self.length)[np.maximum(r, 0)] - Q >= j)
            pairs.append((r[ok], d[ok]))
        r, d = (np.concatenate(x) for x in zip(*pairs))
        if not len(r):
            return none, none, none, none
        over = REGION // BYTES_PER_EDIT
        # A region whose grams all lie on one diagonal stands there letter by letter.
        line, count = np.unique(r << np.int64(40) | d, return_counts=True)
        whole = line[count == self.length[line >> 40] + 1 - Q]
        exact, at = whole >> 40, whole & (1 << 40) - 1
        known = np.concatenate((exact << np.int64(36) | at // BAND, (exact << np.int64(36) | at // BAND - 1)[at % BAND < over]))
        second = d % BAND < over  # in the overlap with the band below
        key = np.concatenate((r, r[second])) << np.int64(36) | np.concatenate((d // BAND, d[second] // BAND - 1))
        key, count = np.unique(key, return_counts=True)
        r, band = key >> 36, key & (1 << 36) - 1
        n = self.length[r]
        edits = np.minimum(n // BYTES_PER_EDIT, np.maximum(0, -(-(n + 1) // Q) - 2))
        keep = (count >= n + 1 - Q * (edits + 1)) & ~np.isin(key, known)
        return r[keep], band[keep], exact, at - len(self.text) + self.start[exact]

    def aligned(self, data: bytes, r: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each region inside its band, and the text's stretch of that alignment."""
        over = REGION // BYTES_PER_EDIT
        low = band * BAND - len(self.text) - over  # lowest diagonal, with room to drift
        width = BAND + 3 * over
        text = np.frombuffer(data, np.uint8)
        items = np.frombuffer(self.text, np.uint8)
        k = np.arange(width, dtype=np.int32)
        big = np.int32(1 << 18)
        cost = np.zeros((len(r), width), np.int32)
        # Where an alignment began is kept as its place in the first row.
        begin = np.repeat(k[None], len(r), axis=0)
        origin_of = self.start[r] + low
        end_cost = np.full(len(r), big, np.int64)
        end_begin, end_at = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for step in range(int(self.length[r].max(initial=0)) + 1):
            place = self.start[r] + step
            at = place[:, None] + low[:, None] + k  # text place before which `step` bytes are aligned
            done = self.length[r] == step
            if done.any():
                best = cost[done].argmin(axis=1)
                rows = np.flatnonzero(done)
                end_cost[rows], end_begin[rows], end_at[rows] = cost[rows, best], origin_of[rows] + begin[rows, best], at[rows, best]
            there = (at >= 0) & (at < len(text))
            other = text[np.clip(at, 0, max(0, len(text) - 1))] != items[np.minimum(place, len(items) - 1)][:, None]
            # Next item byte against the next text byte (same diagonal), or against none (diagonal below).
            same = np.where(there, cost + other, big)
            skip = np.pad(cost[:, 1:] + 1, ((0, 0), (0, 1)), constant_values=big)
            take = skip < same
            new, origin = np.where(take, skip, same), np.where(take, np.pad(begin[:, 1:], ((0, 0), (0, 1))), begin)
            # Text bytes without an item byte: steps to higher diagonals.
            packed = (new - k << np.int32(12)) + k
            packed = np.minimum.accumulate(packed, axis=1)
            source = packed & (1 << 12) - 1
            cost = np.take_along_axis(new, source, 1) + k - source
            begin = np.take_along_axis(origin, source, 1)
        return end_cost, end_begin, end_at

    def plausible(self, data: bytes, r: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which regions can lie inside their band's stretch of text within the budget: the least edits of a
        region's halves, each found anywhere in that stretch, add up to no more than the region's own.

        All pairs step through their stretches together, a half's whole column of the edit matrix in one word's bits.
        """
        over = REGION // BYTES_PER_EDIT
        text, items = np.frombuffer(data, np.uint8), np.frombuffer(self.text, np.uint8)
        one, where = np.unique(r, return_inverse=True)
        start, n = self.start[one], self.length[one]
        place = (self.start[r] + band * BAND - len(self.text) - over)[None] + np.arange(int(n.max(initial=0)) + BAND + 3 * over)[:, None]
        letters = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], GAP[0])
        rows, least = np.arange(len(one)), np.zeros(len(r), np.int64)
        for begin, size in ((start, n // 2), (start + n // 2, n - n // 2)):
            known = np.zeros((len(one), 256), np.uint64)
            for j in range(int(size.max(initial=0))):
                k = rows[j < size]
                known[k, items[begin[k] + j]] |= np.uint64(1 << j)
            top = (np.uint64(1) << (size - 1).astype(np.uint64))[where]
            up, down, cost = np.full(len(r), 2**64 - 1, np.uint64), np.zeros(len(r), np.uint64), size[where].copy()
            best = cost.copy()
            for c in letters:
                same = known[where, c]
                across = (((same & up) + up) ^ up) | same
                rise, fall = down | ~(across | up), up & across
                cost += (rise & top > 0).astype(np.int64) - (fall & top > 0)
                np.minimum(best, cost, out=best)
                rise, fall, level = rise << np.uint64(1), fall << np.uint64(1), same | down
                up, down = fall | ~(level | rise), rise & level
            least += best
        return least <= np.array([budget(k) for k in n.tolist()], np.int64)[where]

    def exact(self, data: bytes, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(region, start, stop, 0) of the items below Q bytes, at their first place in each of the texts that end at `ends`."""
        for n, (keys, region) in self.short.items():
            padded = grams(data + GAP * Q)[: len(data)]
            unique, first, count = np.unique(keys, return_index=True, return_counts=True)
            for a in range(0, len(padded), STRETCH):
                g = padded[a : a + STRETCH] & np.uint64((1 << 8 * n) - 1)
                k = np.minimum(np.searchsorted(unique, g), len(unique) - 1)
                at = np.flatnonzero(unique[k] == g)
                k, at = k[at], at + a
                _, one = np.unique(np.searchsorted(ends, at, "right") * len(unique) + k, return_index=True)
                for place, key in zip(at[one].tolist(), k[one].tolist()):
                    for r in region[first[key] : first[key] + count[key]].tolist():
                        yield r, place, place + n, 0

    def search(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(region, start, stop, edits) of the verified regions in one stretch of texts."""
        r, band, exact, at = self.bands(*self.hits(data))
        yield from zip(exact.tolist(), at.tolist(), (at + self.length[exact]).tolist(), [0] * len(exact))
        if len(r):
            keep = np.concatenate([self.plausible(data, r[a : a + 4096], band[a : a + 4096]) for a in range(0, len(r), 4096)])
            r, band = r[keep], band[keep]
        for a in range(0, len(r), 4096):
            part = r[a : a + 4096]
            edits, begin, end = self.aligned(data, part, band[a : a + 4096])
            ok = edits <= np.array([budget(n) for n in self.length[part].tolist()], np.int64)
            yield from zip(part[ok].tolist(), begin[ok].tolist(), end[ok].tolist(), edits[ok].tolist())


def matches_of(index: Index, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item number, start, stop, least edits, regions) of every text and item that share a region."""
    ends = np.cumsum([len(t or b"") + len(GAPS) for t in texts])
    data = GAPS.join(t or b"" for t in texts).translate(FOLD_TABLE) + GAPS
    found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = defaultdict(dict)
    reach = 4 * REGION

    def add(r: int, start: int, stop: int, edits: int) -> None:
        # An alignment may begin or end in the gap: its middle lies in the text.
        t = int(np.searchsorted(ends, (start + stop) // 2, "right"))
        begin = int(ends[t]) - len(texts[t] or b"") - len(GAPS)
        own = found[t, int(index.item[r])]
        new = (edits, max(0, start - begin), min(stop - begin, len(texts[t] or b"")))
        own[r] = min(own.get(r, new), new)

    for match in index.exact(data, ends):
        add(*match)
    for a in range(0, len(data), STRETCH):
        for r, start, stop, edits in index.search(data[max(0, a - reach) : a + STRETCH + reach]):
            add(r, start + max(0, a - reach), stop + max(0, a - reach), edits)
    return [(t, k, min(x[1] for x in own.values()), max(x[2] for x in own.values()), min(x[0] for x in own.values()), len(own)) for (t, k), own in found.items()]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, sha, text) of the items that have a text."""
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").select("item_id", F.sha2("text", 256).alias("sha"), "text")


def blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """(sha, text) of the items' different texts in blocks of about BLOCK bytes, dealt by a hash of the text."""
    known = items.select("sha", "text").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK))
    for k in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("sha"), F.lit(n)) == k)
        yield sorted((r.sha, r.text) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, stop, edits, regions, regions_of_item of every document that holds a benchmark item or a part of it.

    A row says that `regions` of the item's regions (80 bytes, one every 8; a shorter item is
    one region) occur in the text with at most one edit for 10 bytes (none for items below 10):
    bytes start to stop, `edits` the fewest of a region. Clean documents have no row. Null and
    empty texts and items match nothing. Rows that repeat a doc_id or an item_id
    give a row for each pair of rows. Either table may be empty. Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    context, items = docs.sparkSession.sparkContext, items_of(benchmark)
    found = []
    for block in blocks(items):
        shared = context.broadcast(Index.build(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, "text", 2000, 1 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.items[k], start, stop, edits, n, int(index.of_item[k])) for t, k, start, stop, edits, n in matches_of(index, utf8(batch, "text"))]
                if rows:
                    yield arrow_table(dict(zip(RESULT.names, map(list, zip(*rows)))), RESULT)

        found.append(in_arrow(keyed, run, "doc_id long, sha string, start long, stop long, edits long, regions long, regions_of_item long"))
    out = reduce(DataFrame.union, found)
    return out.join(items.select("sha", "item_id"), "sha").select("doc_id", "item_id", "start", "stop", "edits", "regions", "regions_of_item")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no part of a benchmark item.

    Each row is judged by its own text, so null and repeated ids make no difference; null and empty
    texts stay. Either table may be empty. Nothing is shuffled: a row goes where it is read, and
    beyond one block of the benchmark what is left is written between two blocks.
    """
    context, names = docs.sparkSession.sparkContext, docs.columns
    for k, block in enumerate(blocks(items_of(benchmark))):
        shared = context.broadcast(Index.build(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 2000, 1 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches_of(shared.value, utf8(batch, "text"))]] = False
                yield batch.filter(pa.array(keep)).select(names)

        docs = in_arrow(settle(docs, "kept") if k else docs, run, docs.schema)
    return docs
