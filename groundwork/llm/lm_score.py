"""LM scoring (operator 9): a hashed maximum-entropy model with class-factored softmax.

Tokens are a text's words (A-Z lower-cased) and one end. A token's probability is that of its
class, given the words before it, times those of its steps within the class, given the same:

    P(w | context) = softmax over classes(prior + weights of the context's features)[class of w]
                     * softmax over second last bytes within the class(the same of its own)[of w]
                     * softmax over third last bytes within both(the same of its own)[of w]
                     * ((c(w) + 1/2) / Z) / mass(words that end so)

Features are hashed: the word before, the word two before (skip), and both together. The
most frequent words are classes of their own, all other words fall into classes by their last
byte, so that every word, seen or not, has a class. The steps within a class have as features, each
together with where the step begins, the word before and the last one of the most frequent words
before that, which tells the language and kind of a text. Among words that end in the same three bytes
the maximum-entropy fit of the single-word features is the smoothed relative frequency itself. Priors and
masses are those of the base model, so all weights at zero give the base score; Z = N + (V + 1) / 2 leaves
half a count to one unknown word, which is shared out between the last-byte classes; a class's
share of it does not depend on the steps.

A batch's words are cut, hashed and numbered together; a word is known by its 64-bit hash, in the
counts as in the scores. Weights are used as factors, exp(weight), whose products a softmax divides by
their sum, so that exponentials are taken of rows that change, not of every token's classes.

Counts come from all training documents: each batch adds up its words, Spark the batches. The
weights are trained by gradient updates in every task on its own documents; the tasks' results
are averaged (each round takes its part of the documents, all are used), so they depend, within
the noise of training, on how the documents are dealt over tasks. Averages are taken in two
steps, of some tasks' copies and of these sums, in PARTS streams. Scores: the counts of
the most frequent words are broadcast (a fixed number at most, chosen by a histogram of counts,
so that no more words than those reach the driver), those of rarer ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from groundwork.llm.common import GOLD, arrow_table, crc32_remainder, in_arrow, mix, settle, slices

#: Words whose counts are broadcast, words that are classes of their own, classes by last byte.
FREQUENT, OWN, BUCKETS = 65_536, 16, 32
CLASSES = OWN + BUCKETS
#: Endings of three bytes, each taken modulo BUCKETS.
ENDINGS = BUCKETS**3
#: Rows of the weight table, of those of the two steps within classes, rounds of training, tokens of an update, step of updates.
HASHED, INNER, ROUNDS, UPDATE, RATE = 1 << 14, (1 << 14, 1 << 15), 2, 16_384, 0.3
#: Rows of a block of probabilities, how often a row is met to be summed alone, and the bound of a weight.
BLOCK, OFTEN, MOST = 1024, 64, 20
#: Bounds of a factor, with a prior's share in it: of three, neither the product nor 1 / product overflows.
LEAST_FACTOR, MOST_FACTOR = np.float32(np.exp(-29)), np.float32(np.exp(MOST))
#: Parts in which a task's weights travel, groups of tasks that are summed first, and words, each once a slice of text, that a batch of counting holds.
PARTS, GROUPS, HELD = 64, 16, 1_000_000
#: Stands for a text's end; no word can be it.
END = b"\n"
#: Bytes from which a word is hashed by itself, and what is kept of eight bytes when so many of them belong to the word.
LONG, KEEP = 64, np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

COUNTS = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("name", pa.binary()), ("c", pa.int64())])
WEIGHTS = pa.schema([("part", pa.int32()), ("group", pa.int32()), ("tokens", pa.int64()), ("values", pa.binary())])
ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64()), ("gain_unknown", pa.float64())])


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def ending(word: bytes) -> int:
    """The last three bytes modulo BUCKETS, the last one lowest; 0 for those that a short word has not."""
    return word[-1] % BUCKETS + BUCKETS * (word[-2] % BUCKETS if len(word) > 1 else 0) + BUCKETS**2 * (word[-3] % BUCKETS if len(word) > 2 else 0)


@dataclass
class Words:
    """Tokens in a row: their bytes are buffer[begin : begin + length] (lower-cased, END after all texts); starts: where each text begins."""

    buffer: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    starts: np.ndarray

    @staticmethod
    def padded(data: np.ndarray) -> np.ndarray:
        """data, END and zeros, so that eight bytes can be read from every place, in whole eights."""
        out = np.zeros((len(data) + 31) // 8 * 8, np.uint8)
        out[: len(data)] = data
        out[len(data)] = END[0]
        return out

    @staticmethod
    def of(texts: pa.Array) -> Words:
        """The same tokens as of tokens(), for all texts at once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        size = int(at[-1] - at[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
        at -= at[0]
        buffer = Words.padded(data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)))
        # In one place more than there are bytes: is there a word here, does one begin, did one end just before?
        here = np.zeros(size + 1, np.bool_)
        here[:-1] = (data != 32) & ((data - np.uint8(9)) >= 5)
        begins, ended = here.copy(), np.zeros(size + 1, np.bool_)
        begins[1:] &= ~here[:-1]
        ended[1:] = here[:-1] & ~here[1:]
        begins[at] = here[at]
        inner = at[at > 0]
        ended[inner] = here[inner - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ended)
        starts = np.searchsorted(begin, at) + np.arange(len(at))
        word = np.ones(len(begin) + len(texts), np.bool_)
        word[starts[1:] - 1] = False
        begin_all, length = np.full(len(word), size), np.ones(len(word), np.int64)
        begin_all[word], length[word] = begin, end - begin
        return Words(buffer, begin_all, length, starts)

    @staticmethod
    def listed(words: list[bytes], starts: np.ndarray | None = None) -> Words:
        length = np.fromiter(map(len, words), np.int64, len(words))
        return Words(Words.padded(np.frombuffer(b"".join(words), np.uint8)), np.cumsum(length) - length, length, np.zeros(1, np.int64) if starts is None else starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token: eight bytes at a time, those of LONG bytes and more by the library."""
        eights = self.buffer.view(np.uint64)

        def read(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
            k, shift = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
            x = np.take(eights, k) >> shift
            x |= np.take(eights, k + 1) << np.uint64(1) << (np.uint64(63) - shift)
            x &= np.take(KEEP, np.minimum(length, 8))
            return x

        h = mix(read(self.begin, self.length) + self.length.astype(np.uint64) * GOLD)
        more = np.flatnonzero((self.length > 8) & (self.length < LONG))
        done = 8
        while len(more):
            h[more] = mix(h[more] * GOLD ^ read(self.begin[more] + done, self.length[more] - done))
            done += 8
            more = more[self.length[more] > done]
        for k in np.flatnonzero(self.length >= LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(self.buffer[self.begin[k] : self.begin[k] + self.length[k]])
        return h

    def endings(self, of: np.ndarray) -> np.ndarray:
        """ending() of these tokens."""
        last, length = (self.begin + self.length)[of] - 1, self.length[of]
        e = self.buffer[last].astype(np.int64) % BUCKETS
        for k in (1, 2):
            e += np.where(length > k, self.buffer[np.maximum(last - k, 0)] % BUCKETS, 0).astype(np.int64) * BUCKETS**k
        return e

    def bytes_of(self, of: np.ndarray) -> pa.Array:
        """The bytes of these tokens."""
        length = self.length[of]
        offsets = np.concatenate(([0], np.cumsum(length)))
        data = self.buffer[np.arange(offsets[-1]) + np.repeat(self.begin[of] - offsets[:-1], length)]
        return pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def training(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(crc32_remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out"))


def distinct(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number among the different ones, and a place where each of these stands."""
    found = values.dictionary_encode().indices.to_numpy()
    at = np.empty(int(found.max(initial=-1)) + 1, np.int64)
    at[found] = np.arange(len(found))
    return found, at


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: 64-bit hash, ending, name, c) of every word of the texts; batches are added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            all_held = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found, at = distinct(all_held.column("word"))
            c = np.bincount(found, all_held.column("c").to_numpy()).astype(np.int64)
            return arrow_table({k: all_held.column(k).take(pa.array(at)) for k in ("word", "ending", "name")} | {"c": c}, COUNTS)

        for batch in slices(batches, "text", 2000, 4 << 20):
            words = Words.of(batch.column("text"))
            hashes = pa.array(words.hashes().view(np.int64))
            found, at = distinct(hashes)
            held.append(arrow_table({"word": hashes.take(pa.array(at)), "ending": words.endings(at).astype(np.int32), "name": words.bytes_of(at), "c": np.bincount(found)}, COUNTS))
            if sum(x.num_rows for x in held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return in_arrow(docs.select("text"), run, "word long, ending int, name binary, c long")


@dataclass
class Model:
    """What is known of the training tokens, and the weights. mass: of each class under the base model;
    unknown: each class's share of the unknown word within the class; shares: logarithms of the parts of each
    step within classes, a row for each place where it begins; inner: the weights of these steps."""

    names: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    mass: np.ndarray
    unknown: np.ndarray
    weights: np.ndarray
    shares: list[np.ndarray]
    inner: list[np.ndarray]

    def __post_init__(self) -> None:
        self.z = self.n + 0.5 * (self.v + 1)
        self.endings = np.zeros(FREQUENT + ENDINGS, np.int32)
        self.endings[: len(self.names)] = [ending(w) for w in self.names]
        self.endings[FREQUENT:] = np.arange(ENDINGS)
        self.classes = OWN + self.endings % BUCKETS
        self.classes[: min(OWN, len(self.names))] = np.arange(min(OWN, len(self.names)))
        with np.errstate(divide="ignore"):
            self.prior = np.log(self.mass).astype(np.float32)
        self.hashes = Words.listed(self.names).hashes()

    def tables(self) -> list[np.ndarray]:
        return [self.weights, *self.inner]

    def with_tables(self, tables: list[np.ndarray]) -> Model:
        return Model(self.names, self.counts, self.n, self.v, self.mass, self.unknown, tables[0], self.shares, tables[1:])

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' numbers in a row, and where each text begins."""
        words = Words.listed(list(chain.from_iterable(texts)), np.cumsum([0, *map(len, texts)]))
        return self.numbers(words, words.hashes()), words.starts

    def numbers(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Each token's number: a frequent word's place, FREQUENT + ending for any other."""
        found = pc.fill_null(pc.index_in(pa.array(hashes), value_set=pa.array(self.hashes)), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(found < 0)
        found[rare] = FREQUENT + words.endings(rare)
        return found

    @staticmethod
    def features(numbers: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Rows of the weight table for each token: word before, word two before, both."""
        one, two = np.empty_like(numbers), np.empty_like(numbers)
        one[1:], two[2:] = numbers[:-1], numbers[:-2]
        edge = FREQUENT + ENDINGS
        begin = starts[:-1]
        one[begin] = two[begin] = edge
        second = begin[np.diff(starts) > 1] + 1
        two[second] = edge
        u = [x.astype(np.uint64) for x in (one, two)]
        big = np.uint64(HASHED)
        return [(mix(k) % big).astype(np.uint16) for k in (u[0] * np.uint64(4) + np.uint64(1), u[1] * np.uint64(4) + np.uint64(2), (u[0] << np.uint64(24) | u[1]) * np.uint64(4) + np.uint64(3))]

    @staticmethod
    def before(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the word before, and the last of the OWN most frequent words before it (OWN: none yet)."""
        one = np.empty_like(numbers)
        one[1:] = numbers[:-1]
        one[starts[:-1]] = FREQUENT + ENDINGS
        at = np.where(one < OWN, np.arange(len(one)), 0)
        at[starts[:-1]] = starts[:-1]
        return one.astype(np.uint64), np.minimum(one[np.maximum.accumulate(at)], OWN).astype(np.uint64)

    def steps(self, numbers: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]]:
        """Which tokens have steps within their class, and of each step their rows of its weight table, where it begins and which way it goes."""
        inside = np.flatnonzero(self.classes[numbers] >= OWN)
        e = self.endings[numbers[inside]]
        found = []
        for rows, width in zip(INNER, (BUCKETS, BUCKETS**2), strict=True):
            start = e % width
            key = start.astype(np.uint64) * np.uint64(2)
            hashed = [(mix((b[inside] * np.uint64(2 * BUCKETS**2)) + key + np.uint64(k)) % np.uint64(rows)).astype(np.uint16) for k, b in enumerate(before)]
            found.append((hashed, start, e // width % BUCKETS))
        return inside, found

    def factors(self) -> list[np.ndarray]:
        """exp(weights) of each table, in which the three features of a class share its prior: products of rows are what a softmax divides by their sum."""
        return [np.clip(np.exp(np.clip(t, -MOST, MOST) + p), LEAST_FACTOR, MOST_FACTOR) for t, p in zip(self.tables(), self.within(), strict=True)]

    def within(self) -> list[np.ndarray | np.float32]:
        """What each table's factors hold besides the weights, as logarithms."""
        return [self.prior / np.float32(3), *[np.float32(0)] * len(self.inner)]

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        """Class probabilities of each token's place."""
        return softmax(self.factors()[0], features)

    def step_probabilities(self, k: int, features: list[np.ndarray], start: np.ndarray) -> np.ndarray:
        """Probabilities of the ways of step k."""
        return softmax(self.factors()[1 + k], features, np.exp(self.shares[k]), start)


class Training:
    """A task's own weights, as factors; squares: sums of squared steps of each table's rows so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.factors, self.shares = model, model.factors(), [np.exp(x) for x in model.shares]
        # Kept from one update to the next, as fresh memory costs as much as the work in it.
        self.room = [np.empty((k * UPDATE, CLASSES), np.float32) for k in (1, 3)]
        self.squares = [np.zeros(len(t), np.float32) for t in self.factors]

    def update(self, features: list[np.ndarray], numbers: np.ndarray, before: list[np.ndarray]) -> None:
        """One gradient step on some tokens."""
        self.descend(0, features, self.model.classes[numbers])
        for k, (rows, start, way) in enumerate(self.model.steps(numbers, before)[1]):
            self.descend(1 + k, rows, way, self.shares[k], start)

    def space(self, k: int, rows: int, columns: int) -> np.ndarray:
        return self.room[k].reshape(-1)[: rows * columns].reshape(rows, columns)

    def descend(self, k: int, features: list[np.ndarray], target: np.ndarray, shares: np.ndarray | None = None, start: np.ndarray | None = None) -> None:
        """Move the features' rows of table k against the gradient of the targets' log probabilities."""
        squares, factors = self.squares[k], self.factors[k]
        width = factors.shape[1]
        d = softmax(factors, features, shares, start, self.space(0, len(target), width))
        d[np.arange(len(d)), target] -= 1
        rows, sums = row_sums(d, features, self.space(1, len(features) * len(d), width))
        for a in range(0, len(rows), 2 * BLOCK):
            r, g = rows[a : a + 2 * BLOCK], sums[a : a + 2 * BLOCK]
            squares[r] += np.einsum("rk,rk->r", g, g) / width
            g *= (-RATE / np.sqrt(squares[r] + 1))[:, None]
            np.exp(g, out=g)
            g *= np.take(factors, r, axis=0, mode="clip")
            factors[r] = np.clip(g, LEAST_FACTOR, MOST_FACTOR, out=g)

    def changed(self) -> list[np.ndarray]:
        """By how much each table's weights differ from the model's."""
        return [np.log(f) - p - t for f, p, t in zip(self.factors, self.model.within(), self.model.tables(), strict=True)]


def products(factors: np.ndarray, features: list[np.ndarray], shares: np.ndarray | None, start: np.ndarray | None, out: np.ndarray) -> np.ndarray:
    """The products of the features' rows and of the shares, of which start (if given) tells the row."""
    np.take(factors, features[0], axis=0, out=out, mode="clip")
    for f in features[1:]:
        out *= np.take(factors, f, axis=0, mode="clip")
    if start is not None:
        out *= np.take(shares, start, axis=0, mode="clip")
    return out


def softmax(factors: np.ndarray, features: list[np.ndarray], shares: np.ndarray | None = None, start: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Probabilities by the products of the features' rows and the shares, made in blocks that stay in the processor's cache."""
    s = np.empty((len(features[0]), factors.shape[1]), np.float32) if out is None else out
    for a in range(0, len(s), BLOCK):
        b = slice(a, a + BLOCK)
        part = products(factors, [f[b] for f in features], shares, None if start is None else start[b], s[b])
        part *= (1 / np.einsum("rk->r", part))[:, None]
    return s


def chosen(factors: np.ndarray, features: list[np.ndarray], target: np.ndarray, shares: np.ndarray | None = None, start: np.ndarray | None = None, besides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the probabilities only the targets', and those summed with the weights `besides`, if given."""
    p, other = np.empty(len(target), np.float32), np.zeros(len(target), np.float32)
    out = np.empty((min(BLOCK, len(target)), factors.shape[1]), np.float32)
    for a in range(0, len(target), BLOCK):
        b = slice(a, a + BLOCK)
        part = products(factors, [f[b] for f in features], shares, None if start is None else start[b], out[: len(p[b])])
        total = np.einsum("rk->r", part)
        np.divide(part[np.arange(len(part)), target[b]], total, out=p[b])
        if besides is not None:
            np.divide(part @ besides, total, out=other[b])
    return p, other


def row_sums(d: np.ndarray, features: list[np.ndarray], out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each different value of the features, and the sum of d's rows where they have it; values that occur often are summed one by one, the others together."""
    f = np.concatenate(features)
    order = np.argsort(f, kind="stable")
    f = f[order]
    first = np.flatnonzero(np.diff(f.astype(np.int32), prepend=-1))
    lengths = np.diff(np.append(first, len(order)))
    by = np.argsort(-lengths, kind="stable")
    first, lengths = first[by], lengths[by]
    order = np.tile(np.arange(len(d)), len(features))[order]
    g = np.empty((len(first), d.shape[1]), np.float32) if out is None else out[: len(first)]
    longer = np.searchsorted(-lengths, -np.arange(OFTEN + 1)).tolist()  # how many values occur more than k times
    often, ones = longer[OFTEN], np.ones(int(lengths.max(initial=0)), np.float32)
    for k, (a, n) in enumerate(zip(first[:often].tolist(), lengths[:often].tolist())):
        np.dot(ones[:n], np.take(d, order[a : a + n], axis=0, mode="clip"), out=g[k])
    if often < len(g):
        np.take(d, order[first[often:]], axis=0, out=g[often:], mode="clip")
        for k in range(1, int(lengths[often])):
            n = longer[k]
            g[often:n] += np.take(d, order[first[often:n] + k], axis=0, mode="clip")
    return f[first], g


def most_frequent(counts: DataFrame) -> list:
    """(name, c, bucket) of the words from some count on, at most FREQUENT of them, most frequent first.

    The count comes from a histogram by eighths of powers of two; a step of it is taken whole or not at all.
    """
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r.step):
        total += r.n
        if total > FREQUENT:
            break
        least = r.least
    if least is None:
        return []
    return sorted(counts.where(F.col("c") >= least).select("name", "c", "bucket").collect(), key=lambda r: (-r.c, r.name))


def counted(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The counts of all words (word, c), in the shared folder, and the model without trained weights."""
    counts = settle(word_counts(training(docs).where(~F.col("held_out"))).groupBy("word").agg(F.min("ending").alias("ending"), F.min("name").alias("name"), F.sum("c").alias("c")), "counts")
    counts = counts.withColumn("bucket", F.col("ending") % BUCKETS)
    frequent = most_frequent(counts)
    # A row for each ending at most, however many words there are.
    endings = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()
    buckets = {b: Row(c=sum(r.c for r in found), v=sum(r.v for r in found), once=sum(r.once for r in found)) for b in range(BUCKETS) if (found := [r for r in endings if r.ending % BUCKETS == b])}
    n, v, once = (sum(r[k] for r in buckets.values()) for k in ("c", "v", "once"))
    z = n + 0.5 * (v + 1)
    mass, unknown = np.zeros(CLASSES), np.zeros(CLASSES)
    for b in range(BUCKETS):
        unknown[OWN + b] = 0.5 * ((buckets[b].once / once if b in buckets else 0) if once else 1 / BUCKETS) / z
        mass[OWN + b] = (buckets[b].c + 0.5 * buckets[b].v) / z if b in buckets else 0
    for k, r in enumerate(frequent[:OWN]):
        mass[k] = (r.c + 0.5) / z
        mass[OWN + r.bucket] -= mass[k]
    mass = np.maximum(mass + unknown, 1e-12)
    mass /= mass.sum()
    names = [bytes(r["name"]) for r in frequent]
    doubled = np.zeros(ENDINGS, np.int64)  # twice the count of words of the last-byte classes, and one more for each word
    for r in endings:
        doubled[r.ending] = 2 * r.c + r.v
    for r in frequent[:OWN]:
        doubled[ending(bytes(r["name"]))] -= 2 * r.c + 1
    by = doubled.reshape(BUCKETS, BUCKETS, BUCKETS)  # third last, second last, last byte
    shares = [log_shares(by.sum(axis=0).T), log_shares(by.reshape(BUCKETS, -1).T)]
    inner = [np.zeros((rows, BUCKETS), np.float32) for rows in INNER]
    return counts.select("word", "c"), Model(names, np.array([r.c for r in frequent], np.int64), n, v, mass, unknown / mass, np.zeros((HASHED, CLASSES), np.float32), shares, inner)


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Logarithms of each row's parts; a row without any has equal ones, as no known word takes that way."""
    with np.errstate(divide="ignore"):
        return np.log(np.where(counts.sum(axis=1, keepdims=True) > 0, counts, 1) / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def trained(docs: DataFrame, model: Model) -> Model:
    """Rounds over disjoint parts of the training documents: each task updates its own copy of the
    weights on its documents, the copies' changes are averaged by their tokens in PARTS streams."""
    context = docs.sparkSession.sparkContext
    rows = training(docs).where(~F.col("held_out"))
    for r in range(ROUNDS):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: Model = shared.value
            own, n = Training(m), 0
            for batch in slices(batches, "text", 2000, 1 << 20):
                words = Words.of(batch.column("text"))
                numbers = m.numbers(words, words.hashes())
                features, before = m.features(numbers, words.starts), m.before(numbers, words.starts)
                for a in range(0, len(numbers), UPDATE):
                    own.update([f[a : a + UPDATE] for f in features], numbers[a : a + UPDATE], [b[a : a + UPDATE] for b in before])
                n += len(numbers)
            if n:
                from pyspark import TaskContext

                # What changed, in half floats: their rounding is far below the noise of training.
                changed = np.concatenate([x.ravel() for x in own.changed()])
                values = [x.tobytes() for x in np.array_split(changed.astype(np.float16), PARTS)]
                group = [TaskContext.get().partitionId() % GROUPS] * PARTS
                yield arrow_table({"part": list(range(PARTS)), "group": group, "tokens": [n] * PARTS, "values": values}, WEIGHTS)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Means of the changes, weighted by tokens."""
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for part, group, n, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(values, np.float16).astype(np.float32) * np.float32(n)
                    if (part, group) in sums:
                        sums[part, group][0] += n
                        sums[part, group][1] += x
                    else:
                        sums[part, group] = [n, x]
            for (part, group), (n, x) in sums.items():
                yield arrow_table({"part": [part], "group": [group], "tokens": [n], "values": [(x / np.float32(n)).astype(np.float16).tobytes()]}, WEIGHTS)

        kind = "part int, group int, tokens long, values binary"
        mine = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == r).select("text")
        # Sums of every GROUPS-th task, then of these: PARTS rows of the weight table's size together, however many tasks took part.
        some = in_arrow(in_arrow(mine, run, kind).repartition("part", "group"), added, kind)
        got = in_arrow(some.withColumn("group", F.lit(0)).repartition("part"), added, kind).collect()
        if got:
            changed = np.concatenate([np.frombuffer(x["values"], np.float16) for x in sorted(got, key=lambda x: x.part)])
            ends = np.cumsum([t.size for t in model.tables()])[:-1]
            model = model.with_tables([t + c.reshape(t.shape).astype(np.float32) for t, c in zip(model.tables(), np.split(changed, ends), strict=True)])
        shared.unpersist()
    return model


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    held_out: the crc32 of doc_id as text, modulo 5, is 1; all other rows train (a null doc_id
    too). base_score and score are log10 probabilities of the text, the end included. A null
    or empty text is the end alone. Repeated rows train as often as they occur and each get
    their row; an empty table gives an empty result. Without training rows all words are
    unknown. Other columns are not read.
    """
    counts, model = counted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = shared.value
        base_of = np.log10((np.concatenate((m.counts, np.zeros(FREQUENT - len(m.counts)))) + 0.5) / m.z)
        log_mass = np.log10(m.mass)
        factors, step_shares, unknown_of = m.factors(), [np.exp(x) for x in m.shares], m.unknown.astype(np.float32)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 1000, 1 << 20):
            words = Words.of(batch.column("text"))
            hashes, starts = words.hashes(), words.starts
            numbers = m.numbers(words, hashes)
            classes, features, before = m.classes[numbers], m.features(numbers, starts), m.before(numbers, starts)
            gain, unknown = np.empty(len(numbers)), np.empty(len(numbers))
            for a in range(0, len(numbers), UPDATE):
                c = classes[a : a + UPDATE]
                p, other = chosen(factors[0], [f[a : a + UPDATE] for f in features], c, besides=unknown_of)
                gain[a : a + UPDATE] = np.log10(np.maximum(p, 1e-30)) - log_mass[c]
                # The unknown word stands in all last-byte classes; 0.5 / z is its base probability.
                unknown[a : a + UPDATE] = np.log10(np.maximum(other, 1e-30)) - np.log10(0.5 / m.z)
                inside, found = m.steps(numbers[a : a + UPDATE], [b[a : a + UPDATE] for b in before])
                for k, (rows_of, start, way) in enumerate(found):
                    p, _ = chosen(factors[1 + k], rows_of, way, step_shares[k], start)
                    # No known word goes where the share is none, and unknown ones do not ask for it.
                    gain[a + inside] += np.log10(np.maximum(p, 1e-30)) - np.maximum(m.shares[k][start, way], -69) / np.log(10)
            common = numbers < FREQUENT
            k = batch.num_rows
            of = np.repeat(np.arange(k), np.diff(starts))
            base = np.bincount(of, np.where(common, base_of[np.minimum(numbers, FREQUENT - 1)], 0), k)
            rows = row + np.arange(k)
            row += k
            yield arrow_table({
                "row": rows, "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": np.diff(starts), "word": mix(rows.astype(np.uint64)).view(np.int64), "n": np.zeros(k, np.int64),
                "known": np.bincount(of, common, k).astype(np.int64), "base": base, "gain": np.bincount(of, np.where(common, gain, 0), k), "gain_unknown": np.zeros(k),
            }, ROWS)
            rare = np.flatnonzero(~common)
            if len(rare):
                h = hashes[rare]
                order = np.lexsort((h, of[rare]))
                rare, h = rare[order], h[order]
                doc = of[rare]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(h.view(np.int64), prepend=0) != 0) | (np.arange(len(h)) == 0))
                none = pa.nulls(len(first), pa.int64())
                yield arrow_table({
                    "row": rows[doc[first]], "doc_id": none, "held_out": pa.nulls(len(first), pa.bool_()), "n_tokens": none, "word": h[first].view(np.int64), "n": np.diff(np.append(first, len(h))),
                    "known": np.zeros(len(first), np.int64), "base": np.zeros(len(first)), "gain": np.add.reduceat(gain[rare], first), "gain_unknown": np.add.reduceat(unknown[rare], first),
                }, ROWS)

    made = in_arrow(training(docs), run, "row long, doc_id long, held_out boolean, n_tokens long, word long, n long, known long, base double, gain double, gain_unknown double")
    c = F.coalesce("c", F.lit(0))
    own = F.col("n") == 0
    whole = made.join(counts, "word", "left").select(
        "row", "doc_id", "held_out", "n_tokens",
        F.when(own, F.col("known")).when(c > 0, F.col("n")).otherwise(0).alias("known"),
        F.when(own, F.col("base")).otherwise(F.col("n") * F.log10((c + 0.5) / F.lit(model.z))).alias("base"),
        F.when(own | (c > 0), F.col("gain")).otherwise(F.col("gain_unknown")).alias("gain"),
    )
    summed = whole.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("gain").alias("gain")
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
