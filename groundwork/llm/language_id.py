"""Language ID (operator 8): a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes (A-Z lower-cased, blanks alike) are cut into windows of fixed length,
all of them looked at. Bytes are embedded, filters of several widths slide over each window, each
filter keeps its largest answer, and a softmax layer turns those into language probabilities;
a text's are the mean over its windows, weighted by their lengths. The network is fitted on a
bounded sample of labelled texts; prediction sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, crc32_remainder, in_arrow, slices, unused, utf8

#: Bytes in a window, size of a byte's vector, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: The fit's sample: texts of each language and windows of each text at most; all languages take part.
#: Held-out accuracy no longer rises well before this bound, so it grows with the languages, not with the corpus.
TEXTS, WINDOWS = 500, 3
EPOCHS, BATCH, RATE = 8, 64, 0.01

RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

#: A-Z become a-z, every control and blank a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[:33] = 32
FOLD_TABLE = FOLD.tobytes()


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after another, the last filled up with spaces."""
    n = max(1, -(-len(text) // length))
    return np.frombuffer(text.translate(FOLD_TABLE).ljust(n * length), np.uint8).reshape(n, length)


class ByteConvolution:
    """embedding (256 x EMBED), one kernel for all widths (zero outside a filter's width), softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.reach, n = languages, max(WIDTHS), FILTERS * len(WIDTHS)
        self.floor = 0.0
        self.mask = np.zeros((self.reach * EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)), "kernel": rng.normal(0, 0.25, self.mask.shape) * self.mask,
            "lift": np.zeros(n), "out": rng.normal(0, 0.1, (n, len(languages))), "bias": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer of each filter in each window, where it was, and the unfolded input."""
        b, length = x.shape
        e = self.p["embed"][x]
        unfolded = np.lib.stride_tricks.sliding_window_view(e.reshape(b, length * EMBED), self.reach * EMBED, axis=1)[:, ::EMBED]
        answers = (unfolded.reshape(-1, self.reach * EMBED) @ self.p["kernel"]).reshape(b, length - self.reach + 1, -1)
        return answers.max(axis=1), answers, unfolded

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of windows."""
        out = []
        for a in range(0, len(x), 64):
            top, _, _ = self._pooled(x[a : a + 64])
            z = np.maximum(top + self.p["lift"], 0) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        b = len(x)
        top, answers, unfolded = self._pooled(x)
        hidden = np.maximum(top + self.p["lift"], 0)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(b), y] -= 1
        d /= b
        g = {"out": hidden.T @ d, "bias": d.sum(axis=0)}
        dh = (d @ self.p["out"].T) * (hidden > 0)
        g["lift"] = dh.sum(axis=0)
        where = answers.argmax(axis=1)
        seen = unfolded[np.arange(b)[:, None], where]  # window, filter, reach * EMBED
        g["kernel"] = np.einsum("bf,bfk->kf", dh, seen) * self.mask
        back = (dh[:, :, None] * self.p["kernel"].T[None]).reshape(-1, EMBED)
        at = (where[:, :, None] + np.arange(self.reach)).reshape(b, -1)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x[np.arange(b)[:, None], at].reshape(-1), back)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                k = order[a : a + BATCH]
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for name, g in self._gradient(x[k], y[k]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def fit(docs: DataFrame) -> ByteConvolution | None:
    """A network fitted on at most TEXTS texts of each label; none without labels.

    Uses rows with a label and a text whose crc32 of doc_id modulo 4 is not 2. Which texts are
    taken depends on a hash of their ids: a count of each label gives the share to take.
    """
    usable = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where((crc32_remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & has_letters())
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    # Labels that all take part need no entry: those left have more than TEXTS texts.
    large = [v for r in counts if r["count"] > 1.25 * TEXTS for v in (r["lang"], 1.25 * TEXTS / r["count"])]
    share = F.coalesce(F.create_map(*map(F.lit, large))[F.col("lang")], F.lit(1.0)) if large else F.lit(1.0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) / 1_000_003
    sample = usable.withColumn("draw", drawn).where(F.col("draw") < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, draw, text in zip(batch.column("lang").to_pylist(), batch.column("draw").to_pylist(), utf8(batch, "text"), strict=True):
                w = windows_of(text)
                picked = np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int))
                rows.append((lang, draw, w[picked].tobytes()))
            if rows:
                yield arrow_table(dict(zip(("lang", "draw", "windows"), map(list, zip(*rows)))), pa.schema([("lang", pa.string()), ("draw", pa.float64()), ("windows", pa.binary())]))

    # 1.25 * TEXTS rows of each label on average, WINDOWS * WINDOW bytes each.
    rows = sorted(in_arrow(sample.select("lang", "draw", "text"), cut, "lang string, draw double, windows binary").collect(), key=lambda r: (r.lang, r.draw, r.windows))
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    x, y = [], []
    for r in rows:
        if taken[r.lang] < TEXTS:
            taken[r.lang] += 1
            w = np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW)
            x.append(w)
            y += [languages.index(r.lang)] * len(w)
    if not x:
        return None
    net = ByteConvolution(languages)
    net.fit(np.concatenate(x), np.array(y))
    net.floor = floor_of(net, np.concatenate(x))
    return net


def floor_of(net: ByteConvolution, windows: np.ndarray) -> float:
    """The least probability of its best label that a text of a learned language is taken to have.

    Half way between no information (all labels alike) and the least that any window of the labelled
    sample gives its best label: no window that was learned from is near it, nor is a whole text of
    such windows. A text below it looks like none of the labels.
    """
    chance = 1 / len(net.languages)
    return float(chance + (net.probabilities(windows).max(axis=1).min() - chance) / 2) if len(net.languages) > 1 else 0.0


def labelled(net: ByteConvolution | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Predicted label and score of each text; `und` and 0 for a missing one."""
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    rows = [k for k, t in enumerate(texts) if t] if net else []
    at = 0
    while at < len(rows):
        # Windows of several texts together.
        stop, size = at, 0
        while stop < len(rows) and (stop == at or size + len(texts[rows[stop]]) < 1 << 20):
            size += len(texts[rows[stop]])
            stop += 1
        cut = [windows_of(texts[k]) for k in rows[at:stop]]
        starts = np.cumsum([0, *(len(c) for c in cut)])[:-1]
        p = net.probabilities(np.concatenate(cut))
        lengths = np.full(len(p), WINDOW)
        lengths[starts + [len(c) - 1 for c in cut]] = [len(texts[k]) - WINDOW * (len(c) - 1) for k, c in zip(rows[at:stop], cut)]
        total = np.add.reduceat(p * lengths[:, None], starts) / np.add.reduceat(lengths, starts)[:, None]
        for k, row, best in zip(rows[at:stop], total, total.argmax(axis=1).tolist()):
            pred[k], score[k] = net.languages[best], min(1.0, float(row[best]))
        at = stop
    return pred, score


def has_letters() -> Column:
    """Whether the text has a letter at all (null: no)."""
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def predict_languages(docs: DataFrame, net: ByteConvolution | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    held_out: the crc32 of doc_id as text, modulo 4, is 2 (null doc_id: false). lang_pred is a
    learned label, or `und` with score 0 if the text is null or has no letter or nothing could
    be learned. One row for each input row, repeated or not; an empty table gives an empty
    result. Columns other than doc_id, text and, for the fit, lang are not read.
    """
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1000, 2 << 20):
            texts = [t if k else None for t, k in zip(utf8(batch, "text"), batch.column("letters").to_pylist())]
            pred, score = labelled(shared.value, texts)
            yield arrow_table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pred, "score": score}, RESULT)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(crc32_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), has_letters().alias("letters"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, net: ByteConvolution | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text the network gives a language.

    Null texts, empty ones and those without a letter go, and so do texts whose best label has a
    probability below the network's floor (`floor_of`). Where no network could be fitted (no
    usable label), every text with a letter stays. Null and repeated ids make no difference: each
    row is judged by its own text. An empty table stays empty.
    """
    net = net or fit(docs)
    if net is None:
        return docs.where(has_letters())
    shared, names = docs.sparkSession.sparkContext.broadcast(net), docs.columns
    letters = unused(names, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1000, 2 << 20):
            texts = [t if k else None for t, k in zip(utf8(batch, "text"), batch.column(letters).to_pylist())]
            pred, score = labelled(shared.value, texts)
            yield batch.filter(pa.array([p != "und" and s >= shared.value.floor for p, s in zip(pred, score, strict=True)])).select(names)

    return in_arrow(docs.withColumn(letters, has_letters()), run, docs.schema)
