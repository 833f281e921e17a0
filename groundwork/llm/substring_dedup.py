"""Substring dedup (operator 3): super-k-mer partitioning of 50-word windows.

Consecutive windows that share a minimiser travel as one packed string (their words joined by
spaces) to the minimiser's bucket; there the bucket's windows are sorted, and those that
compare equal are one window's occurrences, counted exactly by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groundwork.llm.common import arrow_table, in_arrow, slices, utf8, word_hashes
from groundwork.llm.windows import Bucket, Windows, alike, duplicated, found_in, keyed, marked

LENGTH, GRAM = 50, 8

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _strings(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split() if spans else []
    return [b" ".join(words[a:b]) for a, b in spans]


def spec(length: int = LENGTH, gram: int = GRAM) -> Windows:
    return Windows(length, gram, lambda t: word_hashes(t.split()), _strings)


def first_documents(length: int):
    """Decides buckets by sorting their windows: a window is fresh in the smallest doc_id that holds it, which learns
    one place of it at least and finds its other ones by itself."""

    def decide(buckets: list[Bucket]) -> list[tuple[int, int, int]]:
        rows = []
        for _, strings in buckets:
            if len(strings) == 1:
                ((packed, (doc, at)),) = strings.items()
                rows.append((doc, at, packed.count(b" ") + 2 - length))
                continue
            windows = []
            for packed, (doc, at) in strings.items():
                ends = np.append(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32), len(packed)).tolist()
                starts = [0, *(e + 1 for e in ends[:-1])]
                windows += [(packed[starts[j] : ends[j + length - 1]], doc, at + j) for j in range(len(ends) - length + 1)]
            windows.sort(key=lambda w: (w[0], w[1]))
            for _, same in groupby(windows, key=lambda w: w[0]):
                same = list(same)
                rows += [(doc, place, 1) for _, doc, place in same if doc == same[0][1]]
        return rows

    return decide


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256: what is left of every whole text.

    A word is removed if a window of `length` words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. Words are runs of characters other
    than ASCII white space. Null, empty and short texts lose nothing. Rows that repeat a
    doc_id are one document and keep what they share among themselves; a null doc_id takes no
    part and keeps its text. An empty table gives an empty result. Other columns are not read.
    """
    s = spec(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 8 << 20):
            rows = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), found_in(batch, "runs", "fresh"), strict=True):
                words = (text or b"").split()
                gone, n_spans = np.zeros(len(words), bool), 0
                if len(own[0]):
                    gone = duplicated(len(words), own, s, lambda known, places, words=words: alike(word_hashes(words), words, length)(known, places))
                    n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if n_spans else words
                rows.append((doc_id, len(words), len(words) - len(kept), n_spans, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield arrow_table(dict(zip(RESULT.names, map(list, zip(*rows)))), RESULT)

    return in_arrow(marked(keyed(docs), s, first_documents(length))[0], run, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")
