"""Suffix-array dedup (operator 2): bytes covered by a 100-byte string that starts earlier are removed.

Candidate runs meet in the bucket of their minimiser (see windows). The distinct strings of a
chunk of buckets are laid end to end, a suffix array is built over them by linear grouping,
and windows that stand side by side in it and agree in all their bytes are one string; its
first occurrence stays, every other one goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, in_arrow, mix, slices, utf8
from groundwork.llm.suffix_array import equal_windows
from groundwork.llm.windows import Bucket, Found, Windows, duplicated, found_in, keyed, marked

LENGTH, GRAM = 100, 32

BYTES = mix(np.arange(256, dtype=np.uint64))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spec(length: int = LENGTH, gram: int = GRAM) -> Windows:
    return Windows(length, gram, lambda t: BYTES[np.frombuffer(t, np.uint8)], lambda t, spans: [t[a:b] for a, b in spans])


def trimmed(strings: list[tuple[bytes, int, int]], length: int, rows: list[tuple[int, int, int]]) -> list[tuple[bytes, int, int]]:
    """The strings cut down to where they have windows whose hash occurs again among them.

    A window whose hash is alone is alone itself, hence fresh: it goes to rows. Equal windows
    stay together, and which windows are equal is for the suffix array to say. Strings that
    are the same once cut (one passage in different surroundings) are kept once, at their
    first place: no window of the others can be its content's first.
    """
    if not strings:
        return []
    ends = np.cumsum([len(p) for p, _, _ in strings])
    h = window_hashes(BYTES[np.frombuffer(b"".join(p for p, _, _ in strings), np.uint8)], length)
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    twin = count[where] > 1
    kept: dict[bytes, tuple[int, int]] = {}
    for (packed, doc, at), end in zip(strings, ends.tolist()):
        start, n = end - len(packed), len(packed) - length + 1
        again = np.flatnonzero(twin[start : start + n])
        if not len(again):
            rows.append((doc, at, n))
            continue
        a, b = int(again[0]), int(again[-1]) + 1
        if a:
            rows.append((doc, at, a))
        if b < n:
            rows.append((doc, at + b, n - b))
        part, place = packed[a : b + length - 1], (doc, at + a)
        kept[part] = min(kept.get(part, place), place)
    return [(part, *place) for part, place in kept.items()]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` symbols from each place on, from the powers of two that make up the length."""
    out, width, done = None, 1, 0
    while width <= length:
        if length & width:
            part = h[done : len(h)]
            out = part if out is None else mix(out[: len(part)] * np.uint64(0x9E6C63D0876A9A47) + part)
            done += width
        if 2 * width <= length:
            h = mix(h[:-width] * np.uint64(0x9E6C63D0876A9A47) + h[width:])
        width *= 2
    return out


def first_places(length: int):
    """Decides buckets by a suffix array: a window is fresh at its smallest (doc_id, start)."""

    def decide(buckets: list[Bucket]) -> list[tuple[int, int, int]]:
        rows, strings = [], []
        for _, many in buckets:
            if len(many) == 1:
                ((packed, owner),) = many.items()
                rows.append((*owner, len(packed) - length + 1))
            else:
                strings += [(packed, *owner) for packed, owner in many.items()]
        strings = trimmed(strings, length, rows)
        if not strings:
            return rows
        sizes = np.array([len(p) for p, _, _ in strings])
        text = np.full(int(sizes.sum()) + len(strings), 256, np.int16)
        ends = np.cumsum(sizes + 1)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(p for p, _, _ in strings), np.uint8)
        counts = sizes - length + 1
        string = np.repeat(np.arange(len(strings)), counts)
        at = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
        number = equal_windows(text, length, (ends - sizes - 1)[string] + at)
        doc, place = (np.array([s[k] for s in strings], np.int64)[string] for k in (1, 2))
        place = place + at
        order = np.lexsort((place, doc, number))
        first = order[np.diff(number[order], prepend=-1) != 0]
        fresh = np.zeros(len(string), bool)
        fresh[first] = True
        edge = np.flatnonzero(fresh & ~((np.roll(fresh, 1)) & (at > 0)))
        stop = np.flatnonzero(fresh & ~(np.roll(fresh, -1) & (np.roll(at, -1) > 0)))
        return rows + list(zip(doc[edge].tolist(), place[edge].tolist(), (stop - edge + 1).tolist()))

    return decide


def _spans(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, list[str], Windows]:
    s = spec(length, gram)
    return *marked(docs, s, first_places(length)), s


def gone_bytes(text: bytes | None, found: Found, s: Windows) -> np.ndarray:
    return duplicated(len(text), found, s) if text and len(found[0]) else np.zeros(len(text or b""), bool)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of every whole text's UTF-8 bytes.

    A byte is removed if a string of `length` bytes that covers it also starts earlier, in a
    smaller doc_id or earlier in the same document; strings are judged on the input and never
    cross documents. Null, empty and short texts lose nothing. Rows that repeat a doc_id are one
    document at one place: what they share at equal starts stays in each. A null doc_id takes
    no part and keeps its text. An empty table gives an empty result. Other columns are not read.
    """
    found, extra, s = _spans(keyed(docs), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 8 << 20):
            rows = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), found_in(batch, *extra), strict=True):
                gone = gone_bytes(text, own, s)
                kept = np.frombuffer(text or b"", np.uint8)[~gone].tobytes()
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((doc_id, len(gone), len(gone) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            yield arrow_table(dict(zip(RESULT.names, map(list, zip(*rows)))), RESULT)

    return in_arrow(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs, with all their columns, the texts without the removed bytes and n_chars, where there is
    such a column, counted anew. A character of which a byte goes, goes whole.

    Null ids, null and empty texts and repeated ids are taken as in `dedup`; a row stays even if nothing
    is left of its text. An empty table stays empty.
    """
    found, extra, s = _spans(docs, length, gram)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 8 << 20):
            texts = []
            for text, own in zip(utf8(batch, "text"), found_in(batch, *extra), strict=True):
                gone = gone_bytes(text, own, s)
                if gone.any():
                    data = np.frombuffer(text, np.uint8)
                    lead = np.flatnonzero(data & 0xC0 != 0x80)
                    whole = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
                    text = data[~whole].tobytes()
                texts.append(None if text is None else text.decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    out = in_arrow(found.select(*names, *extra), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
