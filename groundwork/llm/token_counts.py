"""Token counts (operator 10): a map-side two-tier look-up, with no shuffle of pre-tokens.

Tier one is a compact broadcast table of frequent chunks and their token counts; a miss is
encoded by the library once for each worker (tier two). A chunk is what stands between two
single spaces, with the space before it: byte-level BPE pre-tokens never cross such a border.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.chunk_cache import ODD, RUN, ChunkLengths, TokenCounter
from groundwork.llm.common import CLEAR, arrow_table, in_arrow, slices

#: Rows of which the frequent chunks are taken, at most, and entries of the broadcast table, at most.
#: The table only saves work; no count depends on what is in it.
SAMPLE_ROWS, TABLE_ENTRIES = 1000, 65_536

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def frequent_chunks(docs: DataFrame, path: str) -> dict[str, tuple[bytes, bytes]]:
    """The most frequent chunks of a bounded sample as a compact table: for line heads and for
    chunks after a space, the chunks joined by line breaks and a byte for each one's count."""
    seen = {"first": Counter(), "spaced": Counter()}
    for (text,) in docs.select("text").where(F.col("text").isNotNull()).limit(SAMPLE_ROWS).select(F.substring("text", 1, 20_000)).collect():
        if ODD.search(text) or RUN.search(text):
            continue
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            seen["first"][head] += 1
            seen["spaced"].update(rest)
    table = {}
    for kind, prefix in (("first", ""), ("spaced", " ")):
        lengths = ChunkLengths(path, prefix, {})
        words = [w for w, n in seen[kind].most_common(TABLE_ENTRIES // 2) if n > 1 and len(w) <= 64 and lengths[w] < 256]
        table[kind] = ("\n".join(words).encode(), np.array([lengths[w] for w in words], np.uint8).tobytes())
    return table


def unpacked(table: tuple[bytes, bytes]) -> dict[str, int]:
    words = table[0].decode().split("\n") if table[1] else []
    return dict(zip(words, np.frombuffer(table[1], np.uint8).tolist(), strict=True))


_counters: dict[tuple, TokenCounter] = {}
CLEAR.append(lambda: [c.clear() for c in _counters.values()])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get their row; an
    empty table gives an empty result; a null doc_id is kept. Other columns are not read.
    Special strings inside texts count as the library takes them by default.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    table = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, table.value["first"], table.value["spaced"])
        if key not in _counters:
            _counters.clear()
            _counters[key] = TokenCounter(path, unpacked(key[1]), unpacked(key[2]))
        count = _counters[key].count
        for batch in slices(batches, "text", 2000, 8 << 20):
            n = np.array([count(t) for t in batch.column("text").to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield arrow_table({"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}, SCHEMA)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
