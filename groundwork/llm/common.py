"""What the operators of this package share: the shared scratch folder, batches, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Entries that a worker's cache of words may hold before it is emptied: some 20 MB.
CACHE_ENTRIES = 100_000
#: Bytes of an Arrow batch on its way to a worker. Spark's own bound of 64 MB is one that both sides, and the
#: buffer's doubling, hold several times over; the operators cut batches to a few MB anyway.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path (not yet made) below spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; elsewhere executors
    would not see a local folder, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/groundwork-checkpoints"
    return f"{base.rstrip('/')}/groundwork-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes; a task leaves nothing of its words in the worker.

    The session's bound on an Arrow batch's bytes is lowered to ARROW_BYTES where it is above.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key, "64m"))
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


#: What empties a worker's other caches when a task ends.
CLEAR: list[Callable[[], None]] = []


def release() -> None:
    """Empty this worker's caches and give freed memory back to the system, where the C library can.

    Workers outlive their task, and several may wait for the next one beside those at work.
    """
    _hashes.clear()
    for clear in CLEAR:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as make it differ from all columns in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch with the schema's columns, in its order and types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has at most `rows` rows and, unless it is one row, about `size` bytes of `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's strings as their UTF-8 bytes, nulls kept."""
    return batch.column(column).cast(pa.binary()).to_pylist()


MIX_1, MIX_2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x + GOLD
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word to 64-bit hash; words not yet seen are hashed on first use, and the table is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def crc32_remainder(doc_id: str, modulus: int):
    """Column: unsigned crc32 of the id written as text, modulo `modulus` (null id: null)."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
