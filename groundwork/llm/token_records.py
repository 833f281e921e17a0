"""Token-ID files (operator 1): length-delimited binary records with masked checksums.

A shard is a run of frames, each holding one document:

    8 bytes   payload length, little-endian
    4 bytes   masked checksum of those 8 bytes
    payload   1 byte (1: doc_id known), 8 bytes doc_id, then the ids as little-endian integers
              of 2 bytes (vocabularies up to 65,536) or 4
    4 bytes   masked checksum of the payload

Beside it lies an index: the 8-byte offset of every frame, then the shard's size, so that a
reader can take the records in any order without reading the shard through. The checksum is
crc32, rotated right by 15 bits and moved by a constant, so that checksums of data that holds
checksums stay independent. Shard k holds smaller doc_ids than shard k + 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.chunk_cache import chunk_ids, tokenizer
from groundwork.llm.common import arrow_table, in_arrow, shared_dir, slices, utf8

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
#: Bytes read at a time.
BLOCK = 8 << 20

MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()), ("record", pa.int64())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


class Shard:
    """Reads a shard's records, in file order or by number in any order."""

    def __init__(self, path: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path)
        with self.files.open_input_file(f"{self.path}.idx") as f:
            self.offsets = np.frombuffer(f.read(), "<u8")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def _payload(self, frame: memoryview) -> bytes:
        head, payload = bytes(frame[:8]), bytes(frame[12:-4])
        if struct.unpack("<I", frame[8:12])[0] != masked(head) or struct.unpack("<Q", head)[0] != len(payload) or struct.unpack("<I", frame[-4:])[0] != masked(payload):
            raise ValueError(f"damaged record in {self.path}")
        return payload

    def read(self, k: int) -> bytes:
        """The payload of record k alone, found through the index."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        with self.files.open_input_file(self.path) as f:
            return self._payload(memoryview(f.read_at(b - a, a)))

    def shuffled(self, seed: int) -> Iterator[bytes]:
        """Every payload once, in a random order that the seed fixes."""
        return map(self.read, np.random.default_rng(seed).permutation(len(self)).tolist())

    def __iter__(self) -> Iterator[bytes]:
        k = 0
        with self.files.open_input_file(self.path) as f:
            while k < len(self):
                start = int(self.offsets[k])
                stop = max(k + 1, int(np.searchsorted(self.offsets, start + BLOCK, "right")) - 1)
                data = memoryview(f.read_at(int(self.offsets[stop]) - start, start))
                for j in range(k, stop):
                    yield self._payload(data[int(self.offsets[j]) - start : int(self.offsets[j + 1]) - start])
                k = stop


def split_payload(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """doc_id (or none) and ids of a record's payload."""
    return struct.unpack("<q", payload[1:9])[0] if payload[0] else None, np.frombuffer(payload, f"<u{width}", offset=9)


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_records(docs: DataFrame, folder: str, path: str, end_id: int) -> list:
    """Encode every whole text (null: empty), append end_id, write the shards in ascending doc_id order.

    Returns a row (shard, path, n_docs, n_tokens) for each shard. A task writes under a name of
    its attempt and moves the files when they are complete, so a task that runs again after a
    lost executor leaves one whole shard. Null ids come first; rows that repeat an id stand
    side by side, ordered by text.
    """
    width = id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_ids(path, f"<u{width}").encode, end_id.to_bytes(width, "little")
        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        name, draft = f"{base}/shard-{task.partitionId():06d}.rec", f"{base}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        files.create_dir(base)
        offsets, n_tokens, at = [], 0, 0
        with files.open_output_stream(draft) as out:
            for batch in slices(batches, "text", 2000, BLOCK):
                frames = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                    ids = encode(text) + end
                    frames.append(framed(struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids))
                    offsets.append(at)
                    at += len(frames[-1])
                    n_tokens += len(ids) // width
                out.write(b"".join(frames))
        with files.open_output_stream(f"{draft}.idx") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        if offsets:
            files.move(f"{draft}.idx", f"{name}.idx")
            files.move(draft, name)
            yield arrow_table({"shard": [task.partitionId()], "path": [f"{folder}/shard-{task.partitionId():06d}.rec"], "n_docs": [len(offsets)], "n_tokens": [n_tokens]}, MANIFEST)
        else:
            files.delete_file(draft)
            files.delete_file(f"{draft}.idx")

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(in_arrow(rows, run, "shard long, path string, n_docs long, n_tokens long").collect())


def read_records(spark: SparkSession, manifest: list, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, record of every record, read back from the shards.

    start counts the ids of all records before it; ids_crc32 is over the ids as 4-byte integers.
    """
    starts = np.cumsum([0, *(m.n_tokens for m in manifest)]).tolist()
    shards = spark.createDataFrame([(m.shard, m.path, s) for m, s in zip(manifest, starts)], "shard long, path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for k, payload in enumerate(Shard(path)):
                    doc_id, ids = split_payload(payload, width)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, k))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield arrow_table(dict(zip(READ.names, map(list, zip(*rows)))), READ)
                        rows = []
                if rows:
                    yield arrow_table(dict(zip(READ.names, map(list, zip(*rows)))), READ)

    return in_arrow(shards.repartition(max(1, len(manifest)), "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, record long")


def token_records(docs: DataFrame, path: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the documents' token ids in the file format above and read the files back.

    Result per document: doc_id, start, n_tokens (with the end id), ids_crc32, shard, record.
    Null or empty text: the end id alone. A null doc_id is kept and comes first. Repeated rows
    each become a record. An empty table writes nothing and gives an empty result. Other
    columns are not read. `folder` is a URI that all executors can write to; by default a new
    one below spark.checkpoint.dir.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path("word_bpe_49k.json")
    manifest = write_records(docs, folder or f"{shared_dir(spark)}/records", path, end_id)
    return read_records(spark, manifest, id_width(path))
