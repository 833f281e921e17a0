"""Cross-tokenizer alignment (operator 12): how often tokens of two vocabularies overlap, by documents.

Texts are encoded once. A batch of documents becomes one packed row for each stripe of A ids that
it meets (its pairs, in how many of its documents each is, and the links themselves) and one with
its documents' own figures. Stripes are counted in dense blocks with np.add.at, rows of a block
give each A id's highest count, and the links meet the finished block where they are: a stripe's
rows are dealt over as many tasks as their bytes ask for, the block's counts are sent to each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, in_arrow, settle, slices
from groundwork.llm.pair_codes import Aligner

#: Bytes of a dense block of counts; documents and bytes of text of a batch, at most (a longer text is one of its own).
BLOCK_BYTES, ROWS, BYTES = 96 << 20, 2000, 4 << 20
#: Packed bytes of a stripe that one task is to read.
SHARE = 32 << 20
#: Cells in a row that carries a block's counts.
CELLS = 1 << 16

FIGURES = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_a", "<i8"), ("n_b", "<i8"), ("n_groups", "<i8"), ("n_links", "<i8"), ("sha", "u1", 32)])
SCORES = np.dtype([("doc", "<u2"), ("n_best", "<i8"), ("count_sum", "<i8")])
PACKED = pa.schema([("batch", pa.int64()), ("stripe", pa.int32()), ("cells", pa.binary()), ("held", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("pair_bytes", pa.int64()), ("link_bytes", pa.int64())])
COUNTS = pa.schema([("stripe", pa.int32()), ("cells", pa.binary()), ("held", pa.binary()), ("best", pa.binary())])
PARTS = pa.schema([("batch", pa.int64()), ("scores", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
#: Spark's types of the packed columns.
TYPES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}

_open: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _open:
        _open.clear()
        _open[paths] = Aligner(*paths)
    return _open[paths]


def _forget() -> None:
    """Counting and scoring need the memory that encoding kept for its chunks."""
    for aligner in _open.values():
        aligner.clear()


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {TYPES[f.type]}" for f in schema)


def _small(values: np.ndarray) -> np.ndarray:
    """The values as the narrowest of three unsigned types."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def _wide(packed: bytes, n: int) -> np.ndarray:
    """What `_small` packed, n values."""
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of an ordered array, where each begins and how often it stands there."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], starts, np.diff(np.append(starts, len(ordered)))


class Stripes:
    """A ids are dealt over stripes in turn; a stripe's cells are its A ids times all B ids."""

    def __init__(self, a_size: int, b_size: int) -> None:
        self.b_size = b_size
        self.n = max(1, -(-a_size * b_size * 8 // BLOCK_BYTES))
        self.rows = -(-a_size // self.n)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Stripe and cell of codes a * b_size + b as one number: stripe * cells + cell."""
        a, b = np.divmod(codes, np.uint32(self.b_size))
        row, stripe = np.divmod(np.arange(int(a.max(initial=0)) + 1, dtype=np.uint64), np.uint64(self.n))
        return ((stripe * np.uint64(self.rows) + row) * np.uint64(self.b_size))[a] + b

    @property
    def cells(self) -> int:
        return self.rows * self.b_size


def _encode(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], stripes: Stripes, rows: int) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(paths)
    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", rows, BYTES):
        ids = batch.column("doc_id")
        figures = np.zeros(batch.num_rows, FIGURES)
        figures["doc_id"], figures["has_id"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        links = []
        for k, (codes, n_a, n_b, groups, sha) in enumerate(aligner.documents(batch.column("text").to_pylist())):
            figures[["n_a", "n_b", "n_groups", "n_links"]][k] = (n_a, n_b, groups, codes.size)
            if sha:
                figures["sha"][k] = np.frombuffer(sha, np.uint8)
            links.append(codes)
        keys = stripes.keys(np.concatenate(links)) << np.uint64(16)
        keys |= np.repeat(np.arange(len(links), dtype=np.uint64), [len(x) for x in links])
        keys.sort()
        # A place for each pair and document, how often it is linked there; then one for each pair.
        held, _, times = _runs(keys)
        pairs, starts, in_docs = _runs(held >> np.uint64(16))
        docs = (held & np.uint64(0xFFFF)).astype("<u2")
        stripe, cell = np.divmod(pairs, np.uint64(stripes.cells))
        out = [{"batch": number, "stripe": -1, "cells": figures.tobytes(), "held": b"", "docs": b"", "times": b"", "pair_bytes": 0, "link_bytes": 0}]
        edges = [*np.flatnonzero(np.diff(stripe, prepend=-1)).tolist(), len(pairs)] if len(pairs) else []
        starts = np.append(starts, len(held))
        for low, high in zip(edges, edges[1:], strict=False):
            first, last = starts[low], starts[high]
            parts = (cell[low:high].astype("<u4").tobytes(), _small(in_docs[low:high]).tobytes(), docs[first:last].tobytes(), _small(times[first:last]).tobytes())
            out.append(dict(zip(("cells", "held", "docs", "times"), parts, strict=True)) | {"batch": number, "stripe": int(stripe[low]), "pair_bytes": sum(map(len, parts[:2])), "link_bytes": sum(map(len, parts))})
        yield arrow_table({f.name: [r[f.name] for r in out] for f in PACKED}, PACKED)
        number += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _count(batches: Iterator[pa.RecordBatch], stripes: Stripes, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come by stripe; a stripe's counts go out in rows of whole A ids, with what is highest for its A id."""
    _forget()
    block, now = None, None

    def done() -> Iterator[pa.RecordBatch]:
        cells = np.flatnonzero(block)
        best = block[cells] == block.reshape(stripes.rows, stripes.b_size).max(axis=1)[cells // stripes.b_size]
        for k in range(0, len(cells), most):
            part = cells[k : k + most]
            row = {"stripe": [now], "cells": [part.astype("<u4").tobytes()], "held": [block[part].astype("<i8").tobytes()], "best": [best[k : k + most].tobytes()]}
            yield arrow_table(row, COUNTS)

    for row in _rows(batches):
        if row["stripe"] != now:
            if block is not None:
                yield from done()
            block, now = np.zeros(stripes.cells, np.int64), row["stripe"]
        cells = np.frombuffer(row["cells"], "<u4")
        np.add.at(block, cells, _wide(row["held"], len(cells)) if row["packed"] else np.frombuffer(row["held"], "<i8"))
    if block is not None:
        yield from done()


def _score(batches: Iterator[pa.RecordBatch], stripes: Stripes) -> Iterator[pa.RecordBatch]:
    """Rows come by (stripe, salt), the counts before the links."""
    _forget()
    count = best = now = None
    for row in _rows(batches):
        if row["stripe"] != now:
            count, best, now = np.zeros(stripes.cells, np.int64), np.zeros(stripes.cells, bool), row["stripe"]
        cells = np.frombuffer(row["cells"], "<u4")
        if row["batch"] is None:
            count[cells], best[cells] = np.frombuffer(row["held"], "<i8"), np.frombuffer(row["docs"], bool)
            continue
        docs, each = np.frombuffer(row["docs"], "<u2"), np.repeat(np.arange(len(cells)), _wide(row["held"], len(cells)))
        times = _wide(row["times"], len(docs))
        found, place = np.unique(docs, return_inverse=True)
        scores = np.zeros(len(found), SCORES)
        scores["doc"] = found
        for name, value in (("n_best", best[cells].astype(np.int64)), ("count_sum", count[cells])):
            total = np.zeros(len(found), np.int64)
            np.add.at(total, place, value[each] * times)
            scores[name] = total
        yield arrow_table({"batch": [row["batch"]], "scores": [scores.tobytes()]}, PARTS)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by batch, its documents' figures first, then what each stripe gave."""
    figures, totals = None, None

    def done() -> pa.RecordBatch:
        known = {n: figures[n] for n in ("n_a", "n_b", "n_groups", "n_links")} | {"n_best": totals["n_best"], "count_sum": totals["count_sum"]}
        digests = [bytes(sha).hex() if n else "" for sha, n in zip(figures["sha"], figures["n_a"], strict=True)]
        return arrow_table(known | {"doc_id": pa.array(figures["doc_id"], mask=figures["has_id"] == 0), "groups_sha256": digests}, RESULT)

    for row in _rows(batches):
        if row["figures"]:
            if figures is not None:
                yield done()
            figures = np.frombuffer(row["scores"], FIGURES)
            totals = np.zeros(len(figures), SCORES)
        else:
            scores = np.frombuffer(row["scores"], SCORES)
            for name in ("n_best", "count_sum"):
                totals[name][scores["doc"]] += scores[name]  # a document once in each row
    if figures is not None:
        yield done()


def _salt(size: str) -> Column:
    """A batch's part of its stripe, of as many as `size` asks for."""
    return F.pmod(F.xxhash64("batch"), F.greatest(F.ceil(F.col(size) / SHARE), F.lit(1))).cast("int")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A text that is null, empty, or that the tokens of A or B do not spell byte by byte (after the
    added space) has zeros and an empty digest and counts for no pair. Repeated rows and ids are
    documents of their own, a null doc_id is kept, an empty table gives an empty result, other
    columns are not read. Special strings inside texts are plain text. Files: of the tokenizers
    library with byte-level entries (A), of sentencepiece (B).
    """
    paths = (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
    aligner = Aligner(*paths)
    stripes = Stripes(aligner.a_size, aligner.b_size)
    packed = settle(in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_encode, paths=paths, stripes=stripes, rows=ROWS), _ddl(PACKED)), "packed")
    links = packed.where("stripe >= 0")
    # One row for each stripe at most, so this table is bounded by the vocabularies.
    sizes = F.broadcast(links.groupBy("stripe").agg(F.sum("pair_bytes").alias("all_pairs"), F.sum("link_bytes").alias("all_links")))
    sized = links.join(sizes, "stripe")
    counted = ["stripe", "cells", "held"]
    # Counts of a stripe's parts, then of the parts' sums.
    parts = sized.select(*counted, F.lit(True).alias("packed"), _salt("all_pairs").alias("salt")).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt")
    sums = in_arrow(parts, partial(_count, stripes=stripes, most=CELLS), _ddl(COUNTS)).select(*counted, F.lit(False).alias("packed"))
    counts = settle(in_arrow(sums.repartition("stripe").sortWithinPartitions("stripe"), partial(_count, stripes=stripes, most=CELLS), _ddl(COUNTS)), "counts")
    salts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all_links") / SHARE), F.lit(1)).cast("int") - 1))
    none = F.lit(None).cast("long").alias("batch")
    copies = counts.join(sizes, "stripe").select("stripe", salts.alias("salt"), none, "cells", "held", F.col("best").alias("docs"), F.lit(b"").alias("times"))
    rows = copies.unionByName(sized.select("stripe", _salt("all_links").alias("salt"), "batch", "cells", "held", "docs", "times"))
    scores = in_arrow(rows.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("batch")), partial(_score, stripes=stripes), _ddl(PARTS))
    own = packed.where("stripe < 0").select("batch", F.lit(True).alias("figures"), F.col("cells").alias("scores"))
    both = own.unionByName(scores.select("batch", F.lit(False).alias("figures"), "scores"))
    return in_arrow(both.repartition("batch").sortWithinPartitions("batch", F.desc("figures")), _gather, _ddl(RESULT))
