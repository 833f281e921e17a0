import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundwork.llm import token_records as R

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "The cat sat.", "a\x1cb", "no break", "<|endoftext|> x <|startoftext|>y", "İstanbul ΣΑΣ ς", "é ́ x", "don't we'll", "漢字 テスト", "z" * 3000, "w1 " * 2000, " a\u0085b"]


def ids_of(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 1]


def test_round_trip(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(10 - i, t, 5) for i, t in enumerate(TEXTS)] + [(7, "The cat sat.", 5), (None, "no id", 5)]
    got = R.token_records(spark.createDataFrame(rows, "doc_id long, text string, start long")).collect()
    want = sorted(((i is not None, i or 0), ids_of(lib, t)) for i, t, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [((r.doc_id is not None), r.doc_id or 0) for r in got] == [k for k, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((*k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: ids_of(lib, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in R.token_records(docs).collect()}
    assert got.keys() == want.keys()
    start = 0
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        start += len(want[i])


def test_index_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    manifest = R.write_records(docs, f"file://{tmp_path}/r", PATH, 1)
    shard = R.Shard(manifest[0].path)
    in_order = list(shard)
    assert [shard.read(k) for k in range(len(shard))] == in_order
    assert sorted(shard.shuffled(3)) == sorted(in_order) and list(shard.shuffled(3)) != in_order
    at = tmp_path / "r" / manifest[0].path.rsplit("/", 1)[1]
    data = bytearray(at.read_bytes())
    data[20] ^= 1
    at.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(R.Shard(manifest[0].path))


def test_empty(spark):
    assert R.token_records(spark.createDataFrame([], "doc_id long, text string")).collect() == []
