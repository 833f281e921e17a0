import public_tokenizers
from tokenizers import Tokenizer

from groundwork.llm.token_counts import token_counts

TEXTS = [
    None, "", " ", "\n", "a", "the cat  sat\n on the mat ", "don't\tstop", "x\n\ny", " lead", "trail ", "é à ü", "<|endoftext|> a <|endoftext|>",
    "a\x1cb c", "nb sp ace", "日本語 テスト", "a" * 5000, "word " * 3000, "1 22 333\n4444", "a \n b", "a\n b", "don't 'tis", "é x", "a\r\nb", "a\t\tb  c   d",
]


def test_matches_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "\n", "x"), (None, "null id", "x")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == want


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
