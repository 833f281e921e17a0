import re
import zlib

import numpy as np
import public_tokenizers
from test_decontamination import brute as contaminated
from test_near_dup import brute as grouped
from test_window_dedup import brute_bytes
from tokenizers import Tokenizer

import corpus_pipeline as C


def dedup_brute(rows, length=100):
    """Texts without what brute_bytes removes, broken characters taken out."""
    first, out = {}, {}
    rows = sorted(rows)
    for i, t in rows:
        t = t.encode()
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], (i, k))
    for i, t in rows:
        t = t.encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] != (i, k):
                gone[k : k + length] = b"\1" * length
        chars, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            if not any(gone[at : at + n]):
                chars.append(c)
            at += n
        out[i] = "".join(chars)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    stages = dict(C.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}

    def done(name):
        nonlocal docs
        stages[name](spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return docs

    got = done("language_id")
    assert got.columns == columns
    rows = {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id: r.text for r in got.collect()} == rows

    got = done("near_dup")
    assert got.columns == columns
    kept = {r[0] for r in grouped(list(rows.items())) if r[3]}
    rows = {i: rows[i] for i in kept}
    assert {r.doc_id: r.text for r in got.collect()} == rows

    got = done("suffix_dedup")
    assert got.columns == columns
    assert brute_bytes(list(rows.items()), 100)
    rows = dedup_brute(rows.items())
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in rows.items()}

    got = done("decontamination")
    assert got.columns == columns
    left = {r.doc_id for r in got.collect()}
    exact = {i for i, t in rows.items() if any(x in t for _, x in bench)}
    assert left <= rows.keys() and not left & exact
    assert {i for i, _ in contaminated([(i, rows[i]) for i in sorted(rows.keys() - left)], bench)} == rows.keys() - left
    some = sorted(left)[:25]
    assert not contaminated([(i, rows[i]) for i in some], bench[:15])
    rows = {i: rows[i] for i in left}

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in rows.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, a // 4096, a, len(p := ids[a : a + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for a in range(0, len(ids), 4096)}
    assert {tuple(r)[:5] for r in done("packing").collect()} == want


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 100


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"v{k}" for k in range(100))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", None, 1), (3, long, "en", None, 1), (4, long + " end", None, "s", 2), (None, "some words here", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for name, stage in C.STAGES[:4]:
            part = stage(spark, part, "/root/testdata/sf0.001")
            assert part.columns == docs.columns
            part.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            part = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(r.doc_id or 0 for r in part.collect()) in ([0, 3], [])
