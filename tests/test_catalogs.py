"""Catalogue files: what is read, what breaks a rule, old encodings, manifests, reports."""

import json

import pytest

from groundwork.operators import etl
from groundwork.sources import catalogs as C
from groundwork.sources import tables

SOURCE = [{"doc_id": "KFB-1", "source_url": "https://x", "published_at": "2026", "note": ""}]


def write(path, data):
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def rules(df):
    return sorted((r.key, r.rule) for r in df.collect())


def test_sources(spark, tmp_path):
    items = [{"doc_id": "A", "url": "https://www.go.kr/a", "priority": "P0"}, {"doc_id": "A", "url": "https://kb.example.com", "priority": "P1"}, {"doc_id": "B", "url": "http://evil.test", "priority": "P0"}]
    rows, bad = C.sources(C.catalog(spark, write(tmp_path / "s.json", {"sources": items}), C.SOURCES), ["P0"], ["example.com"], [".go.kr"])
    assert [r.doc_id for r in rows.collect()] == ["A", "B"] and rules(bad) == [("A", "repeated_doc_id"), ("B", "host_not_allowed")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("sources:\n- doc_id: A\n  url: https://x.go.kr\n  priority: P0\n")
    assert C.sources(C.catalog(spark, str(tmp_path / "s.yaml"), C.SOURCES), None, [], [".go.kr"])[0].count() == 1


def test_glossary(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("code,ko,category,en,vi,note\nARC,외국인등록증,document,ARC card,,\nP, 여권 ,document, passport ,hộ chiếu,n\n", encoding="utf-8")
    rows = {r.code: (r.ko, r.labels, r.note) for r in C.glossary(spark, str(path), ["ko", "en", "vi", "th"]).collect()}
    assert rows == {"ARC": ("외국인등록증", {"en": "ARC card"}, ""), "P": ("여권", {"en": "passport", "vi": "hộ chiếu"}, "n")}


def test_matrix_and_others(spark, tmp_path):
    inst = {"inst_code": "KB", "inst_name_ko": "은행", "status": "official", "evidence": SOURCE, "visa_rules": [{"visa_code": "E-9", "account_open": "official", "evidence": []}, {"visa_code": "D-2", "account_open": "maybe"}]}
    _, visa, bad = C.matrix(C.catalog(spark, write(tmp_path / "m.json", {"updated_at": "2026", "institutions": [inst, {"inst_code": "NH", "status": "unknown"}]}), C.MATRIX))
    assert visa.count() == 2 and rules(bad) == [("KB/D-2", "unknown_state"), ("KB/E-9", "no_evidence")]
    block = {"status": "official", "doc_codes": ["P"], "evidence": SOURCE}
    rows, bad = C.checklist(C.catalog(spark, write(tmp_path / "c.json", {"base": block, "account_opening": {"by_purpose": {"salary": block | {"evidence": []}}}, "foreign_registration": {"by_visa": {"E-9": {}}}}), C.CHECKLIST))
    assert sorted((r.kind, r.key, r.status) for r in rows.collect()) == [("account_opening", "salary", "official"), ("base", "", "official"), ("foreign_registration", "E-9", "unknown")]
    assert rules(bad) == [("account_opening/salary", "no_evidence")]
    types, steps, contacts, bad = C.scam(C.catalog(spark, write(tmp_path / "x.json", {"types": [{"code": "T"}], "response_steps": [{"seq": 2}, {"seq": 1}], "contacts": [{"code": "112", "number": "112", "evidence": SOURCE}]}), C.SCAM))
    assert (types.count(), steps.count(), contacts.count()) == (1, 2, 1) and rules(bad) == [("T", "no_evidence")]
    limits = {"a": {"status": "official", "value": 5, "evidence": SOURCE}, "b": {"status": "unknown", "value": 5}, "c": {"status": "official", "evidence": SOURCE}}
    assert rules(C.limits(C.catalog(spark, write(tmp_path / "l.json", {"limits": limits}), C.LIMITS))[1]) == [("b", "value_of_unknown"), ("c", "no_value")]


def test_manifest_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("B", "h2", None), ("A", "h1", "2026")], "doc_id string, sha256 string, verified_at string")
    assert [(r.doc_id, r.line) for r in C.manifest_lines(rows, "doc_id").collect()] == [("A", '{"sha256":"h1","verified_at":"2026"}'), ("B", '{"sha256":"h2","verified_at":null}')]
    paths = [write(tmp_path / f"exp_{k}.json", {"n": k}) for k in (1, 2)]
    assert sorted((r.name, r.n) for r in C.reports(spark, paths, "n int").collect()) == [("exp_1", 1), ("exp_2", 2)]


def test_encodings(spark):
    mixed = '<meta charset="utf-8"><meta charset=euc-kr>한글'.encode("cp949")
    assert C.best_decoding(mixed).endswith("한글") and C.best_decoding("é".encode()) == "é" and C.best_decoding(b"charset=nonsense x").endswith("x")
    files = spark.createDataFrame([("a", bytearray("구분,건수\r\n보이스피싱,1".encode("cp949"))), ("b", bytearray(b"x"))], "name string, content binary")
    pinned = spark.createDataFrame([("a", "0" * 64)], "name string, sha256 string")
    got = {r.name: (r.matches, r.text) for r in C.converted(files, pinned).collect()}
    assert got == {"a": (False, "구분,건수\n보이스피싱,1"), "b": (None, "x")}


def test_upsert_and_keys(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (None, "e"), (3, "f")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(now, new, "k").collect())) == [(1, "a"), (2, "d"), (3, "f")]
    bundle = spark.createDataFrame([("ko", '{"a": {"b": {"c": "x"}, "d": "y"}, "e": "z"}')], "lang string, body string")
    assert sorted((r.key, r.value) for r in tables.flat_keys(bundle, "lang", "body").collect()) == [("a.b.c", "x"), ("a.d", "y"), ("e", "z")]


def brute_blocks(text):
    rows = [r.rstrip() for r in text.split("\n")]
    rows = [r for k, r in enumerate(rows) if k == 0 or r != rows[k - 1] or not r.strip() or "|" in r]
    out, k = [], 0
    while k < len(rows):
        best = 0
        for s in range(len(out)):
            n = 0
            while s + n < len(out) and k + n < len(rows) and out[s + n] == rows[k + n] and "|" not in rows[k + n]:
                n += 1
            best = max(best, n)
        if best >= 3 and rows[k].strip():
            k += best
        else:
            out.append(rows[k])
            k += 1
    return "\n".join(out).strip()


def test_blocks_of_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["a\nb\nc\n\na\nb\nc\nd\nb\nc\n\na", "x|1\ny\nz\nx|1\ny\nz", "p\n\nq\nr\np\n\nq\nr"]
    texts += [t + "\n" + t for t in texts[:20]]
    assert [etl.kept_blocks(t) for t in texts] == [brute_blocks(t) for t in texts]
