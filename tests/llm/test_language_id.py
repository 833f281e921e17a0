import zlib

import numpy as np
import pytest

from groundwork.llm import language_id as L


def test_gradient():
    net = L.ByteConvolution(["a", "b", "c"])
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 122, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net._gradient(x, y)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for name in net.p:
        spots = np.argsort(-np.abs(g[name]).ravel())[:4]
        for k in spots:
            p = net.p[name].reshape(-1)
            old = p[k]
            p[k] = old + 1e-5
            up = loss()
            p[k] = old - 1e-5
            down = loss()
            p[k] = old
            assert g[name].ravel()[k] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = L.predict_languages(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150
    right = np.mean([r.lang_pred == truth[r.doc_id][0] for r in held])
    print("held-out accuracy", right)
    assert right > 0.97


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?! \n", "en"), (4, "the cat sat on the mat", "en"), (5, "la maison est grande", "fr"), (6, "x" * 100_000, None), (6, "é", "fr"), (None, "the end", "en")]
    df = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, lang string, score double, source string")
    got = L.predict_languages(df).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (1, 2, 3)) for r in got)
    assert L.predict_languages(df.limit(0)).collect() == []
    unlabelled = L.predict_languages(df.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_no_labels_keep_documents(spark):
    rows = [(1, None), (2, ""), (3, "12 ?!"), (4, "the cat sat"), (5, "é"), (None, "the end")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    got = L.known_language(df)
    assert got.columns == df.columns and sorted(r.text for r in got.collect()) == ["the cat sat", "the end", "é"]


def test_all_labels_are_learned(spark):
    words = [f"{a}{b}" * 3 for a in "bcdfghjklm" for b in ("a", "e", "i", "o", "u", "y", "au")]
    docs = [(i, " ".join([w] * 8), f"l{k:02}") for k, w in enumerate(words) for i in range(k * 40, k * 40 + (24 if k else 8))]
    net = L.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(words) == 70 and net.languages == [f"l{k:02}" for k in range(70)]


def forward(net, text):
    """A text's label and score, written out byte by byte: windows, filters, largest answers, softmax, weighted mean."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    data = [b + 32 if 65 <= b <= 90 else 32 if b < 33 else b for b in text.encode()]
    mean, weight = [0.0] * len(net.languages), 0
    for start in range(0, max(1, len(data)), L.WINDOW):
        own = data[start : start + L.WINDOW]
        window = own + [32] * (L.WINDOW - len(own))
        hidden = []
        for f in range(L.FILTERS * len(L.WIDTHS)):
            reach, best = L.WIDTHS[f // L.FILTERS], -np.inf
            for at in range(L.WINDOW - max(L.WIDTHS) + 1):
                best = max(best, sum(p["embed"][window[at + j]] @ p["kernel"][j * L.EMBED : (j + 1) * L.EMBED, f] for j in range(reach)))
            hidden.append(max(0.0, best + p["lift"][f]))
        z = [sum(h * p["out"][k, c] for k, h in enumerate(hidden)) + p["bias"][c] for c in range(len(net.languages))]
        e = [np.exp(x - max(z)) for x in z]
        mean = [m + len(own) * x / sum(e) for m, x in zip(mean, e, strict=True)]
        weight += len(own)
    mean = [m / weight for m in mean]
    k = int(np.argmax(mean))
    return net.languages[k], mean[k]


def test_against_loops_over_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = L.fit(docs)
    texts = ["The end of the day", "la maison ÉTÉ", "x", "a\tb\nC " * 50, "日本 z", "y" * 257]
    got = L.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in got:
        lang, score = forward(net, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_the_stage_drops_what_no_label_fits(spark):
    """The decision is the network's: one that tells nothing apart keeps nothing, a fitted one keeps all labelled documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = L.fit(docs)
    assert 1 / len(net.languages) < net.floor < 0.5
    kept = L.known_language(docs, net)
    assert kept.count() == docs.where("lang is not null and text rlike '\\\\p{L}'").count()
    blank = L.ByteConvolution(net.languages)
    blank.p = {k: np.zeros_like(v) for k, v in blank.p.items()}
    blank.floor = net.floor
    assert L.known_language(docs, blank).count() == 0
