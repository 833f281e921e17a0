import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.operators import etl, evaluation, retrieval, rules
from groundwork.sources import tables
from groundwork.streaming import events


def test_kept_blocks():
    assert etl.kept_blocks("a\nb\nc\nx\na\nb\nc\ny") == "a\nb\nc\nx\ny"
    assert etl.kept_blocks("a\nb\nx\na\nb") == "a\nb\nx\na\nb"
    assert etl.kept_blocks("t\nt\n1|2\n1|2") == "t\n1|2\n1|2"


def test_chunks_of():
    parts = etl.chunks_of("# One\n\n" + "\n\n".join("p" * 400 for _ in range(5)) + "\n\na | b | c\n1 | 2 | 3\n\n## Two\n\nend")
    assert parts[0][0] == "One" and any(b.endswith("1 | 2 | 3") for _, b in parts) and parts[-1][0] == "One > Two"
    assert all(b.startswith("…") for _, b in parts[1:] if not b.lstrip().startswith("|"))
    assert etl.chunks_of("") == []


def test_page_text():
    assert etl.page_text("<html><nav>menu</nav><script>x()</script><article><h1>Title</h1><p>Body &amp; more</p><table><tr><td>a</td><td>b</td></tr></table></article></html>") == "Title\nBody & more\n| a | b"


def test_empty_columns(spark):
    docs = spark.createDataFrame([(1, "t\n| a | b | c\n| 1 | | 3\n| 4 | | 6\n\ntext")], "doc_id long, text string")
    assert [tuple(r) for r in etl.empty_columns(docs, "doc_id").collect()] == [(1, 2, 2)]


def test_products(spark):
    base = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "k string")
    options = spark.createDataFrame([("A", 12, 3.0, 3.5), ("A", 24, 3.2, 3.9), ("B", 24, 3.0, 4.1), ("C", 24, None, None)], "k string, save_trm int, rate double, best double")
    cards = lambda term: [r.k for r in rules.product_cards(base, options, ["k"], "rate", "best", term, True).collect()]
    assert cards(12) == ["A"] and cards(24) == ["B", "A", "C"] and cards(None) == ["B", "A", "C"]


def test_unknown_is_not_zero(spark):
    rows = spark.createDataFrame([("official", 0, True, None, None), ("unknown", 0, None, None, None), ("inferred", 2, None, False, 3)], "status string, n_docs int, has_language boolean, has_remote boolean, n_branches int")
    got = [r.s for r in rows.select(rules.fit_score({c: F.col(c) for c in rows.columns}, F.lit(4)).alias("s")).collect()]
    assert got == [1.0, 0.0, 0.53]
    limits = spark.createDataFrame([(50_000.0, 12_000.0), (50_000.0, 60_000.0), (None, 1.0)], "cap double, used double")
    remaining, exceeds = rules.limit_check(F.col("cap"), F.col("used"), F.lit(0.0))
    assert [tuple(r) for r in limits.select(remaining, exceeds).collect()] == [(38_000.0, False), (0.0, True), (None, None)]


def test_relaxation(spark):
    rows = spark.createDataFrame([(1, k, ["x"] if k < 3 else ["y"]) for k in range(6)] + [(2, k, ["x"] if k < 2 else ["y"]) for k in range(5)], "q int, d int, s array<string>")
    got = retrieval.in_scope(rows, "q", F.col("s"), F.lit("x")).groupBy("q").agg(F.count("*").alias("n"), F.first("relaxed").alias("r"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, False), (2, 5, True)]


def test_nearest_rank(spark):
    rows = spark.range(10).withColumn("g", F.lit(1))
    assert rows.agg(evaluation.nearest_rank(F.col("id"), 0.5).alias("p50")).first().p50 == 5
    assert evaluation.nearest_ranks(rows, ["g"], "id", {"p50": 0.5, "p95": 0.95}).first().asDict() == {"g": 1, "n": 10, "p50": 5, "p95": 9}


def test_json_lines_and_upsert(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid": "1", "n": 2}\nbroken\n\n{"qid": "2", "n": 3}\n')
    schema = T.StructType([T.StructField("qid", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = tables.json_lines(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(tuple(r) for r in good.collect()) == [("1", 2), ("2", 3)] and [r.value for r in bad.collect()] == ["broken"]
    changed = spark.createDataFrame([("2", 9), ("3", 1)], schema)
    assert sorted(tuple(r) for r in tables.upsert(good, changed, "qid").collect()) == [("1", 2), ("2", 9), ("3", 1)]
    (tmp_path / "m.md").write_text("---\ntitle: T: x\ndoc_id: A\n---\nbody\n")
    row = tables.front_matter(spark, str(tmp_path / "m.md")).first()
    assert row.meta == {"title": "T: x", "doc_id": "A"} and row.body == "body\n"


def test_field_reader_in_any_pieces():
    body = json.dumps({"tier": "A", "answer": 'He said "hi"\n\\ é 한 \U0001f600', "z": 1})
    for size in range(1, len(body) + 1):
        r = events.FieldReader("answer")
        assert "".join(r.feed(body[k : k + size]) for k in range(0, len(body), size)) == json.loads(body)["answer"]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    counted = events.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour")
    events.drained(counted, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in events.windowed_counts(source, "ts", "event_type", "1 day").collect()}
    # The last window stays open until the watermark passes it.
    last = max(r[0] for r in want)
    assert {r for r in want if r[0] < last} <= got <= want


def test_context_whole_texts(spark):
    """The blocks hold every text to its end."""
    from groundwork.plans import answer_queries, catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want: dict = {}
    for r in sorted(answer_queries.hybrid_rrf(spark, sf).collect(), key=lambda r: (r.item_id, r.position)):
        d = texts[r.doc_id]
        want.setdefault(r.item_id, []).append(f"[{r.position}] {d.source}\n{d.text}")
    assert any(len(t) > 2000 for many in want.values() for t in many)
    got = {r.item_id: r.block for r in catalogue.queries()["q_context_whole"](spark, sf).collect()}
    assert got == {k: hashlib.sha256("\n\n".join(v).encode()).hexdigest() for k, v in want.items()}


def test_dense_with_vectors_of_several_lengths(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [1.0, 0.0, 0.0], 4: [0.0, 1.0, 1.0], 5: None, 6: [], 7: [0.0, 0.0], 8: [1.0, None], 9: [float("inf"), 1.0], 10: [2.0], 11: [0.0, 3.0]}
    rows = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").coalesce(1)
    got = {(r.q, r.id): r.score for r in retrieval.dense(rows.withColumnRenamed("id", "q"), rows, "q", "id", "v").collect()}
    half = round(0.5**0.5, 6)
    pairs = {(1, 2): half, (1, 11): 0.0, (2, 11): half, (3, 4): 0.0}
    assert got == pairs | {(b, a): s for (a, b), s in pairs.items()}


def test_no_base_section(spark):
    from groundwork.operators.responses import checklist_sections

    asked = spark.createDataFrame([(1, "en", None, None), (2, "en", "E-9", "salary")], "request_id int, lang string, visa string, purpose string")
    form = "kind string, key string, status string, doc_codes array<string>, notes_ko string, notes_i18n map<string,string>, caveat_ko string, caveat_i18n map<string,string>, evidence string"
    base = [("base", None, "official", ["a"], None, None, None, None, "e"), ("foreign_registration", "E-9", "official", ["b"], None, None, None, None, "f")]
    kinds = lambda rows: sorted((r.request_id, r.place, r.status) for r in checklist_sections(asked, spark.createDataFrame(rows, form), {"ko": "?"}).collect())
    assert kinds(base) == [(1, 0, "official"), (2, 0, "official"), (2, 1, "unknown"), (2, 2, "official")]
    assert kinds(base[1:]) == [(2, 1, "unknown"), (2, 2, "official")]


def test_pairs_over_tasks(spark, monkeypatch):
    """More pairs of questions and documents are dealt over more tasks; scores and ranks stay."""
    asked = spark.createDataFrame([(q, f"w{q % 7} w{q % 5} all all") for q in range(30)], "qid long, text string")
    docs = spark.createDataFrame([(d, f"all w{d % 7} w{d % 3} v{d}") for d in range(90)], "doc_id long, text string")
    whole = sorted(retrieval.bm25(asked, docs, "qid", "doc_id", 5).collect())
    words, hit = retrieval.asked_words(asked, "qid"), retrieval.postings(docs, "doc_id")
    rows = words.join(hit, "term").count()
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    assert retrieval.pair_tasks(words, hit) == -(-rows // 100) > spark.sparkContext.defaultParallelism
    assert sorted(retrieval.bm25(asked, docs, "qid", "doc_id", 5).collect()) == whole and len(whole) == 150


def test_chunks_in_slices(spark, monkeypatch):
    """A task cuts a few texts at a time; rows, numbers and keys are those of each text alone."""
    texts = ["\n".join(f"# h{k}\n" + f"line {k} of text {d}. " * (k % 40) for k in range(10, 10 + d % 9)) if d % 11 else None for d in range(50)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(etl, "SLICE", 7)
    got = [(r.doc_id, r.seq, r.chunk_id, r.heading_path, r.body, r.char_count) for r in etl.chunks(docs, "doc_id").collect()]
    want = [(d, k, f"{d}#{k:04d}", p, b, len(b)) for d, t in enumerate(texts) for k, (p, b) in enumerate(etl.chunks_of(t or ""))]
    assert got == want and len(want) > len(texts) // 2


def test_term_counts_by_key(spark):
    """A key in two rows counts once for a word, as in the SQL's count(DISTINCT doc_id); a null key only adds occurrences."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c c d"), (2, "A"), (None, "a e"), (3, None), (4, "")], "doc_id long, text string")
    got = {tuple(r) for r in retrieval.term_counts(docs, "doc_id").collect()}
    assert got == {("a", 2, 5), ("b", 1, 1), ("c", 1, 2), ("d", 1, 1), ("e", 0, 1)}


def test_bm25_and_overlap_in_one_pass(spark):
    """BM25 as alone, and distinct words by plain counting; a document that stands twice holds each word once, as in the SQL."""
    texts = [(i, " ".join(f"w{(i * j + j * j) % 23}" for j in range(1, 4 + i % 9))) for i in range(60)] + [(60, None), (61, ""), (62, "w1 w2 w2"), (62, "w1 w2 w2")]
    asked = [(1, "w1 w2 w3 w3"), (2, "w5 w7 w11 none"), (3, "none"), (4, None)]
    docs, questions = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    words, overlap = retrieval.bm25_and_overlap(questions, docs, "item_id", "doc_id", 7)
    of = lambda df: sorted(tuple(r) for r in df.select("item_id", "doc_id", "score", "rank").collect())
    assert of(words) == of(retrieval.bm25(questions, docs, "item_id", "doc_id", 7)) and len(of(words)) == 14
    want = []
    for q, text in asked:
        held = {i: len(set((text or "").split()) & set((t or "").split())) for i, t in texts}
        best = sorted((-n, i) for i, n in held.items() if n)[:7]
        want += [(q, i, float(-n), k + 1) for k, (n, i) in enumerate(best)]
    assert of(overlap) == sorted(want)
