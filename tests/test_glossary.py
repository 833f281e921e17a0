"""The automaton over a glossary against the fold over its surfaces, in Spark and in plain Python."""

import random

import pytest
from groundwork.functions import text as T
from groundwork.operators import glossary as G
from pyspark.sql import functions as F


def folded(text, entries):
    rest, hits = text, []
    for surface, term in entries:
        if surface in rest:
            rest = rest.replace(surface, " ")
            hits += [] if term in hits else [term]
    return hits


def entries_of(rng, n, letters, longest):
    words = {"".join(rng.choices(letters, k=rng.randrange(3, longest + 1))) for _ in range(n)}
    return [(w, f"t{rng.randrange(n // 2)}") for w in sorted(words, key=lambda w: (-len(w), w))]


@pytest.mark.parametrize("letters", ["ab ", "abc", "가나 b"])
def test_against_the_fold(letters):
    rng = random.Random(letters)
    for _ in range(60):
        entries = entries_of(rng, 40, letters, 6)
        finder = G.Finder(entries)
        for _ in range(20):
            text = "".join(rng.choices(letters, k=rng.randrange(60)))
            assert finder.hits(text) == folded(text, entries), (text, entries)


def test_blanked_span_makes_a_surface():
    entries = [("abcdef", "long"), ("x y", "spaced"), ("cde", "inner")]
    assert G.Finder(entries).hits("xabcdefy cde") == ["long", "spaced", "inner"]
    assert G.Finder([]).hits("abc") == []


def test_many_surfaces():
    """A text's time does not follow the number of surfaces: 100,000 of them, held against those that stand in it."""
    rng = random.Random(5)
    entries = entries_of(rng, 100_000, "abcdefghij", 9)
    finder = G.Finder(entries)
    text = " ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(200))
    assert finder.hits(text) == folded(text, entries)
    assert len(finder.hits(text)) > 20


def test_in_spark(spark, monkeypatch):
    terms = spark.createDataFrame([(1, "대한민국", ["Korea", "Republic of Korea"]), (2, "한국", ["KOR", "of"]), (3, "베트남", ["Viet Nam", "Nam"])], "ord int, ko string, labels array<string>")
    surfaces = T.surfaces(terms.withColumn("code", F.lit("x")), "code", "ko", F.col("labels"), "ord")
    texts = ["From the REPUBLIC OF KOREA to Viet Nam", "Nam, Korea", "대한민국", "", None, "none", "Nam " * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, surfaces string")
    got = [G.with_hits(rows, "surfaces", surfaces).orderBy("id").collect()]
    monkeypatch.setattr(G, "MOST_BYTES", 0)
    got.append(G.with_hits(rows, "surfaces", surfaces).orderBy("id").collect())
    assert got[0] == got[1]
    assert [r.hits for r in got[0]] == [["대한민국", "베트남"], ["대한민국", "베트남"], ["대한민국"], [], [], [], ["베트남"]]


def test_no_glossary(spark):
    none = spark.createDataFrame([], "ord int, ko string, labels array<string>")
    surfaces = T.surfaces(none.withColumn("code", F.lit("x")), "code", "ko", F.col("labels"), "ord")
    rows = spark.createDataFrame([(1, "abc")], "id int, q string")
    assert [r.hits for r in G.with_hits(rows, "q", surfaces).collect()] == [[]]
    assert G.with_hits(rows.limit(0), "q", surfaces).count() == 0
