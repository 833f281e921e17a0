import re
from collections import Counter, defaultdict

from groundwork.llm.source_audit import divergence


def audit(rows, least, ranks):
    """Written out over plain dictionaries."""
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    held, counts, sources = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        sources[lang].add(source)
        held.update((lang, t) for t in set(terms))
    kept = {k for k, n in held.items() if n >= least}
    for lang, source, terms in docs:
        for t in terms:
            if (lang, t) in kept:
                counts[lang, source][t] += 1
    out = []
    for lang, names in sources.items():
        words = [t for x, t in kept if x == lang]
        whole = sum((counts[lang, s] for s in names), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(words)) for t in words} for s, c in [*((s, counts[lang, s]) for s in names), (None, whole)]}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in words), o) for o in names if o != s]
            terms = [(p[None][t] - p[s][t], t) for t in words if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out)


def check(spark, rows, least=2, ranks=3):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "text string, lang string, source string, term string, n int")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence(df, least, ranks).collect())
    assert got == audit(rows, least, ranks)
    return got


def test_odd_rows(spark):
    rows = [
        ("a b A ab-b é É ß", "en", "s1"), ("b b c é", "en", "s2"), ("a c", "en", None), (None, "en", "s1"), ("", None, None), ("b ж日本 b", None, "s2"), ("日本ж", "", ""),
        ("b b b", "xx", "s1"), (None, "yy", "s1"), (" 12 ", "yy", "s2"), ("q", "yy", "😀"), ("w", "zz", "only"), ("w", "zz", "only"), ("w " * 3000 + "a", "en", "s3"), ("w", "en", "s2"),
    ]
    got = check(spark, rows)
    assert [r[4] for r in got if r[0] == "yy"] == [0] * 6


def test_one_source_holds_most(spark):
    rows = [(f"the w{'abcdefgh'[k % 8]} of w{'xyz'[k % 3]}", "en", "big" if k % 3 else f"s{k % 7}") for k in range(600)]
    check(spark, rows, least=30, ranks=50)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = audit([tuple(r) for r in docs.select("text", "lang", "source").collect()], 30, 50)
    assert sorted(map(tuple, divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())) == want


def test_empty(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    from groundwork.llm.source_audit import share

    n, total, v = 987_654_321_987_654, 999_999_999_999_999_999, 123_456_789
    row = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(v).cast("long")).alias("p"), share(F.lit(total), F.lit(total), F.lit(1).cast("long")).alias("one")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v) and row.one == 1 + 10**9


def test_no_python(spark):
    plan = divergence(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
