"""Source divergence audit (operator 13): how far the sources of a language differ in their words.

Words are counted by (language, source, word) with map-side sums, a word's counts become one wide
row that holds an array over the language's sources, higher-order functions turn that row into a
contribution for each pair of sources, and map-side sums add these up. All of it is column
expressions; whole numbers and decimals alone, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwork.llm.common import settle

#: What stands between terms, which are runs of ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of its language that a kept term is in, at least; added to every count; ranks of terms.
LEAST, ADDED, RANKS = 30, 5, 50
#: Parts over which a language's terms are dealt when they meet its one row of sources.
SALTS = 64


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def wide_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, counts (structs of source and n, n > 0) of terms in at least `least` documents of their language.

    A document goes through twice as arrays, all its terms and its different terms; both are
    summed where they are read, so what is shuffled has a row for each (language, source, term)
    and task, however often a word or source occurs.
    """
    terms = F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN), "")
    both = _plain(docs).select("lang", "source", terms.alias("all")).select("lang", "source", F.posexplode(F.array("all", F.array_distinct("all"))).alias("kind", "terms"))
    each = both.select("lang", "source", "kind", F.explode("terms").alias("term"))
    counts = each.groupBy("lang", "term", "source").agg(F.sum(1 - F.col("kind")).alias("n"), F.sum("kind").alias("docs"))
    return (
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .where(F.col("docs") >= least).select("lang", "term", "counts")
    )


def language_sources(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each language: v (kept terms), n (their occurrences), sources (structs of source and n, by name), all that occur."""
    groups = _plain(docs).select("lang", "source").distinct()
    sums = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    full = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rows = full.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("n"))
    return rows.join(kept, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), "n", "sources")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + ADDED) / (total + ADDED v)), exact for counts up to 10^18."""
    below = (total + ADDED * v).cast("decimal(19,0)")
    above = (F.lit(1_000_000_000).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")).cast("decimal(30,0)")
    return F.call_function("div", above, below) + 1


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: for each source of a language its distance to every
    other one (part `pair`) and the `ranks` terms that it has most above the language (part `term`).

    A null text, lang or source is empty; repeated rows and ids are documents of their own; an empty
    table gives an empty result; other columns are not read. A group without terms, or whose
    language keeps none, has its pairs, with value 0 if the language keeps none. Equal values rank
    by item in UTF-8 order. A row holds an array over its language's sources, never their pairs.
    """
    terms = settle(wide_terms(docs, least), "terms")
    languages = settle(language_sources(docs, terms), "languages")
    met = terms.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(_salted(languages), ["lang", "salt"])
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])

    def at(s: Column) -> Column:
        own = F.coalesce(F.try_element_at(F.col("by"), s["source"]), F.lit(0).cast("long"))
        return F.struct(s["source"].alias("source"), own.alias("own"), share(own, s["n"], F.col("v")).alias("p"))

    shares = met.select("lang", "term", "v", "sources", F.map_from_entries("counts").alias("by"), share(total, F.col("n"), F.col("v")).alias("q"))
    wide = shares.select("lang", "term", "q", F.transform("sources", at).alias("at"))
    return _pairs(wide, languages).unionByName(_terms(wide, ranks))


def _salted(languages: DataFrame) -> DataFrame:
    """A language's terms or pairs may be nearly all rows: they are dealt over salts, its row of sources is copied to each."""
    return languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _pairs(wide: DataFrame, languages: DataFrame) -> DataFrame:
    """Part `pair`; a language that keeps no term gives its sources a row of equal shares.

    Sources go by their places in the language's array until all is summed up.
    """
    at = wide.select("lang", F.transform("at", lambda x: x["p"]).alias("p"))
    none = languages.select("lang", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("p"))
    one = at.unionByName(none).select("lang", "p", F.posexplode("p").alias("i", "own"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))
    sums = one.select("lang", "i", F.posexplode(later).alias("k", "f")).groupBy("lang", "i", "k").agg(F.sum("f").alias("value"))
    names = sums.withColumn("salt", F.pmod(F.hash("i", "k"), F.lit(SALTS))).join(_salted(languages), ["lang", "salt"])
    ends = names.select("lang", "value", F.get("sources", F.col("i"))["source"].alias("source"), F.get("sources", F.col("i") + 1 + F.col("k"))["source"].alias("other"))
    both = ends.select("lang", "value", F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x"))
    return _ranked(both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def _terms(wide: DataFrame, ranks: int) -> DataFrame:
    """Part `term`."""
    above = F.filter("at", lambda x: (x["own"] > 0) & (x["p"] > F.col("q")))
    each = wide.select("lang", "term", "q", F.explode(above).alias("x"))
    found = each.select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))
    return _ranked(found).where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
