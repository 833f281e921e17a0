"""Look-ups and rankings over small catalogues, where what is unknown is not zero; the decision cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T

# Weights and status scores of the fit.
W_VISA, W_DOCS, W_CHANNEL = 0.5, 0.3, 0.2
W_LANGUAGE, W_REMOTE, W_BRANCH = 0.5, 0.3, 0.2
STATUS_SCORE = {"official": 1.0, "inferred": 0.6, "unknown": 0.0}


def weighted_mean(terms: list[tuple[float, Column]]) -> Column:
    """Mean of the terms that are known, by weight; null if none is."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in terms), F.lit(0.0))
    earned = sum((F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in terms), F.lit(0.0))
    return F.when(total > 0, earned / total)


def fit_score(row: dict[str, Column], max_docs: Column) -> Column:
    """Score of an institution: visa status (always counts), burden of documents and access where known.

    row: status, n_docs, has_language, has_remote, n_branches; a null stands for unknown.
    """
    access = weighted_mean([(W_LANGUAGE, row["has_language"].cast("double")), (W_REMOTE, row["has_remote"].cast("double")), (W_BRANCH, (row["n_branches"] > 0).cast("double"))])
    burden = F.when(row["status"] != "unknown", F.when(max_docs <= 0, 1.0).otherwise(1 - row["n_docs"] / max_docs))
    visa = F.coalesce(F.create_map(*(F.lit(x) for p in STATUS_SCORE.items() for x in p))[row["status"]], F.lit(0.0))
    return F.round(weighted_mean([(W_VISA, visa), (W_DOCS, burden), (W_CHANNEL, access)]), 4)


def product_cards(base: DataFrame, options: DataFrame, keys: list[str], rate: str, best: str, term: int | None, descending: bool) -> DataFrame:
    """Products with their options (nested, ordered), lowest rate and highest best rate; products without
    an option go. Ordered by `best` or `rate`, unknown last, ties by key."""
    kept = options if term is None else options.where(F.col("save_trm") == term)
    nested = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("save_trm", rate, best))).alias("options"), F.count("*").alias("n_options"), F.min(rate).alias("rate_min"), F.max(best).alias("rate_max"),
    )
    order = F.col("rate_max").desc_nulls_last() if descending else F.col("rate_min").asc_nulls_last()
    return base.join(nested, keys).orderBy(order, *keys)


def labelled(rows: DataFrame, code: str, glossary: DataFrame, label: str) -> DataFrame:
    """rows with the code's label; a code without one is its own label."""
    return rows.join(glossary.select(code, label), code, "left").withColumn(label, F.coalesce(label, F.col(code).cast("string")))


def localized(values: Column, lang: Column, fallback: Column) -> Column:
    """The text in a language if there is one, else the fallback."""
    return F.coalesce(F.nullif(F.trim(F.try_element_at(values, lang)), F.lit("")), fallback)


def merged_evidence(rows: DataFrame, owner: str, key: str, priority: str, order: str) -> DataFrame:
    """One row for each (owner, key): the values of the highest priority, at the place first seen."""
    rest = [c for c in rows.columns if c not in (owner, key)]
    return rows.groupBy(owner, key).agg(F.max_by(F.struct(*rest), F.struct(priority, order)).alias("v"), F.min(order).alias("place")).select(owner, key, "place", *(F.col(f"v.{c}").alias(c) for c in rest if c != order))


def limit_check(limit: Column, used: Column, amount: Column) -> tuple[Column, Column]:
    """(remaining, exceeds): both unknown where the limit or what is used of it is."""
    return F.greatest(limit - used, F.lit(0.0)) + F.lit(0.0) * limit * used, used + amount > limit


def latest_quote(quotes: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    return quotes.groupBy(*by).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def decision(answer: DataFrame) -> DataFrame:
    """outcome and tier of generated answers: checks in a fixed order, the first that fails decides.

    Columns: out_of_scope, tier, citations (array of refs), n_refs, unsupported (array), answer,
    lang, all_government, has_stale, needs_confirmation.
    """
    c = F.col
    phantom = F.size(F.array_except("citations", F.when(c("n_refs") > 0, F.sequence(F.lit(1), c("n_refs"))).otherwise(F.array().cast("array<int>")))) > 0
    outcome = (
        F.when(c("tier") == "C", "tier_c").when(c("out_of_scope"), "out_of_scope")
        .when(F.size("citations") == 0, "no_citation").when(phantom, "phantom_citation")
        .when(F.size("unsupported") > 0, "unsupported_number")
        .when(T.first_hit(c("answer"), T.FORBIDDEN).isNotNull(), "forbidden_expression")
        .when(T.first_hit(c("answer"), T.CREDENTIALS).isNotNull(), "credential_request")
        .when(T.in_language(c("answer"), c("lang")).eqNullSafe(F.lit(False)), "language_mismatch")
    )
    weaker = ~c("all_government") | c("has_stale") | c("needs_confirmation")
    final = F.when(outcome.isNotNull(), "C").when((c("tier") == "A") & weaker, "B").otherwise(c("tier"))
    return answer.withColumn("fallback_reason", outcome).withColumn("final_tier", final).withColumn("downgraded_from", F.when(outcome.isNull() & (final != c("tier")), c("tier")))


def with_notice(answer: Column, notice: Column) -> Column:
    """The answer with the notice at its end, once."""
    return F.when(answer.contains(notice), answer).otherwise(F.concat(F.rtrim(answer), F.lit("\n\n"), notice))


def first_in_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
