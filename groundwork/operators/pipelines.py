"""Chains of operators: pages to clean documents, questions to decided answers, a golden set to its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import numerals as N
from groundwork.functions import text as T
from groundwork.operators import etl
from groundwork.operators import evaluation as E
from groundwork.operators import retrieval as R
from groundwork.operators import rules as U

# Least body of a document, intents that are told as what they are.
LEAST_BODY, OWN_REASON = 400, ("scam_verdict",)


def cleaned(docs: DataFrame, previous: DataFrame, key: str, host: str) -> DataFrame:
    """(key, host, text, n_removed, sha256, status, n_empty): extracted documents cleaned in two phases.

    All documents of a host are looked at for its menu lines before any is cleaned; then menus,
    repeated lines and blocks go. status is held against an earlier snapshot of cleaned texts
    (key, text), n_empty counts table columns that lost their content.
    """
    body = etl.strip_nav(docs, etl.nav_lines(docs, key, host), key, host)
    kept = body.withColumn("kept", etl.without_repeated_blocks("text")).select(key, (F.length("text") - F.length("kept")).alias("n_removed"), F.col("kept").alias("text"))
    holes = etl.empty_columns(kept, key).groupBy(key).agg(F.count("*").alias("n_empty"))
    out = kept.join(etl.status(kept, previous, key, LEAST_BODY), key).join(holes, key, "left").join(docs.select(key, host), key)
    return out.select(key, host, "text", "n_removed", "sha256", "status", F.coalesce("n_empty", F.lit(0)).alias("n_empty"))


def told(intent: Column) -> Column:
    return F.when(intent.isin(*OWN_REASON), intent).when(intent.isNotNull(), "tier_c")


def guarded(questions: DataFrame, query: str, table: Column | None) -> DataFrame:
    """questions (query, lang, visa, message, translated) with clean, terms, via, wanted and the reason that stops them before any search.

    Questions are dealt out by their key between the steps: so a step reads the columns of the one
    before it, where Catalyst would else put every pattern's whole expression into the next one's.
    """
    masked, _ = T.mask_pii(F.col("message"))
    rows = questions.withColumn("masked", masked).repartition(query)
    clean, hits = T.neutralise(F.col("masked"))
    rows = rows.withColumns({"clean": clean, "hits": hits}).withColumn("surfaces", F.array().cast("array<struct<surface: string, ko: string>>") if table is None else table).repartition(query)
    rows = rows.withColumn("terms_hit", T.glossary_hits(F.col("clean"), F.col("surfaces"))).withColumn("intent", T.intent(F.col("clean"))).repartition(query)
    rows = rows.withColumn("n", T.normalised(F.col("clean"), F.col("lang"), F.col("visa"), F.col("terms_hit"), F.col("translated"))).repartition(query)
    early = F.when(T.blocked(F.col("message"), F.col("clean"), F.col("hits")), "injection_blocked").otherwise(told(F.col("intent")))
    late = F.when(F.col("n.via") != "passthrough", told(T.intent(F.col("n.terms"))))
    stopped = F.coalesce(early, late)
    return rows.select(*questions.columns, "clean", F.col("n.terms").alias("text"), F.col("n.via").alias("via"), F.col("n.code").alias("wanted"), stopped.alias("stopped")).repartition(query)


def question_run(questions: DataFrame, docs: DataFrame, vectors: DataFrame, generated: DataFrame, query: str, key: str, today: Column, table: Column | None = None) -> DataFrame:
    """One row for each question: its tier, the reason if it fell back, and what was retrieved.

    Input guard, intent rules, normalisation, rules again on normalised terms, hybrid search in
    scope, confidence gate, context, the generated answer (query, answer, tier, citations,
    numbers_used, out_of_scope, needs_confirmation; none: upstream_error), then the decision
    cascade. A question that one step stops is not looked at by the next ones. What is known of the
    questions and the few rows selected for each are kept in the executors' storage, as several steps read them.
    docs: key, text, title, publisher_type, verified_at, scope; vectors: key, embedding.
    """
    rows = guarded(questions, query, table).persist()
    best = R.hybrid(rows.where("stopped is null").select(query, "text", "embedding", "wanted"), docs, vectors, query, key, scoped=True).persist()
    top = best.groupBy(query).agg(F.first("top1").alias("top1"), F.first("margin").alias("margin"), F.first("relaxed").alias("relaxed"), F.transform(F.array_sort(F.collect_list(F.struct("position", key))), lambda x: x[key]).alias("retrieved"))
    seen = best.join(docs.drop("scope"), key)
    context = R.context(seen, query, today)
    rows = rows.join(top, query, "left").join(context, query, "left").join(generated, query, "left")
    passed = R.gate(rows, "lang", "top1")
    stopped = F.coalesce("stopped", F.when(~passed, "low_confidence"), F.when(F.col("tier").isNull(), "upstream_error"))
    rows = rows.withColumn("stopped", stopped)
    rows = rows.withColumns({"numbers": F.coalesce("numbers_used", F.array().cast("array<string>")), "evidence": N.numerals_of(F.coalesce("block", F.lit("")))})
    rows = rows.withColumn("unsupported", N.unsupported_of("numbers", "evidence", "block"))
    rows = rows.withColumns({"n_refs": F.coalesce("n_refs", F.lit(0)).cast("int"), "citations": F.coalesce("citations", F.array().cast("array<int>")), "tier": F.coalesce("tier", F.lit("C"))})
    out = U.decision(rows.repartition(query))
    reason = F.coalesce("stopped", "fallback_reason")
    shown = F.coalesce(F.round("top1", 6), F.lit(0.0))
    return out.select(
        query, "lang", "via", reason.alias("fallback_reason"), F.when(reason.isNotNull(), "C").otherwise(F.col("final_tier")).alias("tier"), F.when(reason.isNull(), F.col("downgraded_from")).alias("downgraded_from"), shown.alias("top1"),
        F.col("n_refs"), F.coalesce("retrieved", F.array().cast("array<long>")).alias("retrieved"), F.coalesce("relaxed", F.lit(False)).alias("relaxed"), "unsupported", "answer",
    )


def scoring_run(run: DataFrame, golden: DataFrame, query: str, by: list[str]) -> DataFrame:
    """The metrics of a run of questions over a golden set (query, should_fallback, expected_fallback, gold, expected_tier), over all rows and by group."""
    rows = run.drop("lang").join(golden, query).withColumns({"error": F.lit(None).cast("string"), "latency_ms": F.lit(0), "retrieved": F.transform("retrieved", lambda x: F.concat(x.cast("string"), F.lit("#0000")))})
    return E.scored(rows, [[], *([c] for c in by)])
