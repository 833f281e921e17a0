"""Queries over evaluation runs: facts, languages, tokens, traps, reports and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.text import upper
from groundwork.operators import evaluation as E
from groundwork.plans.answer_queries import OUTCOMES, METRICS_SQL, outcomes
from groundwork.plans.service_queries import picked
from groundwork.sources.tables import table


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes with their answers: the conversation turns and documents of the run's questions."""
    d = F.col("doc_id")
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"))
    rows = outcomes(spark, sf).join(texts, "doc_id")
    return rows.select(
        "*", d.alias("qid"), F.array(upper(F.substring("answer", 3, 5)), F.lit("no such fact"), F.substring("answer", 10, 3)).alias("gold_facts"), F.array(F.substring("answer", 1, 4), F.lit(""), F.lit("ZZZZ"), upper(F.substring("answer", 2, 6))).alias("forbidden_facts"),
        (d % 5 != 0).alias("generated"), (d % 7 * 100).alias("input_tokens"), (d % 11).alias("output_tokens"), (d % 3).alias("cache_read_tokens"), (d % 4).alias("cache_write_tokens"), (d % 13 == 0).alias("llm_fallback_used"),
        picked(["small", "large", ""], d).alias("model"), picked(["tier_c_trap", "no_evidence", "limits"], d).alias("category"), F.when(d % 10 != 0, d % 2 == 0).alias("evades"),
    )


ANSWERS = f"""{OUTCOMES},
x AS (SELECT o.*, text, d % 5 <> 0 AS gen, d % 7 * 100 AS tin, d % 11 AS tout, d % 3 AS cread, d % 4 AS cwrite, d % 13 = 0 AS fb, ['small', 'large', ''][d % 3 + 1] AS model, ['tier_c_trap', 'no_evidence', 'limits'][d % 3 + 1] AS category, CASE WHEN d % 10 <> 0 THEN d % 2 = 0 END AS evades
  FROM o JOIN documents ON doc_id = d)
"""


def reason_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.reason_histogram(outcomes(spark, sf))


REASON_HISTOGRAM = f"WITH {OUTCOMES} SELECT reason, count(*) AS n FROM o WHERE ok AND NOT trap AND reason IS NOT NULL GROUP BY 1"


def fact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.fact_coverage(answers(spark, sf), ["lang"])


FACT_COVERAGE = f"""
WITH {ANSWERS}, f AS (SELECT d, lang, text, unnest([upper(substr(text, 3, 5)), 'no such fact', substr(text, 10, 3)]) AS fact FROM x WHERE ok AND reason IS NULL),
q AS (SELECT d, lang, count(*) FILTER (contains(lower(text), lower(fact))) / 3.0 AS share FROM f GROUP BY 1, 2)
SELECT lang, round(100 * avg(share), 1) AS coverage, count(*) AS of FROM q GROUP BY 1
"""


def forbidden_hits(spark: SparkSession, sf: str) -> DataFrame:
    return E.forbidden_hits(answers(spark, sf)).select("hits", F.array_join("items", "|").alias("items"))


FORBIDDEN_HITS = f"""
WITH {ANSWERS}, f AS (SELECT d, text, unnest(l) AS fact, generate_subscripts(l, 1) AS pos FROM (SELECT d, text, [substr(text, 1, 4), '', 'ZZZZ', upper(substr(text, 2, 6))] AS l FROM x WHERE ok)),
h AS (SELECT *, row_number() OVER (ORDER BY d, pos) AS k FROM f WHERE fact <> '' AND contains(text, fact))
SELECT count(*) AS hits, string_agg(d || ':' || fact, '|' ORDER BY k) FILTER (k <= 10) AS items FROM h
"""


def language_match(spark: SparkSession, sf: str) -> DataFrame:
    return E.language_match(answers(spark, sf), ["lang"])


LANGUAGE_MATCH = rf"""
WITH {ANSWERS}, j AS (SELECT lang, CASE WHEN lang = 'en' AND length(regexp_replace(text, '\s', '', 'g')) >= 20 THEN NOT regexp_matches(text, '[ăâđêôơưĂÂĐÊÔƠƯ]') END AS ok2 FROM x WHERE ok AND reason IS NULL)
SELECT lang, round(100.0 * count(*) FILTER (ok2) / nullif(count(ok2), 0), 1) AS matched, count(ok2) AS of FROM j GROUP BY 1
"""


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return E.token_usage(answers(spark, sf))


TOKEN_USAGE = f"""
WITH {ANSWERS} SELECT count(*) AS n_generated, round(100.0 * count(*) FILTER (cread > 0) / count(*), 1) AS cache_hit_rate, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
  CAST(sum(cread) AS BIGINT) AS cache_read_tokens, CAST(sum(cwrite) AS BIGINT) AS cache_write_tokens, count(*) FILTER (fb) AS model_fallback_used, array_to_string(list_sort(list_distinct(list(nullif(model, '')))), ',') AS models FROM x WHERE gen AND tin > 0
"""


def trap_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return E.trap_breakdown(answers(spark, sf))


TRAP_BREAKDOWN = f"""
WITH {ANSWERS} SELECT evades, round(100.0 * count(reason) / count(*), 1) AS caught, count(reason) AS hit, count(*) AS of FROM x WHERE ok AND category = 'tier_c_trap' AND evades IS NOT NULL GROUP BY 1
"""


def golden_select(spark: SparkSession, sf: str) -> DataFrame:
    return E.selected(answers(spark, sf), ["en", "fr"], ["tier_c_trap", "limits"], 40, "qid").select("qid", "lang", "category")


GOLDEN_SELECT = f"WITH {ANSWERS} SELECT d AS qid, lang, category FROM x WHERE lang IN ('en', 'fr') AND category IN ('tier_c_trap', 'limits') ORDER BY d LIMIT 40"


def mixed_systems(spark: SparkSession, sf: str) -> DataFrame:
    return E.mixed_systems(answers(spark, sf).withColumn("device", F.lit("cpu")), ["model", "device", "lang"])


MIXED_SYSTEMS = f"""
WITH {ANSWERS}
SELECT 'model' AS "column", string_agg(DISTINCT model, ',' ORDER BY model) AS "values" FROM x UNION ALL SELECT 'lang', string_agg(DISTINCT lang, ',' ORDER BY lang) FROM x
"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    return E.failures(answers(spark, sf))


FAILURES = f"""
WITH {ANSWERS}, h AS (SELECT d AS qid, CASE WHEN NOT ok THEN 'error' WHEN trap AND reason IS NULL THEN 'trap_answered' WHEN NOT trap AND reason IS NOT NULL THEN 'blocked' WHEN trap AND want IS NOT NULL AND want <> reason THEN 'wrong_reason' END AS how FROM x)
SELECT qid, how FROM h WHERE how IS NOT NULL ORDER BY qid LIMIT 10
"""


def progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).where("doc_id % 3 <> 0").withColumn("finished_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("qid") * 7))
    return E.progress(rows, 1000)


PROGRESS = f"""
WITH {ANSWERS}, p AS (SELECT * FROM x WHERE d % 3 <> 0), m AS (SELECT count(*) AS done, round(count(*) / ((max(d) - min(d)) * 7 / 60.0), 2) AS per_minute FROM p)
SELECT done, 1000 - done AS left, per_minute, round((1000 - done) / per_minute, 1) AS minutes_left,
  (SELECT string_agg(k || '=' || n, ' ' ORDER BY k) FROM (SELECT coalesce(lang, 'none') AS k, count(*) AS n FROM p GROUP BY 1)) AS by_lang,
  (SELECT string_agg(k || '=' || n, ' ' ORDER BY k) FROM (SELECT coalesce(reason, 'none') AS k, count(*) AS n FROM p GROUP BY 1)) AS by_fallback_reason FROM m
"""


def summary_line(spark: SparkSession, sf: str) -> DataFrame:
    return E.scored(outcomes(spark, sf), [["lang"]]).select("lang", E.summary_line().alias("line"))


SUMMARY_LINE = f"""
WITH {OUTCOMES}, m AS (SELECT lang, {METRICS_SQL} FROM o GROUP BY lang)
SELECT lang, concat_ws(' · ', {', '.join(f"'{label} ' || coalesce(regexp_replace(CAST({c} AS VARCHAR), '[.]0$', ''), '—') || '%'" for label, c in (('cited', 'citation_rate'), ('recall@5', 'recall_at_5'), ('fallback', 'fallback_accuracy'), ('over', 'over_fallback'), ('numbers', 'number_accuracy'), ('tier', 'tier_match')))}) AS line FROM m
"""


def uncalibrated(spark: SparkSession, sf: str) -> DataFrame:
    return E.uncalibrated(outcomes(spark, sf), "lang", ["en", "vi"]).select(F.array_join("missing", ",").alias("missing"))


UNCALIBRATED = f"WITH {OUTCOMES} SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) AS missing FROM o WHERE lang NOT IN ('en', 'vi')"


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Five reports: the run's questions in five parts, one of them without a measured recall."""
    parts = outcomes(spark, sf).withColumn("part", (F.col("doc_id") % 5).cast("int"))
    scored = E.scored(parts, [["part"]])
    return scored.select(F.col("part").alias("ord"), F.concat(F.lit("exp_"), "part").alias("name"), F.when(F.col("part") != 4, F.col("recall_at_5")).alias("recall_at_5"), "over_fallback")


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    return E.metric_series(_reports(spark, sf), ["recall_at_5", "over_fallback"])


METRIC_SERIES = f"""
WITH {OUTCOMES}, r AS (SELECT CAST(d % 5 AS INTEGER) AS ord, {METRICS_SQL} FROM o GROUP BY 1),
l AS (SELECT ord, 'recall_at_5' AS metric, CASE WHEN ord <> 4 THEN recall_at_5 END AS value FROM r UNION ALL SELECT ord, 'over_fallback', over_fallback FROM r)
SELECT metric, ord, 'exp_' || ord AS name, value, coalesce(ord = max(ord) FILTER (value IS NOT NULL) OVER (PARTITION BY metric), false) AS is_last FROM l
"""


def language_matrix(spark: SparkSession, sf: str) -> DataFrame:
    parts = outcomes(spark, sf).withColumn("part", F.concat(F.lit("exp_"), F.col("doc_id") % 2))
    return E.pivoted(E.scored(parts, [["lang", "part"]]), "lang", "part", ["exp_0", "exp_1", "exp_2"], "recall_at_5")


LANGUAGE_MATRIX = f"""
WITH {OUTCOMES}, r AS (SELECT lang, d % 2 AS part, {METRICS_SQL} FROM o GROUP BY 1, 2)
SELECT lang, max(recall_at_5) FILTER (part = 0) AS exp_0, max(recall_at_5) FILTER (part = 1) AS exp_1, CAST(NULL AS DOUBLE) AS exp_2 FROM r GROUP BY 1
"""


def reason_matrix(spark: SparkSession, sf: str) -> DataFrame:
    over = outcomes(spark, sf).where("error is null and not should_fallback and fallback_reason is not null")
    counts = over.groupBy("fallback_reason", F.concat(F.lit("exp_"), F.col("doc_id") % 3).alias("part")).agg(F.count("*").alias("n"))
    return E.pivoted(counts, "fallback_reason", "part", ["exp_0", "exp_1", "exp_2"], "n")


REASON_MATRIX = f"""
WITH {OUTCOMES}, c AS (SELECT reason AS fallback_reason, d % 3 AS part, count(*) AS n FROM o WHERE ok AND NOT trap AND reason IS NOT NULL GROUP BY 1, 2)
SELECT fallback_reason, max(n) FILTER (part = 0) AS exp_0, max(n) FILTER (part = 1) AS exp_1, max(n) FILTER (part = 2) AS exp_2 FROM c GROUP BY 1
"""


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    return E.distribution(outcomes(spark, sf), ["lang", "should_fallback"], "top1", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


DISTRIBUTION = f"""
WITH {OUTCOMES}, r AS (SELECT lang, trap, top1, row_number() OVER (PARTITION BY lang, trap ORDER BY top1) - 1 AS k, count(*) OVER (PARTITION BY lang, trap) AS n FROM o)
SELECT lang, trap AS should_fallback, max(n) AS n, max(top1) FILTER (k = floor(n * 0.25)) AS q1, max(top1) FILTER (k = floor(n * 0.5)) AS q2, max(top1) FILTER (k = floor(n * 0.75)) AS q3 FROM r GROUP BY 1, 2
"""

QUERIES = {
    "q_reason_histogram": (reason_histogram, REASON_HISTOGRAM), "q_fact_coverage": (fact_coverage, FACT_COVERAGE), "q_forbidden_hits": (forbidden_hits, FORBIDDEN_HITS), "q_language_match": (language_match, LANGUAGE_MATCH),
    "q_token_usage": (token_usage, TOKEN_USAGE), "q_trap_breakdown": (trap_breakdown, TRAP_BREAKDOWN), "q_golden_select": (golden_select, GOLDEN_SELECT), "q_mixed_systems": (mixed_systems, MIXED_SYSTEMS), "q_failures": (failures, FAILURES),
    "q_progress": (progress, PROGRESS), "q_summary_line": (summary_line, SUMMARY_LINE), "q_uncalibrated": (uncalibrated, UNCALIBRATED), "q_metric_series": (metric_series, METRIC_SERIES), "q_language_matrix": (language_matrix, LANGUAGE_MATRIX),
    "q_reason_matrix": (reason_matrix, REASON_MATRIX), "q_distribution": (distribution, DISTRIBUTION),
}
