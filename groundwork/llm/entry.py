"""The queries of this package by name, each over its whole intended table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from groundwork.llm import substring_dedup, suffix_dedup
from groundwork.llm.chat_format import chat_digests, format_chats
from groundwork.llm.decontamination import contaminated
from groundwork.llm.language_id import predict_languages
from groundwork.llm.lm_score import scores
from groundwork.llm.near_dup import near_duplicates
from groundwork.llm.packing import pack
from groundwork.llm.source_audit import divergence
from groundwork.llm.token_alignment import align
from groundwork.llm.token_counts import token_counts
from groundwork.llm.token_records import token_records
from groundwork.llm.topk import top_k


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one, -7, whose texts are made of control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(format_chats(rows.unionByName(planted)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_records": op1_token_records,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_exact_topk": op5_exact_topk,
        "op6_near_dup": op6_near_dup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_language_id": op8_language_id,
        "op9_lm_score": op9_lm_score,
        "op10_token_counts": op10_token_counts,
        "op11_chat_format": op11_chat_format,
        "op12_token_alignment": op12_token_alignment,
        "op13_source_audit": op13_source_audit,
    }


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS a
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Bytes as pairs of hexadecimal digits; a string starts at each byte with 100 from there on.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, strlen(h) // 2 - 1)) AS i FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= strlen(h) THEN substr(h, 2 * i + 1, 200) END AS g FROM p),
r AS (SELECT doc_id, i, byte, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM c)
SELECT d.doc_id, CAST(strlen(d.h) // 2 AS BIGINT) AS n_bytes, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (edge) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id, d.h
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS g FROM p),
r AS (SELECT doc_id, i, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM s),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM c)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (edge) AS BIGINT) AS n_spans,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id, d.w
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
t AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY a) c USING (doc_id)
"""


#: The escape character goes behind the first character of a control string, and is doubled itself.
OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?(SYS|INST|ROLE)\]|SAYS\])', '\1\3\\\2\4', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
      ELSE 19 + length(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?(SYS|INST|ROLE)\]|SAYS\])', '\1\3\\\2\4', 'g')) END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(turn) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS ends
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
    AND arg_max(role, (coalesce(turn, -9223372036854775807), role, text)) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
l AS (SELECT lang, sum(n) AS n FROM c GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS own, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (s.n + 5 * v.v) AS p
  FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + CAST(1000000000 AS HUGEINT) * (sum(c.n) + 5) // (l.n + 5 * v.v) AS q
  FROM k JOIN c ON c.lang = k.lang AND c.term = k.term JOIN v ON v.lang = k.lang JOIN l ON l.lang = k.lang GROUP BY k.lang, k.term, l.n, v.v),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.own > 0 AND p.p > q.q
), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": OP2_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op6_near_dup": OP6_SQL,
        "op5_exact_topk": OP5_SQL,
        "op11_chat_format": OP11_SQL,
        "op13_source_audit": OP13_SQL,
    }
