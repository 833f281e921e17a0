"""Queries over text services and structured answers: normalisation, events, institutions, checklists, remittances, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import responses as P
from groundwork.operators.glossary import with_hits
from groundwork.sources.tables import table


def picked(items: list, k: Column) -> Column:
    """The item at place k modulo their number."""
    return F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))


def lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("t"), T.codes(F.col("text")).alias("codes"))
    words = F.slice("t", F.lit(1), F.size("t") - F.size("codes"))
    return found.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(words, " ")).alias("words"), F.array_join(F.array_sort("codes"), " ").alias("codes"))


LEXICAL_TOKENS = r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(t, '(^|[^A-Za-z0-9])[A-Ha-h](--)?[0-9]{1,2}($|[^0-9])', '\1 \3', 'g')), '[\p{L}\p{N}]+') AS w,
  list_distinct(list_transform(regexp_extract_all(t, '(^|[^A-Za-z0-9])([A-Ha-h](--)?[0-9]{1,2})($|[^0-9])', 2), lambda x: upper(replace(x, '-', '')))) AS c FROM d)
SELECT doc_id, CAST(len(w) + len(c) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS words, array_to_string(list_sort(c), ' ') AS codes FROM w
"""


def _glossary(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary of the nations and regions: the region's name is also a label of each of its nations' shorter forms."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.concat(F.lit("국가"), F.col("n_nationkey")).alias("ko"), F.create_map(F.lit("en"), F.col("n_name"), F.lit("vi"), F.substring_index("n_name", " ", 1)).alias("labels"), F.lit("term").alias("category"))
    region = table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("ord"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("code"), F.concat(F.lit("지역"), F.col("r_regionkey")).alias("ko"), F.create_map(F.lit("en"), F.col("r_name"), F.lit("vi"), F.lit("")).alias("labels"), F.lit("visa").alias("category"))
    return nation.unionByName(region)


def _surfaces(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.filter(F.array(F.try_element_at("labels", F.lit("en")), F.try_element_at("labels", F.lit("vi"))), lambda x: x != "")
    return T.surfaces(_glossary(spark, sf), "code", "ko", labels, "ord")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name a customer's nation and another, with codes here and there."""
    nation = table(spark, sf, "nation")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7) % 25).cast("int").alias("other"))
    c = c.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("one")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("two")), "other")
    k = F.col("c_custkey")
    text = F.concat(F.lit("Send from "), "one", F.when(k % 3 == 0, F.concat(F.lit(" to "), "two")).otherwise(""), F.when(k % 5 == 0, " with E-9").otherwise(""), F.when(k % 4 == 0, " Asia").otherwise(""))
    return c.select("c_custkey", F.when(k % 7 == 0, "ko").otherwise("vi").alias("lang"), F.when(k % 2 == 0, "D-2").alias("visa"), text.alias("query"), F.when(k % 6 == 1, F.concat(F.lit("송금 "), k.cast("string"))).alias("translated"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return with_hits(_asked(spark, sf), "query", _surfaces(spark, sf))


def glossary_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("c_custkey", F.array_join("hits", ",").alias("hits"))


HITS_CTE = """
t AS (SELECT n_nationkey AS ord, '국가' || n_nationkey AS ko, ['국가' || n_nationkey, n_name, split_part(n_name, ' ', 1)] AS s FROM nation UNION ALL SELECT r_regionkey + 100, '지역' || r_regionkey, ['지역' || r_regionkey, r_name] FROM region),
u AS (SELECT ord, ko, unnest(s) AS surface, generate_subscripts(s, 1) AS pos FROM t),
f AS (SELECT lower(surface) AS surface, arg_min(ko, ord * 10 + pos) AS ko, min(ord * 10 + pos) AS place FROM u WHERE length(surface) >= 3 GROUP BY 1),
g AS (SELECT list({'r': '', 's': surface, 'h': [ko]} ORDER BY length(surface) DESC, place) AS list FROM f),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ko' ELSE 'vi' END AS lang, CASE WHEN c_custkey % 2 = 0 THEN 'D-2' END AS visa, CASE WHEN c_custkey % 6 = 1 THEN '송금 ' || c_custkey END AS translated,
  'Send from ' || n.n_name || CASE WHEN c_custkey % 3 = 0 THEN ' to ' || m.n_name ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' with E-9' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ' Asia' ELSE '' END AS query
  FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = c_custkey * 7 % 25),
h AS (SELECT a.*, list_reduce(list_prepend({'r': lower(query), 's': '', 'h': CAST([] AS VARCHAR[])}, list), lambda x, y: CASE WHEN contains(x.r, y.s) THEN {'r': replace(x.r, y.s, ' '), 's': '', 'h': CASE WHEN list_contains(x.h, y.h[1]) THEN x.h ELSE list_concat(x.h, y.h) END} ELSE x END).h AS hits FROM a, g)
"""
GLOSSARY_HITS = f"WITH {HITS_CTE} SELECT c_custkey, array_to_string(hits, ',') AS hits FROM h"


def normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hits(spark, sf).withColumn("n", T.normalised(F.col("query"), F.col("lang"), F.col("visa"), F.col("hits"), F.col("translated")))
    return rows.select("c_custkey", "n.terms", "n.via", "n.code", T.cache_key(F.col("lang"), F.col("visa"), F.col("query")).alias("cache_key"))


NORMALISE = f"""
WITH {HITS_CTE},
v AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'E9' ELSE visa END AS code, CASE WHEN lang = 'ko' THEN 'passthrough' WHEN len(hits) >= 2 THEN 'glossary' WHEN translated IS NULL THEN 'passthrough' ELSE 'llm' END AS via FROM h),
w AS (SELECT *, CASE WHEN via = 'llm' THEN array_to_string(list_prepend(translated, hits), ' ') WHEN lang = 'ko' THEN query WHEN len(hits) > 0 THEN array_to_string(hits, ' ') ELSE query END AS own FROM v)
SELECT c_custkey, CASE WHEN code IS NULL OR contains(replace(upper(own), '-', ''), replace(code, '-', '')) THEN own ELSE code || ' ' || own END AS terms, via, code, sha1(lang || '|' || coalesce(visa, '') || '|' || query) AS cache_key FROM w
"""


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("conv_id") * 5 + F.col("turn"), F.col("turn").cast("string")
    shapes = [
        F.concat(F.lit("<think>이 줄은 아니다\nno</think>\n검색어: 한도 해제 "), n), F.concat(F.lit("Thinking process: 첫째\nLet me see\n\"한도 해제 "), n, F.lit("\"\n설명")), F.concat(F.lit("still thinking </think> 한도 해제 "), n),
        F.concat(F.lit("plain english only "), n), F.concat(F.lit("먼저 살펴봅니다\nKeywords: 한도 해제 "), n), F.lit("").cast("string"),
    ]
    raw = F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.search_terms(raw).alias("terms"))


SEARCH_TERMS = "SELECT conv_id, turn, CASE WHEN (conv_id * 5 + turn) % 6 IN (3, 5) THEN '' ELSE '한도 해제 ' || turn END AS terms FROM conversations"


def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("x"))
    row = lambda x: F.when(x["l_linenumber"] % 3 == 0, F.array(x["l_linenumber"].cast("string"), F.lit(" a\nb "))).when(x["l_linenumber"] % 4 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(x["l_linenumber"].cast("string"), x["l_returnflag"], F.lit(None).cast("string")))
    return cells.select("l_orderkey", T.markdown_table(F.transform("x", row)).alias("shown"))


MARKDOWN_TABLE = """
WITH r AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_linenumber % 3 = 0 OR l_linenumber % 4 <> 0),
w AS (SELECT l_orderkey, count(*) AS k, max(CASE WHEN n % 3 = 0 THEN 2 ELSE 3 END) AS w, min(n) AS first FROM r GROUP BY 1),
s AS (SELECT r.*, k, w, '| ' || n || CASE WHEN n % 3 = 0 THEN ' | a b' || repeat(' | ', w - 2) ELSE ' | ' || f || ' | ' END || ' |' AS line FROM r JOIN w USING (l_orderkey)),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, q, f) AS pos FROM s),
t AS (SELECT l_orderkey, string_agg(CASE WHEN pos = 1 THEN line || chr(10) || '|' || repeat('---|', w) ELSE line END, chr(10) ORDER BY pos) AS shown FROM o WHERE k >= 2 GROUP BY 1)
SELECT DISTINCT l.l_orderkey, coalesce(shown, '') AS shown FROM lineitem l LEFT JOIN t USING (l_orderkey)
"""


def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    fields = {"doc_id": d, "lang": F.col("lang"), "verified_at": F.when(d % 2 == 0, "2026-08-01"), "sha256": F.sha2("text", 256), "topics": F.array("lang", F.lit("x"))}
    return table(spark, sf, "documents").select("doc_id", T.front_matter(fields).alias("head"))


FRONT_MATTER = """
SELECT doc_id, '---' || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'lang: ' || coalesce('"' || lang || '"', 'null') || chr(10) || 'verified_at: ' || CASE WHEN doc_id % 2 = 0 THEN '"2026-08-01"' ELSE 'null' END || chr(10)
  || 'sha256: ' || coalesce('"' || sha256(text) || '"', 'null') || chr(10) || 'topics: [' || coalesce('"' || lang || '"', 'null') || ',"x"]' || chr(10) || '---' || chr(10) AS head FROM documents
"""


def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(T.html_escaped(F.col("html")), 256).alias("sha256"))


HTML_ESCAPE = """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS sha256 FROM pages"""


def pack_list(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.count("*").alias("n"))
    packed = T.packed_list(F.when(F.col("n") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("p")))
    return lists.select("o_custkey", packed.alias("packed"), F.size(T.unpacked_list(packed)).alias("n_unpacked"))


PACK_LIST = """
WITH l AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n % 4 = 0 THEN '|' ELSE '|' || array_to_string(p, '|') || '|' END AS packed, CAST(CASE WHEN n % 4 = 0 THEN 0 ELSE len(p) END AS INTEGER) AS n_unpacked FROM l
"""


def compact_days(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    shown = F.when(k % 5 == 0, "2024133").when(k % 7 == 0, "20241345").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd"))
    return table(spark, sf, "orders").select("o_orderkey", T.compact_day(shown).alias("day"))


COMPACT_DAYS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"


def strict_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    whole = F.to_json(F.struct(F.lit("B").alias("tier"), F.col("text").alias("answer"), F.array(F.struct(F.lit(1).alias("ref"))).alias("citations")))
    raw = F.when(k % 3 == 0, F.substring_index(whole, "citations", 1)).when(k % 5 == 0, '{"tier": "A"}').otherwise(whole)
    row = T.strict_answer(raw, "tier string, answer string, citations array<struct<ref: int>>", ["tier", "answer", "citations"])
    rows = table(spark, sf, "conversations").withColumn("r", row)
    return rows.select("conv_id", "turn", F.when(F.col("r").isNull(), "upstream_error").alias("reason"), F.length("r.answer").alias("n"))


STRICT_JSON = """
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 OR (conv_id + turn) % 5 = 0 THEN 'upstream_error' END AS reason,
  CAST(CASE WHEN (conv_id + turn) % 3 <> 0 AND (conv_id + turn) % 5 <> 0 THEN length(text) END AS INTEGER) AS n FROM conversations
"""


def sse(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations sent as events and read again: what is shown, with the last block still on its way, a broken one and a nameless one."""
    turns = table(spark, sf, "conversations")
    block = F.when(F.col("turn") % 4 == 3, F.lit("event: token\ndata: {broken\n\n")).otherwise(T.sse_text(F.lit("token"), F.to_json(F.struct(F.col("text").alias("t")))))
    streams = turns.groupBy("conv_id").agg(F.concat(F.lit("data: {}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), ""), F.lit("event: token\ndata: {\"t\": \"tail\"}")).alias("stream"))
    found = streams.select("conv_id", T.sse_blocks(F.col("stream")).alias("now"), F.size(T.sse_blocks(F.col("stream"), ended=True)).alias("n_ended"))
    texts = F.transform("now", lambda b: F.get_json_object(b["data"], "$.t"))
    return found.select("conv_id", F.size("now").alias("n"), "n_ended", F.sha2(F.array_join(texts, ""), 256).alias("shown"))


SSE = """
SELECT conv_id, CAST(count(*) FILTER (turn % 4 <> 3) AS INTEGER) AS n, CAST(count(*) FILTER (turn % 4 <> 3) + 1 AS INTEGER) AS n_ended, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn % 4 <> 3), '')) AS shown FROM conversations GROUP BY 1
"""


def accept_language(spark: SparkSession, sf: str) -> DataFrame:
    headers = ["vi,en;q=0.8", "fr;q=0.9, en;q=0.3, ko;q=0.5", "de-DE,fr", "EN-us;q=0.2,vi-VN;q=0.7", "", "ko;q=0.4,en;q=0.4"]
    return table(spark, sf, "customer").select("c_custkey", T.preferred_language(picked(headers, F.col("c_custkey")), ["ko", "en", "vi"], "ko").alias("locale"))


ACCEPT_LANGUAGE = "SELECT c_custkey, ['vi', 'ko', 'ko', 'vi', 'ko', 'ko'][c_custkey % 6 + 1] AS locale FROM customer"


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(T.sigmoid(F.col("c_acctbal") / 100), 9).alias("confidence"), F.round(T.sigmoid(F.lit(-5000.0)), 9).alias("least"))


CONFIDENCE = "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 100)), 9) AS confidence, CAST(0.0 AS DOUBLE) AS least FROM customer"

NOBODY = "array<struct<doc_id: string, source_url: string, published_at: string, note: string>>"


def _matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Institutions and visa rules out of the suppliers."""
    s = F.col("s_suppkey")
    own = F.array(F.struct(F.concat(F.lit("KFB-"), s % 4).alias("doc_id"), F.lit("u").alias("source_url"), F.lit("2026").alias("published_at"), F.lit("inst").alias("note")), F.struct(F.lit("FSC-1").alias("doc_id"), F.lit("u").alias("source_url"), F.lit("2026").alias("published_at"), F.lit("inst").alias("note")))
    inst = table(spark, sf, "supplier").select(
        s.alias("ord"), F.concat(F.lit("I"), s).alias("inst_code"), F.concat(F.lit("은행"), s).alias("inst_name_ko"), F.create_map(F.lit("en"), F.when(s % 3 == 0, "").otherwise(F.col("s_name"))).alias("inst_name_i18n"),
        F.when(s % 6 == 0, "unknown").when(s % 5 == 0, "official").otherwise("inferred").alias("status"), F.array(F.lit("branch")).alias("channels"), F.when(s % 4 == 0, "unknown").otherwise("official").alias("languages_status"),
        F.when(s % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("languages_supported"), (F.col("s_acctbal") > 0).alias("online_available"), F.when(s % 6 != 1, (s % 3).cast("int")).alias("dedicated_branch_count"),
        own.cast(NOBODY).alias("evidence"), F.lit("2026-08-20").alias("updated_at"),
    )
    docs = F.transform(F.sequence(F.lit(1), (s % 5 + 1).cast("int")), lambda k: F.concat(F.lit("N"), (k + s) % 30))
    rules = table(spark, sf, "supplier").where("s_suppkey % 4 <> 3").select(
        F.concat(F.lit("I"), s).alias("inst_code"), F.lit("E-9").alias("visa_code"), picked(["official", "inferred", "unknown"], s).alias("account_open"), F.when(s % 2 == 0, F.array(F.lit("online"))).otherwise(F.array().cast("array<string>")).alias("channels"),
        docs.alias("required_docs"), F.array(F.lit("R1"), F.lit("X9")).alias("purpose_docs"), F.lit("note").alias("notes_ko"), F.array(F.struct(F.lit("FSC-1").alias("doc_id"), F.lit("v").alias("source_url"), F.lit("2027").alias("published_at"), F.lit(" rule ").alias("note"))).cast(NOBODY).alias("evidence"),
    )
    return inst, rules


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    return P.institution_cards(*_matrix(spark, sf), "E-9", "en", _glossary(spark, sf).drop("ord"))


def institutions(spark: SparkSession, sf: str) -> DataFrame:
    labels = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["code"], x["label"])), ",")
    evidence = F.array_join(F.transform("merged", lambda e: F.concat_ws("/", e["doc_id"], e["publisher"], e["published_at"], e["note"])), ";")
    return _cards(spark, sf).select("inst_code", "inst_name", "account_open", F.array_join("channels", ",").alias("channels"), labels("required_docs_labels").alias("docs"), labels("purpose_docs_labels").alias("purpose"), "fit_score", F.array_join("fit_reason", ",").alias("reasons"), F.array_join("unverified", ",").alias("unverified"), evidence.alias("evidence"))


CARDS_CTE = """
g AS (SELECT 'N' || n_nationkey AS code, n_name AS label FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
b AS (SELECT s_suppkey AS s, s_name, s_acctbal, s_suppkey % 4 <> 3 AS ruled, CASE WHEN s_suppkey % 4 = 3 THEN 'unknown' ELSE ['official', 'inferred', 'unknown'][s_suppkey % 3 + 1] END AS open,
  CASE WHEN s_suppkey % 6 = 0 THEN 'unknown' WHEN s_suppkey % 5 = 0 THEN 'official' ELSE 'inferred' END AS status, CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey % 5 + 1 ELSE 0 END AS n FROM supplier),
m AS (SELECT coalesce(max(n), 0) AS most FROM b WHERE open <> 'unknown'),
p AS (SELECT *, CASE WHEN open <> 'unknown' THEN 1 - CAST(n AS DOUBLE) / most END AS burden, CASE WHEN s % 4 <> 0 THEN s % 2 = 0 END AS lang, CASE WHEN status <> 'unknown' THEN s_acctbal > 0 END AS remote, CASE WHEN s % 6 <> 1 THEN s % 3 > 0 END AS branch FROM b, m),
q AS (SELECT *, CASE WHEN lang IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN remote IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN branch IS NOT NULL THEN 0.2 ELSE 0 END AS w,
  CASE WHEN lang THEN 0.5 ELSE 0 END + CASE WHEN remote THEN 0.3 ELSE 0 END + CASE WHEN branch THEN 0.2 ELSE 0 END AS e FROM p),
d AS (SELECT s, list(code || '=' || coalesce(label, code) ORDER BY k) AS docs FROM (SELECT s, k, 'N' || (k + s) % 30 AS code FROM (SELECT s, unnest(generate_series(1, s % 5 + 1)) AS k FROM b WHERE ruled)) LEFT JOIN g USING (code) GROUP BY 1),
c AS (SELECT q.*, docs, round((0.5 * CASE open WHEN 'official' THEN 1.0 WHEN 'inferred' THEN 0.6 ELSE 0 END + CASE WHEN burden IS NOT NULL THEN 0.3 * burden ELSE 0 END + CASE WHEN w > 0 THEN 0.2 * CAST(e AS DOUBLE) / w ELSE 0 END)
  / (0.5 + CASE WHEN burden IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN w > 0 THEN 0.2 ELSE 0 END), 4) AS score FROM q LEFT JOIN d USING (s))
"""
INSTITUTIONS = f"""
WITH {CARDS_CTE}
SELECT 'I' || s AS inst_code, CASE WHEN s % 3 = 0 THEN '은행' || s ELSE s_name END AS inst_name, open AS account_open, CASE WHEN ruled AND s % 2 = 0 THEN 'online' ELSE 'branch' END AS channels,
  coalesce(array_to_string(docs, ','), '') AS docs, CASE WHEN ruled THEN 'R1=' || (SELECT r_name FROM region WHERE r_regionkey = 1) || ',X9=X9' ELSE '' END AS purpose, score AS fit_score,
  concat_ws(',', CASE WHEN open = 'official' THEN 'visa_match' END, CASE WHEN burden >= 0.5 THEN 'doc_simplicity' END, CASE WHEN lang THEN 'language_support' END, CASE WHEN remote THEN 'non_face_to_face' END, CASE WHEN branch THEN 'dedicated_branch' END) AS reasons,
  concat_ws(',', CASE WHEN open <> 'official' THEN 'visa_requirements' END, CASE WHEN burden IS NULL THEN 'required_docs' END, CASE WHEN lang IS NULL THEN 'language_support' END, CASE WHEN remote IS NULL THEN 'non_face_to_face' END, CASE WHEN branch IS NULL THEN 'dedicated_branch' END) AS unverified,
  'KFB-' || s % 4 || '/전국은행연합회/2026/inst;FSC-1/금융위원회/' || CASE WHEN ruled THEN '2027/rule' ELSE '2026/inst' END AS evidence
FROM c
"""


def institution_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = P.institution_response(_cards(spark, sf))
    return out.select("n", F.array_join("unknown_institutions", ",").alias("unknown_institutions"), "disclaimer_tier", "updated_at")


INSTITUTION_SUMMARY = f"""
WITH {CARDS_CTE}
SELECT count(*) AS n, string_agg('I' || s, ',' ORDER BY coalesce(score, -1) DESC, s) FILTER (open = 'unknown') AS unknown_institutions, CASE WHEN bool_or(status = 'official') THEN 'B' ELSE 'C' END AS disclaimer_tier, '2026-08-20' AS updated_at FROM c
"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.when(n == 0, "base").when(n < 13, "account_opening").otherwise("foreign_registration")
    docs = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("D"), n), F.lit("D0")))
    return table(spark, sf, "nation").select(
        kind.alias("kind"), F.when(n == 0, "").otherwise(F.concat(F.lit("k"), n)).alias("key"), F.when(n > 0, "주의").alias("caveat_ko"), F.when(n > 0, F.create_map(F.lit("en"), F.lit("caution"))).alias("caveat_i18n"),
        F.when(n % 3 == 0, "unknown").otherwise("official").alias("status"), docs.alias("doc_codes"), F.concat(F.lit("메모"), n).alias("notes_ko"), F.create_map(F.lit("en"), F.when(n % 2 == 0, F.lit(" ")).otherwise(F.col("n_name"))).alias("notes_i18n"), F.array().cast(NOBODY).alias("evidence"),
    )


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("request_id"), F.when(c % 2 == 0, "en").otherwise("ko").alias("lang"), F.when(c % 3 != 0, F.concat(F.lit("k"), c % 30)).alias("visa"), F.when(c % 4 != 0, F.concat(F.lit("k"), c % 17)).alias("purpose"))


def checklist(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.checklist_sections(_requests(spark, sf), _sections(spark, sf), {"ko": "확인되지 않음", "en": "not confirmed"})
    return rows.select("request_id", "place", "kind", "status", F.array_join("doc_codes", ",").alias("docs"), "notes", "caveat")


CHECKLIST_CTE = """
q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'ko' END AS lang, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 30 END AS visa, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 17 END AS purpose FROM customer),
n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE 'official' END AS status, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'D' || n_nationkey || ',D0' END AS docs, '메모' || n_nationkey AS ko, CASE WHEN n_nationkey % 2 = 0 THEN '메모' || n_nationkey ELSE n_name END AS en FROM nation),
s AS (SELECT id, lang, visa, purpose, 0 AS place, 'base' AS kind, status, docs, CASE lang WHEN 'en' THEN en ELSE ko END AS notes, '' AS caveat FROM q, n WHERE k = 0
  UNION ALL SELECT id, lang, visa, purpose, 1, 'account_opening', coalesce(status, 'unknown'), coalesce(docs, ''), CASE WHEN k IS NULL THEN CASE lang WHEN 'en' THEN 'not confirmed' ELSE '확인되지 않음' END WHEN lang = 'en' THEN en ELSE ko END,
    CASE WHEN k IS NULL THEN '' WHEN lang = 'en' THEN 'caution' ELSE '주의' END FROM q LEFT JOIN n ON k = purpose AND k BETWEEN 1 AND 12 WHERE purpose IS NOT NULL
  UNION ALL SELECT id, lang, visa, purpose, 2, 'foreign_registration', status, docs, CASE lang WHEN 'en' THEN en ELSE ko END, CASE lang WHEN 'en' THEN 'caution' ELSE '주의' END FROM q JOIN n ON k = visa AND k >= 13)
"""
CHECKLIST = f"WITH {CHECKLIST_CTE} SELECT id AS request_id, CAST(place AS INTEGER) AS place, kind, status, docs, notes, caveat FROM s"


def checklist_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.checklist_sections(_requests(spark, sf), _sections(spark, sf), {"ko": "확인되지 않음", "en": "not confirmed"})
    return P.checklist_response(rows, F.lit("2026-08-20").cast("date")).select("request_id", F.array_join("kinds", ",").alias("kinds"), "disclaimer_tier", "filename")


CHECKLIST_FILES = f"""
WITH {CHECKLIST_CTE}
SELECT id AS request_id, string_agg(kind, ',' ORDER BY place) AS kinds, CASE WHEN bool_or(docs <> '') THEN 'B' ELSE 'C' END AS disclaimer_tier, 'checklist_' || coalesce('k' || visa, 'ALL') || '_' || lang || '_20260820.pdf' AS filename FROM s GROUP BY id, lang, visa, purpose
"""


def scam(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    en = lambda c, x: F.create_map(F.lit("en"), F.when(x % 2 == 0, F.col(c)).otherwise(""))
    types = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("T"), "n_nationkey").alias("code"), F.lit("유형").alias("title_ko"), en("n_name", F.col("n_nationkey")).alias("title_i18n"), F.lit("설명").alias("body_ko"), en("n_name", F.col("n_nationkey") + 1).alias("body_i18n"))
    steps = r.select((5 - F.col("r_regionkey")).alias("seq"), F.lit("단계").alias("label_ko"), en("r_name", F.col("r_regionkey")).alias("label_i18n"))
    contacts = r.select(F.col("r_regionkey").alias("ord"), F.concat(F.lit("C"), "r_regionkey").alias("code"), F.lit("112").alias("number"), F.lit("기관").alias("org_ko"), en("r_name", F.col("r_regionkey")).alias("org_i18n"), F.lit("역할").alias("role_ko"), F.create_map(F.lit("en"), F.lit("role")).alias("role_i18n"))
    return P.scam_response(types, steps, contacts, "en")


SCAM = """
SELECT 'type' AS kind, n_nationkey AS place, 'T' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '유형' END AS title, CASE WHEN n_nationkey % 2 = 1 THEN n_name ELSE '설명' END AS body FROM nation
UNION ALL SELECT 'step', 5 - r_regionkey, CAST(5 - r_regionkey AS VARCHAR), CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '단계' END, '' FROM region
UNION ALL SELECT 'contact', r_regionkey, 'C' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '기관' END, '112 role' FROM region
"""


def remittances(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    rows = table(spark, sf, "events").select(F.array(F.struct(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(day).alias("TIME"), F.when(F.col("event_id") % 3 == 0, "-").otherwise(F.format_number(1300 + F.col("event_id") % 100, 2)).alias("DATA_VALUE"))).alias("rows"))
    quotes = P.quotes_of(rows).groupBy("quoted_at").agg(F.max("rate").alias("rate"))
    c = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(c.alias("request_id"), (c * 10_000.0).alias("amount_krw"), F.when(c % 3 != 0, F.col("c_acctbal")).alias("declared_usd"), F.date_add(F.lit("2023-12-25").cast("date"), (c % 45).cast("int")).alias("day"))
    out = P.remittances(requests, quotes, F.lit(5000.0), F.when(c_even(), F.lit(3000.0)), F.lit("2024-01-20"))
    return out.select("request_id", "quoted_at", "rate", "stale", *(F.round(x, 4).alias(x) for x in ("amount_usd", "annual_remaining")), "annual_exceeds", F.round("transaction_remaining", 4).alias("transaction_remaining"), "transaction_exceeds")


def c_even() -> Column:
    return F.col("request_id") % 2 == 0


REMITTANCES = """
WITH e AS (SELECT CAST(ts AS DATE) AS quoted_at, max(1300 + event_id % 100) AS rate FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 GROUP BY 1),
r AS (SELECT c_custkey AS id, c_custkey * 10000.0 AS krw, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS used, DATE '2023-12-25' + CAST(c_custkey % 45 AS INTEGER) AS day FROM customer),
j AS (SELECT r.*, quoted_at, CAST(rate AS DOUBLE) AS rate FROM r ASOF LEFT JOIN e ON r.day >= e.quoted_at)
SELECT id AS request_id, quoted_at, rate, date_diff('day', quoted_at, day) > 3 AS stale, round(krw / rate, 4) AS amount_usd, round(5000 - used, 4) AS annual_remaining, 5000 - used < 0 AS annual_exceeds,
  CASE WHEN id % 2 = 0 THEN round(3000 - krw / rate, 4) END AS transaction_remaining, CASE WHEN id % 2 = 0 THEN krw / rate > 3000 END AS transaction_exceeds FROM j
"""

FALLBACK_TEXTS = {("low_confidence", "ko"): "낮음", ("low_confidence", "en"): "low", ("injection_blocked", "ko"): "차단", ("scam_verdict", "ko"): "사기", ("scam_verdict", "en"): "scam"}
CONTACTS = {"scam": {"ko": ["112"], "en": ["112", "1332"]}, "general": {"ko": ["1332"]}}


def fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") * 3 + F.col("turn")
    reason, lang = picked(["no_citation", "injection_blocked", "scam_verdict", "upstream_error", "low_confidence"], k), picked(["ko", "en", "vi"], k)
    text, contacts = P.fallback(reason, lang, FALLBACK_TEXTS, CONTACTS)
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("told"), F.array_join(contacts, ",").alias("contacts"))


FALLBACKS = """
WITH k AS (SELECT conv_id, turn, ['no_citation', 'injection_blocked', 'scam_verdict', 'upstream_error', 'low_confidence'][(conv_id * 3 + turn) % 5 + 1] AS r, ['ko', 'en', 'vi'][(conv_id * 3 + turn) % 3 + 1] AS l FROM conversations)
SELECT conv_id, turn, CASE r WHEN 'injection_blocked' THEN '차단' WHEN 'scam_verdict' THEN CASE l WHEN 'en' THEN 'scam' ELSE '사기' END ELSE CASE l WHEN 'en' THEN 'low' ELSE '낮음' END END AS told,
  CASE WHEN r = 'scam_verdict' THEN CASE l WHEN 'en' THEN '112,1332' ELSE '112' END ELSE '1332' END AS contacts FROM k
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    bundles = table(spark, sf, "nation").select(F.explode(F.array(*(F.struct(F.lit(lang).alias("lang"), F.concat(F.lit("m"), n).alias("key"), F.when(n % mod == 0, F.concat(F.lit(f"{lang} "), "n_name")).otherwise("").alias("value")) for lang, mod in (("vi", 4), ("en", 3), ("ko", 2))))).alias("b")).select("b.*")
    keys = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("m"), "c_nationkey").alias("key"), picked(["vi", "en", "ko"], F.col("c_custkey")).alias("lang"))
    return P.message(keys, bundles, "key", "lang").select("c_custkey", "value")


MESSAGES = """
WITH k AS (SELECT c_custkey, n_nationkey AS n, n_name, ['vi', 'en', 'ko'][c_custkey % 3 + 1] AS l FROM customer JOIN nation ON n_nationkey = c_nationkey),
v AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'vi ' || n_name END AS vi, CASE WHEN n % 3 = 0 THEN 'en ' || n_name END AS en, CASE WHEN n % 2 = 0 THEN 'ko ' || n_name END AS ko FROM k)
SELECT c_custkey, coalesce(CASE l WHEN 'vi' THEN vi WHEN 'en' THEN en ELSE ko END, en, ko, 'm' || n) AS value FROM v
"""


def profile_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    visa, purpose = F.when(c % 3 != 0, F.concat(F.lit("E-"), c % 10)), F.when(c % 4 != 0, picked(list(P.PURPOSES), c))
    return table(spark, sf, "customer").select("c_custkey", P.profile_query(visa, purpose).alias("query"), F.to_json(P.next_action(visa, purpose)).alias("params"))


PROFILE_QUERIES = """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'E-' || c_custkey % 10 END AS visa, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 END AS k FROM customer)
SELECT c_custkey, concat_ws(' ', '한도제한계좌 해제', visa || ' 체류자격', ['급여 수령', '학비 납부', '생활비', '해외 송금', '사업 자금'][k + 1], '금융거래목적 증빙 서류') AS query,
  '{' || concat_ws(',', '"visa":"' || visa || '"', '"purpose":"' || ['salary', 'tuition', 'living', 'remittance', 'business'][k + 1] || '"') || '}' AS params FROM p
"""


def prompt_terms(spark: SparkSession, sf: str) -> DataFrame:
    return P.prompt_terms(_glossary(spark, sf), "vi", ["term", "visa"])


PROMPT_TERMS = """
SELECT string_agg('- ' || ko || coalesce(' → ' || label, ''), chr(10) ORDER BY ord) AS terms
FROM (SELECT n_nationkey AS ord, '국가' || n_nationkey AS ko, split_part(n_name, ' ', 1) AS label FROM nation UNION ALL SELECT r_regionkey + 100, '지역' || r_regionkey, NULL FROM region)
"""


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Requests set apart by bounds, by an unknown kind, and by a supplier code that is not in the catalogue."""
    parts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_suppkey")
    known = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("known"))
    _, bad = P.quarantined(parts.join(known, "l_suppkey", "left"), {"quantity": F.col("l_quantity").between(1, 40), "flag": F.col("l_returnflag").isin("A", "N"), "supplier": F.col("known")})
    return bad.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.array_join("failed", ",")).alias("failed"))


QUARANTINE = """
WITH f AS (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity NOT BETWEEN 1 AND 40 THEN 'quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END, CASE WHEN s_suppkey IS NULL THEN 'supplier' END) AS failed
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 10 <> 0)
SELECT l_orderkey, l_linenumber, max(failed) AS failed FROM f WHERE failed <> '' GROUP BY 1, 2
"""


def ranking_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What the ranking's own constants give each supplier for what it has."""
    k = F.col("s_suppkey")
    has = {"weight.visa_fit": k % 2 == 0, "weight.doc_burden": k % 3 == 0, "weight.channel_access": k % 5 == 0, "access.language_support": k % 7 == 0, "access.non_face_to_face": k % 4 == 1, "access.dedicated_branch": k % 6 == 1}
    status = F.concat(F.lit("status."), F.when(F.col("s_acctbal") > 5000, "official").when(F.col("s_acctbal") > 0, "inferred").otherwise("unknown"))
    keys = F.array_compact(F.array(status, *(F.when(held, name) for name, held in has.items())))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(keys).alias("key"))
    return rows.join(P.policy(spark, "fit_score"), "key").groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("score"))


RANKING_POLICY = """
WITH p AS (SELECT * FROM (VALUES ('weight.visa_fit', 0.5::DOUBLE), ('weight.doc_burden', 0.3), ('weight.channel_access', 0.2), ('access.language_support', 0.5), ('access.non_face_to_face', 0.3), ('access.dedicated_branch', 0.2),
  ('status.official', 1.0), ('status.inferred', 0.6), ('status.unknown', 0.0)) t(key, value)),
s AS (SELECT s_suppkey, unnest([CASE WHEN s_acctbal > 5000 THEN 'status.official' WHEN s_acctbal > 0 THEN 'status.inferred' ELSE 'status.unknown' END, CASE WHEN s_suppkey % 2 = 0 THEN 'weight.visa_fit' END, CASE WHEN s_suppkey % 3 = 0 THEN 'weight.doc_burden' END,
  CASE WHEN s_suppkey % 5 = 0 THEN 'weight.channel_access' END, CASE WHEN s_suppkey % 7 = 0 THEN 'access.language_support' END, CASE WHEN s_suppkey % 4 = 1 THEN 'access.non_face_to_face' END, CASE WHEN s_suppkey % 6 = 1 THEN 'access.dedicated_branch' END]) AS key FROM supplier)
SELECT s_suppkey, count(*) AS n, round(sum(value), 6) AS score FROM s JOIN p USING (key) GROUP BY 1
"""

QUERIES = {
    "q_lexical_tokens": (lexical_tokens, LEXICAL_TOKENS), "q_glossary_hits": (glossary_hits, GLOSSARY_HITS), "q_normalise": (normalise, NORMALISE), "q_search_terms": (search_terms, SEARCH_TERMS),
    "q_markdown_table": (markdown_table, MARKDOWN_TABLE), "q_front_matter": (front_matter, FRONT_MATTER), "q_html_escape": (html_escape, HTML_ESCAPE), "q_pack_list": (pack_list, PACK_LIST), "q_compact_days": (compact_days, COMPACT_DAYS),
    "q_strict_json": (strict_json, STRICT_JSON), "q_sse": (sse, SSE), "q_accept_language": (accept_language, ACCEPT_LANGUAGE), "q_confidence": (confidence, CONFIDENCE), "q_institutions": (institutions, INSTITUTIONS),
    "q_institution_summary": (institution_summary, INSTITUTION_SUMMARY), "q_checklist": (checklist, CHECKLIST), "q_checklist_files": (checklist_files, CHECKLIST_FILES), "q_scam": (scam, SCAM), "q_remittances": (remittances, REMITTANCES),
    "q_fallbacks": (fallbacks, FALLBACKS), "q_messages": (messages, MESSAGES), "q_profile_queries": (profile_queries, PROFILE_QUERIES), "q_prompt_terms": (prompt_terms, PROMPT_TERMS), "q_quarantine": (quarantine, QUARANTINE),
    "q_ranking_policy": (ranking_policy, RANKING_POLICY),
}
