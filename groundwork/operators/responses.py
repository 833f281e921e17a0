"""Structured answers from catalogues: institutions, checklists, scams, remittances, fallbacks, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators import rules as U
from groundwork.operators.ordered import as_of

# Publishers by a document id's prefix, section keys, quote age, prompt defaults.
PUBLISHERS, NO_PUBLISHER = {"FSC": "금융위원회", "KOREA": "대한민국 정책브리핑", "HIKOREA": "법무부 하이코리아", "KFB": "전국은행연합회"}, "출처 미상"
PURPOSES = {"salary": "급여 수령", "tuition": "학비 납부", "living": "생활비", "remittance": "해외 송금", "business": "사업 자금"}
QUERY_HEAD, QUERY_VISA, QUERY_TAIL = "한도제한계좌 해제", " 체류자격", "금융거래목적 증빙 서류"
QUOTE_DAYS = 3
#: Reasons that a reader is told of as low confidence.
SAME_TEXT = ("no_citation", "phantom_citation", "unsupported_number", "forbidden_expression", "credential_request", "out_of_scope", "language_mismatch")
LOW = "low_confidence"


def look_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def publisher(doc_id: Column) -> Column:
    return F.coalesce(look_up(PUBLISHERS, F.split_part(doc_id, F.lit("-"), F.lit(1))), F.lit(NO_PUBLISHER))


def fit_reasons(row: dict[str, Column], max_docs: Column) -> tuple[Column, Column]:
    """(reasons, unverified) of an institution's fit score, in fixed order; row as in `rules.fit_score`."""
    burden = F.when(max_docs <= 0, 1.0).otherwise(1 - row["n_docs"] / max_docs)
    known = row["status"] != "unknown"
    reasons = [(row["status"] == "official", "visa_match"), (known & (burden >= 0.5), "doc_simplicity"), (row["has_language"], "language_support"), (row["has_remote"], "non_face_to_face"), (row["n_branches"] > 0, "dedicated_branch")]
    open_ = [(row["status"] != "official", "visa_requirements"), (~known, "required_docs"), (row["has_language"].isNull(), "language_support"), (row["has_remote"].isNull(), "non_face_to_face"), (row["n_branches"].isNull(), "dedicated_branch")]
    listed = lambda items: F.filter(F.array(*(F.when(c, name) for c, name in items)), lambda x: x.isNotNull())
    return listed(reasons), listed(open_)


def with_labels(rows: DataFrame, key: list[str], codes: str, glossary: DataFrame, lang: str, out: str) -> DataFrame:
    """rows with an array of (code, label, label_ko) for an array of codes, in its order; a code without a term is its own label."""
    label = F.coalesce(F.nullif(F.trim(F.try_element_at("labels", F.lit(lang))), F.lit("")), F.col("ko"))
    each = rows.select(*key, F.posexplode(codes).alias("at", "code")).join(glossary.select("code", "ko", label.alias("label")), "code", "left")
    item = F.struct("code", F.coalesce("label", "code").alias("label"), F.coalesce("ko", "code").alias("label_ko"))
    listed = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("item")))), lambda x: x["item"]).alias(out))
    return rows.join(listed, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<struct<code: string, label: string, label_ko: string>>")))


def institution_cards(inst: DataFrame, rules: DataFrame, visa: str | None, lang: str, glossary: DataFrame) -> DataFrame:
    """A card for each institution, best fit first (none known last): the rule for the visa if there is one,
    its documents with labels, fit score with reasons, merged evidence with publishers."""
    own = rules.where(F.col("visa_code") == visa if visa else F.lit(False)).select(
        "inst_code", "account_open", F.col("channels").alias("rule_channels"), "required_docs", "purpose_docs", "notes_ko", F.col("evidence").alias("rule_evidence")
    )
    rows = inst.join(own, "inst_code", "left").withColumn("account_open", F.coalesce("account_open", F.lit("unknown")))
    most = rows.where("account_open <> 'unknown'").agg(F.coalesce(F.max(F.size("required_docs")), F.lit(0)).alias("m"))
    max_docs = most.scalar()
    parts = {
        "status": F.col("account_open"), "n_docs": F.coalesce(F.size("required_docs"), F.lit(0)), "has_language": F.when(F.col("languages_status") != "unknown", F.coalesce(F.size("languages_supported") > 0, F.lit(False))),
        "has_remote": F.when(F.col("status") != "unknown", F.coalesce("online_available", F.lit(False))), "n_branches": F.col("dedicated_branch_count"),
    }
    rows = rows.withColumn("_max", max_docs)
    reasons, unverified = fit_reasons(parts, F.col("_max"))
    empty = F.array().cast("array<string>")
    cards = rows.withColumns({"fit_score": U.fit_score(parts, F.col("_max")), "fit_reason": reasons, "unverified": unverified, "inst_name": U.localized(F.col("inst_name_i18n"), F.lit(lang), F.col("inst_name_ko"))})
    cards = cards.withColumn("channels", F.when(F.size("rule_channels") > 0, F.col("rule_channels")).otherwise(F.coalesce("channels", empty)))
    for codes in ("required_docs", "purpose_docs"):
        cards = with_labels(cards.withColumn(codes, F.coalesce(codes, empty)), ["inst_code"], codes, glossary, lang, f"{codes}_labels")
    cards = cards.join(merged_evidence_of(rows), "inst_code", "left")
    order = [F.coalesce("fit_score", F.lit(-1.0)).desc(), F.col("ord")]
    return cards.select("ord", "inst_code", "inst_name", "inst_name_ko", "status", "account_open", "channels", "required_docs_labels", "purpose_docs_labels", "fit_score", "fit_reason", "unverified", F.coalesce("notes_ko", F.lit("")).alias("notes"), "merged", "updated_at").orderBy(*order)


def merged_evidence_of(rows: DataFrame) -> DataFrame:
    """(inst_code, merged): evidence of institution and rule, one for each doc_id, the rule's in place of the institution's, at the place first seen."""
    listed = lambda c, prio: rows.select("inst_code", F.posexplode(c).alias("at", "e")).select("inst_code", F.struct(F.lit(prio).alias("list"), "at").alias("at"), F.lit(prio).alias("priority"), "e.*")
    each = U.merged_evidence(listed("evidence", 0).unionByName(listed("rule_evidence", 1)), "inst_code", "doc_id", "priority", "at")
    item = F.struct("doc_id", publisher(F.col("doc_id")).alias("publisher"), "published_at", "source_url", F.trim(F.coalesce("note", F.lit(""))).alias("note"))
    return each.groupBy("inst_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("merged"))


def institution_response(cards: DataFrame) -> DataFrame:
    """One row over the cards: the unknown institutions in the cards' order, the disclaimer's tier, the number of cards."""
    order = F.struct((-F.coalesce("fit_score", F.lit(-1.0))).alias("s"), "ord")
    unknown = F.array_sort(F.collect_list(F.when(F.col("account_open") == "unknown", F.struct(order.alias("o"), "inst_code"))))
    return cards.agg(F.count("*").alias("n"), F.transform(unknown, lambda x: x["inst_code"]).alias("unknown_institutions"), F.when(F.bool_or(F.col("status") == "official"), "B").otherwise("C").alias("disclaimer_tier"), F.max("updated_at").alias("updated_at"))


def checklist_sections(requests: DataFrame, sections: DataFrame, not_confirmed: dict[str, str]) -> DataFrame:
    """The sections of each request (request_id, lang, visa, purpose): base always; a purpose's, which if it is
    not in the catalogue is an explicit unknown one; a visa's only if there is one. With doc codes, notes, caveat, place.
    The base sections, a row or two of the catalogue, are one array that each request reads."""
    req = requests.select("request_id", "lang", "visa", "purpose")
    always = sections.where("kind = 'base'").agg(F.collect_list(F.struct(*(c for c in sections.columns if c != "key"))).alias("always"))
    base = req.withColumn("base", F.explode(always.scalar())).select(*req.columns, "base.*", F.lit(0).alias("place"))
    keyed = lambda kind: sections.where(F.col("kind") == kind).drop("kind")
    opening = req.where("purpose is not null").join(keyed("account_opening").withColumnRenamed("key", "purpose"), "purpose", "left").withColumns({"kind": F.lit("account_opening"), "place": F.lit(1)})
    missing = F.col("status").isNull()
    opening = opening.withColumns({"notes_ko": F.when(missing, not_confirmed["ko"]).otherwise(F.col("notes_ko")), "notes_i18n": F.when(missing, F.create_map(*(F.lit(x) for p in not_confirmed.items() for x in p))).otherwise(F.col("notes_i18n")), "status": F.coalesce("status", F.lit("unknown"))})
    visa = req.where("visa is not null").join(keyed("foreign_registration").withColumnRenamed("key", "visa"), "visa").withColumns({"kind": F.lit("foreign_registration"), "place": F.lit(2)})
    rows = base.unionByName(opening).unionByName(visa)
    text = lambda stem: F.coalesce(U.localized(F.col(f"{stem}_i18n"), F.col("lang"), F.col(f"{stem}_ko")), F.lit(""))
    return rows.select("request_id", "lang", "visa", "purpose", "place", "kind", "status", F.coalesce("doc_codes", F.array().cast("array<string>")).alias("doc_codes"), text("notes").alias("notes"), text("caveat").alias("caveat"), "evidence")


def checklist_response(sections: DataFrame, today: Column) -> DataFrame:
    """One row for each request: its section kinds in order, tier (C if no section lists a document), file name."""
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"])
    name = F.concat(F.lit("checklist_"), F.coalesce("visa", F.lit("ALL")), F.lit("_"), F.col("lang"), F.lit("_"), F.date_format(today, "yyyyMMdd"), F.lit(".pdf"))
    return sections.groupBy("request_id", "lang", "visa", "purpose").agg(kinds.alias("kinds"), F.when(F.bool_or(F.size("doc_codes") > 0), "B").otherwise("C").alias("disclaimer_tier")).withColumn("filename", name)


def scam_response(types: DataFrame, steps: DataFrame, contacts: DataFrame, lang: str) -> DataFrame:
    """kind, place, code, title, body of what is shown: types, then steps by their number, then contacts, in the language or in Korean."""
    own = lambda stem: U.localized(F.col(f"{stem}_i18n"), F.lit(lang), F.col(f"{stem}_ko"))
    shown = [
        types.select(F.lit("type").alias("kind"), F.col("ord").alias("place"), "code", own("title").alias("title"), own("body").alias("body")),
        steps.select(F.lit("step").alias("kind"), F.col("seq").alias("place"), F.col("seq").cast("string").alias("code"), own("label").alias("title"), F.lit("").alias("body")),
        contacts.select(F.lit("contact").alias("kind"), F.col("ord").alias("place"), "code", own("org").alias("title"), F.concat_ws(" ", "number", own("role")).alias("body")),
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def quotes_of(payload: DataFrame, rows: str = "rows") -> DataFrame:
    """(quoted_at, rate) of a landed payload's (TIME, DATA_VALUE) rows; rows with a broken date or number are skipped."""
    from groundwork.functions.text import compact_day, number

    each = payload.select(F.explode(rows).alias("r"))
    return each.select(compact_day(F.col("r.TIME")).alias("quoted_at"), number(F.col("r.DATA_VALUE")).alias("rate")).where("quoted_at is not null and rate is not null")


def remittances(requests: DataFrame, quotes: DataFrame, annual: Column, per_transaction: Column, today: Column) -> DataFrame:
    """Simulated remittances (request_id, amount_krw, declared_usd) at the latest quote of each request's day or before.

    amount_usd is not rounded; without a quote it is unknown and so is the check of the
    transaction. A limit or use that is unknown leaves remaining and exceeds unknown.
    """
    rows = as_of(requests, quotes.select("quoted_at", "rate"), [], "day", "quoted_at", "q").select("*", "q.quoted_at", F.when(F.col("q.rate") > 0, F.col("q.rate")).alias("rate")).drop("q")
    rows = rows.withColumn("amount_usd", F.col("amount_krw") / F.col("rate")).withColumn("stale", F.datediff(F.col("day"), "quoted_at") > QUOTE_DAYS)
    left = annual - F.col("declared_usd")
    return rows.select(
        "request_id", "quoted_at", "rate", "stale", "amount_usd", left.alias("annual_remaining"), (left < 0).alias("annual_exceeds"),
        (per_transaction - F.col("amount_usd")).alias("transaction_remaining"), (F.col("amount_usd") > per_transaction).alias("transaction_exceeds"),
    )


def fallback(reason: Column, lang: Column, texts: dict[tuple[str, str], str], contacts: dict[str, dict[str, list[str]]]) -> tuple[Column, Column]:
    """(text, contacts) told for a reason: some reasons share low confidence's text, as any without a text of its own does; Korean stands in."""
    known = sorted({r for r, _ in texts})
    effective = F.when(reason.isin(*SAME_TEXT) | ~reason.isin(*known), LOW).otherwise(reason)
    text = F.create_map(*(F.lit(x) for (r, n), t in texts.items() for x in (f"{r}|{n}", t)))
    picked = F.coalesce(text[F.concat_ws("|", effective, lang)], text[F.concat_ws("|", effective, F.lit("ko"))])
    listed = lambda table: F.coalesce(*(F.create_map(*(x for n, v in table.items() for x in (F.lit(n), F.array(*map(F.lit, v)))))[key] for key in (lang, F.lit("ko"))))
    return picked, F.when(reason == "scam_verdict", listed(contacts["scam"])).otherwise(listed(contacts["general"]))


def message(keys: DataFrame, bundles: DataFrame, key: str, lang: str) -> DataFrame:
    """keys with their message: the language's, else English, else Korean, else the key itself."""
    own = bundles.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), "value").where("value <> ''")
    asked = keys.select("*", F.explode(F.array_distinct(F.array(F.col(lang), F.lit("en"), F.lit("ko")))).alias("_lang"))
    rank = F.when(F.col("_lang") == F.col(lang), 0).when(F.col("_lang") == "en", 1).otherwise(2)
    found = asked.join(own.withColumnRenamed("_key", key), ["_lang", key], "left").groupBy(*keys.columns).agg(F.min_by("value", F.when(F.col("value").isNotNull(), rank)).alias("value"))
    return found.withColumn("value", F.coalesce("value", key))


def profile_query(visa: Column, purpose: Column) -> Column:
    """The search query of a profile: its visa and first purpose between fixed words."""
    return F.concat_ws(" ", F.lit(QUERY_HEAD), F.concat(visa, F.lit(QUERY_VISA)), look_up(PURPOSES, purpose), F.lit(QUERY_TAIL))


def next_action(visa: Column, purpose: Column) -> Column:
    """The parameters of the checklist that follows an answer: those of the profile that are known."""
    return F.map_filter(F.create_map(F.lit("visa"), visa, F.lit("purpose"), purpose), lambda _, v: v.isNotNull())


def prompt_terms(glossary: DataFrame, lang: str, categories: list[str]) -> DataFrame:
    """One row: the glossary lines that a prompt carries, in the glossary's order."""
    label = F.coalesce(F.nullif(F.trim(F.try_element_at("labels", F.lit(lang))), F.lit("")), F.col("ko"))
    line = F.concat(F.lit("- "), F.col("ko"), F.when(label != F.col("ko"), F.concat(F.lit(" → "), label)).otherwise(""))
    rows = glossary.where(F.col("category").isin(categories)).select("ord", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("terms"))


def truncated_history(turns: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n turns of each conversation."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with the names of the checks that failed); a check that is null fails."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items())), lambda x: x.isNotNull())
    marked = rows.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def policy(spark, name: str) -> DataFrame:
    """(name, key, value): the constants that a ranking is made of, read from where they are used."""
    rows = [("weight", "visa_fit", U.W_VISA), ("weight", "doc_burden", U.W_DOCS), ("weight", "channel_access", U.W_CHANNEL), ("access", "language_support", U.W_LANGUAGE), ("access", "non_face_to_face", U.W_REMOTE), ("access", "dedicated_branch", U.W_BRANCH)]
    rows += [("status", k, v) for k, v in U.STATUS_SCORE.items()]
    return spark.createDataFrame([(name, f"{a}.{b}", float(v)) for a, b, v in rows], "name string, key string, value double")
