"""Catalogue files: source lists, glossaries, rule matrices, limits, reports, statistics in old encodings.

Catalogues are small hand-kept files, so they are read whole, as JSON (or YAML where PyYAML is
installed), by a given schema. What breaks a rule comes back as rows of violations, beside the
good rows, so that a caller can stop on them or set them apart.
"""

from __future__ import annotations

import json
import re
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import host_allowed

try:
    import yaml
except ImportError:
    yaml = None

# States of evidence, and how far a page's declared charset is looked for.
STATES, DECLARED = ("official", "inferred", "unknown"), 4096

EVIDENCE = "array<struct<doc_id: string, source_url: string, published_at: string, note: string>>"
SOURCES = "sources array<struct<doc_id: string, title: string, url: string, publisher: string, priority: string, allow_short: boolean, visa_scope: array<string>>>"
MATRIX = f"""updated_at string, institutions array<struct<inst_code: string, inst_name_ko: string, inst_name_i18n: map<string,string>, status: string, channels: array<string>,
  languages_status: string, languages_supported: array<string>, online_available: boolean, dedicated_branch_count: int, evidence: {EVIDENCE},
  visa_rules: array<struct<visa_code: string, account_open: string, channels: array<string>, required_docs: array<string>, purpose_docs: array<string>, notes_ko: string, evidence: {EVIDENCE}>>>>"""
BLOCK = f"struct<status: string, doc_codes: array<string>, notes_ko: string, notes_i18n: map<string,string>, evidence: {EVIDENCE}>"
CHECKLIST = f"""base {BLOCK}, account_opening struct<caveat_ko: string, caveat_i18n: map<string,string>, by_purpose: map<string,{BLOCK}>>,
  foreign_registration struct<caveat_ko: string, caveat_i18n: map<string,string>, by_visa: map<string,{BLOCK}>>"""
SCAM = f"""updated_at string, types array<struct<code: string, certainty: string, title_ko: string, title_i18n: map<string,string>, body_ko: string, body_i18n: map<string,string>, evidence: {EVIDENCE}>>,
  response_steps array<struct<seq: int, label_ko: string, label_i18n: map<string,string>>>,
  contacts array<struct<code: string, number: string, org_ko: string, org_i18n: map<string,string>, role_ko: string, role_i18n: map<string,string>, primary: boolean, evidence: {EVIDENCE}>>"""
LIMITS = f"limits map<string,struct<status: string, value: double, evidence: {EVIDENCE}>>, notes_ko string, notes_i18n map<string,string>"


@F.pandas_udf(T.StringType())
def yaml_as_json(text: pd.Series) -> pd.Series:
    plain = lambda x: x.isoformat() if isinstance(x, (date, datetime)) else str(x)
    return text.map(lambda t: json.dumps(yaml.safe_load(t), default=plain, ensure_ascii=False))


def catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: a catalogue file by its schema. Broken files give a row of nulls."""
    text = spark.read.text(path, wholetext=True)
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise ImportError("a YAML catalogue needs PyYAML; write it as JSON")
        text = text.select(yaml_as_json("value").alias("value"))
    return text.select(F.from_json("value", schema).alias("c")).select("c.*")


def rule(rows: DataFrame, key: Column, broken: Column, name: str) -> DataFrame:
    return rows.where(broken).select(key.cast("string").alias("key"), F.lit(name).alias("rule"))


def sources(listed: DataFrame, priorities: list[str] | None, hosts: list[str], suffixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sources of these priorities, violations): a repeated doc_id, a host outside the list."""
    rows = listed.select(F.explode("sources").alias("s")).select("s.*")
    twice = rows.groupBy("doc_id").count().where("count > 1")
    bad = rule(twice, F.col("doc_id"), F.lit(True), "repeated_doc_id").unionByName(rule(rows, F.col("doc_id"), ~host_allowed(F.col("url"), hosts, suffixes), "host_not_allowed"))
    return rows if priorities is None else rows.where(F.col("priority").isin(priorities)), bad


def no_source(evidence: Column) -> Column:
    return ~F.exists(F.coalesce(evidence, F.array().cast(EVIDENCE)), lambda e: F.coalesce(e["source_url"], F.lit("")) != "")


def glossary(spark: SparkSession, path: str, langs: list[str]) -> DataFrame:
    """ord, code, ko, category, labels (map of the languages that have one), note of a glossary's CSV file."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("ord", F.monotonically_increasing_id())
    held = [c for c in langs if c in rows.columns and c != "ko"]
    empty = F.create_map().cast("map<string,string>")
    labels = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, held)), F.array(*(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in held))), lambda _, v: v != "") if held else empty
    note = F.trim(F.coalesce(F.col("note"), F.lit(""))) if "note" in rows.columns else F.lit("")
    return rows.select("ord", *(F.trim(c).alias(c) for c in ("code", "ko", "category")), labels.alias("labels"), note.alias("note"))


def matrix(c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(institutions, visa rules, violations) of a matrix: an unknown state, a confirmed state without a source, a repeated code."""
    inst = c.select("updated_at", F.posexplode("institutions").alias("ord", "i")).select("ord", "updated_at", "i.*")
    rules = inst.select("inst_code", F.explode_outer("visa_rules").alias("r")).where("r is not null").select("inst_code", "r.*")
    inst = inst.drop("visa_rules")
    key = F.concat_ws("/", "inst_code", "visa_code")
    bad = [
        rule(inst, F.col("inst_code"), ~F.col("status").isin(*STATES), "unknown_state"), rule(rules, key, ~F.col("account_open").isin(*STATES), "unknown_state"),
        rule(inst, F.col("inst_code"), (F.col("status") == "official") & no_source(F.col("evidence")), "no_evidence"), rule(rules, key, (F.col("account_open") == "official") & no_source(F.col("evidence")), "no_evidence"),
        rule(inst.groupBy("inst_code").count(), F.col("inst_code"), F.col("count") > 1, "repeated_code"),
    ]
    return inst, rules, _all(bad)


def checklist(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections by kind and key, violations): kind is base, account_opening (key: purpose) or foreign_registration (key: visa)."""
    keyed = lambda kind, by: c.select(F.lit(kind).alias("kind"), F.col(f"{kind}.caveat_ko"), F.col(f"{kind}.caveat_i18n"), F.explode_outer(f"{kind}.{by}").alias("key", "b")).where("b is not null")
    base = c.select(F.lit("base").alias("kind"), F.lit(None).cast("string").alias("caveat_ko"), F.lit(None).cast("map<string,string>").alias("caveat_i18n"), F.lit("").alias("key"), F.col("base").alias("b"))
    rows = base.unionByName(keyed("account_opening", "by_purpose")).unionByName(keyed("foreign_registration", "by_visa"))
    rows = rows.select("kind", "key", "caveat_ko", "caveat_i18n", "b.*").withColumn("status", F.coalesce("status", F.lit("unknown")))
    key = F.concat_ws("/", "kind", "key")
    return rows, _all([rule(rows, key, ~F.col("status").isin(*STATES), "unknown_state"), rule(rows, key, (F.col("status") == "official") & no_source(F.col("evidence")), "no_evidence")])


def scam(c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(types, steps, contacts, violations): every type and contact needs a source."""
    types, steps, contacts = (c.select(F.posexplode(x).alias("ord", "t")).select("ord", "t.*") for x in ("types", "response_steps", "contacts"))
    return types, steps, contacts, _all([rule(x, F.col("code"), no_source(F.col("evidence")), "no_evidence") for x in (types, contacts)])


def limits(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(limits by name, violations): what is known has a source and a value, what is unknown has no value."""
    rows = c.select(F.explode("limits").alias("name", "l")).select("name", "l.*")
    known = F.col("status") != "unknown"
    return rows, _all([
        rule(rows, F.col("name"), ~F.col("status").isin(*STATES), "unknown_state"), rule(rows, F.col("name"), known & no_source(F.col("evidence")), "no_evidence"),
        rule(rows, F.col("name"), known & F.col("value").isNull(), "no_value"), rule(rows, F.col("name"), ~known & F.col("value").isNotNull(), "value_of_unknown"),
    ])


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def manifest_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, line): a manifest's entries as JSON with sorted field names, in key order."""
    fields = sorted(c for c in rows.columns if c != key)
    return rows.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")).orderBy(key)


def reports(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Report files, one JSON object each, with their file's name."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?\z", 1))


def best_decoding(raw: bytes) -> str:
    """A page's text by the charset, of those that it declares, UTF-8 and CP949, that leaves the fewest broken characters; the first of equals."""
    declared = re.findall(r"charset=[\"']?\s*([\w-]+)", raw[:DECLARED].decode("ascii", "ignore").lower())

    def read(name: str) -> str | None:
        try:
            return raw.decode(name, "replace")
        except LookupError:
            return None

    texts = (t for t in map(read, dict.fromkeys([*declared, "utf-8", "cp949"])) if t is not None)
    return min(texts, key=lambda t: t.count("�"))


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else best_decoding(bytes(b)))


def converted(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """name, sha256, matches, text: files (name, content) of old encodings as UTF-8 text with plain line
    breaks, their bytes' hash held against the pinned one (null: none is pinned)."""
    rows = files.select("name", F.sha2("content", 256).alias("sha256"), F.regexp_replace(decoded("content"), r"\r\n?", "\n").alias("text"))
    return rows.join(pinned.select("name", F.col("sha256").alias("pinned")), "name", "left").select("name", "sha256", (F.col("pinned") == F.col("sha256")).alias("matches"), "text")
