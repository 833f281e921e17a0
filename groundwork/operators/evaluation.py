"""Evaluation of answered question sets: conditional ratios, grouped breakdowns, sweeps, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import lower
from groundwork.operators.ordered import ranks_of, running_sums


def percent(hits: Column, of: Column) -> Column:
    """Share in per cent with one decimal; null where nothing was counted."""
    return F.when(of > 0, F.round(100.0 * hits / of, 1))


def nearest_rank(value: Column, share: float) -> Column:
    """The value at place int(n * share) of the sorted values, without interpolation; nulls do not count."""
    ordered = F.array_sort(F.collect_list(value))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) * share) + 1).cast("int"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of groups of any size: equal values are counted, then summed up over ranges of values."""
    return ranks_of(rows, by, value, shares)


def scored(outcomes: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The metric set for each grouping set (an empty one: all rows), in one pass.

    Columns: error, fallback_reason, should_fallback, expected_fallback, n_refs, gold (array),
    retrieved (array of chunk ids), tier, expected_tier, unsupported (array), latency_ms.
    """
    ok = F.col("error").isNull()
    fell = F.col("fallback_reason").isNotNull()
    normal, trap = ok & ~F.col("should_fallback"), ok & F.col("should_fallback")
    answered = ok & ~fell
    recall = F.arrays_overlap("gold", F.array_distinct(F.transform(F.slice("retrieved", 1, 5), lambda x: F.split_part(x, F.lit("#"), F.lit(1)))))
    gold = normal & (F.size("gold") > 0)
    expected = trap & F.col("expected_fallback").isNotNull()
    n = F.count_if
    names = sorted({c for s in sets for c in s})
    rows = outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *names) if names else outcomes.groupBy()
    return rows.agg(
        F.count("*").alias("n_total"), n(ok).alias("n_scored"), n(~ok).alias("n_error"),
        percent(n(answered & (F.col("n_refs") > 0)), n(answered)).alias("citation_rate"),
        percent(n(gold & recall), n(gold)).alias("recall_at_5"),
        percent(n(trap & fell), n(trap)).alias("fallback_accuracy"),
        percent(n(normal & fell), n(normal)).alias("over_fallback"),
        percent(n(expected & (F.col("fallback_reason") == F.col("expected_fallback"))), n(expected)).alias("reason_match"),
        percent(n(answered & (F.size("unsupported") == 0)), n(answered)).alias("number_accuracy"),
        percent(n(answered & (F.col("tier") == F.col("expected_tier"))), n(answered)).alias("tier_match"),
    )


def swept(rows: DataFrame, group: str, score: str, outside: str) -> DataFrame:
    """(group, threshold, over, caught): for every midpoint between neighbouring scores, the share of
    inside rows below it and of outside rows below it.

    Shares come from running sums over each distinct score, not from thresholds joined to rows.
    """
    points = rows.groupBy(group, score).agg(F.count_if(~F.col(outside)).alias("n_in"), F.count_if(outside).alias("n_out"), F.lit(1).alias("one"))
    sums = running_sums(points, [group], [score], {"in_upto": "n_in", "out_upto": "n_out", "place": "one"})
    whole = points.groupBy(group).agg(F.sum("n_in").alias("in_all"), F.sum("n_out").alias("out_all"))
    following = sums.select(group, (F.col("place") - 1).alias("place"), F.col(score).alias("following"))
    out = sums.join(following, [group, "place"]).join(whole, group).select(
        group, F.round((F.col(score) + F.col("following")) / 2, 6).alias("threshold"), percent(F.col("in_upto"), F.col("in_all")).alias("over"), percent(F.col("out_upto"), F.col("out_all")).alias("caught"),
    )
    return out.where("threshold is not null")


def recalibrated(sweep: DataFrame, group: str, most: float) -> DataFrame:
    """Of each group the threshold that catches most with `over` at most `most`, fewest over, lowest threshold."""
    order = Window.partitionBy(group).orderBy(F.desc("caught"), "over", "threshold")
    return sweep.where(F.col("over") <= most).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def calibration(rows: DataFrame, group: str, score: str, outside: str) -> DataFrame:
    """least inside score, largest outside score, their gap, and the midpoint where there is a gap."""
    out = rows.groupBy(group).agg(F.min(F.when(~F.col(outside), F.col(score))).alias("least_inside"), F.max(F.when(F.col(outside), F.col(score))).alias("most_outside"))
    gap = F.round(F.col("least_inside") - F.col("most_outside"), 4)
    return out.withColumn("gap", gap).withColumn("midpoint", F.when(gap > 0, F.round((F.col("least_inside") + F.col("most_outside")) / 2, 3)))


def violations(golden: DataFrame, corpus: DataFrame, langs: list[str]) -> DataFrame:
    """(qid, rule) of rows that break a rule: blank question, unknown language, repeated qid, gold not in
    the corpus, gold on a row that should fall back."""
    rows = [
        golden.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("qid", F.lit("blank_question").alias("rule")),
        golden.where(~F.coalesce(F.col("lang").isin(langs), F.lit(False))).select("qid", F.lit("unknown_lang").alias("rule")),
        golden.groupBy("qid").count().where("count > 1").select("qid", F.lit("repeated_qid").alias("rule")),
        golden.select("qid", F.explode("gold").alias("doc_id")).join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("qid", F.lit("gold_missing").alias("rule")).distinct(),
        golden.where(F.col("should_fallback") & (F.size("gold") > 0)).select("qid", F.lit("gold_on_fallback").alias("rule")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def answered(outcomes: DataFrame) -> Column:
    return F.col("error").isNull() & F.col("fallback_reason").isNull()


def reason_histogram(outcomes: DataFrame) -> DataFrame:
    """(reason, n) of normal questions that fell back, most frequent first."""
    over = outcomes.where(F.col("error").isNull() & ~F.col("should_fallback") & F.col("fallback_reason").isNotNull())
    return over.groupBy(F.col("fallback_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def fact_coverage(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """coverage, of: the mean, over answered questions with facts, of the share of them that the answer holds in any letter case, compared letter for letter."""
    held = F.size(F.filter("gold_facts", lambda f: F.contains(lower(F.col("answer")), lower(f)))) / F.size("gold_facts")
    rows = outcomes.where(answered(outcomes) & (F.size("gold_facts") > 0))
    return rows.groupBy(*by).agg(F.round(100 * F.avg(held), 1).alias("coverage"), F.count("*").alias("of"))


def forbidden_hits(outcomes: DataFrame, first: int = 10) -> DataFrame:
    """hits, items: how often an answer holds a fact that it must not hold, letter by letter, and the first of these."""
    hits = outcomes.where(F.col("error").isNull()).select("qid", F.posexplode("forbidden_facts").alias("at", "fact"), "answer").where("fact <> '' and contains(answer, fact)")
    ranked = hits.orderBy("qid", "at").limit(first)
    items = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("qid", "at", "fact"))), lambda x: F.concat_ws(":", x["qid"].cast("string"), x["fact"])).alias("items"))
    return hits.agg(F.count("*").alias("hits")).join(items, how="inner", on=F.lit(True))


def language_match(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """matched, of: answers in the language asked for, among those of which that can be told."""
    from groundwork.functions.text import in_language

    rows = outcomes.where(answered(outcomes)).withColumn("_ok", in_language(F.col("answer"), F.col("lang")))
    return rows.groupBy(*by).agg(percent(F.count_if("_ok"), F.count("_ok")).alias("matched"), F.count("_ok").alias("of"))


def token_usage(outcomes: DataFrame) -> DataFrame:
    """Sums of tokens over generated answers, the share that hit the cache, how often a fallback model was used, and the models."""
    rows = outcomes.where(F.col("generated") & (F.col("input_tokens") > 0))
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    models = F.array_join(F.array_sort(F.collect_set(F.nullif("model", F.lit("")))), ",")
    return rows.agg(F.count("*").alias("n_generated"), percent(F.count_if(F.col("cache_read_tokens") > 0), F.count("*")).alias("cache_hit_rate"), *sums, F.count_if("llm_fallback_used").alias("model_fallback_used"), models.alias("models"))


def trap_breakdown(outcomes: DataFrame) -> DataFrame:
    """evades, caught, hit, of: of traps without error, those that the rules' patterns do and do not catch."""
    traps = outcomes.where((F.col("category") == "tier_c_trap") & F.col("error").isNull() & F.col("evades").isNotNull())
    hit = F.count_if(F.col("fallback_reason").isNotNull())
    return traps.groupBy("evades").agg(percent(hit, F.count("*")).alias("caught"), hit.alias("hit"), F.count("*").alias("of"))


def selected(golden: DataFrame, langs: list[str] | None, categories: list[str] | None, limit: int | None, order: str) -> DataFrame:
    """The questions of these languages and categories, the first so many in order: what a run is asked to do."""
    rows = golden
    for column, wanted in (("lang", langs), ("category", categories)):
        rows = rows if wanted is None else rows.where(F.col(column).isin(wanted))
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def mixed_systems(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(column, values) of the columns that hold more than one value, where a comparison asks for one system."""
    each = outcomes.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in by))).alias("x")).select("x.*").where("value is not null").distinct()
    return each.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"), F.count("*").alias("n")).where("n > 1").drop("n")


def failures(outcomes: DataFrame, first: int = 10) -> DataFrame:
    """The first questions, by qid, that went wrong, and how: an error, a trap answered, a normal one blocked, a wrong reason."""
    fell = F.col("fallback_reason").isNotNull()
    how = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("should_fallback") & ~fell, "trap_answered").when(~F.col("should_fallback") & fell, "blocked")
        .when(F.col("should_fallback") & F.col("expected_fallback").isNotNull() & (F.col("expected_fallback") != F.col("fallback_reason")), "wrong_reason")
    )
    return outcomes.select("qid", how.alias("how")).where("how is not null").orderBy("qid").limit(first)


def progress(partial: DataFrame, total: int) -> DataFrame:
    """done, left, per_minute, minutes_left of a run's partial rows (finished_at), and its counts by language and by reason as maps."""
    span = (F.unix_seconds(F.max("finished_at")) - F.unix_seconds(F.min("finished_at"))) / 60
    counts = lambda c: partial.groupBy(F.coalesce(c, F.lit("none")).alias("k")).agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws("=", x["k"], x["n"])), " ").alias(f"by_{c}"))
    one = partial.agg(F.count("*").alias("done"), (total - F.count("*")).alias("left"), F.when(span > 0, F.round(F.count("*") / span, 2)).alias("per_minute"))
    one = one.withColumn("minutes_left", F.when(F.col("per_minute") > 0, F.round(F.col("left") / F.col("per_minute"), 1)))
    return one.join(counts("lang"), how="inner", on=F.lit(True)).join(counts("fallback_reason"), how="inner", on=F.lit(True))


def summary_line() -> Column:
    """The metrics of a row of `scored` in one line; what was not measured is a dash."""
    shown = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0\z", ""), F.lit("—"))
    names = (("cited", "citation_rate"), ("recall@5", "recall_at_5"), ("fallback", "fallback_accuracy"), ("over", "over_fallback"), ("numbers", "number_accuracy"), ("tier", "tier_match"))
    return F.concat_ws(" · ", *(F.concat(F.lit(f"{label} "), shown(c), F.lit("%")) for label, c in names))


def uncalibrated(sweep: DataFrame, group: str, known: list[str]) -> DataFrame:
    """One row, one array: the groups seen for which no threshold is set, sorted."""
    return sweep.agg(F.array_sort(F.array_except(F.collect_set(group), F.array(*map(F.lit, known)))).alias("missing"))


def metric_series(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, ord, name, value, is_last): a line for each metric over the reports, its last known point marked; what a report lacks stays null."""
    long = reports.select("ord", "name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("ord", "name", "x.*")
    last = F.max(F.when(F.col("value").isNotNull(), F.col("ord"))).over(Window.partitionBy("metric"))
    return long.withColumn("is_last", F.coalesce(F.col("ord") == last, F.lit(False)))


def pivoted(rows: DataFrame, line: str, column: str, names: list[str], value: str) -> DataFrame:
    """A row for each line, a column for each of the names; what was not measured is null, never 0."""
    return rows.groupBy(line).pivot(column, names).agg(F.first(value))


def distribution(outcomes: DataFrame, by: list[str], score: str, shares: dict[str, float]) -> DataFrame:
    """n and nearest-rank quantiles of a score by group: counts of each value, then running counts, no group's rows in one place."""
    points = outcomes.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*by).orderBy(score)
    ranked = points.withColumns({"upto": F.sum("k").over(upto), "n": F.sum("k").over(Window.partitionBy(*by))})
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col(score))).alias(name) for name, s in shares.items()))
