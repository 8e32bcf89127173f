"""Named queries over a folder of test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from echotide.functions import issues as issue_rules, sentiment
from echotide.functions.text import excerpt
from echotide.operators import aggregates, churn, contracts, dashboards, drilldown, enrich, insights, quality
from echotide.operators import report_store, reports, scope as scopes, trends
from echotide.operators.merge import upsert
from echotide.operators.scope import Scope
from echotide.plans import incremental, pipeline
from echotide.sources import review_files
from echotide.sources.event_reviews import (
    HEADER_SPELLINGS, complaint_documents, edited_reviews, event_review_texts, event_reviews, events,
)
from echotide.tables import read_table, stage, stage_csv, stage_folder

Query = Callable[[SparkSession, str], DataFrame]

WEEK = Scope.of("2024-01-10", "2024-01-20")
FAILURES = Scope.of("2024-01-10", "2024-01-20", issue_label="transaction failure")
NARROW = Scope.of("2024-01-05", "2024-01-25", category="Other", version="5.3.0", issue_label="Login/Auth Issues")
COMPETITORS = ["bank", "otp", "dark mode", "slowbank"]


def _source(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_files.latest_per_review(event_reviews(spark, sf_dir))


def staged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_files.combine(event_review_texts(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored enriched reviews, one folder per day."""
    return stage(spark, _source(sf_dir), "reviews_enriched", lambda: enrich.enrich(deduped(spark, sf_dir)), "day")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, _source(sf_dir), "daily_aggregates", lambda: dashboards.daily_aggregates(enriched(spark, sf_dir))
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, _source(sf_dir), "version_aggregates", lambda: aggregates.version_kpis(enriched(spark, sf_dir))
    )


def _on(table: Query, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir))


def _in_week(df: DataFrame) -> DataFrame:
    return WEEK.apply(df)


# -- ingest ---------------------------------------------------------------------------------

def ingest_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text sources written as CSV files, read back, cast and deduplicated."""
    sources = event_review_texts(spark, sf_dir)
    folders = {n: stage_csv(spark, _source(sf_dir), f"csv_{n}", df) for n, df in sources.items()}
    read = {n: review_files.scan_csv(spark, folder) for n, folder in folders.items()}
    return review_files.latest_per_review(review_files.combine(read))


def ingest_repeated_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with two rating columns, of which the later one counts."""
    source = event_review_texts(spark, sf_dir)["average"].select(F.lit("1").alias("Score!"), "*")
    folder = stage_csv(spark, _source(sf_dir), "csv_repeated", source)
    return review_files.combine({"average": review_files.scan_csv(spark, folder)})


def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources stored first, the third one merged into them."""
    sources = event_review_texts(spark, sf_dir)
    latest = review_files.latest_per_review
    stored = latest(review_files.combine({n: sources[n] for n in ("average", "bad")}))
    return upsert(stored, latest(review_files.combine({"good": sources["good"]})), "review_id")


def batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two sources; then the third one with edits of the first two: other days and versions, replaced rows, rows without an id."""
    sources = event_review_texts(spark, sf_dir)
    first = review_files.combine({n: sources[n] for n in ("average", "bad")})
    second = review_files.combine({"good": sources["good"]})
    return [first, second.unionByName(edited_reviews(spark, sf_dir).withColumn("source", F.lit("edits")))]


def applied(spark: SparkSession, sf_dir: str) -> str:
    """The folder of tables that both batches were applied to, one after the other."""

    def fill(root: str) -> None:
        for number, batch in enumerate(batches(spark, sf_dir)):
            incremental.apply_batch(spark, root, number, batch, buckets=2)

    return stage_folder(spark, _source(sf_dir), "incremental", fill)


def _applied(read: Callable[[SparkSession, str], DataFrame], shape: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: shape(read(spark, applied(spark, sf_dir)))


def ingest_header_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled cells per source and target column, whatever the headers were called."""
    staged = staged_texts(spark, sf_dir)
    columns = [c for c in staged.columns if c != "source"]
    counts = staged.groupBy("source").agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot("source", columns, "target_column", "filled")


# -- enrichment -----------------------------------------------------------------------------

def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.normalize(deduped(spark, sf_dir))


def _with_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.add_sentiment(_normalized(spark, sf_dir))


def _with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.add_issues(_normalized(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside sentiment verdicts for some reviews, derived from the events."""
    e = F.col("event_id")
    label = F.when(e % 3 == 0, "negative").when(e % 3 == 1, "neutral").otherwise("positive")
    return events(spark, sf_dir).filter((e % 5 == 0) & (e % 50 != 49)).select(
        F.concat(F.lit("r"), e.cast("string")).alias("review_id"), label.alias("label"),
        ((e % 40 + 55) / 100.0).alias("confidence"),
    )


def sentiment_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = enrich.combine_verdicts(_with_sentiment(spark, sf_dir), _verdicts(spark, sf_dir))
    return combined.select(
        "review_id", "sentiment_label", F.round("sentiment_confidence", 6).alias("sentiment_confidence"),
        "sentiment_method",
    )


def sentiment_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_sentiment(spark, sf_dir)
    lexicon = sentiment.lexicon_score(F.col("content"))
    needed = sentiment.needs_review(F.col("content"), F.col("score"), F.col("sentiment_confidence"), lexicon)
    return df.select("review_id", needed.cast("int").alias("adjudicate"))


def issue_labels_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read from issue JSON of several shapes, built from the event types."""
    e, kind = F.col("event_id"), F.col("event_type")
    shape = (
        F.when(e % 6 == 0, F.concat(F.lit('[{"label":"'), kind, F.lit('"},{"label":" B "}]')))
        .when(e % 6 == 1, F.concat(F.lit('["'), kind, F.lit('", "", "Second"]')))
        .when(e % 6 == 2, F.concat(F.lit('{"label":"'), kind, F.lit('","confidence":0.6}')))
        .when(e % 6 == 3, F.concat(F.lit('[{"label":"'), kind))
        .when(e % 6 == 4, F.concat(F.lit('[1, {"label":5}, null, {"other":"x"}, "'), kind, F.lit('"]')))
    )
    labels = issue_rules.labels_from_json(shape)
    return events(spark, sf_dir).select("event_id", F.posexplode(labels).alias("position", "label"))


# -- aggregates -----------------------------------------------------------------------------

def _daily_scalars(df: DataFrame) -> DataFrame:
    return df.select("day", "total_reviews", "avg_rating", "pct_negative", "pct_positive", "critical_count")


def _daily_full(df: DataFrame) -> DataFrame:
    return df.select(
        "day", "total_reviews", "avg_rating", "pct_negative", "pct_positive", "critical_count", "churn_high_users",
        F.size("top_issues").alias("issues_listed"), F.size("anomaly_flags").alias("flags"),
    )


def _version_scalars(df: DataFrame) -> DataFrame:
    return df.select(
        "app_version", "first_seen_day", "last_seen_day", "total_reviews", "avg_rating", "pct_negative",
        "critical_count", F.size("issue_breakdown").alias("issues_listed"),
        F.size("category_breakdown").alias("categories_listed"),
    )


def _issue_rows(df: DataFrame, *columns: str) -> DataFrame:
    return issue_rules.issue_rows(df, "review_id").select("review_id", *columns)


def _latest_issue_days(df: DataFrame) -> DataFrame:
    return aggregates.latest_issue_days(df).select("day", F.posexplode("top_issues").alias("position", "i")).select(
        "day", "position", "i.label", "i.review_count", "i.weighted_severity"
    )


# -- drilldown ------------------------------------------------------------------------------

def search_reviews_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows a given position."""
    position = (date(2024, 1, 15), 0.5, "r5")
    return drilldown.search_reviews(enriched(spark, sf_dir), WEEK, page_size=40, after=position).withColumn(
        "sort_severity", F.round("sort_severity", 6)
    )


def overview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the overview shows of a week, as (section, position, item, value) rows."""
    parts = dashboards.overview(daily(spark, sf_dir), WEEK)
    kpis = parts["kpis"]
    metrics = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in kpis.columns])
    trend = F.array(*[F.struct(F.concat(F.col("day").cast("string"), F.lit(f":{m}")).alias("item"), F.col(m).cast("double").alias("value"))
                      for m in ("avg_rating", "pct_negative", "critical_count")])
    sections = [
        kpis.select(F.lit("kpi").alias("section"), F.inline(metrics)), parts["trend"].select(F.lit("trend").alias("section"), F.inline(trend)),
        parts["top_issues"].select(F.lit("issue").alias("section"), F.col("issue_label").alias("item"),
                                   F.col("weighted_severity").alias("value")),
    ]
    return reduce(DataFrame.unionByName, sections).withColumn("value", F.round("value", 4))


def drilldown_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a scope and its quotes, as (section, place, review_id, text) rows."""
    parts = dashboards.drilldown(enriched(spark, sf_dir), NARROW, page_size=10)
    order = Window.orderBy(F.desc_nulls_last("day"), F.desc("severity_score"), "review_id")
    listed = parts["rows"].select(F.lit("row").alias("section"), F.row_number().over(order).alias("place"), "review_id",
                                  F.col("content").alias("text"))
    return listed.unionByName(parts["quotes"].select(F.lit("quote").alias("section"), F.col("rank").alias("place"), "review_id",
                                                     F.col("quote").alias("text")))


def scheduled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that a run stores for a scope, when the brief already is stored."""
    reviews, days = enriched(spark, sf_dir), daily(spark, sf_dir)
    stored = reports.stored_reports(pipeline.brief_report(reviews, days, WEEK))
    fresh = pipeline.missing_reports(reviews, days, stored, WEEK)
    return fresh.select("report_type", "scope_json", "hash_key", "model")


def scope_default_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of the default window, whose bounds are found in the same plan."""
    reviews = enriched(spark, sf_dir)
    window = scopes.default_window(daily(spark, sf_dir))
    start, end = window.select("start_day").scalar(), window.select("end_day").scalar()
    return aggregates.kpi_snapshot(reviews.filter((F.col("day") >= start) & (F.col("day") <= end)))


# -- reports --------------------------------------------------------------------------------

def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_payload(enriched(spark, sf_dir), daily(spark, sf_dir), WEEK, "weekly_exec_brief")


def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload as rows: section, position, and its main text and number."""
    kpi = F.col("kpi_snapshot")

    def section(name: str, items: F.Column, text, number) -> F.Column:
        return F.transform(items, lambda x, i: F.struct(
            F.lit(name).alias("section"), (i + 1).alias("position"), text(x).alias("text"),
            number(x).cast("double").alias("number"),
        ))

    rows = F.concat(
        section("kpi", F.array(*[
            F.struct(F.lit(n).alias("t"), kpi[n].cast("double").alias("n"))
            for n in ("total_reviews", "avg_rating", "pct_negative", "critical_count")
        ]), lambda x: x["t"], lambda x: x["n"]),
        section("issue", F.col("top_issues"), lambda x: x["label"], lambda x: x["weighted_severity"]),
        section("evidence", F.col("evidence_reviews"), lambda x: x["quote"], lambda x: x["severity_score"]),
        section("flag", F.col("anomaly_flags"), lambda x: x["metric"], lambda x: x["z_score"]),
    )
    return _payload(spark, sf_dir).select(F.inline(rows))


def weekly_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief as rows: field and text."""
    b = F.col("brief")

    def row(field: str, text: F.Column) -> F.Column:
        return F.struct(F.lit(field).alias("field"), text.cast("string").alias("text"))

    single = F.array(row("headline", b["headline"]), row("week_range", b["week_range"]))
    drivers = F.transform(b["drivers"], lambda d, i: F.struct(
        F.concat(F.lit("driver"), i.cast("string")).alias("field"),
        F.concat_ws("|", d["title"], d["impact"], d["evidence_quotes"]).alias("text"),
    ))
    risks = F.transform(b["risks"], lambda r, i: F.struct(
        F.concat(F.lit("risk"), i.cast("string")).alias("field"),
        F.concat_ws("|", r["risk"], r["signal"], r["severity"]).alias("text"),
    ))
    recommendations = F.transform(b["recommendations"], lambda r, i: F.struct(
        F.concat(F.lit("action"), i.cast("string")).alias("field"),
        F.concat_ws("|", r["action"], r["owner"], r["expected_impact"]).alias("text"),
    ))
    brief = reports.weekly_brief(_payload(spark, sf_dir))
    return brief.select(F.inline(F.concat(single, drivers, risks, recommendations)))


def _day_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored KPI report per day; some break the contract on purpose."""
    n = F.dayofmonth("day")
    content = F.to_json(F.struct(
        F.when(n % 5 == 1, F.col("day").cast("string"))
        .otherwise(F.concat(F.col("day").cast("string"), F.lit(".."), F.col("day").cast("string"))).alias("week_range"),
        F.when(n % 5 == 2, "").otherwise("Daily health").alias("headline"),
        F.struct(
            F.col("avg_rating").alias("avg_rating"), F.col("pct_negative").alias("pct_negative"),
            F.when(n % 7 != 3, F.col("critical_count")).alias("critical_count"),
        ).alias("kpi_summary"),
        F.transform("top_issues", lambda i: F.struct(
            i["label"].alias("title"),
            F.when(n % 5 == 4, "huge").otherwise(insights.impact(i["weighted_severity"])).alias("impact"),
            F.array(F.lit("quote")).alias("evidence_quotes"),
        )).alias("drivers"),
        F.array().cast("array<string>").alias("risks"),
        F.array().cast("array<string>").alias("recommendations"),
        F.when(n % 11 == 5, "x").alias("extra"),
    ))
    scope = F.struct(
        F.col("day").cast("string").alias("start_date"), F.col("day").cast("string").alias("end_date"),
        F.lit("Ünïcode \"q\" 😀/").alias("category"), F.lit("").alias("version"), F.lit("").alias("issue_label"),
    )
    return reports.stored_reports(daily(spark, sf_dir).filter(F.col("day").isNotNull()).select(
        F.lit("weekly_exec_brief").alias("report_type"), scope.alias("scope"),
        F.when(n % 13 == 6, F.concat(content, F.lit("}"))).otherwise(content).alias("content_json"),
    ))


def report_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_reports(spark, sf_dir).select("report_type", "scope_json", "hash_key")


def report_cache_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports still to be stored when those up to the middle of the month already are."""
    found = _day_reports(spark, sf_dir)
    start = F.get_json_object("scope_json", "$.start_date")
    fresh = reports.only_new(found.unionByName(found), found.filter(start <= "2024-01-15"))
    return fresh.select(start.alias("start_date"), "hash_key")


def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of a week, asked for twice: stored by the first request, returned by the second, whose own text is not used."""

    def build(note: str) -> DataFrame:
        brief = pipeline.brief_report(enriched(spark, sf_dir), daily(spark, sf_dir), WEEK)
        return brief.withColumn("content_json", F.concat("content_json", F.lit(note)))

    def fill(root: str) -> None:
        for note in ("", "again"):
            report_store.report_for(spark, root, "weekly_exec_brief", WEEK, lambda: build(note))

    root = stage_folder(spark, _source(sf_dir), "reports", fill)
    found = report_store.report_for(spark, root, "weekly_exec_brief", WEEK, lambda: build("third"))
    return found.select("report_type", "scope_json", "hash_key", F.get_json_object("content_json", "$.headline").alias("headline"))


def report_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = contracts.check_reports(_day_reports(spark, sf_dir))
    # The text of a broken document cannot be searched as JSON, so the day comes from the scope.
    return checked.select(
        F.get_json_object("scope_json", "$.start_date").alias("start_date"),
        F.array_join("violations", ",").alias("violations"),
    )


def _backlogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One backlog per label, with some fields left out, null or of the wrong type."""
    candidates = insights.backlog_candidates(enriched(spark, sf_dir))
    ticket = F.struct(
        "title", "type", "priority", "severity_score",
        F.concat(F.col("review_count").cast("string"), F.lit(" reviews")).alias("impact_notes"),
        F.array(F.lit("No new reports for a week")).alias("acceptance_criteria"),
        "evidence_quotes", F.array("label").alias("related_labels"), "related_versions",
        F.when(F.col("priority") == "P0", "  ").otherwise(" Ana ").alias("owner"),
        F.lit("Bo").alias("assignee"), F.col("review_count").alias("story_points"), F.lit(2.5).alias("estimate"),
    )
    body = F.to_json(ticket)
    return candidates.select(
        "label",
        F.concat(F.lit('{"tickets":['), body, F.lit(',"skip me",{"severity_score":"n/a","effort":"1.5"},7,'), body,
                 F.lit("]}")).alias("content_json"),
    )


def report_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored backlog report of all reviews, read back from its JSON."""
    report = pipeline.backlog_report(enriched(spark, sf_dir), daily(spark, sf_dir), Scope())
    texts, lists = ("title", "type", "priority", "impact_notes"), ("evidence_quotes", "related_labels", "related_versions")
    fields = [f"{c}: string" for c in texts] + [f"{c}: array<string>" for c in lists] + ["severity_score: double"]
    schema = f"tickets array<struct<{', '.join(fields)}>>"
    read = report.select(F.inline(F.from_json("content_json", schema)["tickets"]))
    return read.select(*texts, "severity_score", *[F.array_join(c, "|").alias(c) for c in lists])


def _ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.ticket_rows(_backlogs(spark, sf_dir), "label")


def _ticket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.ticket_board_totals(_backlogs(spark, sf_dir), "label")


def _exec_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exec_kpi_table(reports.weekly_brief(_payload(spark, sf_dir)))


# -- quality and long texts -----------------------------------------------------------------

def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in hand labels for some reviews, derived from the events."""
    e = F.col("event_id")
    return events(spark, sf_dir).filter((e % 4 == 0) & (e % 50 != 49)).select(
        F.concat(F.lit("r"), e.cast("string")).alias("review_id"),
        F.when(e % 3 == 0, "negative").when(e % 3 == 1, "neutral").otherwise("positive").alias("gold_sentiment"),
        F.when(e % 8 == 0, "Transaction Failure, Login/Auth Issues").otherwise("performance issues")
        .alias("gold_issue_labels"),
        F.when(e % 5 == 0, "critical").otherwise("med").alias("gold_severity_band"),
    )


def golden_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.golden_scores(enriched(spark, sf_dir), _golden(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def document_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon over long texts."""
    lexicon = sentiment.lexicon_score(F.col("text"))
    return _documents(spark, sf_dir).select(
        "doc_id", lexicon.alias("lexicon_score"),
        sentiment.label_of(sentiment.signal(F.lit(0.0), lexicon)).alias("sentiment_label"),
        sentiment.word_count(F.col("text")).cast("bigint").alias("words"),
    )


def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of long texts around a label word."""
    return _documents(spark, sf_dir).select("doc_id", excerpt(F.col("text"), "the tion ering").alias("quote"))


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue rules and the severity score over long texts in four languages, review sentences around them."""
    documents = complaint_documents(_documents(spark, sf_dir)).select(
        "doc_id", "content", F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("thumbs_up"),
    )
    scored = enrich.add_severity(enrich.add_issues(enrich.add_sentiment(documents)))
    return scored.select(
        "doc_id", F.array_join(issue_rules.labels_of(F.col("issues")), ", ").alias("issues"),
        F.round("severity_score", 6).alias("severity_score"), "severity_band",
    )


def catalog() -> dict[str, Query]:
    return {
        "ingest_stage_cast": staged_texts,
        "ingest_header_alias": ingest_header_alias,
        "ingest_csv_scan": ingest_csv_scan,
        "ingest_repeated_header": ingest_repeated_header,
        "ingest_dedupe_latest": deduped,
        "ingest_counters": _on(staged_texts, lambda d: review_files.ingest_counters(d, list(HEADER_SPELLINGS))),
        "ingest_upsert": ingest_upsert,
        "upsert_incremental": _applied(lambda s, root: incremental.read_reviews(s, root, "reviews_raw"), lambda d: d),
        "enriched_churn": _applied(incremental.read_reviews, lambda d: d.select(
            "review_id", "day", "content", F.round("severity_score", 6).alias("severity_score"), "churn_user_score", "churn_user_tier")),
        "daily_incremental": _applied(lambda s, root: read_table(s, root, "daily_aggregates"), _daily_full),
        "daily_incremental_issues": _applied(lambda s, root: read_table(s, root, "daily_aggregates"), lambda d: d.select(
            "day", F.posexplode("top_issues").alias("position", "i")).select("day", "position", "i.*")),
        "version_incremental": _applied(lambda s, root: read_table(s, root, "version_aggregates"), _version_scalars),
        "version_incremental_issues": _applied(lambda s, root: read_table(s, root, "version_aggregates"), trends.issue_shares),
        "churn_incremental": _applied(incremental.churn_table, lambda d: d),
        "run_counts": _applied(lambda s, root: read_table(s, root, "run_counts"), lambda d: d),
        "filter_options_facets": _applied(incremental.facets, drilldown.listed_options),
        "normalize_content": _on(_normalized, lambda d: d.select("review_id", "content", "day", "category_taxonomy")),
        "category_taxonomy": _on(_normalized, lambda d: d.groupBy("category_raw", "category_taxonomy").count()
                                 .withColumnRenamed("count", "review_count")),
        "normalize_summary": _on(_normalized, enrich.normalize_summary),
        "sentiment_rule": _on(_with_sentiment, lambda d: d.select(
            "review_id", "sentiment_label", F.round("sentiment_confidence", 6).alias("sentiment_confidence"))),
        "sentiment_summary": _on(_with_sentiment, enrich.sentiment_summary),
        "sentiment_triggers": sentiment_triggers,
        "sentiment_hybrid": sentiment_hybrid,
        "issues_rule": _on(_with_issues, lambda d: _issue_rows(d, "label", "confidence")),
        "issues_evidence": _on(_with_issues, lambda d: _issue_rows(d, "label", "evidence").select(
            "review_id", "label", F.posexplode("evidence").alias("position", "evidence"))),
        "issue_spans": _on(_normalized, lambda d: enrich.span_rows(d, "review_id")),
        "document_issue_spans": lambda s, d: enrich.span_rows(complaint_documents(_documents(s, d)), "doc_id"),
        "issues_near_failure": _on(_normalized, enrich.near_failures),
        "issues_summary": _on(_with_issues, enrich.issues_summary),
        "issue_triggers": _on(_with_issues, lambda d: d.select("review_id", issue_rules.needs_review(
            F.col("issues"), F.col("category_taxonomy")).cast("int").alias("review_issues"))),
        "issue_labels_json": issue_labels_json,
        "severity_score": lambda s, d: enrich.enrich(deduped(s, d)).select(
            "review_id", F.round("severity_score", 6).alias("severity_score"), "severity_band"),
        "severity_summary": _on(enriched, enrich.severity_summary),
        "severity_by_rating": _on(enriched, aggregates.severity_by_rating),
        "low_rating_negative_rate": _on(enriched, aggregates.negative_rate),
        "daily_kpis": _on(enriched, lambda d: _daily_scalars(aggregates.daily_kpis(d))),
        "daily_top_issues": _on(enriched, aggregates.top_issues_per_day),
        "daily_aggregates": _on(daily, _daily_full),
        "daily_trend_range": _on(daily, lambda d: aggregates.daily_series(_in_week(d))),
        "kpi_rollup": _on(daily, lambda d: aggregates.kpi_rollup(_in_week(d))),
        "window_top_issues": _on(daily, lambda d: aggregates.window_top_issues(_in_week(d))),
        "series_peak": _on(daily, aggregates.series_peaks),
        "newest_day": _on(daily, aggregates.newest_day),
        "latest_issue_days": _on(daily, _latest_issue_days),
        "weekly_rollup": _on(enriched, aggregates.weekly_kpis),
        "version_kpis": _on(versions, _version_scalars),
        "version_issue_breakdown": _on(versions, trends.issue_shares),
        "version_category_breakdown": _on(
            versions, lambda d: d.select("app_version", F.inline("category_breakdown"))),
        "version_list": _on(versions, aggregates.version_list),
        "release_delta": _on(versions, lambda d: aggregates.release_delta(d, "5.1.0", "5.4.0")),
        "release_issue_delta": _on(versions, lambda d: trends.release_issue_delta(d, "5.1.0", "5.4.0")),
        "reviews_raw_daily": _on(deduped, enrich.raw_daily),
        "kpi_snapshot": _on(enriched, lambda d: aggregates.kpi_snapshot(FAILURES.apply(d))),
        "top_issues_scope": _on(enriched, lambda d: aggregates.top_issues(_in_week(d))),
        "scope_default_window": _on(daily, scopes.default_window),
        "scope_default_kpis": scope_default_kpis,
        "preset_windows": _on(daily, scopes.preset_windows),
        "filter_options": _on(enriched, drilldown.filter_options),
        "overview_page": overview_page,
        "drilldown_page": drilldown_page,
        "scheduled_reports": scheduled_reports,
        "search_reviews_page": _on(enriched, lambda d: drilldown.search_reviews(d, NARROW, page=2, page_size=5)),
        "search_reviews_after": search_reviews_after,
        "search_reviews_count": _on(enriched, lambda d: drilldown.count_reviews(d, NARROW)),
        "evidence_quotes": _on(enriched, lambda d: drilldown.evidence_quotes(d, FAILURES, 25)),
        "report_payload": report_payload,
        "weekly_brief": weekly_brief,
        "exec_kpi_table": _exec_kpis,
        "report_cache_keys": report_cache_keys,
        "report_cache_new": report_cache_new,
        "report_lookup": report_lookup,
        "report_contract_check": report_contract_check,
        "report_backlog": report_backlog,
        "ticket_rows": _ticket_rows,
        "ticket_board_totals": _ticket_totals,
        "moving_avg_7d": _on(daily, trends.moving_averages),
        "zscore_flags": _on(enriched, trends.daily_flags),
        "anomaly_flags_scope": _on(daily, lambda d: trends.anomaly_flags(d, WEEK)),
        "version_kpi_lag": _on(versions, trends.version_kpi_deltas),
        "version_issue_delta": _on(versions, trends.version_issue_deltas),
        "release_movers": _on(versions, trends.release_movers),
        "resolution_lag": _on(enriched, trends.resolution_lag),
        "user_churn": _on(enriched, churn.user_churn),
        "churn_distribution": _on(enriched, lambda d: churn.churn_distribution(churn.user_churn(d))),
        "daily_churn_high": _on(enriched, churn.daily_high_churn),
        "reviews_with_churn": _on(enriched, lambda d: churn.with_churn(d, churn.user_churn(d)).select(
            "review_id", "churn_user_score", "churn_user_tier")),
        "quality_checks": _on(enriched, quality.quality_checks),
        "golden_scores": golden_scores,
        "golden_sample": _on(enriched, quality.golden_sample),
        "pain_points": _on(enriched, insights.pain_points),
        "backlog_candidates": _on(enriched, lambda d: insights.backlog_candidates(d).select(
            "title", "type", "priority", "severity_score", "label", "review_count", "weighted_severity",
            "critical_share", F.array_join("evidence_quotes", "|").alias("quotes"),
            F.array_join("related_versions", ",").alias("versions"))),
        "emerging_risks": _on(enriched, insights.emerging_risks),
        "feature_requests": _on(enriched, insights.feature_requests),
        "policy_themes": _on(enriched, lambda d: insights.policy_themes(d).withColumn(
            "evidence_quotes", F.array_join("evidence_quotes", "|"))),
        "competitor_mentions": _on(enriched, lambda d: insights.competitor_mentions(d, COMPETITORS)),
        "spike_drivers": _on(enriched, insights.spike_drivers),
        "kpi_tiles": _on(enriched, lambda d: insights.kpi_tiles(d, WEEK)),
        "document_sentiment": document_sentiment,
        "document_excerpts": document_excerpts,
        "document_issues": document_issues,
    }
