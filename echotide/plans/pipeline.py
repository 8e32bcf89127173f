"""The batch pipeline: review files in, stored tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echotide.operators.aggregates import top_issues, version_kpis
from echotide.operators.churn import user_churn, with_churn
from echotide.operators.dashboards import daily_aggregates
from echotide.operators.enrich import enrich
from echotide.operators.insights import backlog_tickets
from echotide.operators.merge import upsert
from echotide.operators.reports import only_new, report_key, report_payload, stored_reports, weekly_brief
from echotide.operators.scope import Scope
from echotide.sources.review_files import combine, latest_per_review, scan_csv
from echotide.schemas import empty_table
from echotide.tables import read_table, write_table


def ingest_files(spark: SparkSession, files: dict[str, str], *, quoted_newlines: bool, sep: str = ",") -> DataFrame:
    """Typed rows of all files, labelled by source. Missing files or columns fail before any job.

    Files whose fields may hold newlines cannot be split: each is one task. The caller says whether that is needed."""
    return combine({name: scan_csv(spark, path, quoted_newlines, sep) for name, path in files.items()})


def run_pipeline(
    spark: SparkSession,
    staged: DataFrame,
    target: str,
    previous: str | None = None,
    taxonomy: dict[str, str] | None = None,
) -> None:
    """Write all tables of one run to `target` anew, starting from the tables of the run before: for a first load or a rebuild.
    `incremental.apply_batch` changes stored tables at the cost of the batch.

    Only the new rows are enriched. A run never changes the tables of another, so a failed one
    is simply repeated into a new folder.
    """
    write_table(latest_per_review(staged), f"{target}/batch")
    batch = spark.read.parquet(f"{target}/batch")
    write_table(upsert(read_table(spark, previous, "reviews_raw"), batch, "review_id"), f"{target}/reviews_raw")

    stored = read_table(spark, previous, "reviews_enriched").drop("churn_user_score", "churn_user_tier")
    write_table(enrich(batch, taxonomy), f"{target}/batch_enriched")
    reviews = upsert(stored, spark.read.parquet(f"{target}/batch_enriched"), "review_id")
    write_table(user_churn(reviews), f"{target}/user_churn")
    scored = with_churn(reviews, read_table(spark, target, "user_churn"))
    write_table(scored.select(*empty_table(spark, "reviews_enriched").columns), f"{target}/reviews_enriched", "day")
    write_aggregates(spark, target)
    write_reports(spark, target, previous)


def write_aggregates(spark: SparkSession, target: str) -> None:
    """Daily and version tables. A row needs its key; how many reviews have none is written to `run_counts`."""
    reviews = read_table(spark, target, "reviews_enriched")
    write_table(unkeyed_counts(reviews), f"{target}/run_counts")
    write_table(daily_aggregates(reviews).filter(F.col("day").isNotNull()), f"{target}/daily_aggregates")
    write_table(version_kpis(reviews).filter(F.col("app_version").isNotNull()), f"{target}/version_aggregates")


def unkeyed_counts(reviews: DataFrame) -> DataFrame:
    """Reviews that the stored tables leave out, per table."""
    keys = {"daily_aggregates": "day", "version_aggregates": "app_version", "user_churn": "user_name"}
    counts = reviews.agg(*[F.count_if(F.col(key).isNull()).alias(table) for table, key in keys.items()])
    return counts.unpivot([], list(keys), "table_name", "reviews_without_key")


def _scope_row(scope: Scope) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in scope.as_dict().items()])


def brief_report(reviews: DataFrame, daily: DataFrame, scope: Scope) -> DataFrame:
    brief = weekly_brief(report_payload(reviews, daily, scope, "weekly_exec_brief"))
    return brief.select("report_type", "scope", F.to_json("brief", {"ignoreNullFields": "false"}).alias("content_json"))


def top_issues_report(reviews: DataFrame, daily: DataFrame, scope: Scope) -> DataFrame:
    # Five rows at most: best first, equal ones by count and then by name.
    entry = F.struct((-F.col("weighted_severity")).alias("w"), (-F.col("review_count")).alias("c"), "label")
    items = F.transform(F.sort_array(F.collect_list(entry)), lambda i: F.struct(
        i["label"].alias("label"), (-i["c"]).alias("review_count"), (-i["w"]).alias("weighted_severity"),
    ))
    return top_issues(scope.apply(reviews), 5).agg(items.alias("top_issues")).select(
        F.lit("weekly_top_issues").alias("report_type"), _scope_row(scope).alias("scope"),
        F.to_json(F.struct("top_issues")).alias("content_json"),
    )


def backlog_report(reviews: DataFrame, daily: DataFrame, scope: Scope) -> DataFrame:
    return backlog_tickets(scope.apply(reviews)).select(
        F.lit("sprint_backlog").alias("report_type"), _scope_row(scope).alias("scope"),
        F.to_json(F.struct("tickets")).alias("content_json"))


SCHEDULED = {"weekly_exec_brief": brief_report, "weekly_top_issues": top_issues_report, "sprint_backlog": backlog_report}


def missing_reports(reviews: DataFrame, daily: DataFrame, stored: DataFrame, scope: Scope) -> DataFrame | None:
    """The scheduled reports of a scope that are not stored yet. Stored keys are looked up first,
    so a report that exists costs one small read."""
    keys = {report_key(report_type, scope): report_type for report_type in SCHEDULED}
    known = {r["hash_key"] for r in stored.filter(F.col("hash_key").isin(*keys)).select("hash_key").distinct().collect()}
    wanted = [SCHEDULED[t](reviews, daily, scope) for key, t in keys.items() if key not in known]
    return only_new(stored_reports(reduce(DataFrame.unionByName, wanted)), stored) if wanted else None


def write_reports(spark: SparkSession, target: str, previous: str | None) -> None:
    reviews, daily = read_table(spark, target, "reviews_enriched"), read_table(spark, target, "daily_aggregates")
    stored = read_table(spark, previous, "insight_reports")
    fresh = missing_reports(reviews, daily, stored, Scope().within(daily))
    write_table(stored if fresh is None else stored.unionByName(fresh), f"{target}/insight_reports")
