"""Table schemas. Nested results stay typed; JSON text appears only in stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REVIEWS_RAW = """
    review_id string, user_name string, content string, score int, thumbs_up int,
    review_created_version string, at_ts timestamp_ntz, app_version string, category_raw string
"""

REVIEWS_ENRICHED = REVIEWS_RAW.rstrip() + """,
    day date, category_taxonomy string,
    sentiment_label string, sentiment_confidence double, sentiment_method string,
    issues array<struct<label:string,confidence:double,evidence:array<string>>>, issues_method string,
    severity_score double, severity_band string, processed_at timestamp,
    churn_user_score double, churn_user_tier string
"""

DAILY_AGGREGATES = """
    day date, total_reviews bigint, avg_rating double, pct_negative double, pct_positive double,
    critical_count bigint,
    top_issues array<struct<label:string,review_count:bigint,weighted_severity:double>>,
    churn_high_users bigint,
    anomaly_flags array<struct<metric:string,value:double,mean:double,z_score:double>>
"""

VERSION_AGGREGATES = """
    app_version string, first_seen_day date, last_seen_day date, total_reviews bigint,
    avg_rating double, pct_negative double, critical_count bigint,
    issue_breakdown array<struct<label:string,review_count:bigint,pct_reviews:double,weighted_severity:double>>,
    category_breakdown array<struct<category:string,review_count:bigint,pct_reviews:double>>
"""

USER_CHURN = """
    user_name string, reviews bigint, pct_negative double, avg_severity double,
    txn_failures bigint, intent_mentions bigint, churn_user_score double, churn_user_tier string
"""

INSIGHT_REPORTS = """
    report_id string, report_type string, scope_json string, content_json string,
    created_at timestamp_ntz, model string, hash_key string
"""

RUN_COUNTS = "table_name string, reviews_without_key bigint"

TABLES = {
    "reviews_raw": REVIEWS_RAW,
    "reviews_enriched": REVIEWS_ENRICHED,
    "daily_aggregates": DAILY_AGGREGATES,
    "version_aggregates": VERSION_AGGREGATES,
    "user_churn": USER_CHURN,
    "run_counts": RUN_COUNTS,
    "insight_reports": INSIGHT_REPORTS,
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
