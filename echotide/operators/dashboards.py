"""The stored daily table: KPIs, high-churn users and anomaly flags of each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echotide.operators.aggregates import (
    DAILY_COLUMNS, daily_series, day_table, kpi_rollup, top_entries, window_top_issues,
)
from echotide.operators.churn import daily_high_churn
from echotide.operators.drilldown import evidence_quotes, search_reviews
from echotide.operators.scope import Scope
from echotide.operators.trends import with_flags


def daily_aggregates(reviews: DataFrame, top: int = 5) -> DataFrame:
    """KPIs and flags come from one pass over the reviews, high-churn users from another."""
    return daily_rows(day_table(reviews), daily_high_churn(reviews), top)


def daily_rows(days: DataFrame, high: DataFrame, top: int = 5) -> DataFrame:
    """The same from the day table and the high-churn users of each day."""
    flagged = with_flags(days).select(*DAILY_COLUMNS, top_entries(top).alias("top_issues"), "anomaly_flags")
    return flagged.join(high, "day", "left").select(
        *DAILY_COLUMNS, "top_issues", F.coalesce("churn_high_users", F.lit(0)).alias("churn_high_users"), "anomaly_flags"
    )


def overview(daily: DataFrame, scope: Scope) -> dict[str, DataFrame]:
    """Everything the overview page shows, from the daily table alone."""
    window = Scope(scope.start_date, scope.end_date).apply(daily)
    return {"kpis": kpi_rollup(window), "trend": daily_series(window), "top_issues": window_top_issues(window)}


def drilldown(reviews: DataFrame, scope: Scope, page: int = 1, page_size: int = 25) -> dict[str, DataFrame]:
    return {
        "rows": search_reviews(reviews, scope, page, page_size),
        "quotes": evidence_quotes(reviews, scope, limit=8),
    }
