"""Sums of severities must not depend on how the rows are partitioned."""

import pytest

from echotide.operators import aggregates, churn, dashboards, insights
from echotide.plans import catalog
from conftest import rows

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", [
    aggregates.top_issues_per_day, aggregates.top_issues, aggregates.severity_by_rating, insights.pain_points,
    insights.feature_requests, insights.policy_themes, churn.user_churn,
    lambda d: aggregates.window_top_issues(dashboards.daily_aggregates(d)),
], ids=lambda f: f.__name__)
def test_same_rows_at_any_partitioning(spark, query):
    reviews = catalog.enriched(spark, LARGER)
    found = [rows(query(reviews.repartition(n))) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2]
