"""Daily, weekly and per-version KPIs.

Each KPI table reads the enriched reviews once: every review yields one row for itself and
one per issue (and category), tagged by kind, and a single grouping by (group, kind, name)
combines on the map side. What is left is a few rows per group, whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.issues import labels_of
from echotide.functions.numbers import EXACT, exact_mean, exact_sum, rounded


def _tag(kind: str, name: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if name is None else name
    return F.struct(F.lit(kind).alias("kind"), value.alias("name"))


def _tags(*, issues: bool = True, category: bool = False) -> Column:
    parts = [_tag("all")]
    if category:
        parts.append(_tag("category", F.coalesce("category_taxonomy", F.lit("Other"))))
    fixed = F.array(*parts)
    return F.concat(fixed, F.transform(labels_of(F.col("issues")), lambda x: _tag("issue", x))) if issues else fixed


def measures(reviews: DataFrame, group: list[str], tags: Column) -> DataFrame:
    """Additive measures per group, kind and name."""
    severity = F.coalesce("severity_score", F.lit(0.0))
    needed = reviews.select(
        *group, F.col("score").cast("bigint").alias("score"), "sentiment_label", "day_seen",
        severity.alias("severity"), F.explode(tags).alias("tag"),
    )
    return needed.groupBy(*group, F.col("tag.kind").alias("kind"), F.col("tag.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_n"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("severity") >= 0.80).alias("critical"),
        exact_sum("severity").alias("weight"),
        F.min("day_seen").alias("first_day"),
        F.max("day_seen").alias("last_day"),
    )


STATE_SUMS = ("n", "score_sum", "score_n", "negative", "positive", "critical", "weight")


def signed_measures(changes: DataFrame) -> DataFrame:
    """What a batch adds to the measures of each version, day, kind and name: rows that left count negative.

    Every measure is a sum, so the differences of all batches add up to the state of the whole table."""
    sign = F.col("sign")
    severity = F.coalesce("severity_score", F.lit(0.0))
    needed = changes.select("app_version", "day", "sign", F.col("score").cast("bigint").alias("score"), "sentiment_label",
                            severity.alias("severity"), F.explode(_tags(category=True)).alias("tag"))

    def counted(where: Column) -> Column:
        return F.sum(F.when(where, sign).otherwise(0))

    weight = F.col("severity").cast(EXACT)
    grouped = needed.groupBy("app_version", "day", F.col("tag.kind").alias("kind"), F.col("tag.name").alias("name"))
    return grouped.agg(
        F.sum(sign).alias("n"), F.coalesce(F.sum(sign * F.col("score")), F.lit(0)).alias("score_sum"),
        counted(F.col("score").isNotNull()).alias("score_n"), counted(F.col("sentiment_label") == "negative").alias("negative"),
        counted(F.col("sentiment_label") == "positive").alias("positive"), counted(F.col("severity") >= 0.80).alias("critical"),
        F.sum(F.when(sign < 0, -weight).otherwise(weight)).alias("weight"),
    )


def folded_state(state: DataFrame) -> DataFrame:
    """The measures of each version, day, kind and name from all stored differences. What is left of nothing is gone."""
    return state.groupBy("app_version", "day", "kind", "name").agg(*[F.sum(m).alias(m) for m in STATE_SUMS]).filter("n > 0")


def state_by(group: str, folded: DataFrame) -> DataFrame:
    """Measures per group, kind and name. First and last day are those that still hold a review, as no minimum can be subtracted."""
    return folded.groupBy(group, "kind", "name").agg(
        *[F.sum(m).alias(m) for m in STATE_SUMS], F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def _of_kind(kind: str, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def _base(column: str) -> Column:
    """A measure of the group's own row, picked up while the group is folded."""
    return F.max(_of_kind("all", F.col(column)))


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def _issue_order(weight_first: bool) -> list[Column]:
    weight = (-F.col("weight")).alias("w")
    count = (-F.col("n")).alias("c")
    return [weight, count] if weight_first else [count, weight]


def _issue_entries(weight_first: bool) -> Column:
    """Issues of a group, best first. The number of labels is bounded by the rule set."""
    entry = F.struct(*_issue_order(weight_first), F.col("name").alias("label"),
                     F.col("n").alias("n"), F.col("weight").alias("weight"))
    return F.sort_array(F.collect_list(_of_kind("issue", entry)))


def _kpis(parts: DataFrame, group: str) -> DataFrame:
    return parts.groupBy(group).agg(
        _base("n").alias("total_reviews"),
        _base("score_sum").alias("score_sum"),
        _base("score_n").alias("score_n"),
        _base("negative").alias("negative"),
        _base("positive").alias("positive"),
        _base("critical").alias("critical_count"),
        _issue_entries(weight_first=True).alias("entries"),
    )


def _rate_columns() -> dict[str, Column]:
    return {
        "avg_rating": F.round(_share(F.col("score_sum"), F.col("score_n")), 4),
        "pct_negative": F.round(_share(F.col("negative"), F.col("total_reviews")), 4),
        "pct_positive": F.round(_share(F.col("positive"), F.col("total_reviews")), 4),
    }


def measures_by_day(reviews: DataFrame) -> DataFrame:
    return measures(reviews.withColumn("day_seen", F.col("day")), ["day"], _tags())


def daily_issue_counts(reviews: DataFrame) -> DataFrame:
    return issue_totals(reviews, ["day"])


def day_table(reviews: DataFrame) -> DataFrame:
    """One row per day with its counts, rates and all issues, from one pass over the reviews."""
    return day_rows(measures_by_day(reviews))


def day_rows(parts: DataFrame) -> DataFrame:
    """The same from measures per day, kind and name."""
    return _kpis(parts, "day").withColumns(_rate_columns())


def top_entries(top: int) -> Column:
    return F.transform(F.slice("entries", 1, top), lambda e: F.struct(
        e["label"].alias("label"), e["n"].alias("review_count"), rounded(e["weight"], 4).alias("weighted_severity"),
    ))


DAILY_COLUMNS = ("day", "total_reviews", "avg_rating", "pct_negative", "pct_positive", "critical_count")


def daily_kpis(reviews: DataFrame, top: int = 5) -> DataFrame:
    """Count, rating, sentiment shares, critical count and the top issues of each day."""
    return day_table(reviews).select(*DAILY_COLUMNS, top_entries(top).alias("top_issues"))


def weekly_kpis(reviews: DataFrame) -> DataFrame:
    """The daily measures per ISO week; the week is named by its Monday."""
    weekly = reviews.select(
        F.to_date(F.date_trunc("week", "day")).alias("week_start"),
        "score", "sentiment_label", "severity_score", F.col("day").alias("day_seen"), "issues",
    )
    parts = measures(weekly, ["week_start"], _tags(issues=False))
    return _kpis(parts, "week_start").select(
        "week_start", F.weekofyear("week_start").alias("iso_week"), "total_reviews",
        *[c.alias(n) for n, c in _rate_columns().items()], "critical_count",
    )


def version_kpis(reviews: DataFrame) -> DataFrame:
    """First and last day, KPIs, issue and category breakdown of each app version.

    Reviews without a version form one row, whose breakdowns are empty.
    """
    return version_rows(measures(reviews.withColumn("day_seen", F.col("day")), ["app_version"], _tags(category=True)))


def version_rows(parts: DataFrame) -> DataFrame:
    """The same from measures per version, kind and name."""
    category = F.struct((-F.col("n")).alias("c"), F.col("name").alias("category"), F.col("n").alias("n"))
    folded = parts.groupBy("app_version").agg(
        _base("first_day").alias("first_seen_day"), _base("last_day").alias("last_seen_day"),
        _base("n").alias("total_reviews"), _base("score_sum").alias("score_sum"), _base("score_n").alias("score_n"),
        _base("negative").alias("negative"), _base("positive").alias("positive"),
        _base("critical").alias("critical_count"),
        _issue_entries(weight_first=False).alias("issue_entries"),
        F.sort_array(F.collect_list(_of_kind("category", category))).alias("category_entries"),
    )
    total = F.col("total_reviews")
    issue_breakdown = F.transform("issue_entries", lambda e: F.struct(
        e["label"].alias("label"), e["n"].alias("review_count"),
        F.round(_share(e["n"], total), 4).alias("pct_reviews"), rounded(e["weight"], 4).alias("weighted_severity"),
    ))
    category_breakdown = F.transform("category_entries", lambda e: F.struct(
        e["category"].alias("category"), e["n"].alias("review_count"),
        F.round(_share(e["n"], total), 4).alias("pct_reviews"),
    ))
    known = F.col("app_version").isNotNull()

    def unless_unknown(entries: Column) -> Column:
        return F.when(known, entries).otherwise(F.slice(entries, 1, 0))

    rates = _rate_columns()
    return folded.select(
        "app_version", "first_seen_day", "last_seen_day", "total_reviews",
        rates["avg_rating"].alias("avg_rating"), rates["pct_negative"].alias("pct_negative"), "critical_count",
        unless_unknown(issue_breakdown).alias("issue_breakdown"),
        unless_unknown(category_breakdown).alias("category_breakdown"),
    )


def issue_totals(reviews: DataFrame, group: list[str]) -> DataFrame:
    """Review count and summed severity of each issue label per group."""
    return (
        reviews.select(*group, F.coalesce("severity_score", F.lit(0.0)).alias("severity"),
                       F.explode(labels_of(F.col("issues"))).alias("label"))
        .groupBy(*group, "label")
        .agg(F.count(F.lit(1)).alias("review_count"), exact_sum("severity").alias("weight"))
    )


def by_weight(*before: Column) -> list[Column]:
    """The ranking of issues: weight, then count, then name."""
    return [*before, F.desc("weight"), F.desc("review_count"), F.asc("label")]


def top_issues_per_day(reviews: DataFrame, top: int = 5) -> DataFrame:
    ranked = Window.partitionBy("day").orderBy(*by_weight())
    return (
        issue_totals(reviews, ["day"]).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
        .select("day", "rank", "label", "review_count", rounded("weight", 4).alias("weighted_severity"))
    )


def top_issues(scoped: DataFrame, limit: int = 8) -> DataFrame:
    return (
        issue_totals(scoped, []).orderBy(*by_weight()).limit(max(1, int(limit)))
        .select("label", "review_count", rounded("weight", 3).alias("weighted_severity"))
    )


def kpi_snapshot(scoped: DataFrame) -> DataFrame:
    """KPIs of a scope. A missing rating counts as zero here, and an empty scope gives zeros."""
    return scoped.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.coalesce(F.avg(F.coalesce("score", F.lit(0)).cast("double")), F.lit(0.0)), 4).alias("avg_rating"),
        F.round(F.coalesce(
            F.avg(F.when(F.col("sentiment_label") == "negative", 1.0).otherwise(0.0)), F.lit(0.0)), 4
        ).alias("pct_negative"),
        F.count_if(F.col("severity_band") == "critical").alias("critical_count"),
    )


def severity_by_rating(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("score").agg(
        F.count(F.lit(1)).alias("review_count"), F.round(exact_mean("severity_score"), 4).alias("avg_severity")
    )


def negative_rate(reviews: DataFrame, ratings: tuple[int, ...] = (1, 2)) -> DataFrame:
    negative = F.when(F.col("sentiment_label") == "negative", 1.0).otherwise(0.0)
    return reviews.filter(F.col("score").isin(*ratings)).agg(F.round(F.avg(negative), 4).alias("pct_negative"))


def kpi_rollup(daily: DataFrame) -> DataFrame:
    """KPIs of a window from its daily rows; rates are weighted by the reviews of each day.

    High-churn users are summed over days, so a user active on two days counts twice.
    """
    total = F.sum("total_reviews")

    def weighted(rate: str) -> Column:
        return F.coalesce(F.sum(F.col(rate) * F.col("total_reviews")) / F.nullif(total, F.lit(0)), F.lit(0.0))

    return daily.agg(
        F.coalesce(total, F.lit(0)).alias("total_reviews"),
        F.round(weighted("avg_rating"), 6).alias("avg_rating"),
        F.round(weighted("pct_negative"), 6).alias("pct_negative"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("churn_high_users"), F.lit(0)).alias("churn_high_users"),
    )


def window_top_issues(daily: DataFrame, top: int = 5) -> DataFrame:
    """Top issues of a window from the daily top lists. Labels outside a day's list are not seen."""
    items = daily.select(F.explode("top_issues").alias("i")).select("i.*")
    return (
        items.groupBy(F.coalesce("label", F.lit("Unknown")).alias("label"))
        .agg(F.sum("review_count").alias("review_count"), F.round(exact_sum("weighted_severity"), 3).alias("weight"))
        .orderBy(*by_weight()).limit(top)
        .select(F.col("label").alias("issue_label"), "review_count", F.col("weight").cast("double").alias("weighted_severity"))
    )


def daily_series(daily: DataFrame) -> DataFrame:
    return daily.select("day", "avg_rating", "pct_negative", "critical_count").orderBy("day")


def series_peaks(daily: DataFrame, metrics: tuple[str, ...] = ("avg_rating", "pct_negative", "critical_count")) -> DataFrame:
    """Day and value of each metric's maximum; the first day wins a tie."""
    long = daily.select("day", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("s")).select("day", "s.*").filter(F.col("value").isNotNull() & F.col("day").isNotNull())
    best = F.max_by("day", F.struct("value", F.datediff(F.lit("1970-01-01").cast("date"), "day")))
    return long.groupBy("metric").agg(best.alias("day"), F.max("value").alias("value"))


def newest_day(daily: DataFrame) -> DataFrame:
    return daily.agg(F.max("day").alias("newest_day"))


def latest_issue_days(daily: DataFrame, days: int = 3) -> DataFrame:
    return daily.filter(F.size("top_issues") > 0).orderBy(F.desc_nulls_last("day")).limit(days)


def version_list(versions: DataFrame) -> DataFrame:
    return (
        versions.filter(F.col("app_version").isNotNull() & (F.col("app_version") != ""))
        .orderBy(F.desc_nulls_last("last_seen_day"), F.desc("total_reviews"), F.asc("app_version"))
        .select("app_version", "last_seen_day", "total_reviews")
    )


def release_delta(versions: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """KPI rows of two versions and their difference; no rows where either is unknown."""

    def of(version: str, metric: str) -> Column:
        return F.max(F.when(F.col("app_version") == version, F.coalesce(F.col(metric).cast("double"), F.lit(0.0))))

    digits = {"avg_rating": 3, "pct_negative": 4, "critical_count": 0}
    pair = versions.filter(F.col("app_version").isin(version_a, version_b)).agg(
        *[of(v, m).alias(f"{m}_{side}") for m in digits for side, v in (("a", version_a), ("b", version_b))]
    )
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.round(f"{m}_a", d).alias("version_a"), F.round(f"{m}_b", d).alias("version_b"),
            F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), d).alias("delta_b_minus_a"),
        )
        for m, d in digits.items()
    ])
    both = F.col("critical_count_a").isNotNull() & F.col("critical_count_b").isNotNull()
    return pair.filter(both).select(F.inline(rows))
