"""Moving averages, spikes and release comparisons over the small daily and version tables.

Windows without a partition run only here, where the input has one row per day or release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.operators.aggregates import daily_issue_counts, day_table
from echotide.operators.scope import Scope

SPIKE_DAYS = 14
SPIKE_MIN_POINTS = 7
SPIKE_Z = 2.0
FLAG_LIST = "array<struct<metric:string,value:double,mean:double,z_score:double>>"


def _day_number() -> Column:
    return F.datediff("day", F.lit("1970-01-01").cast("date"))


def moving_averages(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the daily rates over the last calendar days; days without reviews do not count."""
    recent = Window.orderBy(_day_number()).rangeBetween(-(days - 1), 0)
    return daily.filter(F.col("day").isNotNull()).select(
        "day",
        F.round(F.avg("avg_rating").over(recent), 6).alias("avg_rating_7dma"),
        F.round(F.avg("pct_negative").over(recent), 6).alias("pct_negative_7dma"),
        F.count(F.lit(1)).over(recent).alias("days_in_window"),
    )


def with_flags(days: DataFrame) -> DataFrame:
    """Add the metrics of each day that lie far above the preceding observed days.

    Takes the day table, one row per day; the spread is that of a sample.
    """
    before = Window.partitionBy(F.col("day").isNull()).orderBy("day").rowsBetween(-SPIKE_DAYS, -1)
    failures = F.filter("entries", lambda e: e["label"] == "Transaction Failure")
    metrics = {
        "critical_count": F.col("critical_count"),
        "pct_negative": F.col("pct_negative"),
        "transaction_failures": F.coalesce(F.get(failures, F.lit(0))["n"], F.lit(0)),
    }

    def flag(metric: str) -> Column:
        value = F.col(f"_{metric}")
        mean, spread = F.avg(value).over(before), F.stddev_samp(value).over(before)
        z = F.round(F.try_divide(value - mean, spread), 4)
        raised = (F.count(value).over(before) >= SPIKE_MIN_POINTS) & (F.round(spread, 12) > 0) & (z >= SPIKE_Z)
        return F.when(raised, F.struct(
            F.lit(metric).alias("metric"), F.round(value, 4).alias("value"), F.round(mean, 8).alias("mean"),
            z.alias("z_score"),
        ))

    valued = days.withColumns({f"_{m}": v.cast("double") for m, v in metrics.items()})
    flags = F.array_compact(F.array(*[flag(m) for m in metrics])).cast(FLAG_LIST)
    return valued.withColumn("anomaly_flags", flags).drop(*[f"_{m}" for m in metrics])


def daily_flags(reviews: DataFrame) -> DataFrame:
    return with_flags(day_table(reviews)).select("day", F.inline("anomaly_flags"))


def anomaly_flags(daily: DataFrame, scope: Scope, limit: int = 10) -> DataFrame:
    """Stored flags of a date range, oldest first; a scope with any other filter has none."""
    if not scope.only_dates():
        daily = daily.limit(0)
    return (
        Scope(scope.start_date, scope.end_date).apply(daily).select("day", F.explode("anomaly_flags").alias("f")).select("day", "f.*")
        .orderBy("day", "metric").limit(limit)
    )


def version_order() -> list[Column]:
    """Releases by first day seen, then by the numbers in the version."""
    numbers = F.transform(F.split("app_version", r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))
    return [F.asc_nulls_last("first_seen_day"), numbers, F.col("app_version")]


def _released(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("app_version").isNotNull())


def version_kpi_deltas(versions: DataFrame) -> DataFrame:
    """Each release with the KPI changes since the one before."""
    order = Window.orderBy(*version_order())

    def change(column: str, digits: int) -> Column:
        return F.round(F.col(column) - F.lag(column).over(order), digits).alias(f"delta_{column}")

    return _released(versions).select(
        "app_version", F.lag("app_version").over(order).alias("previous_version"),
        change("avg_rating", 4), change("pct_negative", 4), change("critical_count", 0),
    )


def version_issue_deltas(versions: DataFrame) -> DataFrame:
    """Change of every issue's share against the release before; an absent issue counts as zero."""
    order = Window.orderBy(*version_order())
    shares = F.map_from_entries(F.transform("issue_breakdown", lambda e: F.struct(e["label"], e["pct_reviews"])))
    paired = _released(versions).withColumn("shares", shares).select(
        "app_version", F.lag("app_version").over(order).alias("previous_version"),
        "shares", F.lag("shares").over(order).alias("before"),
    ).filter(F.col("previous_version").isNotNull())
    labels = F.array_union(F.map_keys("shares"), F.map_keys("before"))
    now = F.coalesce(F.try_element_at("shares", F.col("label")), F.lit(0.0))
    then = F.coalesce(F.try_element_at("before", F.col("label")), F.lit(0.0))
    return paired.withColumn("label", F.explode(labels)).select(
        "app_version", "previous_version", "label", now.alias("pct_issue"), then.alias("previous_pct_issue"),
        F.round(now - then, 4).alias("delta_pct_issue"),
    )


def release_issue_delta(versions: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Change of every issue's share from one release to any other; an absent issue counts as zero. No rows where either
    release is unknown."""
    both = versions.filter(F.col("app_version").isin(version_a, version_b))
    known = both.select("app_version").distinct().agg(F.count(F.lit(1)).alias("found"))
    shares = issue_shares(both)

    def share(version: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("app_version") == version, F.col("pct_reviews"))), F.lit(0.0))

    deltas = shares.groupBy("label").agg(share(version_a).alias("pct_issue_a"), share(version_b).alias("pct_issue_b"))
    needed = known.filter(F.col("found") == len({version_a, version_b})).select("found").scalar()
    return deltas.filter(needed.isNotNull()).select(
        "label", "pct_issue_a", "pct_issue_b", F.round(F.col("pct_issue_b") - F.col("pct_issue_a"), 4).alias("delta_b_minus_a"))


def release_movers(versions: DataFrame, top: int = 5) -> DataFrame:
    """The largest worsenings and improvements between adjacent releases."""
    deltas = version_issue_deltas(versions).select("app_version", "previous_version", "label", "delta_pct_issue")
    ties = ("app_version", "label")
    worse = deltas.filter("delta_pct_issue > 0").orderBy(F.desc("delta_pct_issue"), *ties).limit(top)
    better = deltas.filter("delta_pct_issue < 0").orderBy(F.asc("delta_pct_issue"), *ties).limit(top)
    return worse.withColumn("direction", F.lit("regression")).unionByName(
        better.withColumn("direction", F.lit("improvement"))
    )


def issue_shares(versions: DataFrame) -> DataFrame:
    return versions.select("app_version", F.inline("issue_breakdown"))


def resolution_lag(reviews: DataFrame) -> DataFrame:
    """Days between an issue's first and last mention. Observed in reviews, not a fix date."""
    counts = daily_issue_counts(reviews).filter(F.col("day").isNotNull())
    return counts.groupBy("label").agg(
        F.min("day").alias("first_seen_day"), F.max("day").alias("last_seen_day"),
        F.datediff(F.max("day"), F.min("day")).alias("resolution_lag_days"),
    )
