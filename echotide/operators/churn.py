"""Churn risk of users, from their reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.fixed_values import CHURN_INTENT
from echotide.functions.issues import has_label
from echotide.functions.text import any_present
from echotide.functions.numbers import EXACT, exact_sum

MEASURES = ("reviews", "negative", "severity", "txn_failures", "intent_mentions")


def has_intent(content: Column) -> Column:
    return any_present(F.lower(F.coalesce(content, F.lit(""))), CHURN_INTENT)


def user_days(reviews: DataFrame) -> DataFrame:
    """Additive measures per user and day. Combining by both keeps a very active user small:
    what reaches the user's own grouping is at most one row per day."""
    intent = has_intent(F.col("content"))
    return reviews.filter(F.col("user_name").isNotNull()).groupBy("user_name", "day").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        exact_sum(F.coalesce("severity_score", F.lit(0.0))).alias("severity"),
        F.count_if(has_label(F.col("issues"), "Transaction Failure")).alias("txn_failures"),
        F.count_if(intent).alias("intent_mentions"),
    )


def signed_user_days(changes: DataFrame) -> DataFrame:
    """What a batch adds to the measures of each user, day and bucket; rows that left count negative. Where the sum over all
    batches has reviews, the partition of that day and bucket holds reviews of the user."""
    sign, severity = F.col("sign"), F.coalesce("severity_score", F.lit(0.0)).cast(EXACT)

    def counted(where: Column) -> Column:
        return F.sum(F.when(where, sign).otherwise(0))

    return changes.groupBy("user_name", "day", "bucket").agg(
        F.sum(sign).alias("reviews"), counted(F.col("sentiment_label") == "negative").alias("negative"),
        F.sum(F.when(sign < 0, -severity).otherwise(severity)).alias("severity"),
        counted(has_label(F.col("issues"), "Transaction Failure")).alias("txn_failures"), counted(F.col("intent")).alias("intent_mentions"),
    )


def churn_rows(users: DataFrame) -> DataFrame:
    """Features, score and tier from the summed measures of each user."""
    scored = users.withColumn("churn_user_score", score_of({m: F.col(m) for m in MEASURES}))
    return scored.select(
        "user_name", "reviews",
        F.round(F.try_divide("negative", "reviews"), 4).alias("pct_negative"),
        F.round(F.try_divide(F.col("severity").cast("double"), F.col("reviews")), 4).alias("avg_severity"),
        "txn_failures", "intent_mentions", "churn_user_score",
        tier_of(F.col("churn_user_score")).alias("churn_user_tier"),
    )


def score_of(m: dict[str, Column]) -> Column:
    """The score of summed measures; null for a user without reviews."""
    return F.when(m["reviews"] > 0, _score(m | {"reviews": F.nullif(m["reviews"], F.lit(0))}))


def _score(m: dict[str, Column]) -> Column:
    total = (
        F.lit(0.35) * (m["negative"] / m["reviews"])
        + F.lit(0.30) * (m["severity"].cast("double") / m["reviews"])
        + F.lit(0.15) * F.least(F.lit(1.0), m["txn_failures"] / F.lit(3.0))
        + F.lit(0.20) * F.least(F.lit(1.0), m["intent_mentions"] / F.lit(2.0))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def tier_of(score: Column) -> Column:
    """Null for an unknown score."""
    return F.when(score.isNull(), None).when(score > 0.66, "high").when(score >= 0.33, "med").otherwise("low")


def user_churn(reviews: DataFrame) -> DataFrame:
    """Features, score and tier of every named user."""
    return churn_rows(user_days(reviews).groupBy("user_name").agg(*[F.sum(m).alias(m) for m in MEASURES]))


def churn_distribution(churn: DataFrame) -> DataFrame:
    """Users and share of users in each tier."""
    tiers = churn.groupBy("churn_user_tier").agg(F.count(F.lit(1)).alias("users"))
    share = F.col("users") / F.sum("users").over(Window.partitionBy())
    return tiers.select("churn_user_tier", "users", F.round(share, 4).alias("share"))


def daily_high_churn(reviews: DataFrame) -> DataFrame:
    """Distinct high-risk users active on each day."""
    user = Window.partitionBy("user_name")
    totals = {m: F.sum(m).over(user) for m in MEASURES}
    scored = user_days(reviews).select("user_name", "day", *[c.alias(m) for m, c in totals.items()])
    high = scored.filter(tier_of(_score({m: F.col(m) for m in MEASURES})) == "high")
    return high.groupBy("day").agg(F.count(F.lit(1)).alias("churn_high_users"))


def with_churn(reviews: DataFrame, churn: DataFrame) -> DataFrame:
    """Reviews with the score and tier of their author."""
    return reviews.join(churn.select("user_name", "churn_user_score", "churn_user_tier"), "user_name", "left")
