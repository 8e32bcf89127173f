"""Raw reviews -> one wide enriched row each. Narrow steps only: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echotide.functions import issues, sentiment, severity
from echotide.functions.fixed_values import EMPTY_REVIEW
from echotide.functions.text import tidy_content
from echotide.functions.numbers import exact_mean
from echotide.sources.taxonomy import category_taxonomy


RAW_COLUMNS = ("review_id", "user_name", "content", "score", "thumbs_up", "review_created_version", "at_ts", "app_version",
               "category_raw")


def normalize(raw: DataFrame, taxonomy: dict[str, str] | None = None) -> DataFrame:
    """Tidy text, category name and calendar day."""
    return raw.withColumns({
        "content": tidy_content(F.col("content"), EMPTY_REVIEW),
        "day": F.to_date("at_ts"),
        "category_taxonomy": category_taxonomy(F.col("category_raw"), taxonomy),
    })


def add_sentiment(df: DataFrame) -> DataFrame:
    lexicon = sentiment.lexicon_score(F.col("content"))
    return (
        df.withColumn("_signal", sentiment.signal(sentiment.rating_prior(F.col("score")), lexicon))
        .withColumns({
            "sentiment_label": sentiment.label_of(F.col("_signal")),
            "sentiment_confidence": sentiment.confidence_of(F.col("_signal")),
            "sentiment_method": F.lit("rule"),
        })
        .drop("_signal")
    )


def add_issues(df: DataFrame) -> DataFrame:
    return df.withColumns({"issues": issues.issues_in(F.col("content")), "issues_method": F.lit("rule")})


def span_rows(df: DataFrame, key: str) -> DataFrame:
    """Every match of every issue rule: key, label, place of the phrase in its rule, start and end, near a failure word or not."""
    labels = F.array(*[F.lit(label) for label in issues.CHECKS])
    found = df.select(key, F.inline(issues.issue_spans(F.col("content"))))
    return found.select(key, F.get(labels, F.col("rule")).alias("label"), "phrase", "start", "end", F.col("near").cast("int").alias("near"))


def near_failures(df: DataFrame) -> DataFrame:
    """(review_id, label) where a match lies near a failure word."""
    return df.select("review_id", F.explode(issues.near_labels(F.col("content"))).alias("label"))


def add_severity(df: DataFrame) -> DataFrame:
    score = severity.severity(
        F.col("score"), F.col("sentiment_label"), F.col("content"),
        issues.labels_of(F.col("issues")), F.col("thumbs_up"),
    )
    return df.withColumn("severity_score", score).withColumn(
        "severity_band", severity.band_of(F.col("severity_score"))
    )


def enrich(raw: DataFrame, taxonomy: dict[str, str] | None = None) -> DataFrame:
    scored = add_severity(add_issues(add_sentiment(normalize(raw, taxonomy))))
    return scored.withColumn("processed_at", F.current_timestamp())


def combine_verdicts(reviews: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join outside sentiment verdicts (review_id, label, confidence): the verdict's label wins,
    confidence is the larger one, lowered where the two disagree. Of several verdicts on one
    review the most confident counts."""
    verdicts = verdicts.groupBy("review_id").agg(
        F.max_by("label", F.struct("confidence", "label")).alias("_label"), F.max("confidence").alias("_confidence")
    )
    agreed = F.greatest("sentiment_confidence", "_confidence")
    known = F.col("_label").isNotNull()
    combined = F.when(F.col("_label") == F.col("sentiment_label"), agreed).otherwise(agreed * 0.85)
    return (
        reviews.join(verdicts, "review_id", "left")
        .withColumns({
            "sentiment_confidence": F.when(known, combined).otherwise(F.col("sentiment_confidence")),
            "sentiment_label": F.coalesce("_label", "sentiment_label"),
            "sentiment_method": F.when(known, "hybrid").otherwise(F.col("sentiment_method")),
        })
        .drop("_label", "_confidence")
    )


def normalize_summary(normalized: DataFrame) -> DataFrame:
    return normalized.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count("category_taxonomy").alias("enriched_rows"),
        F.count_if(F.col("content") == EMPTY_REVIEW).alias("empty_rows"),
    )


def sentiment_summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sentiment_method") == "rule").alias("rule_rows"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative_rows"),
    )


def issues_summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("issues_method") == "rule").alias("rule_rows"),
        F.count_if(F.size(F.coalesce("issues", F.array().cast(issues.ISSUE_LIST))) > 0).alias("issue_rows"),
    )


def raw_daily(raw: DataFrame) -> DataFrame:
    """The raw reviews with their calendar day."""
    return raw.select(*RAW_COLUMNS[:7], F.to_date("at_ts").alias("day"), *RAW_COLUMNS[7:])


def severity_summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(exact_mean("severity_score"), 4).alias("avg_severity"),
        F.count_if(F.col("severity_band") == "critical").alias("critical_rows"),
    )
