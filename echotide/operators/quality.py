"""Checks of the enrichment against expectations and hand labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.fixed_values import ISSUE_RULES
from echotide.functions.issues import has_label, labels_of
from echotide.functions.numbers import exact_mean


def quality_checks(reviews: DataFrame) -> DataFrame:
    """One row per check with its value, the bound it must reach, and whether it does."""
    known = F.array(*[F.lit(label) for label in ISSUE_RULES])
    labels = labels_of(F.col("issues"))
    failure = F.when(has_label(F.col("issues"), "Transaction Failure"), 1.0).otherwise(0.0)

    def rate(of: Column, where: Column) -> Column:
        return F.avg(F.when(where, F.when(of, 1.0).otherwise(0.0)))

    def mean_severity(score: int) -> Column:
        return exact_mean(F.when(F.col("score") == score, F.col("severity_score")))

    valid = (
        F.col("sentiment_label").isin("negative", "neutral", "positive")
        & F.col("severity_band").isin("low", "med", "high", "critical")
        & F.col("issues").isNotNull() & (F.size(F.array_except(labels, known)) == 0)
    )
    checks = {
        "valid_rows": (F.avg(F.when(valid, 1.0).otherwise(0.0)), 1.0),
        "negative_share_score_1": (rate(F.col("sentiment_label") == "negative", F.col("score") == 1), 0.85),
        "positive_share_score_5": (rate(F.col("sentiment_label") == "positive", F.col("score") == 5), 0.85),
        "severity_gap_score_1_vs_5": (mean_severity(1) - mean_severity(5), 0.0),
        "failure_vs_low_score": (-F.corr(failure, F.col("score").cast("double")), 0.0),
        "failure_vs_severity": (F.corr(failure, F.col("severity_score")), 0.0),
    }
    values = reviews.agg(*[F.round(value, 4).alias(name) for name, (value, _) in checks.items()])
    rows = F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(n).alias("value"), F.lit(float(b)).alias("bound"))
        for n, (_, b) in checks.items()
    ])
    reached = F.when(F.col("check_name").isin("valid_rows", "negative_share_score_1", "positive_share_score_5"),
                     F.col("value") >= F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return values.select(F.inline(rows)).withColumn("passed", F.coalesce(reached, F.lit(False)))


def golden_scores(reviews: DataFrame, golden: DataFrame, k: int = 2) -> DataFrame:
    """Sentiment accuracy, band accuracy and label precision at k against hand labels.

    Labels are ranked by confidence, then name; a review without labels has no precision.
    """
    gold_labels = F.transform(F.split(F.coalesce("gold_issue_labels", F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    ranked = F.transform(
        F.sort_array(F.transform("issues", lambda i: F.struct((-i["confidence"]).alias("c"), i["label"].alias("l")))),
        lambda r: F.lower(r["l"]),
    )
    top = F.slice(ranked, 1, k)
    precision = F.when(F.size(top) > 0, F.size(F.array_intersect(top, gold_labels)) / F.size(top))
    return reviews.join(golden, "review_id").agg(
        F.count(F.lit(1)).alias("labelled"),
        F.round(F.avg(F.when(F.col("sentiment_label") == F.col("gold_sentiment"), 1.0).otherwise(0.0)), 4)
        .alias("sentiment_accuracy"),
        F.round(F.avg(F.when(F.col("severity_band") == F.col("gold_severity_band"), 1.0).otherwise(0.0)), 4)
        .alias("band_accuracy"),
        F.round(F.avg(precision), 4).alias("label_precision_at_k"),
    )


def golden_sample(reviews: DataFrame, per_stratum: int = 4, salt: str = "") -> DataFrame:
    """A fixed random sample for hand labelling, equally many per rating and category."""
    draw = F.md5(F.concat("review_id", F.lit(salt)))
    order = Window.partitionBy("score", "category_taxonomy").orderBy(draw, "review_id")
    return (
        reviews.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= per_stratum)
        .select("review_id", "score", "category_taxonomy", "content")
    )
