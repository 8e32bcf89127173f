"""Severity score and band of one review."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echotide.functions.fixed_values import (
    CRITICAL_ISSUES, FAILURE_TERMS, HIGH_ISSUES, SEVERITY_BANDS, SEVERITY_WEIGHTS,
)
from echotide.functions.text import any_present, bind


def rating_part(score: Column) -> Column:
    stars = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(score, F.lit(3))))
    return (F.lit(5) - stars) / F.lit(4.0)


def sentiment_part(label: Column) -> Column:
    return F.when(label == "negative", 1.0).when(label == "positive", 0.1).otherwise(0.4)


def failure_part(content: Column) -> Column:
    return F.when(any_present(F.lower(F.coalesce(content, F.lit(""))), FAILURE_TERMS), 1.0).otherwise(0.0)


def issue_part(labels: Column) -> Column:
    def weigh(lowered: Column) -> Column:
        def any_of(names: tuple[str, ...]) -> Column:
            return F.arrays_overlap(lowered, F.array(*[F.lit(n) for n in names]))

        return F.when(any_of(CRITICAL_ISSUES), 1.0).when(any_of(HIGH_ISSUES), 0.5).otherwise(0.3)

    return bind(F.transform(labels, lambda label: F.lower(F.trim(label))), weigh)


def thumbs_part(thumbs_up: Column) -> Column:
    votes = F.greatest(F.lit(0), F.coalesce(thumbs_up, F.lit(0)))
    return F.least(F.lit(1.0), F.log(F.lit(1) + votes) / F.log(F.lit(51.0)))


def severity(score: Column, sentiment: Column, content: Column, labels: Column, thumbs_up: Column) -> Column:
    w = SEVERITY_WEIGHTS
    total = (
        F.lit(w["rating"]) * rating_part(score)
        + F.lit(w["sentiment"]) * sentiment_part(sentiment)
        + F.lit(w["failure"]) * failure_part(content)
        + F.lit(w["issue"]) * issue_part(labels)
        + F.lit(w["thumbs"]) * thumbs_part(thumbs_up)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def band_of(value: Column) -> Column:
    band = F
    for floor, name in SEVERITY_BANDS:
        band = band.when(value >= floor, name)
    return band.otherwise("low")
