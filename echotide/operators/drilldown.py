"""Filtered review pages, evidence quotes and filter choices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.issues import labels_of
from echotide.functions.text import excerpt
from echotide.operators.scope import Scope

MAX_PAGE = 200
MAX_QUOTES = 50


def _severity() -> Column:
    return F.coalesce("severity_score", F.lit(0.0))


def review_rows(scoped: DataFrame) -> DataFrame:
    """The columns of a drilldown, with defaults for missing values, plus the sort key."""
    return scoped.select(
        "review_id", "day", "app_version",
        F.coalesce("category_taxonomy", F.lit("Other")).alias("category_taxonomy"),
        F.coalesce("sentiment_label", F.lit("unknown")).alias("sentiment_label"),
        F.coalesce("severity_band", F.lit("unknown")).alias("severity_band"),
        F.round(_severity(), 3).alias("severity_score"),
        "score", F.coalesce("thumbs_up", F.lit(0)).alias("thumbs_up"),
        F.array_join(labels_of(F.col("issues")), ", ").alias("issues"),
        "content", _severity().alias("sort_severity"),
    )


def search_reviews(
    reviews: DataFrame,
    scope: Scope,
    page: int = 1,
    page_size: int = 25,
    after: tuple[date, float, str] | None = None,
) -> DataFrame:
    """One page of reviews, newest and most severe first.

    Early pages are a top-k. For deep pages pass `after`, the (day, sort_severity, review_id)
    of the last row seen: the next page is then a top-k again, however far down it is.
    """
    size = max(1, min(int(page_size), MAX_PAGE))
    rows = review_rows(scope.apply(reviews))
    if after is not None:
        day, severity, review_id = (F.lit(v) for v in after)
        same_day = F.col("day") == day
        rows = rows.filter(
            (F.col("day") < day) | F.col("day").isNull()
            | (same_day & (F.col("sort_severity") < severity))
            | (same_day & (F.col("sort_severity") == severity) & (F.col("review_id") > review_id))
        )
    ordered = rows.orderBy(F.desc_nulls_last("day"), F.desc("sort_severity"), F.asc_nulls_last("review_id"))
    skip = 0 if after is not None else (max(int(page), 1) - 1) * size
    page_rows = (ordered.offset(skip) if skip else ordered).limit(size)
    return page_rows if after is not None else page_rows.drop("sort_severity")


def count_reviews(reviews: DataFrame, scope: Scope) -> DataFrame:
    return scope.apply(reviews).agg(F.count(F.lit(1)).alias("total_rows"))


def evidence_quotes(reviews: DataFrame, scope: Scope, limit: int = 5) -> DataFrame:
    """The most severe and most supported reviews of a scope, as short quotes."""
    order = [F.desc(_severity()), F.desc(F.coalesce("thumbs_up", F.lit(0))),
             F.desc_nulls_last("at_ts"), F.asc("review_id")]
    best = scope.apply(reviews).orderBy(*order).limit(max(1, min(int(limit), MAX_QUOTES)))
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "review_id", "day", "score", "thumbs_up", "app_version",
        F.coalesce("category_taxonomy", F.lit("Other")).alias("category_taxonomy"),
        F.coalesce("sentiment_label", F.lit("unknown")).alias("sentiment_label"),
        F.round(_severity(), 3).alias("severity_score"),
        excerpt(F.col("content"), scope.issue_label or None).alias("quote"),
    )


def filter_options(reviews: DataFrame) -> DataFrame:
    """Every value a filter can take, one row each: (kind, position, value).

    One pass: each review names its values, equal ones collapse before the shuffle, and the
    few distinct values left are put in order.
    """

    def option(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    choices = F.concat(
        F.array(
            option("category", F.coalesce("category_taxonomy", F.lit("Other"))),
            option("version", F.nullif("app_version", F.lit(""))),
            option("day", F.col("day").cast("string")),
        ),
        F.transform(labels_of(F.col("issues")), lambda x: option("issue_label", x)),
    )
    distinct = (
        reviews.select("day", F.explode(choices).alias("o"))
        .groupBy("o.kind", "o.value").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
        .filter(F.col("value").isNotNull())
    )
    return listed_options(distinct)


def listed_options(distinct: DataFrame) -> DataFrame:
    """The choices of every filter in order, from (kind, value, n, last_day)."""
    bounds = distinct.filter("kind = 'day'").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        F.inline(F.array(
            F.struct(F.lit("min_day").alias("kind"), F.col("lo").alias("value"), F.lit(1).alias("position")),
            F.struct(F.lit("max_day").alias("kind"), F.col("hi").alias("value"), F.lit(1).alias("position")),
        ))
    )
    newest_first = F.when(F.col("kind") == "version", F.datediff("last_day", F.lit("1970-01-01").cast("date")))
    most_first = F.when(F.col("kind") == "version", F.col("n"))
    order = Window.partitionBy("kind").orderBy(F.desc_nulls_last(newest_first), F.desc_nulls_last(most_first), "value")
    listed = distinct.filter("kind <> 'day'").select("kind", "value", F.row_number().over(order).alias("position"))
    return listed.unionByName(bounds)
