"""Reviews derived from the `events` test table by a fixed rule (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

OPENINGS = (
    "Great app, love it", "payment failed again", "Not good, very slow and laggy",
    "unable to login, otp not received", "app keeps crashing on start", "please add dark mode support",
    "hidden charges, fee changed", "customer service was rude", "navigation is bad and confusing",
    "my transfer to the bank was declined", "Perfect, easy and reliable", "ok.",
)
CLOSINGS = (
    "I will uninstall", "not bad though", "there was an error", "never works",
    "it is smooth and fast", "refund not received and 2fa stuck", "thanks.",
)
CATEGORIES = (
    "Account Balance", "card-management", " Money  Transfers ", "LOGIN", "crash", "notifications!", "something else",
)

HEADER_SPELLINGS = {
    "average": ("reviewId", "userName", "content", "score", "thumbsUpCount",
                "reviewCreatedVersion", "at", "appVersion", "category"),
    "bad": ("ID", "user_name", "Review Text", "Star Rating", "helpful-count",
            "review created version", "created_at", "version", "topic"),
    "good": ("review_id", "User", "comment", "rating", "thumbs_up",
             "reviewversion", "Date", "app_version", "Category Name"),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pick(items: tuple[str, ...], index: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(i) for i in items]), index.cast("int"))


def _derived(e: F.Column, u: F.Column) -> dict[str, F.Column]:
    text = F.concat_ws(" ", _pick(OPENINGS, e % 12), _pick(CLOSINGS, u % 7))
    version = F.concat(F.lit("5."), ((e + u) % 7).cast("string"), F.lit(".0"))
    return {
        "review_id": F.concat(F.lit("r"), F.when(e % 50 == 49, e - 1).otherwise(e).cast("string")),
        "user_name": F.concat(F.lit("u"), u.cast("string")),
        "content": F.when(e % 31 == 0, None).when(e % 37 == 0, "   ").otherwise(text),
        "score": F.when(e % 97 == 0, None).otherwise(1 + (e * 7 + u * 3) % 5).cast("int"),
        "thumbs_up": F.when(e % 89 == 0, None).otherwise(F.floor("value") % 80).cast("int"),
        "review_created_version": F.concat(F.lit("5."), (u % 7).cast("string"), F.lit(".0")),
        "at_ts": F.col("ts"),
        "app_version": F.when(e % 101 == 0, None).otherwise(version),
        "category_raw": _pick(CATEGORIES, e % 8),
    }


def complaint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and content: each whole document with review sentences around it, some of them far apart (see FIXTURES.md)."""
    i = F.col("doc_id")
    head = F.when(i % 5 == 0, F.concat(_pick(OPENINGS, F.floor(i / 7) % 12), F.lit(". "))).otherwise("")
    gap = F.repeat(F.lit(" indeed"), (i % 10).cast("int"))
    text = F.concat(head, "text", F.lit(" "), _pick(OPENINGS, i % 12), gap, F.lit(" "), _pick(CLOSINGS, i % 7))
    return documents.select("doc_id", text.alias("content"))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with nulls, blank texts, and two percent repeated ids."""
    columns = _derived(F.col("event_id"), F.col("user_id"))
    return events(spark, sf_dir).select(*[c.alias(name) for name, c in columns.items()])


def edited_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of the first two sources sent again: three days later, with the opposite rating, one version renamed, and some
    without an id."""
    e = F.col("event_id")
    columns = _derived(e, F.col("user_id"))
    edited = columns | {
        "review_id": F.when(e % 11 != 0, columns["review_id"]), "score": 6 - columns["score"],
        "at_ts": F.col("ts") + F.make_dt_interval(F.lit(3)),
        "app_version": F.when(columns["app_version"] == "5.6.0", "5.5.0").otherwise(columns["app_version"]),
    }
    return events(spark, sf_dir).filter((e % 7 == 3) & (e % 3 != 2)).select(*[c.alias(name) for name, c in edited.items()])


def event_review_texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same reviews as three text-only sources with different headers and untidy fields."""
    e = F.col("event_id")
    columns = _derived(e, F.col("user_id"))
    score, at = columns["score"].cast("string"), F.col("ts")
    untidy = columns | {
        "content": F.concat(F.lit("\u00a0 "), columns["content"], F.lit(" ")),
        "score": F.when(e % 53 == 0, "4.5").when(e % 59 == 0, "abc").when(e % 61 == 0, "1e0")
        .otherwise(F.concat(F.lit(" "), score, F.lit(" "))),
        "thumbs_up": columns["thumbs_up"].cast("string"),
        "at_ts": F.when(e % 43 == 0, "yesterday").when(e % 47 == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(e % 41 == 0, F.date_format(at, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
        "app_version": F.coalesce(columns["app_version"], F.lit("  ")),
        "category_raw": F.concat(columns["category_raw"], F.lit(" ")),
    }
    return {
        name: events(spark, sf_dir).filter(e % 3 == i)
        .select(*[c.alias(header) for header, c in zip(headers, untidy.values())])
        for i, (name, headers) in enumerate(HEADER_SPELLINGS.items())
    }
