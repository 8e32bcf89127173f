"""One batch of reviews applied to stored tables, at a cost that follows the batch and not the tables.

Reviews lie in partitions of (day, bucket); the bucket is a hash of the id, so that a large day, or the reviews without a day,
are many partitions. A place table says where each review lies. From it the rows that the batch replaces are found, and the
batch becomes signed changes: old rows with -1, new rows with +1. Everything else follows from the changes:

* `reviews_raw` and `reviews_enriched`: only partitions that hold a batch key or its old row are written again (dynamic
  partition overwrite); a review that changes its day leaves the old partition.
* `review_state`: differences of additive measures per (version, day, kind, name). Daily and version tables and the filter
  facets are sums over it, so they read no review.
* `user_state`: the same per (user, day, bucket). It gives the churn features, and where the reviews of a user lie: if a score
  changes, the partitions of that user are written again too.

State tables only grow by a folder per batch. Every step writes a folder named after the batch, or partitions as a function of
stored changes, so a batch that failed half-way is applied again under its number with the same result; a finished one changes
nothing. Lists of partitions are brought to the driver (days times buckets at most), rows never.

Defined cases: a null review_id is not stored. A null day is a partition of its own; a null user has no score. A partition that
loses its last review keeps one row without an id, because an overwrite cannot remove a partition; readers leave it out. An
empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from operator import or_

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echotide.functions.issues import labels_of
from echotide.operators.aggregates import day_rows, folded_state, signed_measures, state_by, version_rows
from echotide.operators.churn import MEASURES, churn_rows, has_intent, score_of, signed_user_days, tier_of
from echotide.operators.dashboards import daily_rows
from echotide.operators.enrich import enrich
from echotide.schemas import TABLES, USER_CHURN, empty_table
from echotide.sources.review_files import latest_per_review

BUCKETS = 16

PLACES = "review_id string, day date, bucket int"
CHANGES = """
    sign int, review_id string, user_name string, day date, bucket int, app_version string, category_taxonomy string, score int,
    sentiment_label string, severity_score double, issues array<struct<label:string>>, intent boolean
"""
REVIEW_STATE = """
    app_version string, day date, kind string, name string, n bigint, score_sum bigint, score_n bigint, negative bigint,
    positive bigint, critical bigint, weight decimal(38,12)
"""
USER_STATE = """
    user_name string, day date, bucket int, reviews bigint, negative bigint, severity decimal(38,12), txn_failures bigint,
    intent_mentions bigint
"""
USER_LOG = USER_CHURN.rstrip() + ", score_before double, tier_before string"
HIGH_DAYS = "day date, churn_high_users bigint"
STEPS = "id bigint, step string"
LOGS = {"review_places": PLACES, "changes": CHANGES, "review_state": REVIEW_STATE, "user_state": USER_STATE,
        "user_churn_log": USER_LOG, "high_days": HIGH_DAYS, "steps": STEPS}

Part = tuple[date | None, int]


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All batches of a state table, with their numbers."""
    schema = f"{LOGS[name]}, batch bigint"
    try:
        spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def _write_log(df: DataFrame, root: str, name: str, batch: int) -> None:
    """Replaces what an earlier attempt at the batch wrote."""
    columns = df.sparkSession.createDataFrame([], LOGS[name]).schema
    df.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def read_reviews(spark: SparkSession, root: str, name: str = "reviews_enriched") -> DataFrame:
    """The stored reviews (`reviews_raw` or `reviews_enriched`), with the columns of their schema."""
    return _stored(spark, root, name).where("review_id is not null").select(*empty_table(spark, name).columns)


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = TABLES[name] + (", bucket int" if "day date" in TABLES[name] else ", day date, bucket int")
    try:
        spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def in_parts(parts: list[Part]) -> Column:
    """Rows of the given partitions: a test of partition columns alone, so no other file is opened. One list of days for each
    bucket, so that the plan stays flat however many days there are."""
    by_bucket: dict[int, set[date | None]] = {}
    for day, bucket in parts:
        by_bucket.setdefault(bucket, set()).add(day)

    def among(days: set[date | None]) -> Column:
        known = F.coalesce(F.col("day").isin(sorted(days - {None})), F.lit(False)) if days - {None} else F.lit(False)
        return known | F.col("day").isNull() if None in days else known

    return reduce(or_, [(F.col("bucket") == bucket) & among(days) for bucket, days in sorted(by_bucket.items())], F.lit(False))


def _parts(df: DataFrame) -> list[Part]:
    return [(r["day"], r["bucket"]) for r in df.select("day", "bucket").distinct().collect()]


def apply_batch(spark: SparkSession, root: str, batch: int, staged: DataFrame, taxonomy: dict[str, str] | None = None,
                buckets: int = BUCKETS) -> None:
    """Insert or replace the reviews of a batch and bring all tables of `root` up to date. Batches are numbered upwards."""
    steps = {(r["batch"], r["step"]) for r in read_log(spark, root, "steps").where(F.col("batch") >= batch).collect()}
    if any(number > batch for number, _ in steps):
        raise ValueError(f"batch {batch} is older than batches already applied to {root}")
    if (batch, "done") in steps:
        return
    incoming = f"{root}/incoming/batch={batch}"
    if (batch, "changes") not in steps:
        fresh = latest_per_review(staged).withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(buckets)).cast("int"))
        enriched = enrich(fresh.withColumn("raw_content", F.col("content")), taxonomy)
        enriched.write.mode("overwrite").parquet(incoming)
        _write_log(_changes(spark, root, batch, spark.read.parquet(incoming)), root, "changes", batch)
        _mark(spark, root, batch, "changes")
    rows = spark.read.parquet(incoming)
    changes = spark.read.schema(CHANGES).parquet(f"{root}/changes/batch={batch}")

    def users() -> None:
        _write_log(signed_user_days(changes), root, "user_state", batch)
        _write_log(_user_scores(spark, root, batch), root, "user_churn_log", batch)

    def totals() -> None:
        _write_log(_high_days(spark, root, batch), root, "high_days", batch)
        write_totals(spark, root)

    _together(spark, users, lambda: _write_log(signed_measures(changes), root, "review_state", batch),
              lambda: _write_log(rows.select("review_id", "day", "bucket"), root, "review_places", batch))
    _together(spark, totals, lambda: _rewrite_reviews(spark, root, batch, rows, changes))
    _mark(spark, root, batch, "done")


def _together(spark: SparkSession, *steps: Callable[[], None]) -> None:
    """Steps that write tables of their own from finished ones, as Spark jobs at the same time: one alone leaves cores idle. All
    have ended when this returns or raises."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for step in running:
        step.result()


def _mark(spark: SparkSession, root: str, batch: int, step: str) -> None:
    spark.range(1).select("id", F.lit(step).alias("step")).write.mode("append").parquet(f"{root}/steps/batch={batch}")


def _changes(spark: SparkSession, root: str, batch: int, rows: DataFrame) -> DataFrame:
    """Signed rows: what the batch adds, and what it replaces."""
    latest = read_log(spark, root, "review_places").where(F.col("batch") < batch).join(rows.select("review_id"), "review_id", "left_semi")
    places = latest.groupBy("review_id").agg(F.max_by(F.struct("day", "bucket"), "batch").alias("place")).select(
        "review_id", F.col("place.day").alias("old_day"), F.col("place.bucket").alias("old_bucket"))
    touched = _parts(places.select(F.col("old_day").alias("day"), F.col("old_bucket").alias("bucket")))
    old = _stored(spark, root, "reviews_enriched").where(in_parts(touched)).join(places, "review_id")
    old = old.where(F.col("day").eqNullSafe(F.col("old_day")) & (F.col("bucket") == F.col("old_bucket")))

    def signed(df: DataFrame, sign: int) -> DataFrame:
        labels = F.transform(labels_of(F.col("issues")), lambda x: F.struct(x.alias("label")))
        return df.select(F.lit(sign).alias("sign"), "review_id", "user_name", "day", "bucket", "app_version", "category_taxonomy",
                         "score", "sentiment_label", "severity_score", labels.alias("issues"), has_intent(F.col("content")).alias("intent"))

    return signed(old, -1).unionByName(signed(rows, 1))


def _user_scores(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Users whose reviews changed: features and score now, score and tier before. Only their rows of the state are summed."""
    state = read_log(spark, root, "user_state").where(F.col("batch") <= batch)
    users = state.where((F.col("batch") == batch) & F.col("user_name").isNotNull()).select("user_name").distinct()
    earlier = F.col("batch") < batch
    sums = state.join(users, "user_name", "left_semi").groupBy("user_name").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        *[F.coalesce(F.sum(F.when(earlier, F.col(m))), F.lit(0)).alias(f"{m}_before") for m in MEASURES])
    before = score_of({m: F.col(f"{m}_before") for m in MEASURES})
    known = sums.select("user_name", before.alias("score_before")).withColumn("tier_before", tier_of(F.col("score_before")))
    return churn_rows(sums).join(known, "user_name")


def _high_days(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """How the number of high-risk users of each day changes: a user counts on the days on which they have reviews."""
    scores = read_log(spark, root, "user_churn_log").where(F.col("batch") == batch).select("user_name", "churn_user_tier", "tier_before")
    state = read_log(spark, root, "user_state").where(F.col("batch") <= batch)
    active = state.join(scores.select("user_name"), "user_name", "left_semi").groupBy("user_name", "day").agg(
        F.sum("reviews").alias("now"), F.sum(F.when(F.col("batch") < batch, F.col("reviews")).otherwise(0)).alias("before"))

    def counts(tier: str, reviews: str) -> Column:
        return F.when((F.col(tier) == "high") & (F.col(reviews) > 0), 1).otherwise(0)

    moved = counts("churn_user_tier", "now") - counts("tier_before", "before")
    return active.join(scores, "user_name").groupBy("day").agg(F.sum(moved).alias("churn_high_users")).where("churn_high_users <> 0")


def _rewrite_reviews(spark: SparkSession, root: str, batch: int, rows: DataFrame, changes: DataFrame) -> None:
    held = _parts(changes)
    scores = read_log(spark, root, "user_churn_log").where(F.col("batch") == batch).select(
        F.col("user_name"), F.col("churn_user_score").alias("new_score"), F.col("churn_user_tier").alias("new_tier"), "score_before")
    state = read_log(spark, root, "user_state").where(F.col("batch") <= batch)
    rescored = scores.where(~F.col("new_score").eqNullSafe(F.col("score_before")))
    own = state.join(rescored, "user_name", "left_semi").groupBy("user_name", "day", "bucket").agg(F.sum("reviews").alias("n"))
    touched = sorted({*held, *_parts(own.where("n > 0"))}, key=repr)
    left = state.where(in_parts(touched)).groupBy("day", "bucket").agg(F.sum("reviews").alias("n"))
    emptied = _parts(left.where("n = 0"))

    raw = rows.select("review_id", "user_name", F.col("raw_content").alias("content"), "score", "thumbs_up", "review_created_version",
                      "at_ts", "app_version", "category_raw", "day", "bucket")

    def with_scores(df: DataFrame) -> DataFrame:
        """Scores of the users that the batch touched are new, all others stay. Reviews without a user match none, and are
        spread by their own id."""
        user = scores.select(F.col("user_name").alias("user_key"), F.lit(False).alias("nameless"), "new_score", "new_tier")
        keyed = df.withColumns({"user_key": F.coalesce("user_name", "review_id"), "nameless": F.col("user_name").isNull()})
        found = keyed.join(user.withColumn("touched", F.lit(True)), ["user_key", "nameless"], "left")
        return found.withColumns({
            "churn_user_score": F.when(F.col("touched"), F.col("new_score")).otherwise(F.col("churn_user_score")),
            "churn_user_tier": F.when(F.col("touched"), F.col("new_tier")).otherwise(F.col("churn_user_tier")),
        }).select(*df.columns)

    fresh = rows.withColumns({"churn_user_score": F.lit(None).cast("double"), "churn_user_tier": F.lit(None).cast("string")})
    _together(spark, lambda: _overwrite(spark, root, "reviews_raw", held, rows, raw, emptied),
              lambda: _overwrite(spark, root, "reviews_enriched", touched, rows, fresh, emptied, with_scores))


def _overwrite(spark: SparkSession, root: str, name: str, parts: list[Part], keys: DataFrame, fresh: DataFrame, emptied: list[Part],
               change=lambda df: df) -> None:
    """Write the given partitions again: their stored rows without the batch keys, and the rows of the batch."""
    if not parts:
        return
    stored = _stored(spark, root, name)
    kept = stored.where("review_id is not null").where(in_parts(parts)).join(keys.select("review_id"), "review_id", "left_anti")
    rows = change(kept.select(*stored.columns).unionByName(fresh.select(*stored.columns)))
    blank = spark.createDataFrame([p for p in emptied if p in set(parts)], "day date, bucket int")
    rows = rows.unionByName(blank, allowMissingColumns=True)
    (rows.hint("rebalance", "day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "bucket").parquet(f"{root}/{name}"))


# -- tables that are sums over the state ----------------------------------------------------------------------------------

def review_state(spark: SparkSession, root: str) -> DataFrame:
    return folded_state(read_log(spark, root, "review_state"))


def daily_table(spark: SparkSession, root: str) -> DataFrame:
    high = read_log(spark, root, "high_days").groupBy("day").agg(F.sum("churn_high_users").alias("churn_high_users"))
    return daily_rows(day_rows(state_by("day", review_state(spark, root).where("day is not null"))), high.where("day is not null"))


def version_table(spark: SparkSession, root: str) -> DataFrame:
    return version_rows(state_by("app_version", review_state(spark, root).where("app_version is not null")))


def churn_table(spark: SparkSession, root: str) -> DataFrame:
    """Every user with reviews: the row of the last batch that touched them."""
    log = read_log(spark, root, "user_churn_log")
    columns = [c for c in log.columns if c not in ("batch", "score_before", "tier_before", "user_name")]
    latest = log.groupBy("user_name").agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return latest.select("user_name", "row.*").where("reviews > 0")


def write_totals(spark: SparkSession, root: str) -> None:
    """Daily and version tables and the counts of reviews without a key: a few rows per day and version, written whole. The churn
    table, a row per user, is read from its log instead."""
    everything = review_state(spark, root).where("kind = 'all'")
    users = read_log(spark, root, "user_state").where("user_name is null").agg(F.coalesce(F.sum("reviews"), F.lit(0)).alias("n"))
    lost = everything.agg(*[F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias(table) for table, key in (
        ("daily_aggregates", "day"), ("version_aggregates", "app_version"))])
    counts = lost.unpivot([], lost.columns, "table_name", "reviews_without_key").unionByName(
        users.select(F.lit("user_churn").alias("table_name"), F.col("n").alias("reviews_without_key")))
    for name, table in (("daily_aggregates", daily_table(spark, root)), ("version_aggregates", version_table(spark, root)),
                        ("run_counts", counts)):
        table.write.mode("overwrite").parquet(f"{root}/{name}")


def facets(spark: SparkSession, root: str) -> DataFrame:
    """How many reviews each filter value has, and the last day of a version. A value without reviews is gone."""
    state = review_state(spark, root)

    def of(kind: str, rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(value.alias("value")).agg(F.sum("n").alias("n"), F.max("day").alias("last_day")).select(
            F.lit(kind).alias("kind"), "value", "n", "last_day")

    everything = state.where("kind = 'all'")
    return reduce(DataFrame.unionByName, [
        of("category", state.where("kind = 'category'"), F.col("name")), of("issue_label", state.where("kind = 'issue'"), F.col("name")),
        of("version", everything, F.nullif("app_version", F.lit(""))), of("day", everything, F.col("day").cast("string")),
    ]).where("value is not null")
