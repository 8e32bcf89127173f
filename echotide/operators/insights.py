"""Ranked findings behind the report pages: pain points, backlog, risks, themes, spikes, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.issues import labels_of
from echotide.functions.numbers import exact_sum, rounded
from echotide.functions.text import excerpt
from echotide.operators.aggregates import by_weight, day_table, issue_totals, measures_by_day
from echotide.operators.scope import Scope
from echotide.operators.trends import SPIKE_DAYS, with_flags


def impact(weight: Column) -> Column:
    return F.when(weight >= 12.0, "high").when(weight >= 5.0, "med").otherwise("low")


def _strongest() -> list[Column]:
    return [F.desc(F.coalesce("severity_score", F.lit(0.0))), F.desc(F.coalesce("thumbs_up", F.lit(0))),
            F.desc_nulls_last("at_ts"), F.asc("review_id")]


def _with_quotes(winners: DataFrame, reviews: DataFrame) -> DataFrame:
    """Excerpts of the reviews that a ranking has chosen: only the identifiers were ranked, texts are fetched for the few winners."""
    return winners.join(reviews.select("review_id", excerpt(F.col("content")).alias("quote")), "review_id")


def _strongest_of(mentions: DataFrame, group: list[str], number: int) -> DataFrame:
    """The strongest reviews of every group, as (group, quote_rank, review_id). Each task keeps only its best before the shuffle."""
    order = F.row_number().over(Window.partitionBy(*group).orderBy(*_strongest()))
    return mentions.withColumn("quote_rank", order).filter(F.col("quote_rank") <= number).select(*group, "quote_rank", "review_id")


def label_quotes(scoped: DataFrame, per_label: int = 3) -> DataFrame:
    """The strongest reviews of every label."""
    mentions = scoped.select(
        F.explode(labels_of(F.col("issues"))).alias("label"), "review_id", "severity_score", "thumbs_up", "at_ts")
    found = _with_quotes(_strongest_of(mentions, ["label"], per_label), scoped)
    return found.select("label", "quote_rank", "review_id", "quote")


def _ranked_labels(scoped: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(*by_weight()))
    return issue_totals(scoped, []).withColumn("rank", rank)


def pain_points(scoped: DataFrame, per_label: int = 3) -> DataFrame:
    """Labels by summed severity, each with its strongest quotes."""
    weight = rounded("weight", 4)
    ranked = _ranked_labels(scoped).select(
        "rank", "label", "review_count", weight.alias("weighted_severity"), impact(weight).alias("impact")
    )
    return ranked.join(label_quotes(scoped, per_label), "label")


def ticket_type(label: Column) -> Column:
    return (
        F.when(label == "Feature Requests", "feature")
        .when(label.isin("UI/UX Problems", "Policy Complaints", "Customer Support"), "improvement")
        .otherwise("bug")
    )


def backlog_candidates(scoped: DataFrame, quotes: int = 2) -> DataFrame:
    """One ticket per label: type, priority from critical share and weight, quotes, all versions, most reviews first."""
    exploded = scoped.select(
        F.explode(labels_of(F.col("issues"))).alias("label"), "app_version",
        F.coalesce("severity_score", F.lit(0.0)).alias("severity"),
    )
    per_version = exploded.groupBy("label", "app_version").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("severity").alias("weight"),
        F.count_if(F.col("severity") >= 0.80).alias("critical"),
    )
    known = F.col("app_version").isNotNull()
    totals = per_version.groupBy("label").agg(
        F.sum("n").alias("review_count"), F.sum("weight").alias("weight"), F.sum("critical").alias("critical"),
        F.sort_array(F.collect_list(F.when(known, F.struct((-F.col("n")).alias("n"), "app_version")))).alias("all_versions"),
    )
    weight = rounded("weight", 4)
    critical_share = F.round(F.col("critical") / F.col("review_count"), 4)
    priority = (
        F.when(critical_share >= 0.30, "P0").when(weight >= 12.0, "P1").when(weight >= 5.0, "P2").otherwise("P3")
    )
    picked = label_quotes(scoped, quotes).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("quote_rank", "quote"))), lambda q: q["quote"]).alias("quotes")
    )
    return totals.join(picked, "label").select(
        F.concat(F.lit("Address "), "label").alias("title"), ticket_type(F.col("label")).alias("type"),
        priority.alias("priority"), F.round(F.col("weight").cast("double") / F.col("review_count"), 3).alias("severity_score"),
        "label", "review_count", weight.alias("weighted_severity"), critical_share.alias("critical_share"),
        F.col("quotes").alias("evidence_quotes"),
        F.transform("all_versions", lambda v: v["app_version"]).alias("related_versions"),
    )


def backlog_tickets(scoped: DataFrame) -> DataFrame:
    """The candidates as tickets of the backlog contract, most urgent first. One row; its list has one ticket per label."""
    ticket = F.struct(
        "title", "type", "priority", "severity_score",
        F.concat(F.col("review_count").cast("string"), F.lit(" reviews")).alias("impact_notes"),
        F.array(F.lit("No new reports for a week")).alias("acceptance_criteria"), "evidence_quotes",
        F.array("label").alias("related_labels"), "related_versions",
    )
    order = F.struct(F.col("priority").alias("p"), (-F.col("weighted_severity")).alias("w"), F.col("label").alias("l"),
                     ticket.alias("ticket"))
    return backlog_candidates(scoped).agg(F.sort_array(F.collect_list(order)).alias("ordered")).select(
        F.transform("ordered", lambda x: x["ticket"]).alias("tickets"))


def emerging_risks(reviews: DataFrame, days: int = 7, tolerance: float = 0.2) -> DataFrame:
    """Share of each label in the last days against the days before: rising, stable or falling."""
    newest = reviews.agg(F.max("day").alias("newest")).scalar()
    compared = reviews.filter((F.col("day") > F.date_sub(newest, 2 * days)) & (F.col("day") <= newest))
    parts = measures_by_day(compared).filter(F.col("kind").isin("all", "issue"))
    recent = parts.withColumn("period", F.floor(F.datediff(newest, "day") / days))

    def count(period: int) -> Column:
        return F.sum(F.when(F.col("period") == period, F.col("n")).otherwise(0))

    counts = recent.groupBy("kind", "name").agg(count(0).alias("now"), count(1).alias("before"))
    everything = Window.partitionBy()

    def share(column: str) -> Column:
        total = F.max(F.when(F.col("kind") == "all", F.col(column))).over(everything)
        return F.round(F.coalesce(F.col(column) / F.nullif(total, F.lit(0)), F.lit(0.0)), 4)

    shares = counts.select("kind", F.col("name").alias("label"), share("now").alias("share_now"),
                           share("before").alias("share_before"))
    trend = (
        F.when(F.col("share_now") > F.round(F.col("share_before") * (1 + tolerance), 6), "rising")
        .when(F.col("share_now") < F.round(F.col("share_before") * (1 - tolerance), 6), "falling").otherwise("stable")
    )
    return shares.filter("kind = 'issue'").select("label", "share_now", "share_before", trend.alias("trend"))


def _evidence_rows(reviews: DataFrame, label: str, before: Column) -> DataFrame:
    """One row per distinct evidence phrase of one label, and one for the review as a whole."""
    own = F.filter("issues", lambda i: i["label"] == label)
    phrases = F.concat(before, F.array_distinct(F.flatten(F.transform(own, lambda i: i["evidence"]))))
    return reviews.filter(F.exists("issues", lambda i: i["label"] == label)).select(
        F.explode(phrases).alias("phrase"), "review_id", "severity_score", "thumbs_up", "at_ts",
        F.coalesce("severity_score", F.lit(0.0)).alias("severity"),
        F.greatest(F.lit(0), F.coalesce("thumbs_up", F.lit(0))).cast("bigint").alias("thumbs"),
    )


def feature_requests(scoped: DataFrame) -> DataFrame:
    """Requested features by summed severity, then by votes."""
    rows = _evidence_rows(scoped, "Feature Requests", F.array().cast("array<string>"))
    return rows.groupBy(F.col("phrase").alias("request")).agg(
        F.count(F.lit(1)).alias("review_count"), rounded(exact_sum("severity"), 4).alias("weighted_severity"),
        F.sum("thumbs").alias("thumbs_up"),
    ).withColumn("priority", impact(F.col("weighted_severity"))).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("weighted_severity"), F.desc("thumbs_up"), "request"))
    )


def policy_themes(scoped: DataFrame, quotes: int = 2) -> DataFrame:
    """Phrases behind policy complaints, with their share of all such reviews and the strongest of them in words."""
    rows = _evidence_rows(scoped, "Policy Complaints", F.array(F.lit("*")))
    counts = rows.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"), rounded(exact_sum("severity"), 4).alias("weighted_severity")
    )
    total = F.max(F.when(F.col("phrase") == "*", F.col("n"))).over(Window.partitionBy())
    themes = counts.select(
        F.col("phrase").alias("theme"), F.col("n").alias("review_count"),
        F.round(F.col("n") / total, 4).alias("share"), "weighted_severity",
    ).filter(F.col("theme") != "*")
    chosen = _strongest_of(rows.filter("phrase <> '*'"), ["phrase"], quotes)
    said = _with_quotes(chosen, scoped).groupBy(F.col("phrase").alias("theme")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("quote_rank", "quote"))), lambda q: q["quote"]).alias("evidence_quotes"))
    return themes.join(said, "theme")


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(?Us)^(?:\w+|\W)", 0)


def competitor_mentions(scoped: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """Reviews naming each competitor as a whole word, with the sentiment mix.

    The names are a table (column `name`), of any size. Every place of a text where a name could begin yields a window as long
    as the longest name, and windows are joined to the names by their first word, so the work grows with the text and the hits,
    not with the number of names. A review counts once per name; an empty name is never mentioned.
    """
    if "review_id" not in scoped.columns:
        scoped = scoped.withColumn("review_id", F.monotonically_increasing_id())
    if isinstance(names, list):
        names = scoped.sparkSession.createDataFrame([(n,) for n in names], "name string")
    listed = names.select("name", F.lower("name").alias("low")).filter("low <> ''").distinct()
    # Two facts about the names, of bounded size: their greatest length and the characters they begin with.
    longest, letters = listed.agg(F.coalesce(F.max(F.length("low")), F.lit(1)), F.collect_set(F.substring("low", 1, 1))).first()
    begins = "".join(rf"\x{{{ord(c):x}}}" for c in sorted(letters)) or r"\x{0}"
    keyed = listed.withColumn("key", _first_word(F.col("low")))
    windows = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(rf"(?Us)(?<!\w)(?=([{begins}].{{0,{longest}}}))"), F.lit(1))
    places = scoped.select("review_id", "sentiment_label", F.explode(F.array_distinct(windows)).alias("window")).withColumn(
        "key", _first_word(F.col("window")))
    ends = ~F.rlike(F.substr("window", F.length("low") + 1, F.lit(1)), F.lit(r"(?U)^\w"))
    mentioned = places.join(keyed, "key").filter(F.startswith("window", "low") & ends).dropDuplicates(["review_id", "name"])
    return mentioned.groupBy("name").agg(
        F.count(F.lit(1)).alias("mentions"),
        *[F.count_if(F.col("sentiment_label") == s).alias(s) for s in ("positive", "neutral", "negative")],
    )


def spike_drivers(reviews: DataFrame, top: int = 3) -> DataFrame:
    """For each spike: labels whose share rose most over the preceding days, with the strongest review and its words. Drivers are
    at most `top` rows per metric and calendar day. The base is a running sum over the numbered days, so no history is carried."""
    by_day = Window.orderBy("day")
    counts = F.transform("entries", lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n")))
    days = with_flags(day_table(reviews.filter(F.col("day").isNotNull()))).select(
        "day", F.row_number().over(by_day).alias("place"), F.col("total_reviews").alias("total"),
        F.sum("total_reviews").over(by_day.rowsBetween(-SPIKE_DAYS, -1)).alias("total_before"), counts.alias("labels"), "anomaly_flags")
    earlier = Window.partitionBy("label").orderBy("place").rangeBetween(-SPIKE_DAYS, -1)
    labelled = days.select("day", "place", "total", "total_before", "anomaly_flags", F.inline("labels")).withColumn(
        "n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    spikes = labelled.select("*", F.inline("anomaly_flags"))
    share, share_before = F.col("n") / F.col("total"), F.try_divide("n_before", "total_before")
    lifts = spikes.select(
        "day", "metric", "z_score", "label", F.round(share, 4).alias("share"), F.round(share_before, 4).alias("share_before"),
        F.round(share - share_before, 4).alias("lift"))
    order = Window.partitionBy("day", "metric").orderBy(F.desc("lift"), "label")
    drivers = lifts.filter("lift > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    mentions = reviews.select(
        "day", F.explode(labels_of(F.col("issues"))).alias("label"), "review_id", "severity_score", "thumbs_up", "at_ts")
    wanted = mentions.join(drivers.select("day", "label").distinct(), ["day", "label"], "left_semi")
    found = _with_quotes(_strongest_of(wanted, ["day", "label"], 1), reviews).select(
        "day", "label", F.col("review_id").alias("evidence_review_id"), F.col("quote").alias("evidence_quote"))
    return drivers.join(found, ["day", "label"])


def kpi_tiles(reviews: DataFrame, scope: Scope) -> DataFrame:
    """KPIs of a period next to the equally long period before it."""
    before = scope.previous_period()
    both = Scope(before.start_date, scope.end_date, scope.category, scope.version, scope.issue_label)
    is_now = F.col("day") >= F.lit(scope.start_date).cast("date")

    def pair(name: str, value) -> list[Column]:
        return [value(is_now).alias(f"{name}_now"), value(~is_now).alias(f"{name}_before")]

    def rate(of: Column):
        return lambda where: F.coalesce(F.avg(F.when(where, of)), F.lit(0.0))

    negative = F.when(F.col("sentiment_label") == "negative", 1.0).otherwise(0.0)
    values = both.apply(reviews).agg(
        *pair("total_reviews", lambda where: F.count_if(where).cast("double")),
        *pair("avg_rating", rate(F.col("score").cast("double"))),
        *pair("pct_negative", rate(negative)),
        *pair("critical_count", lambda where: F.count_if(where & (F.col("severity_band") == "critical")).cast("double")),
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("label"), F.round(f"{n}_now", 4).alias("value"),
                 F.round(F.col(f"{n}_now") - F.col(f"{n}_before"), 4).alias("delta"))
        for n in ("total_reviews", "avg_rating", "pct_negative", "critical_count")
    ])
    return values.select(F.inline(rows))
