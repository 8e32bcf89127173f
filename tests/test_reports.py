"""Pipeline runs, scopes, reports, contracts and properties of the aggregates."""

import datetime as dt
import hashlib
import json
import random
import re
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from echotide.functions import text
from echotide.operators import (
    aggregates, churn, contracts, dashboards, drilldown, insights, quality, report_store, reports, trends,
)
from echotide.operators.scope import Scope, default_window, iso_day, preset_window
from echotide.plans import catalog, pipeline
from echotide.sources.event_reviews import event_review_texts
from echotide.sources.review_files import combine
from echotide.tables import read_table


def test_scope_rules():
    assert iso_day("2024-01-02T10:00") == iso_day(" 2024-01-02 10:00 ") == iso_day(dt.datetime(2024, 1, 2, 5)) == "2024-01-02"
    assert iso_day(dt.date(2024, 1, 2)) == "2024-01-02" and iso_day("  ") is None
    for wrong in ("garbage", 20240102):
        with pytest.raises((ValueError, TypeError)):
            iso_day(wrong)
    swapped = Scope.of("2024-02-01", "2024-01-01", " A ", None, "")
    assert (swapped.start_date, swapped.end_date, swapped.category) == ("2024-01-01", "2024-02-01", "A")
    before = Scope.of("2024-03-01", "2024-03-07").previous_period()
    assert (before.start_date, before.end_date) == ("2024-02-23", "2024-02-29")


def test_windows(spark, reviews):
    full = Scope().within(reviews)
    low, high = reviews.agg(F.min("day"), F.max("day")).first()
    assert (full.start_date, full.end_date) == (str(max(low, high - dt.timedelta(6))), str(high))
    assert rows(preset_window(reviews, "bogus")) == rows(preset_window(reviews, "7D"))
    none = default_window(reviews.limit(0)).first()
    assert none["end_day"] - none["start_day"] == dt.timedelta(6)


def test_enrichment_keeps_rows_and_ranges(spark, reviews):
    raw = catalog.deduped(spark, SMALL)
    assert reviews.count() == raw.count() == reviews.select("review_id").distinct().count()
    assert reviews.filter("severity_score < 0 or severity_score > 1 or severity_score is null").count() == 0


def test_totals_agree(spark, reviews):
    daily, versions = aggregates.daily_kpis(reviews), aggregates.version_kpis(reviews)
    total = reviews.count()
    assert daily.agg(F.sum("total_reviews")).first()[0] == total == versions.agg(F.sum("total_reviews")).first()[0]
    per_version = versions.filter("app_version is not null").select("total_reviews", "category_breakdown").collect()
    assert all(v["total_reviews"] == sum(c["review_count"] for c in v["category_breakdown"]) for v in per_version)
    unknown = versions.filter("app_version is null").first()
    assert unknown["issue_breakdown"] == [] == unknown["category_breakdown"]
    gap = {r["score"]: r["avg_severity"] for r in aggregates.severity_by_rating(reviews).collect()}
    assert gap[1] > gap[5]
    assert aggregates.negative_rate(reviews).first()[0] >= 0.70


def test_empty_scopes(spark, reviews):
    nothing = Scope.of("1999-01-01", "1999-01-02")
    assert rows(aggregates.kpi_snapshot(nothing.apply(reviews))) == [(0, 0.0, 0.0, 0)]
    assert aggregates.top_issues(nothing.apply(reviews)).count() == 0
    assert drilldown.evidence_quotes(reviews, nothing).count() == 0
    versions = aggregates.version_kpis(reviews)
    assert aggregates.release_delta(versions, "5.1.0", "none").count() == 0
    assert trends.anomaly_flags(catalog.daily(spark, SMALL), Scope.of("2024-01-01", "2024-01-31", version="5.1.0")).count() == 0
    payload = reports.report_payload(reviews, catalog.daily(spark, SMALL), nothing, "weekly_exec_brief")
    brief = reports.weekly_brief(payload).first()["brief"]
    assert brief["drivers"] == [] and [r["severity"] for r in brief["risks"]] == ["low", "low"]
    assert brief["headline"] == "Weekly health: rating 0.00, negative 0.0%, critical 0."


def test_paging_visits_every_row_once(spark, reviews):
    scope, seen, after = Scope.of("2024-01-01", "2024-01-08"), [], None
    total = drilldown.count_reviews(reviews, scope).first()[0]
    for _ in range(total // 90 + 2):
        page = drilldown.search_reviews(reviews, scope, page_size=90, after=after or (dt.date(9999, 1, 1), 9.0, ""))
        found = page.collect()
        if not found:
            break
        seen += [r["review_id"] for r in found]
        after = (found[-1]["day"], found[-1]["sort_severity"], found[-1]["review_id"])
    by_offset = [
        r["review_id"] for p in range(1, total // 100 + 2)
        for r in drilldown.search_reviews(reviews, scope, page=p, page_size=100).collect()
    ]
    assert len(seen) == total and seen == by_offset
    assert drilldown.search_reviews(reviews, scope, page=0, page_size=10**6).count() == min(200, total)


def test_spikes_need_history_and_spread(spark):
    values = [0.1, 0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.9, 0.1]
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)] + [(None, 9.0)]
    frame = spark.createDataFrame(days, "day date, pct_negative double").selectExpr(
        "day", "pct_negative", "5L critical_count", "array(named_struct('label', 'x', 'n', 3L)) entries")
    flagged = trends.with_flags(frame).filter(F.size("anomaly_flags") > 0).collect()
    assert [(r["day"].day, [f["metric"] for f in r["anomaly_flags"]]) for r in flagged] == [(8, ["pct_negative"])]


def test_moving_average_skips_missing_days(spark):
    days = [("2024-01-01", 1.0), ("2024-01-07", 3.0), ("2024-01-08", 5.0)]
    frame = spark.createDataFrame(days, "day string, avg_rating double").selectExpr(
        "cast(day as date) day", "avg_rating", "avg_rating pct_negative")
    found = trends.moving_averages(frame).orderBy("day").collect()
    assert [(r["avg_rating_7dma"], r["days_in_window"]) for r in found] == [(1.0, 1), (2.0, 2), (4.0, 2)]


def test_versions_are_ordered_by_number(spark):
    frame = spark.createDataFrame(
        [("5.10.0", 3.0), ("5.9.0", 2.0), ("5.9.0.1", 4.0), ("x", 1.0)], "app_version string, avg_rating double"
    ).selectExpr("app_version", "date'2024-01-01' first_seen_day", "avg_rating", "0D pct_negative", "0L critical_count")
    found = {r["app_version"]: r["previous_version"] for r in trends.version_kpi_deltas(frame).collect()}
    assert found == {"x": None, "5.9.0": "x", "5.9.0.1": "5.9.0", "5.10.0": "5.9.0.1"}


def test_one_user_with_most_reviews(spark, reviews):
    """A third of all rows under one name gives the same result as scoring that name alone."""
    hot = reviews.withColumn("user_name", F.when(F.hash("review_id") % 3 == 0, "hot").otherwise(F.col("user_name")))
    alone = churn.user_churn(hot.filter("user_name = 'hot'"))
    assert rows(churn.user_churn(hot).filter("user_name = 'hot'")) == rows(alone)
    days = churn.daily_high_churn(hot)
    high = [r["user_name"] for r in churn.user_churn(hot).filter("churn_user_tier = 'high'").collect()]
    expected = hot.filter(F.col("user_name").isin(high)).groupBy("day").agg(F.countDistinct("user_name"))
    assert rows(days) == rows(expected)


@pytest.mark.parametrize("category", ["", "Ünïcode \"q\" \\ /", "tab\tnl\n\x7f\x01 😀"])
def test_keys_equal_the_hash_of_canonical_json(spark, category):
    scope = Scope("2024-01-01", "2024-01-07", category, "5.1.0", "")
    frame = spark.createDataFrame([tuple(scope.as_dict().values())], ", ".join(f"{k} string" for k in scope.as_dict()))
    text = frame.select(reports.scope_json(F.struct("*"))).first()[0]
    assert text == json.dumps(scope.as_dict(), sort_keys=True, separators=(",", ":"))
    assert reports.report_key("weekly_exec_brief", scope) == hashlib.sha256(f"weekly_exec_brief{text}".encode()).hexdigest()


TICKET = {"title": "t", "type": "bug", "priority": "P0", "severity_score": 0.8, "impact_notes": "n", "acceptance_criteria": [],
          "evidence_quotes": ["q"], "related_labels": ["A", "B"], "related_versions": []}


def test_contracts(spark):
    cases = [
        ("sprint_backlog", {"tickets": [TICKET]}, []),
        ("sprint_backlog", {"tickets": [TICKET | {"type": "epic"}]}, ["tickets"]),
        ("sprint_backlog", {"tickets": [{k: v for k, v in TICKET.items() if k != "title"}]}, ["tickets"]),
        ("sprint_backlog", {"tickets": [TICKET | {"extra": 1}]}, ["tickets"]),
        ("sprint_backlog", {"tickets": [TICKET | {"severity_score": "0.8"}]}, ["tickets"]),
        ("sprint_backlog", {"tickets": [TICKET | {"title": ""}]}, ["tickets"]),
        ("sprint_backlog", {"tickets": {}}, ["tickets"]), ("sprint_backlog", {}, ["tickets"]),
        ("sprint_backlog", {"tickets": [], "more": 1}, ["unknown field"]),
        ("sentiment", {"sentiment_label": "x", "confidence": 1, "other": 2}, []),
        ("sentiment", {"sentiment_label": 1}, ["sentiment_label", "confidence"]),
        ("issues", [{"label": "x", "confidence": 0.5, "more": 1}], []), ("issues", [{"label": "x"}], ["issues"]),
        ("issues", {}, ["issues"]), ("insight_report", {"summary": "s"}, []), ("insight_report", [], ["summary"]),
        ("unchecked", 5, []),
    ]
    frame = spark.createDataFrame([(i, t, json.dumps(c)) for i, (t, c, _) in enumerate(cases)],
                                  "id int, report_type string, content_json string")
    found = [r["violations"] for r in contracts.check_reports(frame).orderBy("id").collect()]
    assert found == [v for _, _, v in cases]
    broken = spark.createDataFrame([("sentiment", "{")], "report_type string, content_json string")
    assert contracts.check_reports(broken).first()["violations"] == ["not JSON"]


def test_ticket_defaults(spark):
    tickets = [TICKET | {"owner": " ", "assignee": "Bo", "estimate": 3}, "x", {"severity_score": "0.9", "effort": None, "estimate": 5},
               {"severity_score": {}, "suggested_owner": 5, "priority": "P1", "story_points": "2.5"}]
    frame = spark.createDataFrame([(json.dumps({"tickets": tickets}),), ("{}",), ("[",)], "content_json string")
    found = contracts.ticket_rows(frame).orderBy("ticket_id").collect()
    assert [(r["ticket_id"], r["priority"], r["title"], r["severity_score"], r["owner"], r["related_labels"]) for r in found] == [
        (1, "P0", "t", 0.8, "Bo", "A, B"), (2, "P3", "Untitled", 0.9, "Unassigned", ""), (3, "P1", "Untitled", 0.0, "Unassigned", "")]
    assert tuple(contracts.ticket_board_totals(frame).first()) == (3, 1, 1, 2, 5.5)


def test_competitors_are_whole_words(spark):
    frame = spark.createDataFrame(
        [("Acme is better", "negative"), ("acmes", "positive"), ("like C++ bank", "neutral"), (None, "neutral")],
        "content string, sentiment_label string")
    found = {r["name"]: r["mentions"] for r in insights.competitor_mentions(frame, ["Acme", "C++"]).collect()}
    assert found == {"Acme": 1, "C++": 1}


def test_competitors_from_a_large_table(spark):
    rng = random.Random(3)
    parts = ["Bank", "bank", "slow", " ", " ", "-", ".net", "C++", "at&t", "é", "_", "\n", "ab", "x1"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(500)] + [None, "", "bank", "bank.", "my bank"]
    names = ["bank", "Slow Bank", ".NET", "c++", "AT&T", "é", "x1", "bank.", ""]
    reviews = spark.createDataFrame([(str(i), t, "neutral") for i, t in enumerate(texts)], "review_id string, content string, sentiment_label string")
    found = {r["name"]: r["mentions"] for r in insights.competitor_mentions(reviews, names).collect()}
    wanted = {n: sum(bool(re.search(rf"(?<!\w){re.escape(n.lower())}(?!\w)", (t or "").lower())) for t in texts) for n in names if n}
    assert found == {n: k for n, k in wanted.items() if k}

    def plan(number):
        table = spark.range(number).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
        df = insights.competitor_mentions(reviews, table.unionByName(spark.createDataFrame([("bank",)], "name string")))
        assert [(r["name"], r["mentions"]) for r in df.collect()] == [("bank", wanted["bank"])]
        return df._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(100_000) == plan(4)


def test_golden_sample_is_balanced(spark, reviews):
    counts = quality.golden_sample(reviews, 2).groupBy("score", "category_taxonomy").count().collect()
    assert max(r["count"] for r in counts) <= 2
    assert len(counts) == reviews.select("score", "category_taxonomy").distinct().count()


def test_overview_reads_the_daily_table(spark, reviews):
    parts = dashboards.overview(catalog.daily(spark, SMALL), Scope.of("2024-01-01", "2024-01-31"))
    assert parts["kpis"].first()["total_reviews"] == reviews.count()
    assert parts["top_issues"].count() == 5 and parts["trend"].count() == 30


def test_pipeline_runs_build_on_each_other(spark, tmp_path):
    sources = event_review_texts(spark, SMALL)
    first, second, again = (str(tmp_path / n) for n in ("run1", "run2", "run3"))
    pipeline.run_pipeline(spark, combine({n: sources[n] for n in ("average", "bad")}), first)
    pipeline.run_pipeline(spark, combine({"good": sources["good"]}), second, previous=first)
    pipeline.run_pipeline(spark, combine({"good": sources["good"]}), again, previous=second)
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline(spark, combine({"good": sources["good"]}), str(tmp_path / "run4"), previous=f"{second}-typo")

    def ids(target, table):
        return read_table(spark, target, table).select("review_id").distinct().count()

    everything = {r[0] for s in sources.values() for r in combine({"s": s}).select("review_id").distinct().collect()}
    assert ids(second, "reviews_raw") == ids(second, "reviews_enriched") == len(everything) == ids(again, "reviews_raw")
    reviews = read_table(spark, second, "reviews_enriched")
    assert reviews.count() == len(everything)
    daily = read_table(spark, second, "daily_aggregates")
    assert daily.agg(F.sum("total_reviews")).first()[0] == reviews.filter("day is not null").count()
    assert daily.filter("day is null").count() == 0
    left_out = {r[0]: r[1] for r in spark.read.parquet(f"{second}/run_counts").collect()}
    assert left_out["version_aggregates"] == reviews.filter("app_version is null").count() > 0
    stored = read_table(spark, again, "insight_reports")
    assert stored.count() == stored.select("hash_key").distinct().count()
    assert stored.count() == read_table(spark, second, "insight_reports").count() >= 2
    listed = json.loads(stored.filter("report_type = 'weekly_top_issues'").first()["content_json"])["top_issues"]
    ranked = [(-i["weighted_severity"], -i["review_count"], i["label"]) for i in listed]
    assert len(listed) == 5 and ranked == sorted(ranked)
    scope = Scope().within(read_table(spark, again, "reviews_enriched"))
    assert pipeline.missing_reports(reviews, daily, stored, scope) is None
    assert reports.stored_report(stored, "weekly_top_issues", scope).first()["report_type"] == "weekly_top_issues"
    assert reports.stored_report(stored, "weekly_top_issues", Scope.of("2020-01-01", "2020-01-02")).isEmpty()
    assert contracts.check_reports(stored).filter(F.size("violations") > 0).count() == 0


def test_reports_are_stored_once(spark, tmp_path):
    """Two requests miss at the same time: both generate, one stores, both return what is stored."""
    root, scope = str(tmp_path), Scope.of("2024-01-01", "2024-01-07")
    both = threading.Barrier(2, timeout=60)

    def request(name):
        def build():
            both.wait()
            return spark.range(1).select(
                F.lit("weekly_exec_brief").alias("report_type"),
                F.struct(*[F.lit(v).alias(k) for k, v in scope.as_dict().items()]).alias("scope"),
                F.lit(f'{{"by":"{name}"}}').alias("content_json"))

        return report_store.report_for(spark, root, "weekly_exec_brief", scope, build).first()

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(request, "ab"))
    assert found[0]["report_id"] == found[1]["report_id"] and found[0]["content_json"] == found[1]["content_json"]
    assert report_store.all_reports(spark, root).count() == 1
    never = lambda: pytest.fail("a stored report is not made again")
    again = report_store.report_for(spark, root, "weekly_exec_brief", scope, never).first()
    assert again["report_id"] == found[0]["report_id"] and again["created_at"] is not None
    assert report_store.find_report(spark, root, "sprint_backlog", scope) is None


def test_stored_content_is_ascii(spark):
    content = json.dumps({"title": "\u00dcber \U0001f600 \"x\"", "n": 1}, ensure_ascii=False, separators=(",", ":"))
    frame = spark.createDataFrame([(content,), ("{}",), (None,)], "content_json string")
    found = [r[0] for r in frame.select(text.ascii_json(F.col("content_json"))).collect()]
    assert found == [json.dumps(json.loads(content), separators=(",", ":")), "{}", None]
