"""Report payloads, the deterministic weekly brief, stored reports and their contracts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.functions.fixed_values import BRIEF_FILLER_SIGNAL, BRIEF_RECOMMENDATIONS, BRIEF_RISKS
from echotide.functions.text import ascii_json, compact_quote, fixed_text, json_string, percent_text
from echotide.operators.aggregates import kpi_snapshot, top_issues
from echotide.operators.drilldown import evidence_quotes
from echotide.operators.insights import impact
from echotide.operators.scope import Scope
from echotide.operators.trends import anomaly_flags

MODEL = "rules"


def _as_list(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The few rows of a top-k result as one ordered array."""
    rank = F.row_number().over(Window.orderBy(*order))
    ranked = df.select(rank.alias("rank"), F.struct(*df.columns).alias("item"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda r: r["item"])
    return ranked.agg(items.alias(name))


def report_payload(reviews: DataFrame, daily: DataFrame, scope: Scope, report_type: str) -> DataFrame:
    """One row with the KPIs, top issues, quotes and (for the weekly brief) flags of a scope."""
    scoped = scope.apply(reviews)
    issues = top_issues(scoped, 5)
    quotes = evidence_quotes(reviews, scope, 10)
    short = quotes.select(
        "rank", compact_quote(F.col("quote")).alias("quote"), "sentiment_label", "severity_score", "app_version"
    )
    by_issue = [F.desc("weighted_severity"), F.desc("review_count"), F.asc("label")]
    parts = [
        kpi_snapshot(scoped).select(F.struct("*").alias("kpi_snapshot")),
        _as_list(issues, by_issue, "top_issues"),
        _as_list(short, [F.asc("rank")], "evidence_reviews"),
    ]
    if report_type == "weekly_exec_brief":
        flags = anomaly_flags(daily, scope, 5)
        parts.append(_as_list(flags, [F.asc("day"), F.asc("metric")], "anomaly_flags"))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [p.columns[0] for p in parts]
    return merged.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names]).select(
        F.lit(report_type).alias("report_type"),
        F.struct(*[F.lit(v).alias(k) for k, v in scope.as_dict().items()]).alias("scope"),
        *names,
    )


def weekly_brief(payload: DataFrame) -> DataFrame:
    """Headline, drivers, risks and recommendations from a payload. Fields are in name order."""
    kpi = F.col("kpi_snapshot")
    negative, critical = kpi["pct_negative"], kpi["critical_count"]
    quotes = F.filter(F.transform("evidence_reviews", lambda e: e["quote"]), lambda q: q != "")
    drivers = F.transform(
        F.slice("top_issues", 1, 2),
        lambda i: F.struct(
            F.slice(quotes, 1, 2).alias("evidence_quotes"),
            impact(i["weighted_severity"]).alias("impact"), i["label"].alias("title"),
        ),
    )

    def risk(key: str, signal: Column) -> Column:
        text, severity = BRIEF_RISKS[key]
        return F.struct(F.lit(text).alias("risk"), F.lit(severity).alias("severity"), signal.alias("signal"))

    filler = risk("filler", F.lit(BRIEF_FILLER_SIGNAL))
    raised = F.array_compact(F.array(
        F.when(negative >= 0.35, risk("negative", F.concat(F.lit("pct_negative="), percent_text(negative)))),
        F.when(critical >= 8, risk("critical", F.concat(F.lit("critical_count="), critical.cast("string")))),
    ))
    return payload.select(
        "report_type", "scope",
        F.struct(
            drivers.alias("drivers"),
            F.concat(
                F.lit("Weekly health: rating "), fixed_text(kpi["avg_rating"], 2), F.lit(", negative "),
                percent_text(negative), F.lit(", critical "), critical.cast("string"), F.lit("."),
            ).alias("headline"),
            F.struct(kpi["avg_rating"].alias("avg_rating"), critical.alias("critical_count"),
                     negative.alias("pct_negative")).alias("kpi_summary"),
            F.array(*[
                F.struct(F.lit(a).alias("action"), F.lit(e).alias("expected_impact"), F.lit(o).alias("owner"))
                for a, o, e in BRIEF_RECOMMENDATIONS
            ]).alias("recommendations"),
            F.slice(F.concat(raised, F.array(filler, filler)), 1, 2).alias("risks"),
            F.concat(F.col("scope.start_date"), F.lit(".."), F.col("scope.end_date")).alias("week_range"),
        ).alias("brief"),
    )


def report_key(report_type: str, scope: Scope) -> str:
    """The cache key of one report."""
    text = json.dumps(scope.as_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(f"{report_type}{text}".encode()).hexdigest()


def scope_json(scope: Column) -> Column:
    """A scope struct as the JSON text that is hashed: sorted keys, no spaces, pure ASCII."""
    names = ("category", "end_date", "issue_label", "start_date", "version")
    fields = [F.concat(F.lit(f'"{n}":'), json_string(F.coalesce(scope[n], F.lit("")))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def stored_reports(reports: DataFrame) -> DataFrame:
    """(report_type, scope, content_json) rows as they are stored, with key, id and time."""
    text = scope_json(F.col("scope"))
    return reports.select(
        F.uuid().alias("report_id"), "report_type", text.alias("scope_json"),
        ascii_json(F.col("content_json")).alias("content_json"),
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz").alias("created_at"),
        F.lit(MODEL).alias("model"),
        F.sha2(F.concat("report_type", text), 256).alias("hash_key"),
    )


def stored_report(stored: DataFrame, report_type: str, scope: Scope) -> DataFrame:
    """The stored report of a type and scope, if there is one: a filter on its key, pushed down to the scan."""
    return stored.filter(F.col("hash_key") == report_key(report_type, scope))


def exec_kpi_table(brief: DataFrame) -> DataFrame:
    """The KPI summary of a brief as metric and display value."""
    kpi = F.col("brief.kpi_summary")
    rows = {
        "avg_rating": F.round(kpi["avg_rating"], 3).cast("string"),
        "pct_negative": percent_text(kpi["pct_negative"]),
        "critical_count": kpi["critical_count"].cast("string"),
    }
    return brief.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows.items()
    ])))


def only_new(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Reports whose key is not stored yet, one per key. Appending these keeps keys unique."""
    return candidates.dropDuplicates(["hash_key"]).join(existing.select("hash_key"), "hash_key", "left_anti").select(
        *existing.columns
    )
