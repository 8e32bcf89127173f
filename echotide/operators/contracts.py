"""Checks of stored report text against the report contracts, and ticket tables from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from echotide.functions.text import bind, parse_json

Check = Callable[[Column], Column]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _keys(value: Column) -> Column:
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def is_filled_text(value: Column) -> Column:
    return is_text(value) & (F.length(_text(value)) >= 1)


def is_number(value: Column) -> Column:
    return F.rlike(_kind(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))


def is_integer(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return is_number(value) & (number == F.floor(number))


def one_of(*choices: str) -> Check:
    return lambda value: is_text(value) & _text(value).isin(*choices)


def matches(pattern: str) -> Check:
    return lambda value: is_text(value) & F.rlike(_text(value), F.lit(pattern))


def list_of(check: Check) -> Check:
    return lambda value: F.coalesce(
        F.forall(_items(value), lambda item: F.coalesce(check(item), F.lit(False))), F.lit(False)
    )


def record(fields: dict[str, Check], closed: bool = True) -> Check:
    """An object with all the fields; a closed one has no others."""

    def check(value: Column) -> Column:
        keys = _keys(value)
        result = F.coalesce(keys.isNotNull(), F.lit(False))
        if closed:
            allowed = F.array(*[F.lit(n) for n in fields])
            result = result & F.coalesce(F.size(F.array_except(keys, allowed)) == 0, F.lit(False))
        for name, of in fields.items():
            result = result & F.coalesce(of(_field(value, name)), F.lit(False))
        return result

    return check


# Field names, choices and patterns of the report contracts.
CONTRACTS: dict[str, tuple[dict[str, Check], bool]] = {
    "weekly_exec_brief": ({
        "week_range": matches(r"^\d{4}-\d{2}-\d{2}\.\.\d{4}-\d{2}-\d{2}$"),
        "headline": is_filled_text,
        "kpi_summary": record({"avg_rating": is_number, "pct_negative": is_number, "critical_count": is_integer}),
        "drivers": list_of(record({
            "title": is_filled_text, "impact": one_of("high", "med", "low"), "evidence_quotes": list_of(is_text),
        })),
        "risks": list_of(record({
            "risk": is_filled_text, "signal": is_filled_text, "severity": one_of("high", "med", "low"),
        })),
        "recommendations": list_of(record({
            "action": is_filled_text, "owner": one_of("PM", "Eng", "Support"), "expected_impact": is_filled_text,
        })),
    }, True),
    "sprint_backlog": ({
        "tickets": list_of(record({
            "title": is_filled_text, "type": one_of("bug", "improvement", "feature"),
            "priority": one_of("P0", "P1", "P2", "P3"), "severity_score": is_number, "impact_notes": is_filled_text,
            "acceptance_criteria": list_of(is_text), "evidence_quotes": list_of(is_text),
            "related_labels": list_of(is_text), "related_versions": list_of(is_text),
        })),
    }, True),
    "sentiment": ({"sentiment_label": is_text, "confidence": is_number}, False),
    "insight_report": ({"summary": is_text}, False),
}
ISSUES_CONTRACT = list_of(record({"label": is_text, "confidence": is_number}, closed=False))


def contract_violations(report_type: str, content_json: Column) -> Column:
    """Names of the top-level fields that break the contract; empty when the text is valid."""

    def violations(document: Column) -> Column:
        if report_type == "issues":
            found = [F.when(~ISSUES_CONTRACT(document), F.lit("issues"))]
        else:
            fields, closed = CONTRACTS[report_type]
            found = [F.when(~F.coalesce(check(_field(document, name)), F.lit(False)), F.lit(name))
                     for name, check in fields.items()]
            if closed:
                extra = F.size(F.array_except(_keys(document), F.array(*[F.lit(n) for n in fields]))) > 0
                found.append(F.when(extra, F.lit("unknown field")))
        return F.when(document.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*found)))

    return bind(parse_json(content_json), violations)


def check_reports(reports: DataFrame) -> DataFrame:
    """Stored reports with their violations. A type without a contract is not checked."""
    result = F.array().cast("array<string>")
    for report_type in (*CONTRACTS, "issues"):
        violations = contract_violations(report_type, F.col("content_json"))
        result = F.when(F.col("report_type") == report_type, violations).otherwise(result)
    return reports.withColumn("violations", result)


def tickets_of(content_json: Column) -> Column:
    """The ticket objects of a backlog; other list entries are skipped."""
    tickets = _items(_field(parse_json(content_json), "tickets"))
    return F.filter(
        F.coalesce(tickets, F.array().cast("array<variant>")), lambda t: F.startswith(_kind(t), F.lit("OBJECT"))
    )


def _value(ticket: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(ticket, f"$.{name}", kind)


def _first_filled(ticket: Column, names: tuple[str, ...], default: str) -> Column:
    filled = [
        F.when(is_text(_field(ticket, n)), F.nullif(F.trim(_value(ticket, n, "string")), F.lit(""))) for n in names
    ]
    return F.coalesce(*filled, F.lit(default))


def ticket_rows(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per ticket, numbered by position, with defaults for missing fields."""
    exploded = reports.select(*keep, F.posexplode(tickets_of(F.col("content_json"))).alias("pos", "t"))
    t = F.col("t")

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(_value(t, name, "array<string>"), ", "), F.lit(""))

    return exploded.select(
        *keep, (F.col("pos") + 1).alias("ticket_id"),
        F.coalesce(_value(t, "priority", "string"), F.lit("P3")).alias("priority"),
        F.coalesce(_value(t, "title", "string"), F.lit("Untitled")).alias("title"),
        F.coalesce(_value(t, "type", "string"), F.lit("")).alias("type"),
        F.coalesce(_value(t, "severity_score", "double"), F.lit(0.0)).alias("severity_score"),
        _first_filled(t, ("suggested_owner", "owner", "assignee"), "Unassigned").alias("owner"),
        _first_filled(t, ("due_date", "target_date", "eta"), "").alias("due_date"),
        joined("related_labels").alias("related_labels"), joined("related_versions").alias("related_versions"),
        F.coalesce(_value(t, "impact_notes", "string"), F.lit("")).alias("impact_notes"),
    )


def ticket_board_totals(reports: DataFrame, *keep: str) -> DataFrame:
    """Tickets, P0 and P1 counts, risk flags and summed effort of each backlog.

    Effort is the first of its four fields that is present, even where it holds no number.
    """
    exploded = reports.select(*keep, F.explode_outer(tickets_of(F.col("content_json"))).alias("t"))
    t = F.col("t")
    keys = _keys(t)
    effort = F.lit(0.0)
    for name in reversed(("estimated_effort", "effort", "story_points", "estimate")):
        effort = F.when(F.array_contains(keys, name), F.coalesce(_value(t, name, "double"), F.lit(0.0))).otherwise(effort)
    priority = F.coalesce(_value(t, "priority", "string"), F.lit("P3"))
    real = t.isNotNull()
    return exploded.groupBy(*keep).agg(
        F.count_if(real).alias("total_tickets"),
        F.count_if(real & (priority == "P0")).alias("p0"), F.count_if(real & (priority == "P1")).alias("p1"),
        F.count_if(real & (F.coalesce(_value(t, "severity_score", "double"), F.lit(0.0)) >= 0.75)).alias("risk_flags"),
        F.round(F.coalesce(F.sum(F.when(real, effort)), F.lit(0.0)), 1).alias("estimated_effort"),
    )
