"""SQL per query name. Column names and rounding match the registered queries."""

from __future__ import annotations

from echotide.functions import fixed_values as fv
from echotide.plans.catalog import COMPETITORS
from echotide.sources.event_reviews import CLOSINGS, OPENINGS
from oracle.base import (
    CLEAN, COLUMNS, DAILY, DEDUPED, ENRICHED, ISSUES, REVIEWS, SENTIMENT, STAGED, VERSIONS, WEEK, excerpt, items, latest,
    lexicon, lit, merged, with_,
)

_snapshot = """count(*) AS total_reviews, round(coalesce(avg(coalesce(score, 0)::DOUBLE), 0), 4)::DOUBLE AS avg_rating,
  round(coalesce(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 4)::DOUBLE AS pct_negative,
  count(*) FILTER (WHERE severity_band = 'critical') AS critical_count"""

_has_failure = "contains(lower(issue_text), 'transaction failure')"
_narrow = ("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND category_taxonomy = 'Other' "
           "AND app_version = '5.3.0' AND contains(issue_text, 'Login/Auth Issues')")
_strong = "severity_score DESC, coalesce(thumbs_up, 0) DESC, at_ts DESC NULLS LAST, review_id"

_row = """review_id, day, app_version, category_taxonomy, sentiment_label, severity_band,
  round(severity_score, 3) AS severity_score, score, coalesce(thumbs_up, 0) AS thumbs_up, issue_text AS issues, content"""

_week_kpi = f"kpi AS (SELECT {_snapshot} FROM enriched WHERE {WEEK})"
_week_top = f"""top AS (SELECT *, row_number() OVER (ORDER BY weighted_severity DESC, review_count DESC, label) AS position
  FROM (SELECT label, count(*) AS review_count, CAST(round(sum(CAST(severity_score AS DECIMAL(18,12))), 3) AS DOUBLE) AS weighted_severity
    FROM issue_rows WHERE {WEEK} GROUP BY label ORDER BY sum(CAST(severity_score AS DECIMAL(18,12))) DESC, count(*) DESC, label LIMIT 5))"""
_week_quotes = f"""quotes AS (SELECT row_number() OVER (ORDER BY {_strong}) AS position, review_id, severity_score,
    {excerpt('content', '', 120)} AS quote FROM enriched WHERE {WEEK} ORDER BY {_strong} LIMIT 10)"""
_week_flags = f"""week_flags AS (SELECT row_number() OVER (ORDER BY day, metric) AS position, metric, z_score
  FROM flags WHERE {WEEK} ORDER BY day, metric LIMIT 5)"""

_impact = "CASE WHEN {0} >= 12 THEN 'high' WHEN {0} >= 5 THEN 'med' ELSE 'low' END"

BRIEF = DAILY + f""",
{_week_kpi}, {_week_top}, {_week_quotes},
two AS (SELECT string_agg(quote, '|' ORDER BY position) AS quotes FROM quotes WHERE position <= 2),
raised AS (
  SELECT 1 AS o, {lit(fv.BRIEF_RISKS['negative'][0])} || '|pct_negative=' || printf('%.1f%%', pct_negative * 100) || '|high' AS text
    FROM kpi WHERE pct_negative >= 0.35
  UNION ALL SELECT 2, {lit(fv.BRIEF_RISKS['critical'][0])} || '|critical_count=' || CAST(critical_count AS VARCHAR) || '|med'
    FROM kpi WHERE critical_count >= 8
  UNION ALL SELECT o, {lit(fv.BRIEF_RISKS['filler'][0] + '|' + fv.BRIEF_FILLER_SIGNAL + '|low')} FROM (VALUES (3), (4)) f(o))"""

_day_json_scope = """'{"category":"\\u00dcn\\u00efcode \\"q\\" \\ud83d\\ude00/","end_date":"' || CAST(day AS VARCHAR)
  || '","issue_label":"","start_date":"' || CAST(day AS VARCHAR) || '","version":""}'"""

_week_json_scope = """'{"category":"","end_date":"2024-01-20","issue_label":"","start_date":"2024-01-10","version":""}'"""

_MENTION = "regexp_matches(lower(content), '(^|[^\\w])' || {0} || '($|[^\\w])')"

CANDIDATES = ENRICHED + f""",
week_issue AS (SELECT * FROM issue_rows),
totals AS (SELECT label, count(*) AS review_count, sum(CAST(severity_score AS DECIMAL(18,12))) AS weight,
    round(count(*) FILTER (WHERE severity_score >= 0.80) / count(*)::DOUBLE, 4) AS critical_share FROM week_issue GROUP BY label),
label_quotes AS (SELECT label, review_id, {excerpt('content')} AS quote,
    row_number() OVER (PARTITION BY label ORDER BY {_strong}) AS quote_rank FROM week_issue),
label_versions AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, app_version) AS place
  FROM (SELECT label, app_version, count(*) AS n FROM week_issue WHERE app_version IS NOT NULL GROUP BY ALL)),
candidates AS (SELECT 'Address ' || label AS title,
    CASE WHEN label = 'Feature Requests' THEN 'feature'
      WHEN label IN ('UI/UX Problems', 'Policy Complaints', 'Customer Support') THEN 'improvement' ELSE 'bug' END AS type,
    CASE WHEN critical_share >= 0.30 THEN 'P0' WHEN round(weight, 4) >= 12 THEN 'P1' WHEN round(weight, 4) >= 5 THEN 'P2'
      ELSE 'P3' END AS priority,
    round(weight::DOUBLE / review_count, 3) AS severity_score, label, review_count, CAST(round(weight, 4) AS DOUBLE) AS weighted_severity, critical_share,
    (SELECT string_agg(quote, '|' ORDER BY quote_rank) FROM label_quotes q WHERE q.label = t.label AND quote_rank <= 2) AS quotes,
    (SELECT string_agg(app_version, ',' ORDER BY place) FROM label_versions v WHERE v.label = t.label) AS versions
  FROM totals t)"""


def _phrase_rows(label: str) -> str:
    """Reviews with one label, per matching phrase."""
    return ENRICHED + f""",
phrases AS (SELECT DISTINCT content, evidence FROM hits WHERE label = {lit(label)}),
phrase_rows AS (SELECT e.*, p.evidence FROM enriched e JOIN phrases p USING (content))"""


def _distinct_events(columns: str, where: str) -> str:
    return f"(SELECT 'r' || CAST(event_id AS VARCHAR) AS review_id, {columns} FROM events WHERE {where} AND event_id % 50 <> 49)"


def _issue_json() -> str:
    return """SELECT event_id, position, label FROM (
      SELECT event_id, unnest(range(0, len(labels))) AS position, unnest(labels) AS label FROM (
        SELECT event_id, CASE event_id % 6
          WHEN 0 THEN [lower(event_type), 'b'] WHEN 1 THEN [lower(event_type), 'second']
          WHEN 2 THEN [lower(event_type)] WHEN 4 THEN [lower(event_type)] ELSE [] END AS labels FROM events))"""


def _documents_enriched() -> str:
    """The review CTEs from the lexicon on, with the documents in place of the reviews."""
    source = f"""clean AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ([{items(OPENINGS)}])[1 + (doc_id // 7) % 12] || '. ' ELSE '' END
        || text || ' ' || ([{items(OPENINGS)}])[1 + doc_id % 12] || repeat(' indeed', doc_id % 10) || ' '
        || ([{items(CLOSINGS)}])[1 + doc_id % 7] AS content,
      CAST(NULL AS INTEGER) AS score, CAST(NULL AS INTEGER) AS thumbs_up FROM documents)"""
    return source + ENRICHED.removeprefix(CLEAN)


_span_rows = """SELECT {key}, label, CAST(pos AS INTEGER) AS phrase, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS "end",
  CAST(EXISTS (SELECT 1 FROM failures f WHERE f.content = s.content
    AND CASE WHEN f.en < s.st THEN s.st - f.en WHEN s.en < f.st THEN f.st - s.en ELSE 0 END <= 40) AS INTEGER) AS near
  FROM clean JOIN spans s USING (content)"""

_daily_full = """SELECT day, total_reviews, avg_rating, pct_negative, pct_positive, critical_count,
  churn_high_users, CAST((SELECT count(*) FROM day_top t WHERE t.day = d.day) AS INTEGER) AS issues_listed,
  CAST((SELECT count(*) FROM flags f WHERE f.day = d.day) AS INTEGER) AS flags FROM daily d"""

_version_scalars = """SELECT *,
  CAST((SELECT count(*) FROM version_issue i WHERE i.app_version = b.app_version) AS INTEGER) AS issues_listed,
  CAST((SELECT count(*) FROM version_category c WHERE c.app_version = b.app_version) AS INTEGER) AS categories_listed
  FROM version_base b"""

_user_churn = """SELECT user_name, reviews, round(neg / reviews, 4) AS pct_negative,
  round(sev / reviews, 4) AS avg_severity, txn AS txn_failures, intent AS intent_mentions, churn_user_score,
  churn_user_tier FROM tiers"""

_filter_options = """
  SELECT 'category' AS kind, category_taxonomy AS value, CAST(row_number() OVER (ORDER BY category_taxonomy) AS INTEGER) AS position
    FROM (SELECT DISTINCT category_taxonomy FROM enriched)
  UNION ALL SELECT 'issue_label', label, CAST(row_number() OVER (ORDER BY label) AS INTEGER)
    FROM (SELECT DISTINCT label FROM issue_rows)
  UNION ALL SELECT 'version', app_version,
    CAST(row_number() OVER (ORDER BY last_seen_day DESC, total_reviews DESC, app_version) AS INTEGER)
    FROM version_base WHERE app_version IS NOT NULL
  UNION ALL SELECT 'min_day', CAST(min(day) AS VARCHAR), 1 FROM enriched
  UNION ALL SELECT 'max_day', CAST(max(day) AS VARCHAR), 1 FROM enriched"""


def oracle_queries() -> dict[str, str]:
    texts = "documents"
    return {
        "ingest_stage_cast": with_(STAGED, f"SELECT {COLUMNS}, source FROM staged"),
        "ingest_header_alias": with_(STAGED, " UNION ALL ".join(
            f"SELECT source, {lit(c)} AS target_column, count({c}) AS filled FROM staged GROUP BY source"
            for c in COLUMNS.split(", "))),
        "ingest_csv_scan": with_(STAGED, latest("staged")),
        "ingest_repeated_header": with_(STAGED, f"SELECT {COLUMNS}, source FROM staged WHERE source = 'average'"),
        "ingest_dedupe_latest": with_(REVIEWS, latest("reviews")),
        "ingest_counters": with_(STAGED, """
          SELECT 'loaded:' || source AS counter, count(*) AS row_count FROM staged GROUP BY source
          UNION ALL SELECT 'combined', count(*) FROM staged
          UNION ALL SELECT 'deduped_out', count(*) - count(DISTINCT review_id) FROM staged
          UNION ALL SELECT 'inserted', count(DISTINCT review_id) FROM staged"""),
        "ingest_upsert": with_(STAGED + f""",
          fresh AS ({latest('staged', "source = 'good'")}), stored AS ({latest('staged', "source <> 'good'")})""", """
          SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE review_id NOT IN (SELECT review_id FROM fresh)"""),
        "upsert_incremental": with_(merged(DEDUPED), "SELECT * FROM deduped"),
        "enriched_churn": with_(merged(DAILY), """SELECT review_id, day, content, round(severity_score, 6) AS severity_score,
          churn_user_score, churn_user_tier FROM enriched JOIN tiers USING (user_name)"""),
        "daily_incremental": with_(merged(DAILY), f"{_daily_full} WHERE day IS NOT NULL"),
        "daily_incremental_issues": with_(merged(DAILY), """SELECT day, CAST(rank - 1 AS INTEGER) AS position, label, review_count,
          CAST(round(weight, 4) AS DOUBLE) AS weighted_severity FROM day_top WHERE day IS NOT NULL"""),
        "version_incremental": with_(merged(VERSIONS), f"{_version_scalars} WHERE app_version IS NOT NULL"),
        "version_incremental_issues": with_(merged(VERSIONS), "SELECT * FROM version_issue"),
        "churn_incremental": with_(merged(DAILY), _user_churn),
        "run_counts": with_(merged(CLEAN), """
          SELECT 'daily_aggregates' AS table_name, count(*) FILTER (day IS NULL) AS reviews_without_key FROM clean
          UNION ALL SELECT 'version_aggregates', count(*) FILTER (app_version IS NULL) FROM clean
          UNION ALL SELECT 'user_churn', count(*) FILTER (user_name IS NULL) FROM clean"""),
        "filter_options_facets": with_(merged(VERSIONS), _filter_options),
        "normalize_content": with_(CLEAN, "SELECT review_id, content, day, category_taxonomy FROM clean"),
        "category_taxonomy": with_(CLEAN, """
          SELECT category_raw, category_taxonomy, count(*) AS review_count FROM clean GROUP BY ALL"""),
        "normalize_summary": with_(CLEAN, f"""SELECT count(*) AS raw_rows, count(*) AS enriched_rows,
          count(*) FILTER (WHERE content = {lit(fv.EMPTY_REVIEW)}) AS empty_rows FROM clean"""),
        "sentiment_rule": with_(SENTIMENT, """
          SELECT review_id, sentiment_label, round(sentiment_confidence, 6) AS sentiment_confidence FROM sentiment"""),
        "sentiment_summary": with_(SENTIMENT, """SELECT count(*) AS total, count(*) AS rule_rows,
          count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_rows FROM sentiment"""),
        "sentiment_triggers": with_(SENTIMENT, """
          SELECT review_id, CAST(sentiment_confidence < 0.70 OR prior * lex < 0
            OR (words < 4 AND coalesce(score IN (1, 5), FALSE)) AS INTEGER) AS adjudicate FROM sentiment"""),
        "sentiment_hybrid": with_(SENTIMENT + ", verdicts AS " + _distinct_events(
            """CASE event_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label,
            (event_id % 40 + 55) / 100.0::DOUBLE AS confidence""", "event_id % 5 = 0"), """
          SELECT review_id, coalesce(label, sentiment_label) AS sentiment_label,
            round(CASE WHEN label IS NULL THEN sentiment_confidence
              WHEN label = sentiment_label THEN greatest(sentiment_confidence, confidence)
              ELSE greatest(sentiment_confidence, confidence) * 0.85::DOUBLE END, 6) AS sentiment_confidence,
            CASE WHEN label IS NULL THEN 'rule' ELSE 'hybrid' END AS sentiment_method
          FROM sentiment LEFT JOIN verdicts USING (review_id)"""),
        "issues_rule": with_(CLEAN + "," + ISSUES, """
          SELECT review_id, label, confidence FROM clean JOIN issues USING (content)"""),
        "issues_evidence": with_(CLEAN + "," + ISSUES, """
          SELECT review_id, label, CAST(row_number() OVER (PARTITION BY review_id, label ORDER BY pos) - 1 AS INTEGER) AS position,
            evidence FROM clean JOIN hits USING (content)"""),
        "issue_spans": with_(CLEAN + "," + ISSUES, _span_rows.format(key="review_id")),
        "document_issue_spans": with_(_documents_enriched(), _span_rows.format(key="doc_id")),
        "issues_near_failure": with_(CLEAN + "," + ISSUES, """
          SELECT review_id, label FROM clean JOIN near USING (content)"""),
        "issues_summary": with_(CLEAN + "," + ISSUES, """SELECT count(*) AS total, count(*) AS rule_rows,
          count(*) FILTER (WHERE content IN (SELECT content FROM issues)) AS issue_rows FROM clean"""),
        "issue_triggers": with_(CLEAN + "," + ISSUES + """, labels AS (SELECT content, list(label) AS l FROM issues GROUP BY content)""", """
          SELECT review_id, CAST(l IS NULL OR len(l) > 4
            OR (category_taxonomy = 'App Performance' AND NOT list_has_any(l, ['Performance Issues', 'Glitches/Bugs']))
            OR (category_taxonomy = 'Login & Authentication' AND NOT list_contains(l, 'Login/Auth Issues')) AS INTEGER)
            AS review_issues FROM clean LEFT JOIN labels USING (content)"""),
        "issue_labels_json": _issue_json(),
        "severity_score": with_(ENRICHED, """
          SELECT review_id, round(severity_score, 6) AS severity_score, severity_band FROM enriched"""),
        "severity_summary": with_(ENRICHED, """SELECT count(*) AS total, round(sum(CAST(severity_score AS DECIMAL(18,12)))::DOUBLE / count(severity_score), 4) AS avg_severity,
          count(*) FILTER (WHERE severity_band = 'critical') AS critical_rows FROM enriched"""),
        "severity_by_rating": with_(ENRICHED, """SELECT score, count(*) AS review_count,
          round(sum(CAST(severity_score AS DECIMAL(18,12)))::DOUBLE / count(severity_score), 4) AS avg_severity FROM enriched GROUP BY score"""),
        "low_rating_negative_rate": with_(ENRICHED, """SELECT
          round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END), 4) AS pct_negative
          FROM enriched WHERE score IN (1, 2)"""),
        "daily_kpis": with_(DAILY, """SELECT day, total_reviews, avg_rating, pct_negative, pct_positive, critical_count FROM daily"""),
        "daily_top_issues": with_(DAILY, """SELECT day, CAST(rank AS INTEGER) AS rank, label, review_count,
          CAST(round(weight, 4) AS DOUBLE) AS weighted_severity FROM day_top"""),
        "daily_aggregates": with_(DAILY, _daily_full),
        "daily_trend_range": with_(DAILY, f"SELECT day, avg_rating, pct_negative, critical_count FROM daily WHERE {WEEK}"),
        "kpi_rollup": with_(DAILY, f"""SELECT CAST(sum(total_reviews) AS BIGINT) AS total_reviews,
          round(sum(avg_rating * total_reviews) / sum(total_reviews), 6) AS avg_rating,
          round(sum(pct_negative * total_reviews) / sum(total_reviews), 6) AS pct_negative,
          CAST(sum(critical_count) AS BIGINT) AS critical_count, CAST(sum(churn_high_users) AS BIGINT) AS churn_high_users
          FROM daily WHERE {WEEK}"""),
        "window_top_issues": with_(DAILY, f"""SELECT label AS issue_label, CAST(sum(review_count) AS BIGINT) AS review_count,
          CAST(round(sum(round(weight, 4)), 3) AS DOUBLE) AS weighted_severity FROM day_top WHERE {WEEK} GROUP BY label
          ORDER BY weighted_severity DESC, review_count DESC, issue_label LIMIT 5"""),
        "series_peak": with_(DAILY + """, series AS (
            SELECT day, 'avg_rating' AS metric, avg_rating::DOUBLE AS value FROM daily
            UNION ALL SELECT day, 'pct_negative', pct_negative FROM daily
            UNION ALL SELECT day, 'critical_count', critical_count FROM daily)""", """
          SELECT metric, day, value FROM series
          QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, day) = 1"""),
        "newest_day": with_(CLEAN, "SELECT max(day) AS newest_day FROM clean"),
        "latest_issue_days": with_(DAILY, """SELECT day, CAST(rank - 1 AS INTEGER) AS position, label, review_count,
          CAST(round(weight, 4) AS DOUBLE) AS weighted_severity FROM day_top
          WHERE day IN (SELECT DISTINCT day FROM day_top ORDER BY day DESC LIMIT 3)"""),
        "weekly_rollup": with_(ENRICHED, """SELECT CAST(date_trunc('week', day) AS DATE) AS week_start,
          CAST(any_value(week(day)) AS INTEGER) AS iso_week, count(*) AS total_reviews,
          round(avg(CAST(score AS DOUBLE)), 4) AS avg_rating,
          round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END), 4) AS pct_negative,
          round(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END), 4) AS pct_positive,
          count(*) FILTER (WHERE severity_score >= 0.80) AS critical_count FROM enriched GROUP BY 1"""),
        "version_kpis": with_(VERSIONS, _version_scalars),
        "version_issue_breakdown": with_(VERSIONS, "SELECT * FROM version_issue"),
        "version_category_breakdown": with_(VERSIONS, "SELECT * FROM version_category"),
        "version_list": with_(VERSIONS, """SELECT app_version, last_seen_day, total_reviews FROM version_base
          WHERE app_version IS NOT NULL"""),
        "release_delta": with_(VERSIONS + """, metrics AS (
            SELECT app_version, 'avg_rating' AS metric, avg_rating::DOUBLE AS v, 3 AS d FROM version_base
            UNION ALL SELECT app_version, 'pct_negative', pct_negative, 4 FROM version_base
            UNION ALL SELECT app_version, 'critical_count', critical_count, 0 FROM version_base)""", """
          SELECT a.metric, round(a.v, a.d) AS version_a, round(b.v, a.d) AS version_b, round(b.v - a.v, a.d) AS delta_b_minus_a
          FROM metrics a JOIN metrics b USING (metric) WHERE a.app_version = '5.1.0' AND b.app_version = '5.4.0'"""),
        "release_issue_delta": with_(VERSIONS, """
          SELECT label, coalesce(max(pct_reviews) FILTER (WHERE app_version = '5.1.0'), 0.0::DOUBLE) AS pct_issue_a,
            coalesce(max(pct_reviews) FILTER (WHERE app_version = '5.4.0'), 0.0::DOUBLE) AS pct_issue_b,
            round(pct_issue_b - pct_issue_a, 4) AS delta_b_minus_a
          FROM version_issue WHERE app_version IN ('5.1.0', '5.4.0') GROUP BY label"""),
        "reviews_raw_daily": with_(REVIEWS, "SELECT *, CAST(at_ts AS DATE) AS day FROM (" + latest("reviews") + ")"),
        "kpi_snapshot": with_(ENRICHED, f"SELECT {_snapshot} FROM enriched WHERE {WEEK} AND {_has_failure}"),
        "top_issues_scope": with_(ENRICHED, f"""SELECT label, count(*) AS review_count,
          CAST(round(sum(CAST(severity_score AS DECIMAL(18,12))), 3) AS DOUBLE) AS weighted_severity FROM issue_rows WHERE {WEEK} GROUP BY label
          ORDER BY sum(CAST(severity_score AS DECIMAL(18,12))) DESC, review_count DESC, label LIMIT 8"""),
        "scope_default_window": with_(CLEAN, """SELECT greatest(min(day), CAST(max(day) - INTERVAL 6 DAY AS DATE)) AS start_day,
          max(day) AS end_day FROM clean"""),
        "scope_default_kpis": with_(ENRICHED, f"""SELECT {_snapshot} FROM enriched
          WHERE day > (SELECT CAST(max(day) - INTERVAL 7 DAY AS DATE) FROM enriched)"""),
        "preset_windows": with_(CLEAN + ", b AS (SELECT min(day) AS lo, max(day) AS hi FROM clean)", """
          SELECT preset, greatest(lo, CASE preset WHEN 'YTD' THEN CAST(date_trunc('year', hi) AS DATE)
            ELSE CAST(hi - to_days(CAST(days AS INTEGER)) AS DATE) END) AS start_day, hi AS end_day
          FROM b, (VALUES ('7D', 6), ('30D', 29), ('90D', 89), ('YTD', 0)) p(preset, days)"""),
        "filter_options": with_(VERSIONS, _filter_options),
        "overview_page": with_(DAILY + f""",
          week AS (SELECT * FROM daily WHERE {WEEK}),
          kpi AS (SELECT sum(total_reviews)::DOUBLE AS n, round(sum(avg_rating * total_reviews) / sum(total_reviews), 6) AS avg_rating,
            round(sum(pct_negative * total_reviews) / sum(total_reviews), 6) AS pct_negative,
            sum(critical_count)::DOUBLE AS critical_count, sum(churn_high_users)::DOUBLE AS high FROM week),
          top AS (SELECT label, sum(review_count) AS n, CAST(round(sum(round(weight, 4)), 3) AS DOUBLE) AS value FROM day_top
            WHERE {WEEK} GROUP BY label ORDER BY value DESC, n DESC, label LIMIT 5)""", """
          SELECT 'kpi' AS section, 'total_reviews' AS item, n AS value FROM kpi
          UNION ALL SELECT 'kpi', 'avg_rating', round(avg_rating, 4) FROM kpi
          UNION ALL SELECT 'kpi', 'pct_negative', round(pct_negative, 4) FROM kpi
          UNION ALL SELECT 'kpi', 'critical_count', critical_count FROM kpi UNION ALL SELECT 'kpi', 'churn_high_users', high FROM kpi
          UNION ALL SELECT 'trend', CAST(day AS VARCHAR) || ':avg_rating', avg_rating FROM week
          UNION ALL SELECT 'trend', CAST(day AS VARCHAR) || ':pct_negative', pct_negative FROM week
          UNION ALL SELECT 'trend', CAST(day AS VARCHAR) || ':critical_count', critical_count::DOUBLE FROM week
          UNION ALL SELECT 'issue', label, round(value, 4) FROM top"""),
        "drilldown_page": with_(ENRICHED + f""",
          page AS (SELECT * FROM enriched e WHERE {_narrow} ORDER BY e.day DESC, e.severity_score DESC, e.review_id LIMIT 10),
          quotes AS (SELECT * FROM enriched e WHERE {_narrow} ORDER BY {_strong.replace('severity_score', 'e.severity_score')} LIMIT 8)""", f"""
          SELECT 'row' AS section, CAST(row_number() OVER (ORDER BY day DESC, round(severity_score, 3) DESC, review_id) AS INTEGER) AS place,
            review_id, content AS text FROM page
          UNION ALL SELECT 'quote', CAST(row_number() OVER (ORDER BY {_strong}) AS INTEGER), review_id,
            {excerpt('content', 'Login/Auth Issues')} FROM quotes"""),
        "scheduled_reports": with_(REVIEWS, f"""SELECT kind AS report_type, {_week_json_scope} AS scope_json,
          sha256(kind || {_week_json_scope}) AS hash_key, 'rules' AS model
          FROM (VALUES ('weekly_top_issues'), ('sprint_backlog')) k(kind)"""),
        "search_reviews_page": with_(ENRICHED, f"""SELECT {_row} FROM enriched e WHERE {_narrow}
          ORDER BY e.day DESC, e.severity_score DESC, e.review_id LIMIT 5 OFFSET 5"""),
        "search_reviews_after": with_(ENRICHED, f"""SELECT {_row}, round(e.severity_score, 6) AS sort_severity FROM enriched e
          WHERE {WEEK} AND (day < DATE '2024-01-15' OR (day = DATE '2024-01-15' AND (e.severity_score < 0.5
            OR (e.severity_score = 0.5 AND review_id > 'r5'))))
          ORDER BY e.day DESC, e.severity_score DESC, e.review_id LIMIT 40"""),
        "search_reviews_count": with_(ENRICHED, f"SELECT count(*) AS total_rows FROM enriched WHERE {_narrow}"),
        "evidence_quotes": with_(ENRICHED, f"""SELECT CAST(row_number() OVER (ORDER BY {_strong}) AS INTEGER) AS rank,
          review_id, day, score, thumbs_up, app_version, category_taxonomy, sentiment_label,
          round(e.severity_score, 3) AS severity_score, {excerpt('content', 'transaction failure')} AS quote
          FROM enriched e WHERE {WEEK} AND {_has_failure}
          ORDER BY e.severity_score DESC, coalesce(thumbs_up, 0) DESC, at_ts DESC NULLS LAST, review_id LIMIT 25"""),
        "report_payload": with_(DAILY + f", {_week_kpi}, {_week_top}, {_week_quotes}, {_week_flags}", """
          SELECT 'kpi' AS section, CAST(1 AS INTEGER) AS position, 'total_reviews' AS text, total_reviews::DOUBLE AS number FROM kpi
          UNION ALL SELECT 'kpi', 2, 'avg_rating', avg_rating FROM kpi
          UNION ALL SELECT 'kpi', 3, 'pct_negative', pct_negative FROM kpi
          UNION ALL SELECT 'kpi', 4, 'critical_count', critical_count FROM kpi
          UNION ALL SELECT 'issue', CAST(position AS INTEGER), label, weighted_severity FROM top
          UNION ALL SELECT 'evidence', CAST(position AS INTEGER), quote, round(severity_score, 3) FROM quotes
          UNION ALL SELECT 'flag', CAST(position AS INTEGER), metric, z_score FROM week_flags"""),
        "weekly_brief": with_(BRIEF, f"""
          SELECT 'headline' AS field, 'Weekly health: rating ' || printf('%.2f', avg_rating) || ', negative '
            || printf('%.1f%%', pct_negative * 100) || ', critical ' || CAST(critical_count AS VARCHAR) || '.' AS text FROM kpi
          UNION ALL SELECT 'week_range', '2024-01-10..2024-01-20'
          UNION ALL SELECT 'driver' || CAST(position - 1 AS VARCHAR),
            label || '|' || {_impact.format('weighted_severity')} || '|' || quotes FROM top, two WHERE position <= 2
          UNION ALL SELECT 'risk' || CAST(row_number() OVER (ORDER BY o) - 1 AS VARCHAR), text
            FROM (SELECT * FROM raised ORDER BY o LIMIT 2)
          UNION ALL VALUES """ + ", ".join(
            f"('action{i}', {lit('|'.join(r))})" for i, r in enumerate(fv.BRIEF_RECOMMENDATIONS))),
        "exec_kpi_table": with_(ENRICHED + "," + _week_kpi, """
          SELECT 'avg_rating' AS metric, CAST(round(avg_rating, 3) AS VARCHAR) AS value FROM kpi
          UNION ALL SELECT 'pct_negative', printf('%.1f%%', pct_negative * 100) FROM kpi
          UNION ALL SELECT 'critical_count', CAST(critical_count AS VARCHAR) FROM kpi"""),
        "report_lookup": with_(ENRICHED + "," + _week_kpi, f"""
          SELECT 'weekly_exec_brief' AS report_type, {_week_json_scope} AS scope_json,
            sha256('weekly_exec_brief' || {_week_json_scope}) AS hash_key,
            'Weekly health: rating ' || printf('%.2f', avg_rating) || ', negative '
            || printf('%.1f%%', pct_negative * 100) || ', critical ' || CAST(critical_count AS VARCHAR) || '.' AS headline FROM kpi"""),
        "report_cache_keys": with_(CLEAN, f"""SELECT DISTINCT 'weekly_exec_brief' AS report_type, {_day_json_scope} AS scope_json,
          sha256('weekly_exec_brief' || {_day_json_scope}) AS hash_key FROM clean WHERE day IS NOT NULL"""),
        "report_cache_new": with_(CLEAN, f"""SELECT DISTINCT CAST(day AS VARCHAR) AS start_date,
          sha256('weekly_exec_brief' || {_day_json_scope}) AS hash_key FROM clean WHERE day > DATE '2024-01-15'"""),
        "report_contract_check": with_(CLEAN + ", d AS (SELECT DISTINCT day, dayofmonth(day) AS n FROM clean WHERE day IS NOT NULL)", """
          SELECT CAST(day AS VARCHAR) AS start_date, CASE WHEN n % 13 = 6 THEN 'not JSON' ELSE array_to_string(list_filter([
            CASE WHEN n % 5 = 1 THEN 'week_range' END, CASE WHEN n % 5 = 2 THEN 'headline' END,
            CASE WHEN n % 7 = 3 THEN 'kpi_summary' END, CASE WHEN n % 5 = 4 THEN 'drivers' END,
            CASE WHEN n % 11 = 5 THEN 'unknown field' END], lambda x: x IS NOT NULL), ',') END AS violations FROM d"""),
        "report_backlog": with_(CANDIDATES, """
          SELECT title, type, priority, severity_score, CAST(review_count AS VARCHAR) || ' reviews' AS impact_notes,
            quotes AS evidence_quotes, label AS related_labels, replace(versions, ',', '|') AS related_versions FROM candidates"""),
        "ticket_rows": with_(CANDIDATES, """
          SELECT label, CAST(i AS INTEGER) AS ticket_id, CASE i WHEN 2 THEN 'P3' ELSE priority END AS priority,
            CASE i WHEN 2 THEN 'Untitled' ELSE title END AS title, CASE i WHEN 2 THEN '' ELSE type END AS type,
            CASE i WHEN 2 THEN 0.0::DOUBLE ELSE severity_score END AS severity_score,
            CASE WHEN i = 2 THEN 'Unassigned' WHEN priority = 'P0' THEN 'Bo' ELSE 'Ana' END AS owner, '' AS due_date,
            CASE i WHEN 2 THEN '' ELSE label END AS related_labels,
            CASE i WHEN 2 THEN '' ELSE coalesce(replace(versions, ',', ', '), '') END AS related_versions,
            CASE i WHEN 2 THEN '' ELSE CAST(review_count AS VARCHAR) || ' reviews' END AS impact_notes
          FROM candidates, (VALUES (1), (2), (3)) p(i)"""),
        "ticket_board_totals": with_(CANDIDATES, """
          SELECT label, CAST(3 AS BIGINT) AS total_tickets, CAST(CASE priority WHEN 'P0' THEN 2 ELSE 0 END AS BIGINT) AS p0,
            CAST(CASE priority WHEN 'P1' THEN 2 ELSE 0 END AS BIGINT) AS p1,
            CAST(CASE WHEN severity_score >= 0.75 THEN 2 ELSE 0 END AS BIGINT) AS risk_flags,
            round(2.0::DOUBLE * review_count + 1.5, 1) AS estimated_effort FROM candidates"""),
        "moving_avg_7d": with_(DAILY, """SELECT day, round(avg(avg_rating) OVER w, 6) AS avg_rating_7dma,
          round(avg(pct_negative) OVER w, 6) AS pct_negative_7dma, count(*) OVER w AS days_in_window FROM daily
          WHERE day IS NOT NULL WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"""),
        "zscore_flags": with_(DAILY, "SELECT * FROM flags"),
        "anomaly_flags_scope": with_(DAILY, f"SELECT * FROM flags WHERE {WEEK} ORDER BY day, metric LIMIT 10"),
        "version_kpi_lag": with_(VERSIONS, """SELECT app_version, lag(app_version) OVER w AS previous_version,
          round(avg_rating - lag(avg_rating) OVER w, 4) AS delta_avg_rating,
          round(pct_negative - lag(pct_negative) OVER w, 4) AS delta_pct_negative,
          critical_count - lag(critical_count) OVER w AS delta_critical_count FROM ordered WINDOW w AS (ORDER BY place)"""),
        "version_issue_delta": with_(VERSIONS, "SELECT * FROM issue_delta"),
        "release_movers": with_(VERSIONS, """
          (SELECT app_version, previous_version, label, delta_pct_issue, 'regression' AS direction FROM issue_delta
            WHERE delta_pct_issue > 0 ORDER BY delta_pct_issue DESC, app_version, label LIMIT 5)
          UNION ALL (SELECT app_version, previous_version, label, delta_pct_issue, 'improvement' FROM issue_delta
            WHERE delta_pct_issue < 0 ORDER BY delta_pct_issue, app_version, label LIMIT 5)"""),
        "resolution_lag": with_(CLEAN + "," + ISSUES, """SELECT label, min(day) AS first_seen_day, max(day) AS last_seen_day,
          CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS resolution_lag_days
          FROM clean JOIN issues USING (content) WHERE day IS NOT NULL GROUP BY label"""),
        "user_churn": with_(DAILY, _user_churn),
        "churn_distribution": with_(DAILY, """SELECT churn_user_tier, count(*) AS users,
          round(count(*) / (SELECT count(*) FROM tiers), 4) AS share FROM tiers GROUP BY churn_user_tier"""),
        "daily_churn_high": with_(DAILY, "SELECT day, churn_high_users FROM high_days"),
        "reviews_with_churn": with_(DAILY, """
          SELECT review_id, churn_user_score, churn_user_tier FROM enriched JOIN tiers USING (user_name)"""),
        "quality_checks": with_(ENRICHED + """, c AS (SELECT
            round(avg(CASE WHEN sentiment_label IN ('negative', 'neutral', 'positive')
              AND severity_band IN ('low', 'med', 'high', 'critical') THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS valid,
            round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END) FILTER (WHERE score = 1), 4) AS neg1,
            round(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) FILTER (WHERE score = 5), 4) AS pos5,
            round(avg(severity_score) FILTER (WHERE score = 1) - avg(severity_score) FILTER (WHERE score = 5), 4) AS gap,
            round(-corr(CASE WHEN contains(issue_text, 'Transaction Failure') THEN 1.0::DOUBLE ELSE 0 END, score::DOUBLE), 4) AS fs,
            round(corr(CASE WHEN contains(issue_text, 'Transaction Failure') THEN 1.0::DOUBLE ELSE 0 END, severity_score), 4) AS fv
            FROM enriched)""", """
          SELECT 'valid_rows' AS check_name, valid AS value, 1.0::DOUBLE AS bound, valid >= 1.0 AS passed FROM c
          UNION ALL SELECT 'negative_share_score_1', neg1, 0.85, neg1 >= 0.85 FROM c
          UNION ALL SELECT 'positive_share_score_5', pos5, 0.85, pos5 >= 0.85 FROM c
          UNION ALL SELECT 'severity_gap_score_1_vs_5', gap, 0.0, gap > 0 FROM c
          UNION ALL SELECT 'failure_vs_low_score', fs, 0.0, fs > 0 FROM c
          UNION ALL SELECT 'failure_vs_severity', fv, 0.0, fv > 0 FROM c"""),
        "golden_scores": with_(ENRICHED + ", golden AS " + _distinct_events("""
            CASE event_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS gold_sentiment,
            CASE WHEN event_id % 8 = 0 THEN ['transaction failure', 'login/auth issues'] ELSE ['performance issues'] END AS gold_labels,
            CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'med' END AS gold_band""", "event_id % 4 = 0") + """,
          best AS (SELECT content, label FROM issues
            QUALIFY row_number() OVER (PARTITION BY content ORDER BY confidence DESC, label) <= 2),
          judged AS (SELECT g.review_id, avg(CASE WHEN list_contains(gold_labels, lower(b.label)) THEN 1.0 ELSE 0.0 END) AS p
            FROM golden g JOIN enriched e USING (review_id) JOIN best b USING (content) GROUP BY 1)""", """
          SELECT count(*) AS labelled,
            round(avg(CASE WHEN sentiment_label = gold_sentiment THEN 1.0 ELSE 0.0 END), 4) AS sentiment_accuracy,
            round(avg(CASE WHEN severity_band = gold_band THEN 1.0 ELSE 0.0 END), 4) AS band_accuracy,
            round(avg(p), 4) AS label_precision_at_k
          FROM golden g JOIN enriched e USING (review_id) LEFT JOIN judged USING (review_id)"""),
        "golden_sample": with_(CLEAN, """SELECT review_id, score, category_taxonomy, content FROM clean
          QUALIFY row_number() OVER (PARTITION BY score, category_taxonomy ORDER BY md5(review_id), review_id) <= 4"""),
        "pain_points": with_(CANDIDATES, f"""SELECT t.label, CAST(dense_rank() OVER (ORDER BY weight DESC, review_count DESC, t.label)
          AS INTEGER) AS rank, review_count, CAST(round(weight, 4) AS DOUBLE) AS weighted_severity,
          {_impact.format('round(weight, 4)')} AS impact, CAST(quote_rank AS INTEGER) AS quote_rank, review_id, quote
          FROM totals t JOIN label_quotes q ON q.label = t.label WHERE quote_rank <= 3"""),
        "backlog_candidates": with_(CANDIDATES, "SELECT * FROM candidates"),
        "emerging_risks": with_(ENRICHED + """, ages AS (SELECT day, label,
            CAST(floor(date_diff('day', day, (SELECT max(day) FROM enriched)) / 7) AS INTEGER) AS period FROM issue_rows),
          totals AS (SELECT count(*) FILTER (WHERE period = 0) AS now, count(*) FILTER (WHERE period = 1) AS before
            FROM (SELECT floor(date_diff('day', day, (SELECT max(day) FROM enriched)) / 7) AS period FROM enriched)),
          shares AS (SELECT label, round(count(*) FILTER (WHERE period = 0) / any_value(now), 4) AS share_now,
            round(count(*) FILTER (WHERE period = 1) / any_value(before), 4) AS share_before
            FROM ages, totals WHERE period < 2 GROUP BY label)""", """
          SELECT label, share_now, share_before, CASE WHEN share_now > round(share_before * 1.2::DOUBLE, 6) THEN 'rising'
            WHEN share_now < round(share_before * 0.8::DOUBLE, 6) THEN 'falling' ELSE 'stable' END AS trend FROM shares"""),
        "feature_requests": with_(_phrase_rows("Feature Requests") + """,
          f AS (SELECT evidence AS request, count(*) AS review_count, CAST(round(sum(CAST(severity_score AS DECIMAL(18,12))), 4) AS DOUBLE) AS weighted_severity,
            CAST(sum(greatest(0, coalesce(thumbs_up, 0))) AS BIGINT) AS thumbs_up FROM phrase_rows GROUP BY evidence)""", f"""
          SELECT *, {_impact.format('weighted_severity')} AS priority,
            CAST(row_number() OVER (ORDER BY weighted_severity DESC, thumbs_up DESC, request) AS INTEGER) AS rank FROM f"""),
        "policy_themes": with_(_phrase_rows("Policy Complaints") + f""",
          said AS (SELECT evidence, {excerpt('content')} AS quote,
            row_number() OVER (PARTITION BY evidence ORDER BY {_strong}) AS place FROM phrase_rows)""", """
          SELECT evidence AS theme, count(*) AS review_count,
            round(count(*) / (SELECT count(DISTINCT review_id) FROM phrase_rows), 4) AS share,
            CAST(round(sum(CAST(severity_score AS DECIMAL(18,12))), 4) AS DOUBLE) AS weighted_severity,
            (SELECT string_agg(quote, '|' ORDER BY place) FROM said s WHERE s.evidence = p.evidence AND place <= 2) AS evidence_quotes
          FROM phrase_rows p GROUP BY evidence"""),
        "competitor_mentions": with_(SENTIMENT, f"""SELECT name, count(*) AS mentions,
          count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
          count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral,
          count(*) FILTER (WHERE sentiment_label = 'negative') AS negative
          FROM sentiment, (SELECT unnest([{items(COMPETITORS)}]) AS name)
          WHERE {_MENTION.format('name')} GROUP BY name"""),
        "spike_drivers": with_(DAILY + """,
          numbered AS (SELECT day, n, row_number() OVER (ORDER BY day) AS place FROM day_base WHERE day IS NOT NULL),
          lifts AS (SELECT f.day, f.metric, f.z_score, i.label, i.review_count / d.n AS share,
              (SELECT coalesce(sum(b.review_count), 0) FROM day_issue b JOIN numbered x ON x.day = b.day
                WHERE b.label = i.label AND x.place BETWEEN d.place - 14 AND d.place - 1)
              / (SELECT sum(x.n) FROM numbered x WHERE x.place BETWEEN d.place - 14 AND d.place - 1) AS before
            FROM flags f JOIN numbered d ON d.day = f.day JOIN day_issue i ON i.day = f.day),
          drivers AS (SELECT day, metric, z_score, label, round(share, 4)::DOUBLE AS share, round(before, 4)::DOUBLE AS share_before,
              round(share - before, 4)::DOUBLE AS lift FROM lifts)""", f"""
          SELECT d.day, d.metric, d.z_score, d.label, share, share_before, lift,
            CAST(row_number() OVER (PARTITION BY d.day, d.metric ORDER BY lift DESC, d.label) AS INTEGER) AS rank,
            (SELECT review_id FROM issue_rows r WHERE r.day = d.day AND r.label = d.label
              ORDER BY {_strong} LIMIT 1) AS evidence_review_id,
            (SELECT {excerpt('content')} FROM issue_rows r WHERE r.day = d.day AND r.label = d.label
              ORDER BY {_strong} LIMIT 1) AS evidence_quote
          FROM drivers d WHERE lift > 0 QUALIFY rank <= 3"""),
        "kpi_tiles": with_(ENRICHED + """, p AS (SELECT *, day >= DATE '2024-01-10' AS cur FROM enriched
            WHERE day BETWEEN DATE '2023-12-30' AND DATE '2024-01-20'),
          t AS (SELECT cur, count(*)::DOUBLE AS total_reviews, avg(score::DOUBLE) AS avg_rating,
            avg(CASE WHEN sentiment_label = 'negative' THEN 1.0::DOUBLE ELSE 0 END) AS pct_negative,
            (count(*) FILTER (WHERE severity_band = 'critical'))::DOUBLE AS critical_count FROM p GROUP BY cur),
          m AS (UNPIVOT t ON total_reviews, avg_rating, pct_negative, critical_count INTO NAME label VALUE v)""", """
          SELECT label, round(coalesce(max(v) FILTER (WHERE cur), 0), 4)::DOUBLE AS value,
            round(coalesce(max(v) FILTER (WHERE cur), 0) - coalesce(max(v) FILTER (WHERE NOT cur), 0), 4)::DOUBLE AS delta
          FROM m GROUP BY label"""),
        "document_sentiment": with_(lexicon(texts, "text"), """
          SELECT doc_id, lex AS lexicon_score, CASE WHEN 0.55::DOUBLE * lex <= -0.45 THEN 'negative'
            WHEN 0.55::DOUBLE * lex >= 0.45 THEN 'positive' ELSE 'neutral' END AS sentiment_label, words
          FROM documents JOIN lexicon ON lexicon.content = documents.text"""),
        "document_issues": with_(_documents_enriched(), """SELECT doc_id, issue_text AS issues,
          round(severity_score, 6) AS severity_score, severity_band FROM enriched"""),
        "document_excerpts": f"SELECT doc_id, {excerpt('text', 'the tion ering')} AS quote FROM documents",
    }
