"""Common table expressions: events -> reviews -> enriched reviews, in plain SQL.

Texts repeat in the test tables, so the lexicon and the issue rules are worked out once per
distinct text, relationally: one row per text, rule and match.
"""

from __future__ import annotations

from echotide.functions import fixed_values as fv
from echotide.sources.event_reviews import CATEGORIES, CLOSINGS, OPENINGS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(lit(v) for v in values)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


COLUMNS = "review_id, user_name, content, score, thumbs_up, review_created_version, at_ts, app_version, category_raw"

REVIEWS = f"""
reviews AS (
  SELECT 'r' || CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS review_id,
    'u' || CAST(user_id AS VARCHAR) AS user_name,
    CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '   '
      ELSE ([{items(OPENINGS)}])[1 + event_id % 12] || ' ' || ([{items(CLOSINGS)}])[1 + user_id % 7] END AS content,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(1 + (event_id * 7 + user_id * 3) % 5 AS INTEGER) END AS score,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 80 AS INTEGER) END AS thumbs_up,
    '5.' || CAST(user_id % 7 AS VARCHAR) || '.0' AS review_created_version,
    ts AS at_ts,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE '5.' || CAST((event_id + user_id) % 7 AS VARCHAR) || '.0' END AS app_version,
    ([{items(CATEGORIES)}])[1 + event_id % 8] AS category_raw,
    event_id, CASE event_id % 3 WHEN 0 THEN 'average' WHEN 1 THEN 'bad' ELSE 'good' END AS source
  FROM events
)"""


def latest(source: str, where: str = "TRUE") -> str:
    return f"""SELECT {COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY at_ts DESC NULLS LAST, score DESC NULLS LAST,
      thumbs_up DESC NULLS LAST, content DESC NULLS LAST, app_version DESC NULLS LAST, user_name DESC NULLS LAST,
      review_created_version DESC NULLS LAST, category_raw DESC NULLS LAST) AS rn
    FROM {source} WHERE review_id IS NOT NULL AND {where}) WHERE rn = 1"""


_cell = lambda c: f"nullif(trim({c}), '')"

STAGED = REVIEWS + f""",
untidy AS (
  SELECT * REPLACE (
    chr(160) || ' ' || content || ' ' AS content,
    CASE WHEN event_id % 53 = 0 THEN '4.5' WHEN event_id % 59 = 0 THEN 'abc' WHEN event_id % 61 = 0 THEN '1e0'
      ELSE ' ' || CAST(score AS VARCHAR) || ' ' END AS score,
    CAST(thumbs_up AS VARCHAR) AS thumbs_up,
    CASE WHEN event_id % 43 = 0 THEN 'yesterday' WHEN event_id % 47 = 0 THEN strftime(at_ts, '%Y-%m-%d')
      WHEN event_id % 41 = 0 THEN strftime(at_ts, '%Y-%m-%d %H:%M') ELSE strftime(at_ts, '%Y-%m-%d %H:%M:%S') END AS at_ts,
    coalesce(app_version, '  ') AS app_version, category_raw || ' ' AS category_raw)
  FROM reviews
),
staged AS (
  SELECT {_cell('review_id')} AS review_id, {_cell('user_name')} AS user_name, {_cell('content')} AS content,
    TRY_CAST({_cell('score')} AS INTEGER) AS score, TRY_CAST({_cell('thumbs_up')} AS INTEGER) AS thumbs_up,
    {_cell('review_created_version')} AS review_created_version,
    coalesce(try_strptime({_cell('at_ts')}, '%Y-%m-%d %H:%M:%S'), try_strptime({_cell('at_ts')}, '%Y-%m-%d %H:%M'),
      try_strptime({_cell('at_ts')}, '%Y-%m-%d')) AS at_ts,
    {_cell('app_version')} AS app_version, {_cell('category_raw')} AS category_raw, source
  FROM untidy
)"""

_slug = "regexp_replace(regexp_replace(lower(trim(coalesce(category_raw, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_taxonomy = "CASE " + _slug + " " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.TAXONOMY_MAP.items() if k != "__fallback__"
) + f" ELSE {lit(fv.TAXONOMY_MAP['__fallback__'])} END"

DEDUPED = REVIEWS + f""",
deduped AS ({latest('reviews')})"""

CLEAN = DEDUPED + f""",
clean AS (
  SELECT * REPLACE (CASE WHEN content IS NULL OR length(trim(content)) = 0 THEN {lit(fv.EMPTY_REVIEW)}
      ELSE regexp_replace(trim(content), '\\s+', ' ', 'g') END AS content),
    CAST(at_ts AS DATE) AS day, {_taxonomy} AS category_taxonomy
  FROM deduped
)"""

MERGED = STAGED + f""",
edits AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN review_id END AS review_id, 6 - score AS score,
    at_ts + INTERVAL 3 DAY AS at_ts, CASE app_version WHEN '5.6.0' THEN '5.5.0' ELSE app_version END AS app_version)
  FROM reviews WHERE event_id % 7 = 3 AND event_id % 3 <> 2),
second_batch AS (SELECT {COLUMNS} FROM staged WHERE source = 'good' UNION ALL SELECT {COLUMNS} FROM edits),
fresh AS ({latest('second_batch')}),
stored AS ({latest('staged', "source <> 'good'")}),
deduped AS (SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE review_id NOT IN (SELECT review_id FROM fresh))"""


def merged(ctes: str) -> str:
    """The same expressions over the reviews that are left when the second batch has replaced rows of the first."""
    return MERGED + ctes.removeprefix(DEDUPED)


_single_pos = [w for w in fv.POSITIVE_WORDS if " " not in w]
_single_neg = [w for w in fv.NEGATIVE_WORDS if " " not in w]


def lexicon(text_table: str, text: str) -> str:
    """CTEs `tokens` and `lexicon(content, lex, words)` over a table of texts."""

    def follows(words) -> str:
        return (f"len(list_filter(range(1, len(tok)), lambda i: tok[i] IN ({items(fv.NEGATORS)}) "
                f"AND tok[i + 1] IN ({items(words)})))")

    return f"""
tokens AS (SELECT DISTINCT {text} AS content, lower({text}) AS t,
    regexp_extract_all(lower({text}), '[a-z'']+') AS tok FROM {text_table}),
lexicon AS (SELECT content, len(tok) AS words, CAST(
    {_count('t', fv.POSITIVE_WORDS)} + {follows(_single_neg)}
    - {_count('t', fv.NEGATIVE_WORDS)} - {follows(_single_pos + list(fv.NEGATED_WORK_WORDS))} AS DOUBLE) AS lex
  FROM tokens)"""


SENTIMENT = CLEAN + "," + lexicon("clean", "content") + """,
signals AS (
  SELECT c.*, l.lex, l.words, CASE WHEN score IN (1, 2) THEN -1.0::DOUBLE WHEN score IN (4, 5) THEN 1.0::DOUBLE
      ELSE 0.0::DOUBLE END AS prior
  FROM clean c JOIN lexicon l USING (content)
),
sentiment AS (
  SELECT *, 1.3::DOUBLE * prior + 0.55::DOUBLE * lex AS total,
    CASE WHEN 1.3::DOUBLE * prior + 0.55::DOUBLE * lex <= -0.45 THEN 'negative'
      WHEN 1.3::DOUBLE * prior + 0.55::DOUBLE * lex >= 0.45 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
    greatest(0.5::DOUBLE, least(0.99::DOUBLE, 0.5::DOUBLE + 0.12::DOUBLE * abs(1.3::DOUBLE * prior + 0.55::DOUBLE * lex)))
      AS sentiment_confidence
  FROM signals
)"""

_patterns = []
for _no, (_label, (_phrases, _pattern)) in enumerate(fv.ISSUE_RULES.items()):
    for _pos, (_name, _regex) in enumerate([(p, rf"\b{p}\b") for p in _phrases] + [(f"regex:{_pattern}", _pattern)]):
        _patterns.append(f"({_no}, {lit(_label)}, {_pos}, {lit(_name)}, {lit(_regex)})")

_span = ("coalesce(list_sum(list_transform(s[1:i], lambda x: len(x))), 0) "
         "+ coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)")

ISSUES = """
rules(rule_no, label, pos, evidence, pattern) AS (VALUES """ + ", ".join(_patterns) + f"""),
folded AS (SELECT DISTINCT content, lower(content) AS t FROM clean),
hits AS (SELECT content, rule_no, label, pos, evidence, regexp_extract_all(t, pattern) AS m,
    string_split_regex(t, pattern) AS s FROM folded, rules WHERE regexp_matches(t, pattern)),
spans AS (SELECT content, rule_no, label, pos, evidence, {_span} AS st, {_span} + len(m[i]) AS en
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)),
failed AS (SELECT content, regexp_extract_all(t, {lit(fv.NEAR_FAILURE_PATTERN)}) AS m,
    string_split_regex(t, {lit(fv.NEAR_FAILURE_PATTERN)}) AS s FROM folded),
failures AS (SELECT content, {_span} AS st, {_span} + len(m[i]) AS en
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM failed)),
near AS (SELECT DISTINCT k.content, k.label FROM spans k JOIN failures f USING (content)
  WHERE CASE WHEN f.en < k.st THEN k.st - f.en WHEN k.en < f.st THEN f.st - k.en ELSE 0 END <= {fv.NEAR_FAILURE_GAP}),
issues AS (
  SELECT h.content, h.rule_no, h.label, round(least(0.85, 0.60 + CASE WHEN count(*) >= 2 THEN 0.10 ELSE 0 END
      + CASE WHEN any_value(n.label) IS NOT NULL THEN 0.10 ELSE 0 END)::DOUBLE, 2) AS confidence
  FROM spans h LEFT JOIN near n ON n.content = h.content AND n.label = h.label GROUP BY ALL
)"""

_clip = "least(1.0::DOUBLE, ln(1 + greatest(0, coalesce(thumbs_up, 0))) / ln(51.0::DOUBLE))"
_severity = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.35::DOUBLE * ((5 - greatest(1, least(5, coalesce(score, 3)))) / 4.0::DOUBLE)
  + 0.25::DOUBLE * CASE sentiment_label WHEN 'negative' THEN 1.0::DOUBLE WHEN 'positive' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END
  + 0.15::DOUBLE * CASE WHEN {_any('lower(content)', fv.FAILURE_TERMS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  + 0.15::DOUBLE * CASE WHEN top_class = 2 THEN 1.0::DOUBLE WHEN top_class = 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END
  + 0.10::DOUBLE * {_clip}))"""

ENRICHED = SENTIMENT + "," + ISSUES + f""",
classes AS (SELECT content, max(CASE WHEN lower(label) IN ({items(fv.CRITICAL_ISSUES)}) THEN 2
    WHEN lower(label) IN ({items(fv.HIGH_ISSUES)}) THEN 1 ELSE 0 END) AS top_class, count(*) AS n_issues,
    string_agg(label, ', ' ORDER BY rule_no) AS issue_text FROM issues GROUP BY content),
scored AS (SELECT s.*, coalesce(n_issues, 0) AS n_issues, coalesce(issue_text, '') AS issue_text, {_severity} AS severity_score
  FROM sentiment s LEFT JOIN classes USING (content)),
enriched AS (SELECT *, CASE WHEN severity_score >= 0.80 THEN 'critical' WHEN severity_score >= 0.60 THEN 'high'
    WHEN severity_score >= 0.30 THEN 'med' ELSE 'low' END AS severity_band FROM scored),
issue_rows AS (SELECT e.*, i.label, i.confidence, i.rule_no FROM enriched e JOIN issues i USING (content))"""

DAILY = ENRICHED + """,
day_base AS (SELECT day, count(*) AS n, avg(CAST(score AS DOUBLE)) AS avg_rating,
    avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END) AS pct_negative,
    avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) AS pct_positive,
    count(*) FILTER (WHERE severity_score >= 0.80) AS critical_count FROM enriched GROUP BY day),
day_issue AS (SELECT day, label, count(*) AS review_count, sum(CAST(severity_score AS DECIMAL(18,12))) AS weight FROM issue_rows GROUP BY ALL),
day_top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY weight DESC, review_count DESC, label) AS rank
  FROM day_issue QUALIFY rank <= 5),
user_features AS (SELECT user_name, count(*) AS reviews, count(*) FILTER (WHERE sentiment_label = 'negative') AS neg,
    sum(CAST(severity_score AS DECIMAL(18,12)))::DOUBLE AS sev, count(*) FILTER (WHERE contains(issue_text, 'Transaction Failure')) AS txn,
    count(*) FILTER (WHERE """ + _any("lower(content)", fv.CHURN_INTENT) + """) AS intent FROM enriched GROUP BY user_name),
users AS (SELECT *, round(greatest(0.0, least(1.0, 0.35::DOUBLE * (neg / reviews) + 0.30::DOUBLE * (sev / reviews)
    + 0.15::DOUBLE * least(1.0::DOUBLE, txn / 3.0::DOUBLE) + 0.20::DOUBLE * least(1.0::DOUBLE, intent / 2.0::DOUBLE))), 6)::DOUBLE
    AS churn_user_score FROM user_features),
tiers AS (SELECT *, CASE WHEN churn_user_score > 0.66 THEN 'high' WHEN churn_user_score >= 0.33 THEN 'med' ELSE 'low' END
    AS churn_user_tier FROM users),
high_days AS (SELECT day, count(DISTINCT user_name) AS churn_high_users FROM enriched JOIN tiers USING (user_name)
  WHERE churn_user_tier = 'high' GROUP BY day),
daily AS (SELECT b.day, b.n AS total_reviews, round(avg_rating, 4) AS avg_rating, round(pct_negative, 4) AS pct_negative,
    round(pct_positive, 4) AS pct_positive, critical_count, coalesce(churn_high_users, 0) AS churn_high_users
  FROM day_base b LEFT JOIN high_days USING (day)),
day_metrics AS (
  SELECT day, 'pct_negative' AS metric, pct_negative::DOUBLE AS value FROM daily
  UNION ALL SELECT day, 'critical_count', critical_count::DOUBLE FROM daily
  UNION ALL SELECT d.day, 'transaction_failures', coalesce(i.review_count, 0)::DOUBLE FROM daily d
    LEFT JOIN day_issue i ON i.day = d.day AND i.label = 'Transaction Failure'),
day_stats AS (SELECT *, count(value) OVER w AS points, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS spread
  FROM day_metrics WINDOW w AS (PARTITION BY metric ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
flags AS (SELECT day, metric, round(value, 4) AS value, round(mean, 8) AS mean, round((value - mean) / spread, 4) AS z_score
  FROM day_stats WHERE points >= 7 AND round(spread, 12) > 0 AND round((value - mean) / spread, 4) >= 2.0)"""

VERSIONS = ENRICHED + """,
version_base AS (SELECT app_version, min(day) AS first_seen_day, max(day) AS last_seen_day, count(*) AS total_reviews,
    round(avg(CAST(score AS DOUBLE)), 4) AS avg_rating,
    round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END), 4) AS pct_negative,
    count(*) FILTER (WHERE severity_score >= 0.80) AS critical_count FROM enriched GROUP BY app_version),
version_issue AS (SELECT i.app_version, label, count(*) AS review_count,
    round(count(*) / any_value(b.total_reviews)::DOUBLE, 4) AS pct_reviews, CAST(round(sum(CAST(severity_score AS DECIMAL(18,12))), 4) AS DOUBLE) AS weighted_severity
  FROM issue_rows i JOIN version_base b ON b.app_version = i.app_version GROUP BY ALL),
version_category AS (SELECT e.app_version, category_taxonomy AS category, count(*) AS review_count,
    round(count(*) / any_value(b.total_reviews)::DOUBLE, 4) AS pct_reviews
  FROM enriched e JOIN version_base b ON b.app_version = e.app_version GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (ORDER BY first_seen_day NULLS LAST,
    list_transform(string_split(app_version, '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER), -1)), app_version) AS place
  FROM version_base WHERE app_version IS NOT NULL),
pairs AS (SELECT a.app_version, b.app_version AS previous_version FROM ordered a JOIN ordered b ON b.place = a.place - 1),
pair_labels AS (SELECT DISTINCT p.*, label FROM pairs p JOIN version_issue i
    ON i.app_version = p.app_version OR i.app_version = p.previous_version),
issue_delta AS (SELECT p.app_version, p.previous_version, p.label, coalesce(a.pct_reviews, 0.0::DOUBLE) AS pct_issue,
    coalesce(b.pct_reviews, 0.0::DOUBLE) AS previous_pct_issue,
    round(coalesce(a.pct_reviews, 0.0::DOUBLE) - coalesce(b.pct_reviews, 0.0::DOUBLE), 4) AS delta_pct_issue
  FROM pair_labels p LEFT JOIN version_issue a ON a.app_version = p.app_version AND a.label = p.label
    LEFT JOIN version_issue b ON b.app_version = p.previous_version AND b.label = p.label)"""

WEEK = "day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"


def excerpt(content: str, label: str = "", width: int = 180) -> str:
    """SQL for a short excerpt of a text."""
    text = f"replace(regexp_replace(coalesce({content}, ''), '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"
    found = "".join(
        f"WHEN position({lit(w.lower())} IN lower({text})) > 0 THEN {_centred(text, w.lower(), width)} "
        for w in label.split() if len(w) >= 4
    )
    head = f"regexp_replace(substring({text}, 1, {width}), '\\s+$', '') || '...'"
    return f"CASE WHEN length({text}) <= {width} THEN {text} {found}ELSE {head} END"


def _centred(text: str, word: str, width: int) -> str:
    start = f"greatest(0, position({lit(word)} IN lower({text})) - 1 - {width // 2})"
    end = f"least(length({text}), {start} + {width})"
    body = f"regexp_replace(substring({text}, {start} + 1, {end} - {start}), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {start} > 0 THEN '...' ELSE '' END || {body} || CASE WHEN {end} < length({text}) THEN '...' ELSE '' END"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
