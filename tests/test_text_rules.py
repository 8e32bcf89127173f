"""Edges of the text rules, worked out by hand or by a direct search of the text."""

import random
import re

import pytest

from pyspark.sql import functions as F

from conftest import texts
from echotide.functions import issues, sentiment, severity, text
from echotide.functions.fixed_values import ISSUE_RULES


def column(spark, values, expression):
    return [r[0] for r in texts(spark, values).orderBy("id").select(expression.alias("x")).collect()]


def test_lexicon_counts_presence_not_occurrences(spark):
    cases = {
        "goodbye": 1, "badge": -1, "crash and crashes": -1, "not good": 0, "not working": -2, "never works": -1,
        "not not good": 0, "not bad": 0, "great great": 1, "": 0, None: 0, "NOT, good": 0, "note good": 1,
        "doesn't work": -1, "not é good": 0, "cannot good": 1, "works not": 0,
    }
    assert column(spark, list(cases), sentiment.lexicon_score(F.col("content"))) == [float(v) for v in cases.values()]


def test_sentiment_edges(spark):
    frame = spark.createDataFrame(
        [(1, "great love"), (3, ""), (None, "ok"), (4, ""), (2, ""), (9, "bad")], "score int, content string"
    )
    total = sentiment.signal(sentiment.rating_prior(F.col("score")), sentiment.lexicon_score(F.col("content")))
    found = frame.select(sentiment.label_of(total), F.round(sentiment.confidence_of(total), 4)).collect()
    assert [tuple(r) for r in found] == [
        ("neutral", 0.524), ("neutral", 0.5), ("neutral", 0.5), ("positive", 0.656), ("negative", 0.656),
        ("negative", 0.566),
    ]


def expected_issues(content):
    """A direct search with Python's own matcher."""
    body = content.strip().lower()
    failures = [m.span() for m in re.finditer(r"\b(can't|cant|cannot|failed|failure|error)\b", body, re.I)]
    found = []
    for label, (phrases, pattern) in ISSUE_RULES.items():
        spans, evidence = [], []
        for name, regex in [(p, r"\b" + re.escape(p) + r"\b") for p in phrases] + [("regex:" + pattern, pattern)]:
            hits = [m.span() for m in re.finditer(regex, body, re.I)]
            spans += hits
            evidence += [name] * bool(hits)
        if spans:
            near = any(max(s, fs) - min(e, fe) <= 40 for s, e in spans for fs, fe in failures)
            found.append((label, round(min(0.85, 0.6 + 0.1 * (len(spans) > 1) + 0.1 * near), 2), evidence))
    return found


def random_texts(n):
    rng = random.Random(7)
    words = sorted({w for phrases, _ in ISSUE_RULES.values() for p in phrases for w in p.split()})
    words += ["payment", "transfer", "fail", "failure", "error", "cannot", "can't", "cant", "stuck", "crashed", "bugs",
              "fee", "kyc", "unfair", "problem", "ux", "design", "hard", "lag", "freeze", "agent", "rude", "ui",
              "feature", "mode", "option", "é", "çui", "uié", "ſlow", "login2", "x" * 15, "zzzz", "y" * 30]
    seps = [" ", " ", " ", "  ", ". ", "\n", ", ", "-", "\r", " ", "_", "'", "\x01", "\x02"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_issues_match_a_direct_search(spark):
    cases = random_texts(1500) + [
        "", "  ", "PAYMENT FAILED", "payment  failed", "slow", "slow slow", "slow " + "x" * 39 + " failed",
        "slow " + "x" * 38 + " failed", "error " + "x" * 38 + " slow", "error " + "x" * 39 + " slow", "cannot find",
        "Please add dark mode support", "payment a failed b error", "login error error error",
        "payment " + "x" * 23 + " error", "payment\nfailed", "\x01slow\x02 failed", "ſlow", "İlogin error",
        "slow\u0301 bug", "e\u0301slow", "slow\u200dbug", "slow\u203fbug", "slow²", "½slow", "Ⓐslow", "Ⅷslow", "slow😀failed", "_slow",
    ]
    found = column(spark, cases, issues.issues_in(F.col("content")))
    for content, issue_list in zip(cases, found):
        assert [(i["label"], i["confidence"], i["evidence"]) for i in issue_list] == expected_issues(content), content


def test_spans_match_a_direct_search(spark):
    cases = random_texts(400) + ["slow " * 3000 + "error", "payment payment failed payment failed", "2fa", "crash crashes crashing"]
    found = column(spark, cases, issues.issue_spans(F.col("content")))
    for content, spans in zip(cases, found):
        body = content.lower().replace("\u017f", "s")
        wanted = sorted((m.start(), m.end(), rule, place) for rule, checks in enumerate(issues.CHECKS.values())
                        for place, (_, pattern) in enumerate(checks) for m in re.finditer(pattern, body, re.I))
        assert sorted((s["start"], s["end"], s["rule"], s["phrase"]) for s in spans) == wanted
        assert [s["start"] for s in spans] == sorted(s["start"] for s in spans)


def test_spans_by_hand():
    assert issues.spans_in("The payment failed!") == [(4, 18, 0, 0, True), (4, 18, 0, 8, True)]
    assert issues.spans_in("very sluggish app") == [(0, 13, 2, 5, False), (5, 13, 2, 9, False)]
    assert issues.spans_in(None) == issues.spans_in("all is well") == []


def test_leading_words_come_from_the_patterns():
    assert issues.leading_words(r"\b(a|log in)\b.{0,24}\b(x)\b") == ["a", "log in"]
    assert issues.leading_words(r"\bcan't login\b") == ["can"]
    assert issues.leading_words(r".*x") == []
    assert set(issues.STARTS) == {w[0] for checks in issues.CHECKS.values() for _, p in checks for w in issues.leading_words(p)}


def test_missing_text_has_no_issues(spark):
    assert column(spark, [None, " \n "], issues.issues_in(F.col("content"))) == [[], []]


def test_labels_from_json_shapes(spark):
    cases = {
        '[{"label":" A "},"B",{"label":"c","x":1}]': ["a", "b", "c"], '{"label":"Solo"}': ["solo"], '["x", "", " "]': ["x"],
        "": [], "nope": [], "[1, null, {}, [\"n\"], {\"label\": 3}]": [], "5": [], '"text"': [], '["a"] trailing': [],
        '["a"],["b"]': [], None: [], '{"label": null}': [],
    }
    assert column(spark, list(cases), issues.labels_from_json(F.col("content"))) == list(cases.values())


def test_severity_parts(spark):
    frame = spark.createDataFrame(
        [(1, "negative", "it failed", ["Transaction Failure"], 50), (5, "positive", "ok", [], 0),
         (None, None, None, ["glitches/bugs"], None), (9, "neutral", "cant", ["UI/UX Problems"], -4),
         (0, "negative", "", ["x"], 10**6)],
        "score int, label string, content string, labels array<string>, thumbs int",
    )
    value = severity.severity(F.col("score"), F.col("label"), F.col("content"), F.col("labels"), F.col("thumbs"))
    found = frame.select(F.round(value, 6), severity.band_of(value)).collect()
    assert [tuple(r) for r in found] == [
        (1.0, "critical"), (0.07, "low"), (0.35, "med"), (0.295, "low"), (0.745, "high"),
    ]


def test_tidy_and_slug(spark):
    tidy = text.tidy_content(F.col("content"), "[EMPTY_REVIEW]")
    assert column(spark, ["  a\t b\n\nc ", "  x  ", "   ", None, ""], tidy) == [
        "a b c", "x", "[EMPTY_REVIEW]", "[EMPTY_REVIEW]", "[EMPTY_REVIEW]"]
    assert column(spark, [" Money  Transfers ", "LOGIN", "__a--b__", None, "é"], text.slug(F.col("content"))) == [
        "money_transfers", "login", "a_b", "", ""]


LONG_TEXT = "x" * 100 + " the login page " + "y" * 100


@pytest.mark.parametrize("content, label, expected", [
    ("  short\ntext ", "", "short text"),
    ("a" * 180, "", "a" * 180),
    ("a" * 181, "", "a" * 180 + "..."),
    ("a" * 178 + "   " + "b" * 9, "", "a" * 178 + "..."),
    (LONG_TEXT, "", "x" * 100 + " the login page " + "y" * 64 + "..."),
    (LONG_TEXT, "Login/Auth Issues", "x" * 100 + " the login page " + "y" * 64 + "..."),
    (LONG_TEXT, "login", "..." + "x" * 85 + " the login page " + "y" * 79 + "..."),
    (LONG_TEXT, "UI to the page", "..." + "x" * 79 + " the login page " + "y" * 85 + "..."),
    ("login " + "z" * 200, "LOGIN", "login " + "z" * 174 + "..."),
])
def test_excerpts(spark, content, label, expected):
    assert column(spark, [content], text.excerpt(F.col("content"), label)) == [expected]


def test_compact_quotes(spark):
    assert column(spark, ["q" * 120, "q" * 121, " q\nr "], text.compact_quote(F.col("content"))) == ["q" * 120, "q" * 120 + "...", "q r"]


def test_fixed_text_rounds_like_printing_the_binary_value(spark):
    values = [n / 10000 for n in range(0, 10001, 7)] + [0.3525, 0.4235, 0.0005, 0.0015, 0.9995, 1.0, 0.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").orderBy("id")
    found = frame.select(text.percent_text(F.col("v")), text.fixed_text(F.col("v") * 5, 2)).collect()
    assert [tuple(r) for r in found] == [(f"{v:.1%}", f"{v * 5:.2f}") for v in values]


def test_equal_texts_of_a_batch_are_searched_once(monkeypatch):
    import pyarrow as pa

    values = ["payment failed again", None, "ok.", "payment failed again", "", None] * 50
    wanted = [issues.spans_in(v) for v in values]
    searched, real = [], issues.spans_in
    monkeypatch.setattr(issues, "spans_in", lambda value: searched.append(value) or real(value))
    found = issues._span_lists(pa.chunked_array([values]).combine_chunks())
    assert [[tuple(s.values()) for s in spans] for spans in found.to_pylist()] == wanted
    assert sorted(searched, key=repr) == sorted(set(values), key=repr)


def test_trimming_and_runs_as_by_patterns(spark):
    rng = random.Random(3)
    marks = [*text.SPACES, *text.WHITESPACE, "\x1c", "​", " ", "a", "b", "_", "é"]
    values = ["".join(rng.choices(marks, k=rng.randint(0, 7))) for _ in range(3000)] + [None, "", "a  b", " a\tb\x0b c "]
    trimmed = F.regexp_replace("content", r"^\p{Zs}+|\p{Zs}+\z", "")  # \z: a space before a last newline stays, as in SQL
    assert column(spark, values, text.trim_spaces(F.col("content"))) == column(spark, values, trimmed)
    tidy = F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit("none")).otherwise(F.regexp_replace(trimmed, r"\s+", " "))
    assert column(spark, values, text.tidy_content(F.col("content"), "none")) == column(spark, values, tidy)
