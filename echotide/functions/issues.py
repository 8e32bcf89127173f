"""Multi-label issue rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echotide.functions.fixed_values import ISSUE_RULES, NEAR_FAILURE_GAP, NEAR_FAILURE_PATTERN
from echotide.functions.text import bind, parse_json, strip_whitespace

ISSUE_LIST = "array<struct<label:string,confidence:double,evidence:array<string>>>"
SPAN_LIST = "array<struct<start:int,end:int,rule:int,phrase:int,near:boolean>>"

# Evidence name and pattern of every phrase of a rule, then of its own pattern.
CHECKS = {
    label: [(p, rf"\b{re.escape(p)}\b") for p in phrases] + [(f"regex:{pattern}", pattern)]
    for label, (phrases, pattern) in ISSUE_RULES.items()
}


def leading_words(pattern: str) -> list[str]:
    """The words of which one must stand where a pattern matches; a pattern of another shape has none listed."""
    if not pattern.startswith(r"\b"):
        return []
    body = re.sub(r"\(\?:[^()]*\)\?", "", pattern.removeprefix(r"\b")).replace(r"\ ", " ")  # without optional endings
    words = re.match(r"\(((?:[\w ]+\|?)+)\)\\b|[\w ]+", body)
    return (words[1] or words[0]).split("|") if words else []


def _by_first_letter() -> tuple[dict[str, list[tuple[int, int, re.Pattern]]], re.Pattern]:
    """Rule, place and pattern of everything that can match at a letter, and one pattern for all letters that can begin a match.

    It tests the rest of a leading word after its letter, and takes the letter alone, so that matches may begin inside others."""
    found, rests = defaultdict(list), defaultdict(set)
    for rule, checks in enumerate(CHECKS.values()):
        for place, (_, pattern) in enumerate(checks):
            words = leading_words(pattern)
            if not words:
                raise ValueError(f"an issue pattern must begin with a word boundary and words: {pattern}")
            for word in words:
                rests[word[0]].add(re.escape(word[1:]))
            for letter in {w[0] for w in words}:
                found[letter].append((rule, place, re.compile(pattern)))
    return dict(found), re.compile("|".join(f"{re.escape(c)}(?={'|'.join(sorted(rest))})" for c, rest in sorted(rests.items())))


STARTS, ANY_RULE = _by_first_letter()
FAILURE = re.compile(NEAR_FAILURE_PATTERN)


def fold(text: str | None) -> str:
    """Lower case, and the two letters that matching without regard to case also equates with ASCII."""
    return (text or "").lower().replace("\u017f", "s").replace("\u0131", "i")


def spans_in(text: str | None) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, rule, place of the pattern, near a failure word) of every match, by start; each pattern's own matches do
    not overlap. Near means that no more than the allowed gap lies between the two, or that they touch or overlap."""
    text = fold(text)
    done: dict[tuple[int, int], int] = {}
    found = []
    for anchor in ANY_RULE.finditer(text):
        start = anchor.start()
        for rule, place, pattern in STARTS.get(text[start], ()):
            if start >= done.get((rule, place), 0) and (match := pattern.match(text, start)):
                done[rule, place] = match.end()
                found.append((start, match.end(), rule, place))
    if not found:
        return []
    failures = [m.span() for m in FAILURE.finditer(text)]
    ends = [end for _, end in failures]

    def near(start: int, end: int) -> bool:
        first = bisect_left(ends, start - NEAR_FAILURE_GAP)  # failure words do not overlap, so they are in order by both ends
        return first < len(ends) and failures[first][0] <= end + NEAR_FAILURE_GAP

    return [(*span, near(*span[:2])) for span in found]


def _span_lists(texts: pa.Array) -> pa.Array:
    """Equal texts of a batch are searched once."""
    encoded = texts.dictionary_encode(null_encoding="encode")
    offsets, rows = [0], []
    for text in encoded.dictionary.to_pylist():
        rows += spans_in(text)
        offsets.append(len(rows))
    columns = list(zip(*rows)) or [()] * 5
    types = {"start": pa.int32(), "end": pa.int32(), "rule": pa.int32(), "phrase": pa.int32(), "near": pa.bool_()}
    spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).take(encoded.indices)


def issue_spans(content: Column) -> Column:
    """All matches of all rules in one pass over the lower-case text, as a sorted list; code points, end exclusive. Arrow batches
    go to Python once per text; whatever is made of the list stays with Spark."""
    return F.arrow_udf(_span_lists, SPAN_LIST)(content)


def _per_rule(spans: Column, result: Callable[[Column, Column], Column]) -> Column:
    """One result for each rule that has a match, in rule order, from the rule (label, names) and its matches."""
    rules = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(name) for name, _ in checks]).alias("names"))
                      for label, checks in CHECKS.items()])

    def of_rule(rule: Column, number: Column) -> Column:
        own = F.filter(spans, lambda s: s["rule"] == number)
        return bind(own, lambda matches: F.when(F.size(matches) > 0, result(rule, matches)))

    return F.array_compact(F.transform(rules, of_rule))


def _issue(rule: Column, matches: Column) -> Column:
    places = F.array_sort(F.array_distinct(F.transform(matches, lambda s: s["phrase"])))
    confidence = (
        F.lit(0.60)
        + F.when(F.size(matches) >= 2, 0.10).otherwise(0.0)
        + F.when(F.exists(matches, lambda s: s["near"]), 0.10).otherwise(0.0)
    )
    return F.struct(
        rule["label"].alias("label"),
        F.round(F.least(F.lit(0.85), confidence), 2).alias("confidence"),
        F.transform(places, lambda p: F.get(rule["names"], p)).alias("evidence"),
    )


def issues_from(spans: Column) -> Column:
    """Label, confidence and evidence of every rule that matches, in rule order."""
    return bind(spans, lambda found: _per_rule(found, _issue))


def issues_in(content: Column) -> Column:
    return issues_from(issue_spans(content))


def near_labels(content: Column) -> Column:
    """Labels with a match near a failure word."""

    def label_if_near(rule: Column, matches: Column) -> Column:
        return F.when(F.exists(matches, lambda s: s["near"]), rule["label"])

    return bind(issue_spans(content), lambda found: _per_rule(found, label_if_near))


def labels_of(issues: Column) -> Column:
    """Non-null labels of an issue list; a missing list is an empty one.

    Taking the field from the whole list lets the scan skip confidence and evidence.
    """
    labels = F.coalesce(issues.getField("label"), F.array().cast("array<string>"))
    return F.filter(labels, lambda label: label.isNotNull())


def issue_rows(reviews: DataFrame, *keep: str) -> DataFrame:
    """One row per issue of each review. Exploding the plain column would make Spark add a filter
    on it, computed a second time where the issues are not stored yet."""
    return reviews.select(*keep, F.inline(F.filter("issues", lambda i: i["label"].isNotNull())))


def has_label(issues: Column, label: str) -> Column:
    return F.exists(labels_of(issues), lambda x: F.lower(x) == label.lower())


def labels_from_json(payload: Column) -> Column:
    """Lower-case labels from foreign JSON: a list of objects or strings, or one object."""

    def is_text(value: Column) -> Column:
        return F.schema_of_variant(value) == "STRING"

    def label_in(value: Column) -> Column:
        inner = F.try_variant_get(value, "$.label", "variant")
        named = F.when(is_text(inner), F.try_variant_get(value, "$.label", "string"))
        return F.when(is_text(value), F.try_variant_get(value, "$", "string")).otherwise(named)

    def labels_in(document: Column) -> Column:
        items = F.coalesce(
            F.try_variant_get(document, "$", "array<variant>"),
            F.when(F.schema_of_variant(document).startswith("OBJECT"), F.array(document)),
            F.array().cast("array<variant>"),
        )
        labels = F.transform(items, lambda v: F.nullif(F.lower(strip_whitespace(label_in(v))), F.lit("")))
        return F.filter(labels, lambda label: label.isNotNull())

    return bind(parse_json(payload), labels_in)


def needs_review(issues: Column, taxonomy: Column) -> Column:
    """No label, more than four, or a category that none of the labels supports."""
    labels = labels_of(issues)

    def lacks(*expected: str) -> Column:
        return ~F.arrays_overlap(labels, F.array(*[F.lit(e) for e in expected]))

    mismatch = (
        F.when(taxonomy == "App Performance", lacks("Performance Issues", "Glitches/Bugs"))
        .when(taxonomy == "Login & Authentication", lacks("Login/Auth Issues"))
        .otherwise(False)
    )
    return (F.size(labels) == 0) | (F.size(labels) > 4) | mismatch
