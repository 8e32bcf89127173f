"""Rating-plus-lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echotide.functions.fixed_values import (
    NEGATED_WORK_WORDS, NEGATIVE_WORDS, NEGATORS, POSITIVE_WORDS,
)
from echotide.functions.text import any_present, count_present


def rating_prior(score: Column) -> Column:
    return F.when(score.isin(1, 2), -1.0).when(score.isin(4, 5), 1.0).otherwise(0.0)


def _negated(text: Column, words: tuple[str, ...]) -> Column:
    """How often a negator is directly followed by one of the words."""
    letter = "[a-z']"
    pattern = f"(?<!{letter})(?:{'|'.join(NEGATORS)})[^a-z']+(?:{'|'.join(words)})(?!{letter})"
    return F.when(any_present(text, NEGATORS), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def lexicon_score(content: Column) -> Column:
    """Positive minus negative hits. A negated word adds one hit to the other side."""
    text = F.lower(F.coalesce(content, F.lit("")))
    single_positive = tuple(w for w in POSITIVE_WORDS if " " not in w)
    single_negative = tuple(w for w in NEGATIVE_WORDS if " " not in w)
    positive = count_present(text, POSITIVE_WORDS) + _negated(text, single_negative)
    negative = count_present(text, NEGATIVE_WORDS) + _negated(text, single_positive + NEGATED_WORK_WORDS)
    return (positive - negative).cast("double")


def signal(prior: Column, lexicon: Column) -> Column:
    return F.lit(1.3) * prior + F.lit(0.55) * lexicon


def label_of(total: Column) -> Column:
    return F.when(total <= -0.45, "negative").when(total >= 0.45, "positive").otherwise("neutral")


def confidence_of(total: Column) -> Column:
    return F.greatest(F.lit(0.50), F.least(F.lit(0.99), F.lit(0.50) + F.lit(0.12) * F.abs(total)))


def word_count(content: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(content, F.lit(""))), F.lit("[a-z']+"))


def needs_review(content: Column, score: Column, confidence: Column, lexicon: Column) -> Column:
    """Low confidence, rating against wording, or an extreme rating on a very short text."""
    clash = rating_prior(score) * lexicon < 0
    terse = (word_count(content) < 4) & F.coalesce(score.isin(1, 5), F.lit(False))
    return (confidence < 0.70) | clash | terse
