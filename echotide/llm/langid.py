"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting: every training text adds its hashed 1- to 3-grams to its language; tasks count in numpy, Spark sums, and the counts
above zero are a stored table. Scoring: the matrix of log probabilities is broadcast in sparse form, per bucket the languages
that have it and how far each lies above its probability of an unseen bucket. Batches of texts become sparse counts per
(text, bucket), which are multiplied with the matrix. Entries are multiples of STEP, so that sums are exact and do not depend on
batches or pieces.

The matrix has at most MATRIX_CELLS cells above zero, 512 languages that fill every bucket and far more rare ones. The number of
buckets is a parameter and never changes by itself: beyond the bound `train` raises and names the parameter.

Defined cases: a null text, an empty one and one without a letter are `und` with score 0; so is every text when nothing
could be learned (no row with both text and language). Long texts are scored piece by piece. Rows with null or repeated
doc_id, and equal rows, are each scored by themselves. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echotide.llm.common import store

UNKNOWN = "und"
BUCKETS = 1 << 15
MATRIX_CELLS = 1 << 24
STEP = 2.0 ** -20  # of log probabilities
TEXTS = 64  # texts of a batch
LANGUAGES = 64  # languages that a counting task holds at a time
LEAST_RATIO = 1.5  # of `known_language`
ALPHA = 0.5  # additive smoothing
ORDERS = (1, 2, 3)
PIECE = 1 << 18  # characters handled at once
#: Odd multipliers of the rolling hash.
FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


class Model(NamedTuple):
    languages: list[str]
    size: int  # buckets
    starts: np.ndarray  # per bucket its first cell, and the number of all cells
    language: np.ndarray  # of each cell
    above: np.ndarray  # of each cell: log probability above that of a bucket the language has not
    unseen: np.ndarray  # per language: log probability of such a bucket
    priors: np.ndarray


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets(text: str, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in pieces; pieces overlap so that each n-gram comes once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for start in range(0, len(points), PIECE):
        for n in ORDERS:
            part = points[start : start + PIECE + n - 1]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ part[i : len(part) - n + 1 + i]) * FACTORS[i]
                h ^= h >> np.uint32(15)
            yield h % np.uint32(size)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = BUCKETS) -> Model:
    """Count over every row with a text and a language. What reaches the driver is one count per language and bucket it has."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def flush(name):
            if parts := waiting.pop(name, []):
                sums[name][:-1] += np.bincount(np.concatenate(parts), minlength=size)

        def counted():
            for name in list(sums):
                flush(name)
                counts = sums.pop(name)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                    ["lang", "bucket", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in sums and len(sums) == LANGUAGES:
                    yield from counted()
                counts = sums.setdefault(name, np.zeros(size + 1, dtype=np.int64))
                counts[-1] += 1  # documents
                for part in buckets(value, size):
                    waiting.setdefault(name, []).append(part)
                if sum(map(len, waiting.get(name, []))) > PIECE:
                    flush(name)
        yield from counted()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counted = store(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")), "language_counts")
    cells = counted.count()
    if cells > MATRIX_CELLS:
        raise ValueError(f"{cells} counts of languages and buckets, at most {MATRIX_CELLS} are broadcast: give a smaller `size`")
    return fitted(counted.toPandas(), size)


def fitted(found: pd.DataFrame, size: int) -> Model:
    """The model of counts (lang, bucket, n); bucket `size` counts documents."""
    language, names = pd.factorize(found["lang"], sort=True)
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    grams = bucket < size
    seen = np.bincount(language[~grams], n[~grams], minlength=len(names))
    sums = np.bincount(language[grams], n[grams], minlength=len(names))
    order = np.lexsort((language[grams], bucket[grams]))
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket[grams], minlength=size))]).astype(np.int64)
    above = np.rint(np.log1p(n[grams][order] / ALPHA) / STEP) * STEP
    unseen = np.rint(np.log(ALPHA / (sums + ALPHA * size)) / STEP) * STEP
    return Model(list(names), size, starts, language[grams][order].astype(np.int32), above.astype(np.float32), unseen,
                 np.log(seen / max(seen.sum(), 1)))


def _multiply(model: Model, keys: np.ndarray, texts: int) -> np.ndarray:
    """Texts x languages: the sparse counts of keys (text * buckets + bucket) times the matrix."""
    keys, times = np.unique(keys, return_counts=True)
    text, bucket = np.divmod(keys, model.size)
    first = model.starts[bucket]
    width = model.starts[bucket + 1] - first
    cells = np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())
    into = np.repeat(text, width) * len(model.languages) + model.language[cells]
    sums = np.bincount(into, np.repeat(times, width) * model.above[cells].astype(np.float64), texts * len(model.languages))
    return sums.reshape(texts, -1)


def log_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages: log likelihood of the n-grams; and the number of n-grams of each text."""
    totals = np.zeros((len(texts), len(model.languages)))
    grams = np.zeros(len(texts), dtype=np.int64)
    waiting, held = [], 0
    for i, value in enumerate(texts):
        for part in buckets(value, model.size):
            waiting.append(part.astype(np.int64) + i * model.size)
            grams[i] += len(part)
            held += len(part)
            if held > PIECE:
                totals += _multiply(model, np.concatenate(waiting), len(texts))
                waiting, held = [], 0
    if waiting:
        totals += _multiply(model, np.concatenate(waiting), len(texts))
    return totals + grams[:, None] * model.unseen, grams


def predictions(model: Model, values: list[str | None]) -> list[tuple[str, float, float]]:
    """Language, posterior, and mean log-likelihood ratio per n-gram of that language against equally likely buckets."""
    out = [(UNKNOWN, 0.0, 0.0)] * len(values)
    known = [i for i, value in enumerate(values) if model.languages and has_letter(value)]
    for start in range(0, len(known), TEXTS):
        group = known[start : start + TEXTS]
        likelihood, grams = log_likelihoods(model, [values[i] for i in group])
        total = likelihood + model.priors
        best = total.argmax(axis=1)
        at = np.arange(len(group))
        share = 1 / np.exp(total - total[at, best][:, None]).sum(axis=1)
        ratio = likelihood[at, best] / grams + np.log(model.size)
        for i, b, p, r in zip(group, best, share, ratio):
            out[i] = (model.languages[b], float(p), float(r))
    return out


def scorer(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang_pred, score, ratio); score is the posterior probability of the predicted language, which is near 1 for all
    but short texts; ratio is a mean per n-gram (`predictions`), which is low where the text is like no language learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ratio double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predictions(shared.value, list(texts)), columns=["lang_pred", "score", "ratio"])

    return score(F.col(text))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for one fold; a null doc_id is in no fold and so may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, model).alias("found"))
    return scored.select("doc_id", "held_out", "found.lang_pred", "found.score")


def known_language(docs: DataFrame, model: Model, least: float = LEAST_RATIO) -> DataFrame:
    """Rows whose text is like a learned language: mean log-likelihood ratio per n-gram of at least `least`. `und`, letter junk
    and scripts that were never learned are rejected, however long. All columns stay."""
    found = scorer(docs, model)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["ratio"] >= least))
