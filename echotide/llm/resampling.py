"""Importance resampling towards a target distribution, with features hashed by length-bucketed CRC matrices.

Features are runs of words. The distinct ones of a piece of text are grouped by length into two-dimensional byte arrays, all
CRCs of a group advance column by column, and the buckets are scattered back to the places of the features. Features longer
than LONGEST bytes, which would be rows of their own, are hashed one by one with the same CRC.

Both corpora are counted into a fixed number of buckets; only those counts reach the driver and are broadcast as gains, so
their size does not depend on the data. The draw (the highest scores) is a distributed rank: range-partitioned by score, a
number within each task, and the rows of the tasks before it, one number a task.

Defined cases: a null text has no word; a document without features has weight 0. A null doc_id hashes like an empty one and
comes last among ties; further ties go to the smaller weight, then to fewer features, and rows equal in all of them are
interchangeable. Texts of any length are read in pieces cut between words. Empty tables count nothing and draw nothing. Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store

BUCKETS = 10_000
PIECE = 1 << 22  # bytes of text that are worked on at once
LONGEST = 256
SALTS = 64
_LETTERS = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower case of A-Z; every byte that is not part of a word becomes a blank.
FOLD = bytes(low if (low := b + 32 if 0x41 <= b <= 0x5A else b) in _LETTERS else 0x20 for b in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature."""
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    out = np.empty(len(features), dtype=np.uint32)
    for place in np.flatnonzero(lengths > LONGEST):
        out[place] = zlib.crc32(features[place])
    order = np.argsort(lengths, kind="stable")
    order = order[: int((lengths <= LONGEST).sum())]
    joined = np.frombuffer(b"".join([features[i] for i in order]), dtype=np.uint8)
    sizes, firsts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    at = 0
    for size, first, count in zip(sizes.tolist(), firsts.tolist(), counts.tolist()):
        columns = np.ascontiguousarray(joined[at : at + size * count].reshape(count, size).T)
        register = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
        for column in columns:
            register = CRC_TABLE[(register ^ column) & 0xFF] ^ (register >> 8)
        out[order[first : first + count]] = ~register
        at += size * count
    return out


def pieces(text: bytes | None, size: int = PIECE) -> Iterator[bytes]:
    """A folded text in pieces of about `size` bytes; words stay whole."""
    text = b"" if text is None else text.translate(FOLD)
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + size)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop]
        start = stop


def features(words: list[bytes], least: int, most: int, new: int) -> list[bytes]:
    """Runs of `least` to `most` words that end in one of the last `new` words."""
    found = []
    for n in range(least, most + 1):
        first = max(0, len(words) - new - n + 1)
        found += words[first:] if n == 1 else [b" ".join(words[i : i + n]) for i in range(first, len(words) - n + 1)]
    return found


def hashed(texts: list[bytes | None], least: int, most: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of about `size` bytes of text: (places of the texts, number of words of each, of features of each), buckets of all features."""
    places, n_words, n_features, waiting, held = [], [], [], [], 0

    def flush():
        codes, distinct = pd.factorize(np.fromiter(waiting, dtype=object, count=len(waiting)))
        of_distinct = crcs(list(distinct)) % np.uint32(BUCKETS)
        return np.array([places, n_words, n_features]), of_distinct[codes] if len(codes) else np.zeros(0, np.uint32)

    for place, text in enumerate(texts):
        kept: list[bytes] = []
        for part in pieces(text, size):
            new = part.split()
            words = kept + new
            found = features(words, least, most, len(new))
            kept = words[max(0, len(words) - most + 1):] if most > 1 else []
            places.append(place), n_words.append(len(new)), n_features.append(len(found))
            waiting += found
            held += len(part)
            if held >= size:
                yield flush()
                places, n_words, n_features, waiting, held = [], [], [], [], 0
    if places:
        yield flush()


def bucket_counts(texts: DataFrame, least: int = 1, most: int = 1) -> DataFrame:
    """(bucket, n) over all texts: tasks count in numpy, Spark sums."""

    def count(batches):
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, found in hashed(batch.column(0).to_pylist(), least, most):
                sums += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, least: int = 1, most: int = 1) -> np.ndarray:
    """Gain of each bucket, in thousandths. What reaches the driver are two counts a bucket."""
    both = bucket_counts(raw, least, most).select("bucket", "n", F.lit(0).alias("side")).unionByName(
        bucket_counts(target, least, most).select("bucket", "n", F.lit(1).alias("side")))
    counts = [[0] * BUCKETS, [0] * BUCKETS]
    for bucket, n, side in both.collect():  # at most 2 * BUCKETS rows
        counts[side][bucket] = n
    raw_size, target_size = (sum(side) + BUCKETS for side in counts)
    ratios = (float((t + 1) * raw_size) / float((s + 1) * target_size) for s, t in zip(*counts))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), dtype=np.int64)  # words, features, gains
            for (places, words, found), hashes in hashed(batch.column(1).to_pylist(), least, most):
                np.add.at(sums[0], places, words)
                np.add.at(sums[1], places, found)
                totals = np.concatenate([[0], np.cumsum(shared.value[hashes])])
                ends = np.cumsum(found)
                np.add.at(sums[2], places, totals[ends] - totals[ends - found])
            weight = sums[2] // np.maximum(sums[1], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = 2024) -> DataFrame:
    """Adds the score: weight and a Gumbel draw from the hash of the identifier, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(uniform))))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds `rank`, counted from 1, by falling score. Stored in the shared folder."""
    keys = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("salt"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    # In sorted tasks the identifier holds the task and the place in it.
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    placed = store(placed.drop("salt"), "resampling_ranks")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size")).collect()  # one row a task
    before, seen = [], 0
    for part, size in sorted(map(tuple, sizes)):
        before.append((part, seen))
        seen += size
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1,
             seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null unless the document is drawn."""
    gain = gains(docs, target, least, most)
    all_rows = store(scored(weigh(docs, gain, least, most), seed), "resampling_scores")
    eligible = F.col("n_words") >= least_words
    order = ranked(all_rows.where(eligible))
    drawn = F.floor(F.lit(percent) * all_rows.where(eligible).agg(F.count(F.lit(1)).alias("n")).scalar() / 100)
    columns = ("doc_id", "n_features", "weight", "score")
    return order.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        all_rows.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))
