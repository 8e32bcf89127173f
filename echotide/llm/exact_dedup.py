"""Exact deduplication by content sort.

Sampled splitters range-partition the texts (Spark's range exchange), each range is sorted externally, and the window over
equal texts compares full neighbouring texts. The splitters, which the driver holds, are the first PREFIX characters and a
hash of the rest, so their size is bounded; texts that agree in both are still compared whole. A text held by very many
documents would fill one range, so the sort key ends with a salt of the row: its copies spread over up to SALTS neighbouring
runs, and what remains of each run, one small row, is merged by SHA-256. Text moves once, in that exchange.

`duplicates` salts every text. `one_of_each` passes the kept rows on with all their columns, in the same exchange; it salts
only texts that a bounded sample of hashes shows to be frequent, so that the runs that lose to another run of their text are
few: at most SAMPLE / FREQUENT texts of SALTS runs, which are broadcast. The sample decides on the spreading alone.

Defined cases: a null text counts as empty; empty texts are equal to each other. Of equal texts the largest doc_id stays;
a null doc_id is below every other; of rows with the same text and doc_id, exactly one stays. An empty table gives no rows.
Long texts are compared whole. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from echotide.llm.common import spare, store

SALTS = 64
PREFIX = 32
SAMPLE = 100_000
FREQUENT = 10


def _keys(text: Column) -> list[Column]:
    return [F.substring(text, 1, PREFIX).alias("prefix"), F.xxhash64(text).alias("hash")]


def content_sorted(docs: DataFrame, normalise=lambda text: text) -> DataFrame:
    """One row per document: doc_id, text_sha256, salt, and the size, order and largest doc_id of its sorted run."""
    rows = docs.select(
        "doc_id", normalise(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SALTS)).alias("salt"))
    rows = rows.select("*", *_keys(F.col("text")))
    ordered = Window.partitionBy("prefix", "hash", "salt", "text").orderBy(F.col("doc_id").desc_nulls_last())
    run = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = rows.repartitionByRange("prefix", "hash", "salt")
    return ranged.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), "salt",
        F.row_number().over(ordered).alias("place"),
        F.first("doc_id").over(run).alias("run_id"), F.count(F.lit(1)).over(run).alias("run_size"))


def duplicates(docs: DataFrame, normalise=lambda text: text) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    sorted_rows = store(content_sorted(docs, normalise), "exact_runs")
    heads = sorted_rows.where("place = 1")
    # Of runs that tie on the identifier (only null ones can), the one with the smallest salt has the row that stays.
    groups = store(heads.groupBy("text_sha256").agg(
        F.max("run_id").alias("keep_id"), F.sum("run_size").alias("group_size"),
        F.min(F.when(F.col("run_id").isNull(), F.col("salt"))).alias("null_salt")), "exact_groups")
    # Back by way of the heads, so that the copies of one text meet their group in as many places as they have salts.
    of_run = heads.select("text_sha256", "salt").join(groups, "text_sha256")
    joined = sorted_rows.join(of_run, ["text_sha256", "salt"])
    return joined.select("doc_id", "keep_id", "group_size", _stays().alias("kept"), "text_sha256")


def _stays() -> Column:
    numbered = F.col("doc_id") == F.col("keep_id")
    unnumbered = F.col("keep_id").isNull() & (F.col("salt") == F.col("null_salt"))
    return (F.col("place") == 1) & F.coalesce(numbered, unnumbered)


def frequent_hashes(docs: DataFrame) -> DataFrame:
    """Hashes of texts that occur FREQUENT times or more in a sample of about SAMPLE rows: at most SAMPLE / FREQUENT of them.
    Stored, so that all that salts by them reads the same ones."""
    hashes = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    seen = hashes.sample(share, seed=7).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return store(seen.select("hash"), "exact_frequent")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    key = spare(docs, "exact_key")[0]
    text = F.coalesce(F.col("text"), F.lit(""))
    frequent = frequent_hashes(docs).select(F.col("hash").alias("h"))
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, MapType) and f.name != "text"]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS))
    keyed = docs.withColumn(key, F.struct(*_keys(text)))
    hot = keyed.join(F.broadcast(frequent), F.col(f"{key}.hash") == F.col("h"), "left")
    salted = hot.withColumn(key, F.struct(f"{key}.*", F.when(F.col("h").isNotNull(), spread).otherwise(-1).alias("salt"))).drop("h")

    # Of a frequent text every run but the one with the largest doc_id loses; only small rows of frequent texts are shuffled here.
    runs = salted.where(F.col(f"{key}.salt") >= 0).select(
        F.sha2(text, 256).alias("sha"), F.col(f"{key}.salt").alias("salt"), "doc_id").groupBy("sha", "salt").agg(F.max("doc_id").alias("best"))
    order = Window.partitionBy("sha").orderBy(F.col("best").desc_nulls_last(), "salt")
    losers = runs.withColumn("place", F.row_number().over(order)).where("place > 1").select("sha", F.col("salt").alias("lost"))

    prefix, hashed, salt = (F.col(f"{key}.{c}") for c in ("prefix", "hash", "salt"))
    flat, names = salted, spare(salted, "exact_prefix", "exact_hash", "exact_salt", "exact_place")
    for name, column in zip(names, (prefix, hashed, salt)):
        flat = flat.withColumn(name, column)
    flat = flat.drop(key).repartitionByRange(*names[:3])
    ordered = Window.partitionBy(*names[:3], text).orderBy(F.col("doc_id").desc_nulls_last())
    heads = flat.withColumn(names[3], F.row_number().over(ordered)).where(F.col(names[3]) == 1)
    out = heads.join(F.broadcast(losers), (F.col(names[2]) == F.col("lost")) & (F.sha2(text, 256) == F.col("sha")), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
