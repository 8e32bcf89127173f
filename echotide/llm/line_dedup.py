"""Line deduplication: of a line that several documents hold, only the smallest doc_id keeps its copies.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned and sorted by document and position; a window
streams the first document of each run. A line that a third of all documents hold would fill one range, so runs end with a
salt of the document, and only the heads of the runs, at most SALTS rows per key, are merged. What comes back to the
documents is no text but a compressed bitmap per document: the 32-bit groups of dropped positions, empty groups left out.

Defined cases: a null or empty text is one empty line. Keys shorter than `shortest` code points stay everywhere. A null
doc_id counts as larger than every other, and rows without one as one document. Rows that share a doc_id are one document,
judged by their own lines. A line that repeats within its only document stays. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.llm.common import store

SALTS = 32
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\v\f\r"))
    ascii_only = F.octet_length(bare) == F.length(bare)  # then `lower`, which is faster, does the same
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _identified(docs: DataFrame) -> DataFrame:
    """id and text are those of the row; version tells texts of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.xxhash64(text).alias("version"), text.alias("text"))


def hashed_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """id, version, position, h1, h2 of every line whose key is long enough to be judged."""
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    keys = lines.where(F.length("line") >= shortest).select("id", "version", "position", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= shortest).select(
        "id", "version", "position", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))


def first_holders(lines: DataFrame) -> DataFrame:
    """(h1, h2, first) of the keys that at least two documents hold."""
    salted = lines.select("h1", "h2", "id", "position", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    run = Window.partitionBy("h1", "h2", "salt").orderBy("id", "position")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = salted.repartitionByRange("h1", "h2", "salt").select(
        "h1", "h2", F.row_number().over(run).alias("place"), "id", F.last("id").over(whole).alias("last"))
    heads = streamed.where("place = 1")
    return heads.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("last").alias("last")).where("first < last")


def drop_bitmaps(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """id, version, dropped (count), bitmap: an array of (group, bits), bit b of group g set for a dropped line 32 * g + b."""
    lines = store(hashed_lines(docs, shortest), "line_hashes")
    firsts = store(first_holders(lines).select("h1", "h2", "first"), "line_first")
    dropped = lines.join(firsts, ["h1", "h2"]).where("id > first")
    groups = dropped.repartition("id", "version").groupBy(
        "id", "version", F.floor(F.col("position") / 32).cast("int").alias("group")).agg(
        F.bit_or(_bit(F.col("position") % 32)).alias("bits"))
    return groups.groupBy("id", "version").agg(
        F.sum(F.bit_count("bits")).alias("dropped"), F.collect_list(F.struct("group", "bits")).alias("bitmap"))


def dedup_lines(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined by line feeds) of every row."""
    rows = _identified(docs)
    bitmaps = store(drop_bitmaps(rows, shortest), "line_bitmaps")
    # Rows that repeat are judged alike, so their bits agree and one bitmap serves all.
    joined = rows.join(bitmaps, ["id", "version"], "left")
    lines = F.split("text", "\n", -1)
    stays = F.transform(F.array(_dense(F.col("bitmap"))), lambda bits: F.filter(lines, lambda line, i: F.coalesce(
        F.get(bits, F.floor(i / 32).cast("int")).bitwiseAND(_bit(i % 32)), F.lit(0)) == 0))[0]
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0)).alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _dense(bitmap: Column) -> Column:
    """The bits of every group from 0 to the last one that is stored."""
    def fill(groups: Column) -> Column:
        def gap(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(groups, k - 1)["group"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0).cast("long"), x["group"] - before - 1), F.array(x["bits"]))
        return F.flatten(F.transform(groups, gap))

    return F.transform(F.array(F.sort_array(bitmap)), fill)[0]
