"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed rule. A policy is a
version and a mask of the rules it enforces: verdicts of any policy and ablations (what one rule alone removes) are bitwise
operations on the stored ledger (`stored_ledger`), without another pass over the text. All measurements are column expressions over the whole text.

Defined cases: a null or empty text has no words and fails `few_words`; ratios of a text without words are 0. Every row is
judged by itself, whatever its doc_id. Other columns take no part. An empty table has an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from echotide.llm.common import SPACE, store, words

GRAM = 5
#: Words without a letter or digit.
BARE_SIGNS = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
#: Rules in the order of their bits: name, SQL condition of failure on the measurements.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("separators", "10 * n_separators > 3 * n_words"),
    ("shouting", "n_letters >= 50 and 10 * n_capitals > 7 * n_letters"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Versioned policies: the rules that a version enforces.
POLICIES = {1: BASE, 2: (1 << len(RULES)) - 1}


def _repeat_words(w: Column) -> Column:
    """Words in windows of GRAM words that the text holds at least twice, every such window counted, each word once."""
    last = F.greatest(F.size(w) - (GRAM - 1), F.lit(0))
    hashes = F.transform(F.arrays_zip(*[F.slice(w, i + 1, last) for i in range(GRAM)]), lambda x: F.xxhash64(x))
    distinct = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.transform(F.array(hashes), lambda h: F.when(distinct(h), 0).otherwise(_covered(h)))[0]


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash comes twice or more: windows sorted by hash, then the starts of equal neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def equal_neighbour(p: Column):
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(p, k + 1)["h"] == x["h"], F.lit(False))
        return F.filter(p, same)

    def union(starts: Column) -> Column:
        lengths = F.transform(starts, lambda at, k: F.least(F.lit(GRAM), F.coalesce(F.get(starts, k + 1) - at, F.lit(GRAM))))
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    twice = F.transform(F.array(placed), equal_neighbour)[0]
    return F.transform(F.array(F.sort_array(F.transform(twice, lambda x: x["i"]))), union)[0]


def measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    counted = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))[0]
    line_counts = F.transform(F.array(lines), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))[0]
    found = docs.select(
        "doc_id", counted.alias("w"), line_counts.alias("l"), (F.length(text) - count(SPACE)).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"), count(BARE_SIGNS).alias("n_separators"),
        count(r"\p{Lu}").alias("n_capitals"), count(r"\p{L}").alias("n_letters"))
    return found.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                        "l.n_lines", "n_separators", "n_capitals", "n_letters")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `failed`, the bits of the rules that the document fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(c), BITS[name]).otherwise(0) for name, c in RULES))
    return measure(docs).withColumn("failed", bits.cast("long"))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it and leave the text alone."""
    return store(ledger(docs), "quality_ledger")


def verdicts(book: DataFrame, version: int) -> DataFrame:
    """Adds `kept`: no rule that this version enforces has failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(book: DataFrame, version: int) -> DataFrame:
    """Per rule of a version: documents that fail it, and those that only it removes. Counts per bitmask come first,
    so at most 2^rules rows are shuffled."""
    mask = POLICIES[version]
    sums = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
                      for name, bit in BITS.items() if bit & mask])
    each = sums.select("failed", "n", F.explode(rules).alias("r"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"))
