"""Mixing sources to target weights, in blocks of a fixed number of words.

1. Targets. Sources weigh as asked and share the size of the whole corpus; none gets more than LIMIT times its own size, the
   excess goes to the others by weight. That fixed point is found in closed form: sources sorted by size over weight, running
   sums, one comparison each.
2. Blocks. The words of a source, its documents laid end to end in the order of a hash, are cut every `block` words; a block
   covers parts of documents, the last one may be short. Places come from sums per bucket and then per source, so no source
   is summed in one task.
3. Draws. A source's target, rounded to whole words, is filled by slots of one block each; the last slot takes only the words
   that are missing, so every source, however small, gets its target to within half a word. All slots together are shuffled
   by a pseudorandom permutation of their numbers and dealt to output shards in order: the source counts of a shard are a
   multinomial draw without replacement. (Independent draws per shard would miss the targets by chance and could exceed
   LIMIT times a source's size.)
4. Join. The slots of a source come in rounds over its blocks: slot k of a round maps to block p(k), p a pseudorandom
   permutation per source of the whole blocks, with the short one last; slots join blocks by index. So a source asked for less
   than it has gives distinct blocks, one asked for more repeats all of them equally often.

Everything is integer arithmetic on column expressions: reruns agree, whatever the partitions.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order.
Rows that repeat a doc_id are told apart by their texts; rows equal in both share one place in the source and are taken alike.
A corpus without words has targets 0. Long texts span as many blocks as they need. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echotide.llm.common import SPACE, WORD, spare, store

LIMIT = 3
BLOCK = 128
SHARD = 4096  # slots of an output shard
BUCKETS = 1024
CHUNK = 1 << 14  # slots that one row of a task makes
CHUNKS = 8  # such rows of a task
MOST_TASKS = 20_000
#: Multipliers of the permutation: a prime that does not divide the length is used, and no length below 2^43 has all three.
PRIMES = (786433, 611953, 999983)
TURNS = 2


def permutation(length: Column, seed: Column) -> Column:
    """The constants of a pseudorandom permutation of 0 .. length - 1."""
    half = F.length(F.bin(length)) - 1
    prime = F.lit(1).cast("long")
    for p in reversed(PRIMES):
        prime = F.when(length % p != 0, F.lit(p).cast("long")).otherwise(prime)
    shifts = [F.pmod(F.xxhash64(seed, F.lit(turn)), length).alias(f"shift{turn}") for turn in range(TURNS + 1)]
    return F.struct(length.cast("long").alias("length"), prime.alias("prime"), F.floor((half + 1) / 2).cast("int").alias("half"),
                    F.call_function("shiftleft", F.lit(1).cast("long"), half).alias("low"), *shifts)


def permuted(x: Column, constants: Column) -> Column:
    """Multiplications modulo the length with, in between, for what lies below the largest power of two within it, a
    reversible shift and a multiplication by an odd number. Each step is one to one."""
    low = constants["low"]
    for turn in range(TURNS + 1):
        x = F.pmod(x * constants["prime"] + constants[f"shift{turn}"], constants["length"])
        if turn < TURNS:
            folded = x.bitwiseXOR(F.call_function("shiftright", x, constants["half"])) * 2207
            x = F.when(x < low, folded.bitwiseAND(low - 1)).otherwise(x)
    return x


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """source, source_size, target of every source. `weight` is an expression on `place`, the order of the sources from 0."""
    weight = F.col("place") % 3 + 1 if weight is None else weight
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source in these windows, never one per document.
    placed = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("weight", weight.cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - LIMIT * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    filled = placed.select("source", "source_size", "place", "weight", level.alias("level"))
    capped = F.col("level") * F.col("weight") >= LIMIT * F.col("source_size")
    common = F.max(F.when(~capped, F.col("level"))).over(everything)  # the level of the first source that is not capped
    return filled.select("source", "source_size", "place", F.when(capped, (LIMIT * F.col("source_size")).cast("double"))
                         .otherwise(common * F.col("weight")).alias("target"))


def placed_documents(rows: DataFrame) -> DataFrame:
    """Distinct documents with words, and `start`: the words of its source before it."""
    rows = rows.where("size > 0").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(BUCKETS)))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    begins = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                         F.coalesce(F.sum("n").over(across), F.lit(0)).alias("begin"))
    places = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = places.join(begins, places.source.eqNullSafe(begins.s) & (places.bucket == begins.b))
    return joined.select("doc_id", "version", "source", "size", (F.col("begin") + F.col("inside")).alias("start"))


def quotas(shares: DataFrame, block: int) -> DataFrame:
    """Adds wanted (words to take), blocks (of the source), slots (to take), the number of its first slot among all slots, and
    both permutations; `of_blocks` is that of the whole blocks."""
    blocks = F.ceil(F.col("source_size") / block)
    counted = shares.where("source_size > 0").withColumn("blocks", blocks).withColumn(
        "wanted", F.least(LIMIT * F.col("source_size"), F.round("target").cast("long")))
    rounds = F.floor(F.col("wanted") / F.col("source_size"))
    counted = counted.withColumn("slots", rounds * F.col("blocks") + F.ceil(F.col("wanted") % F.col("source_size") / block))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = counted.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    counted = counted.withColumn("all_slots", F.sum("slots").over(everything))
    return counted.withColumn("of_slots", permutation(F.greatest("all_slots", F.lit(1)), F.lit(7))).withColumn(
        "of_blocks", permutation(F.greatest(F.floor(F.col("source_size") / block), F.lit(1)), F.col("place")))


def slots(counted: DataFrame, block: int) -> DataFrame:
    """shard, slot, place (of the source), block_id, round (from 1), length (words from the front of the block): what the mix
    takes, in output order within a shard."""
    constants = ("place", "first_slot", "of_slots", "of_blocks", "blocks", "source_size", "wanted")
    chunks = counted.where("slots > 0").select(*constants, "slots", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    # The chunks are few and short but what they make is not: a given number of tasks is not merged by adaptive execution.
    rows = counted.agg(F.coalesce(F.sum(F.ceil(F.col("slots") / CHUNK)), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, max(1, -(-rows // CHUNKS)))
    each = chunks.repartition(tasks, "place", "chunk").select(*constants, F.explode(F.sequence(
        F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("t"))
    each = each.withColumn("k", F.col("t") % F.col("blocks")).withColumn("round", F.floor(F.col("t") / F.col("blocks")))
    before = F.col("k") * block  # words that the round has taken before this slot
    whole = before + block <= F.col("source_size")
    length = F.least(F.lit(block), F.col("source_size") - before, F.col("wanted") - F.col("round") * F.col("source_size") - before)
    each = each.select("place", permuted(F.col("first_slot") + F.col("t"), F.col("of_slots")).alias("at"),
                       F.when(whole, permuted(F.col("k"), F.col("of_blocks"))).otherwise(F.col("k")).alias("block_id"),
                       (F.col("round") + 1).alias("round"), length.alias("length"))
    return each.select(F.floor(F.col("at") / SHARD).alias("shard"), (F.col("at") % SHARD).alias("slot"), "place", "block_id",
                       "round", "length")


def spans(placed: DataFrame, counted: DataFrame, block: int) -> DataFrame:
    """doc_id, version, place, block_id, from_word, to_word, at (words of the block before it): the parts of documents that
    blocks cover."""
    sources = counted.select(F.col("source").alias("s"), "place")
    rows = placed.join(sources, placed.source.eqNullSafe(sources.s))
    rows = rows.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin = F.greatest(F.col("block_id") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block_id") + 1) * block - F.col("start"), F.col("size"))
    return rows.select("doc_id", "version", "place", "block_id", begin.alias("from_word"), end.alias("to_word"),
                       F.greatest(F.col("start") - F.col("block_id") * block, F.lit(0)).alias("at"))


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, draws). Rows: doc_id, version, size, place, source_size, target of every row. A draw is (shard, slot, place,
    block_id, round, doc_id, version, from_word, to_word): the output, slot by slot, as word ranges of documents."""
    rows = store(sized(docs), "mix_sizes")
    shares = store(targets(rows), "mix_targets")
    counted = store(quotas(shares, block), "mix_quotas")
    drawn = store(slots(counted, block), "mix_slots").join(spans(placed_documents(rows), counted, block), ["place", "block_id"])
    end = F.least(F.col("to_word"), F.col("from_word") + F.col("length") - F.col("at"))
    drawn = drawn.where("length > at").withColumn("to_word", end).drop("length", "at")
    shares = shares.withColumnRenamed("source", "s")
    return rows.join(shares, rows.source.eqNullSafe(shares.s)), drawn


def _same_document(drawn: DataFrame, rows: DataFrame) -> Column:
    return (rows.place == drawn.place) & (rows.version == drawn.version) & rows.doc_id.eqNullSafe(drawn.doc_id)


def taken_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words the mix takes, repeats counted) of every row."""
    rows, drawn = mix(docs, block)
    taken = drawn.groupBy("place", "doc_id", "version").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return rows.join(taken, _same_document(taken, rows), "left").select(
        rows.doc_id, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that the mix takes, `text` (and `n_chars`, where present) replaced by the words taken, with the white
    space before each: first the parts drawn at least once in document order, then those drawn again, each round on a new
    line. A document taken once and whole is as it was but for white space at its end."""
    rows, drawn = mix(docs, block)
    plan = drawn.groupBy("place", "doc_id", "version").agg(
        F.sort_array(F.collect_list(F.struct("round", "from_word", "to_word"))).alias("parts"))
    joined = rows.select("place", "version", "doc_id", "source").distinct()
    plan = joined.join(plan, _same_document(plan, joined)).select(
        F.struct(joined.doc_id, joined.version, joined.source).alias("mixed_key"), "parts")

    key, parts = spare(docs, "mix_key", "mix_parts")
    source = docs.withColumn(key, F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "source"))
    plan = plan.withColumnRenamed("mixed_key", key).withColumnRenamed("parts", parts)
    same = [source[key][c].eqNullSafe(plan[key][c]) for c in ("doc_id", "version", "source")]
    words = F.regexp_extract_all(F.col("text"), F.lit(f"{SPACE}*{WORD}"), F.lit(0))

    def compose(w: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            part = F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")), "")
            again = (i > 0) & (p["round"] > F.get(F.col(parts), i - 1)["round"])
            return F.concat(F.when(again, "\n").otherwise(""), part)
        return F.array_join(F.transform(F.col(parts), piece), "")

    out = source.join(plan, same).withColumn("text", F.transform(F.array(words), compose)[0])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
