"""Near-duplicate documents by SetSketch registers.

1. Sketch. A document becomes its set of hashed word shingles and M registers: each the truncated base-b logarithm of the
   smallest of exponentially distributed values that the shingles draw. Registers of a union are the maxima of the registers.
   Documents with equal sets form one class, so thousands of copies count once from here on.
2. Band. Bands of ROWS equal registers put classes into buckets; at a similarity of 0.8 some band agrees but for 2 in
   100,000 pairs, at 0.85 but for 1 in 10 million.
3. Stars, without emitting the pairs of a bucket. Each bucket has a centre, the member that shares the most buckets; members
   whose joint maximum-likelihood estimate with it is not more than SURE_NOT below the asked similarity hang on it. The others
   are compared by their registers with all members of the bucket, block against block. Families are the components of
   the pairs that pass.
4. Verify on full shingle sets. First every member with its centres, which leaves most families in one component. Then, in
   families that still hold several, the members outside the largest component with all members, block against block. A task
   holds at most about two blocks of BLOCK sets, skips pairs that are connected already, and returns connecting links only.

Defined cases: a document without words (null or empty text too) has an empty set, is linked with nothing and is its own
component. Rows that repeat a doc_id are one document: they share a component and are all kept. A null doc_id links
nothing: its component is null and the row is kept. Long texts are sketched whole; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store
from echotide.llm.components import Forest, components

BANDS, ROWS = 28, 5
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
SURE_NOT = 0.15  # below the asked similarity by so much: nearly five deviations of the estimate
BLOCK = 64
CACHE = 300_000  # words of which a task remembers the hash

_draw = np.random.default_rng(2024)
SEEDS = _draw.integers(0, 1 << 64, M, dtype=np.uint64)[:, None]
ODDS = _draw.integers(0, 1 << 64, M, dtype=np.uint64)[:, None] | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(ids) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return np.unique(h)


def registers(elements: np.ndarray) -> np.ndarray:
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(elements), 1024):
        least = np.minimum(least, ((elements[None, start : start + 1024] ^ SEEDS) * ODDS).min(axis=1))
    draws = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(draws) / np.log(BASE)), 0, TOP).astype("<u2")


def _likelihood(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Log-likelihood of similarity j for registers that are above, below or equal, given both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)

    up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
    equal = M - above - below
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from how often a register of one is above, below or equal to the other's."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    low, high = np.zeros(len(above)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(40):  # ternary search; the likelihood has one peak
        third = (high - low) / 3
        rises = _likelihood(above, below, n_a, n_b, low + third) < _likelihood(above, below, n_a, n_b, high - third)
        low, high = np.where(rises, low + third, low), np.where(rises, high, high - third)
    return (low + high) / 2


def not_below(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least so much: the likelihood, which has one peak, does not fall there."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    low, high = (_likelihood(above, below, n_a, n_b, least + x) for x in (-1e-4, 1e-4))
    return (high >= low) & (np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (distinct shingles), class (128 bits of the set), registers; null class for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in batches:
            found = ([], [], [])
            for text in batch.column(1):
                s = shingles(text.as_py(), size, hashes)
                found[0].append(len(s))
                found[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found[2].append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.binary(), pa.binary())))],
                ["doc_id", "n", "class", "registers"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, class binary, registers binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (v, centre) whose estimate does not rule them out."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, M) for k in (2, 3))
            n_a, n_b = (batch.column(k).to_numpy().astype(np.float64) for k in (4, 5))
            keep = pa.array(not_below(a, b, n_a, n_b, least))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["v", "centre"])

    side = lambda x: classes.select(
        F.col("v").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("v"), "v").join(side("centre"), "centre")
    return both.select("v", "centre", "r_v", "r_centre", "n_v", "n_centre").mapInArrow(run, "v long, centre long").distinct()


def stars(classes: DataFrame, least: float) -> DataFrame:
    """(v, centre): each member of a bucket with a centre it may be similar to."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, i * {2 * ROWS} + 1, {2 * ROWS})))")
    rows = classes.select("v", F.explode(keys).alias("key"))
    sizes = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near_sizes")
    members = store(rows.join(sizes, "key"), "near_members")
    scores = store(members.groupBy("v").agg(F.sum("size").alias("score")), "near_scores")
    centres = members.join(scores, "v").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "v")).alias("c"))
    centres = store(centres.select("key", F.col("c.v").alias("centre")), "near_centres")
    hung = store(members.join(centres, "key").where("v <> centre"), "near_hung")
    passed = store(_estimated(hung.select("v", "centre").distinct(), classes, least), "near_stars")
    # What hangs on no centre. In a bucket of two there is nothing else to compare with.
    rest = store(hung.where("size > 2").join(passed, ["v", "centre"], "left_anti").select("key", "v"), "near_rest")
    found = passed.union(_bucket_pairs(rest, members, classes, least))
    return store(found.distinct(), "near_stars")


def _bucket_pairs(rest: DataFrame, members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(v, centre): pairs of a member in `rest` and any member of its bucket that pass the estimate, without those that
    connect what earlier pairs of the same two blocks connect."""
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("few"))
    blocks = store(blocks, "near_open_buckets")
    place = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    all_blocks = members.withColumn("many", F.ceil(F.col("size") / BLOCK).cast("int")).join(blocks, "key")
    many = all_blocks.select("key", "few", "many").distinct()
    left = rest.join(many, "key").select(
        F.col("key").alias("g"), place("few").alias("i"), F.explode(F.expr("sequence(0, many - 1)")).alias("j"), "v", F.lit(0).alias("side"))
    right = all_blocks.select(
        F.col("key").alias("g"), F.explode(F.expr("sequence(0, few - 1)")).alias("i"), place("many").alias("j"), "v", F.lit(1).alias("side"))

    def run(group):
        v, n, side = group["v"].to_numpy(), group["n"].to_numpy().astype(float), group["side"].to_numpy()
        regs = np.frombuffer(b"".join(group["registers"]), dtype="<u2").reshape(-1, M)
        right_rows = np.flatnonzero(side == 1)
        joined, links = Forest(), []
        for k in np.flatnonzero(side == 0):
            at = right_rows[v[right_rows] != v[k]]
            for m in at[not_below(regs[k], regs[at], n[k], n[at], least)]:
                if joined.join(int(v[k]), int(v[m])):
                    links.append((v[k], v[m]))
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return type(group)({"v": a, "centre": b})

    rows = left.unionByName(right).join(classes.select("v", "n", "registers"), "v")
    return rows.groupBy("g", "i", "j").applyInPandas(run, "v long, centre long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """v, n, registers, s (the sorted set) of the classes whose smallest doc_id is among the nodes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(x.as_py(), size, hashes).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["v", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    sets = rows.join(nodes, "node", "left_semi").mapInArrow(run, "v long, s binary")
    return store(sets.join(classes.select("v", "n", "registers"), "v"), "near_sets")


def verified(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of each group (g, i, j) as all its similar pairs of side 0 with side 1 would.
    Rows: g, i, j, v, side, component; pairs within one component are not compared."""
    least = percent / 100 - SURE_NOT

    def run(group):
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            links = connecting(*(
                (x["v"].to_numpy(), x["component"].to_numpy(), x["n"].to_numpy().astype(float), np.frombuffer(
                    b"".join(x["registers"]), dtype="<u2").reshape(-1, M), [np.frombuffer(s, dtype=np.uint64) for s in x["s"]])
                for x in (left, right)))
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return type(group)({"a": a, "b": b})

    def connecting(one, other):
        (v0, c0, n0, r0, s0), (v1, c1, n1, r1, s1) = one, other
        likely = []
        for k in range(len(v0)):
            at = np.flatnonzero((c1 != c0[k]) & (100 * np.minimum(n0[k], n1) >= percent * np.maximum(n0[k], n1)))
            at = at[not_below(r0[k], r1[at], n0[k], n1[at], least)]
            likely += [(-int(equal), k, m) for equal, m in zip((r0[k] == r1[at]).sum(-1), at)]
        connected, links = Forest(), []
        for _, k, m in sorted(likely):  # the likeliest first, so that most of the others are connected when they come
            x, y = int(c0[k]), int(c1[m])
            if not connected.joined(x, y) and similar(s0[k], s1[m], percent):
                connected.join(x, y)
                links.append((min(v0[k], v1[m]), max(v0[k], v1[m])))
        return links

    rows = groups.join(sets, "v").select("g", "i", "j", "v", "side", "component", "n", "registers", "s")
    return rows.groupBy("g", "i", "j").applyInPandas(run, "a long, b long").where("a < b").distinct()


def _star_groups(found: DataFrame) -> DataFrame:
    """Every centre against blocks of its members."""
    counts = found.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    counts = store(counts.select("centre", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "near_hubs")
    own = F.lit(0).alias("j"), F.col("v").alias("component")
    members = found.join(counts, "centre").select(
        F.col("centre").alias("g"), F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("i"), "v", F.lit(1).alias("side"), *own)
    hubs = counts.select(F.col("centre").alias("g"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"),
                         F.col("centre").alias("v"), F.lit(0).alias("side")).select("*", *own)
    return members.unionByName(hubs)


def _open_groups(families: DataFrame, labels: DataFrame) -> DataFrame:
    """In families of several components: blocks of the members outside the largest one against blocks of all members."""
    placed = store(families.join(labels.select(F.col("node").alias("v"), F.col("component").alias("label")), "v", "left").select(
        "v", "family", F.coalesce("label", "v").alias("component")), "near_placed")
    sizes = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("family").agg(
        F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts"))
    whole = store(whole.where("parts > 1").select(
        "family", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("few"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("many")), "near_open")
    rows = placed.join(whole, "family")
    place = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    left = rows.where("component <> main").select(
        F.col("family").alias("g"), place("few").alias("i"), F.explode(F.expr("sequence(0, many - 1)")).alias("j"),
        "v", F.lit(0).alias("side"), "component")
    right = rows.select(
        F.col("family").alias("g"), F.explode(F.expr("sequence(0, few - 1)")).alias("i"), place("many").alias("j"),
        "v", F.lit(1).alias("side"), "component")
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents link at a similarity of `percent` or more."""
    sketches = store(sketch(docs, size), "near_sketches")
    sets = sketches.where("n > 0 and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("v"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = store(sets, "near_classes")

    found = stars(classes, percent / 100 - SURE_NOT)
    families = store(components(found.select(F.col("v").alias("a"), F.col("centre").alias("b"))), "near_families")
    families = families.select(F.col("node").alias("v"), F.col("component").alias("family"))
    sets = shingle_sets(docs, families.select(F.col("v").alias("node")), classes, size)
    links = store(verified(_star_groups(found), sets, percent).union(_same_id(sketches, classes)), "near_links")
    labels = store(components(links), "near_labels")
    more = store(verified(_open_groups(families, labels), sets, percent), "near_links")
    if not more.isEmpty():
        labels = store(components(links.union(more)), "near_labels")
    placed = store(classes.select("class", "v").join(labels, classes.v == labels.node, "left").select(
        "class", F.coalesce("component", "v").alias("component")), "near_components")
    return _result(sketches, placed)


def _same_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id; only ids that repeat with different texts have any."""
    rows = sketches.where("n > 0 and doc_id is not null").select("doc_id", "class")
    several = rows.groupBy("doc_id").agg(F.min("class").alias("one"), F.max("class").alias("last")).where("one <> last")
    several = store(several.select("doc_id", "one"), "near_same_id")
    pairs = rows.join(several, "doc_id").where("class <> one").select("class", "one").distinct()
    pairs = pairs.join(classes.select("class", F.col("v").alias("x")), "class").join(
        classes.select(F.col("class").alias("one"), F.col("v").alias("y")), "one")
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _result(sketches: DataFrame, placed: DataFrame) -> DataFrame:
    rows = sketches.select("doc_id", "n", "class").join(placed, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns."""
    dropped = near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    dropped = store(dropped.distinct(), "near_dropped")
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
