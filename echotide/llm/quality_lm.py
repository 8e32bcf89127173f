"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text, and perplexity per document.

Trusted text is every document labelled good and not toxic. Every word and every bigram of it is counted, without a cap: words
are 48-bit hashes (of 10^9 unknown words some 4 in a million are taken for one of 10^9 known ones), and a shard holds all
bigrams whose first word lies in its range of hashes. A word that trusted text lacks has the share of the lower order that is
spread evenly over the known words and one unknown word, over VOCABULARY words at least.

The log probability of a text is a sum over keys: one per word (lower order, and its weight as the context of the next word),
one per bigram (what it is above that), one each for the first and last place. The model is a sharded table of counts, of which
a shard makes the values of its keys, and the sum is a join with it; only totals, such as how many n-grams occur once, are
broadcast. Every word is the first of one pair (the last word pairs with END), so its own key needs no place of its own: tasks
send, by shard, the pairs of a chunk of documents that can add something. Words that trusted text lacks (for a trusted document:
that other folds lack) add nothing; a bitmap of FILTER_BITS places, which each shard fills its range of, finds most of them. It
has the same size whatever trusted text holds, and a word that shares its place with a known one is sent in vain. First words
are sorted and sent as steps, document numbers rise within a first word. Words go as their places in a book, the others as hashes:
the book has the BOOK commonest words of trusted text, every task has it, and it only says how a word is written, so no result
depends on it. What a pair takes does not depend on how many shards there are. A shard answers one partial sum per document.
Groups of the join are bounded: a shard by SHARD_WORDS, the chunks it meets by SALT_BYTES.

A document is rejected when its log perplexity, drawn towards the median of its language by PRIOR words, exceeds the quantile
LEVEL of its language. Median and quantile are those of trusted documents, each scored by a model without the trusted texts of
its own fold (FOLDS folds by a hash of the text, so copies share one), that is, as a document the model has not seen. Both are exact
over values rounded to thousandths, so they depend on no order of rows. A language without trusted documents takes the median
and quantile of all trusted documents.

Defined cases: a null or empty text, or one without words, has no perplexity and is rejected. A null language is a language
of its own. Every row is scored by itself, whatever its doc_id. Other columns take no part. Without trusted text every word is
unknown and no document stands out.
"""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store

VOCABULARY = 16_384  # words that the lowest order is spread over, at least; as many as trusted text has when it has more
SHARDS = 32  # at least; more when trusted text is long
SHARD_WORDS = 4_000_000
SALT_BYTES = 256 << 20
CHUNK_WORDS, CHUNK_DOCS = 3_000_000, 16_384
CACHE_WORDS = 500_000  # hashes that a task remembers
BROADCAST_IDS = 4_000_000  # up to so many trusted ids go to every task, beyond they are joined by a shuffle
FOLDS = 4
PRIOR = 20.0
LEVEL = 0.98
BEGIN, END = 0x1CE5_7A97_0F31, 0xD0C5_A1B7_93E9  # stand for the place before the first word and after the last
FILTER_BITS = 1 << 27  # a power of two
UNKNOWN = 0  # stands for a second word that adds nothing
BOOK = 1 << 20  # words that are sent by their place in a list that every task has
MANY_LANGUAGES = 100_000  # beyond, thresholds are not broadcast
WORD_BYTES = 6  # of a word's hash
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COUNTED = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("firsts", "runs", "list", "uses", "seconds", "counts")]])
SENT = [(c, pa.binary()) for c in ("firsts", "runs", "seconds", "others", "members", "columns")]


class Totals(NamedTuple):
    """What the model shares. Column f of FOLDS leaves the trusted texts of fold f out, the last one has them all."""

    discounts: np.ndarray  # columns x 3, by count 1, 2, 3 and more
    low: np.ndarray  # the same of the lower order
    types: np.ndarray  # bigrams, per column
    unknown: np.ndarray  # lower-order probability of an unknown word

    def lower(self, before: np.ndarray) -> np.ndarray:
        """Lower-order probabilities of words that come second in so many bigrams (columns x words)."""
        cut = np.take_along_axis(self.low, np.clip(before, 1, 3) - 1, axis=1)
        return np.where(before > 0, before - cut, 0.0) / self.types[:, None] + self.unknown[:, None]


class Known(NamedTuple):
    """What tasks that send pairs know of the words of trusted text; all compressed."""

    any: bytes  # bitmap of the words
    several: bytes  # bitmap of those in two folds at least
    book: bytes  # UNKNOWN, END and the commonest words, by use


class Book:
    """The words that are sent by their places: in order of use, and sorted."""

    def __init__(self, packed: bytes):
        self.by_use = _unpack(packed, "<u8")
        self.rank = np.argsort(self.by_use)
        self.words = self.by_use[self.rank]

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted words, whether the word is there) of each word."""
        at = np.searchsorted(self.words, words)
        return at, self.words.take(at, mode="clip") == words


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that every label calls good and none toxic."""
    return docs.join(_trusted_ids(labels)[0], F.col("doc_id") == F.col("trusted_id"), "left_semi")


def _trusted_ids(labels: DataFrame) -> tuple[DataFrame, bool]:
    """The identifiers as trusted_id, and whether they are few enough for a broadcast."""
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    ids = store(ids.where("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").alias("trusted_id")), "lm_trusted")
    few = ids.count() <= BROADCAST_IDS
    return F.broadcast(ids) if few else ids, few


def _settled(df: DataFrame, name: str) -> DataFrame:
    """The stored frame. The shuffle files that made it go at once, else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return store(df, name)
    finally:
        conf.set(CLEANUP, before)


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the values, so that the bytes that are alike lie together."""
    flat = np.ascontiguousarray(values).reshape(-1)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_numbers(values: np.ndarray) -> bytes:
    """Of whole numbers below 2^48: how many bits each has, compressed, then its bits below the highest."""
    sizes = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    coded = zstandard.ZstdCompressor(level=1).compress(sizes.tobytes())
    out = [len(coded).to_bytes(4, "little"), coded]
    for size in range(2, sizes.max(initial=0) + 1):
        bits = np.unpackbits(values[sizes == size].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(bits[:, 65 - size:]).tobytes())
    return b"".join(out)


def _unpack_numbers(data: bytes) -> np.ndarray:
    at = 4 + int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:at]), dtype=np.uint8)
    values = (sizes > 0).astype(np.int64)
    for size in range(2, sizes.max(initial=0) + 1):
        rows = np.flatnonzero(sizes == size)
        held = len(rows) * (size - 1)
        bits = np.zeros((len(rows), 64), dtype=np.uint8)
        bits[:, 64 - size] = 1
        part = np.frombuffer(data, dtype=np.uint8, count=-(-held // 8), offset=at)
        bits[:, 65 - size:] = np.unpackbits(part, count=held).reshape(-1, size - 1)
        values[rows] = np.packbits(bits, axis=1).view(">i8").reshape(-1)
        at += len(part)
    return values


def _pack_steps(values: np.ndarray) -> bytes:
    """Of unsigned values that rise."""
    return _pack_numbers(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_numbers(data)).astype(np.uint64)


def _pack_rising(values: np.ndarray, at: np.ndarray) -> bytes:
    """Of values that rise within runs, which start at these places."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    steps[at] = values[at]
    return _pack_numbers(steps)


def _unpack_rising(data: bytes, runs: np.ndarray) -> np.ndarray:
    steps = _unpack_numbers(data)
    total, at = np.cumsum(steps), np.cumsum(runs) - runs
    return total - np.repeat(total[at] - steps[at], runs)


def _pack_words(words: np.ndarray, book: Book) -> bytes:
    """Words that rise: those of the book by their places there, then the others."""
    at, inside = book.places(words)
    places = _pack_steps(at[inside].astype(np.uint64))
    return len(places).to_bytes(4, "little") + places + _pack_steps(words[~inside])


def _unpack_words(data: bytes, book: Book) -> np.ndarray:
    others = 4 + int.from_bytes(data[:4], "little")
    places = _unpack_steps(data[4:others]).astype(np.int64)
    return np.sort(np.concatenate((book.words[places], _unpack_steps(data[others:]))))


def _pack_sent(first: np.ndarray, second: np.ndarray, member: np.ndarray, book: Book) -> dict[str, bytes]:
    """Pairs in their order, which the first words rise in, and documents within a first word. A second word is 1 + its rank in
    the book, or 0 and stands among the others."""
    at = _starts(first)
    listed, of = np.unique(second, return_inverse=True)
    place, inside = book.places(listed)
    rank = np.where(inside, book.rank.take(place, mode="clip") + 1, 0)[of]
    return {"firsts": _pack_words(first[at], book), "runs": _pack_numbers(np.diff(at, append=len(first))),
            "seconds": _pack_numbers(rank), "others": _pack(second[rank == 0]), "members": _pack_rising(member, at)}


def _unpack_sent(row, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, how many pairs each has, second word of every pair, its document) of a row of _pack_sent."""
    runs, rank = _unpack_numbers(row.runs), _unpack_numbers(row.seconds)
    second = book.by_use[np.maximum(rank - 1, 0)]
    second[rank == 0] = _unpack(row.others, "<u8")
    return _unpack_words(row.firsts, book), runs, second, _unpack_rising(row.members, runs)


def _pack_counted(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """Distinct pairs and FOLDS counts of each. Second words are ranks by use in a list of their own, and rise within a first word.
    Counts up to 2 have two bits each, the others follow."""
    words, place, uses = np.unique(second, return_inverse=True, return_counts=True)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(words))
    rank = rank[place]
    order = np.lexsort((rank, first))
    first, rank, counts = first[order], rank[order], counts[:, order]
    at = _starts(first)
    low = np.minimum(counts, 3)
    bits = sum((low[f] << (2 * f) for f in range(FOLDS)), np.zeros(len(first), dtype=np.int64)).astype("<u4")
    bits, more = _pack(bits), _pack_numbers(counts[low == 3] - 3)
    return {"firsts": _pack_steps(first[at]), "runs": _pack_numbers(np.diff(at, append=len(first))), "list": _pack_steps(words),
            "uses": _pack_numbers(uses), "seconds": _pack_rising(rank, at), "counts": len(bits).to_bytes(4, "little") + bits + more}


def _unpack_counted(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, how many pairs each has, second word of every pair, its counts) of a row of _pack_counted."""
    runs, uses, more = _unpack_numbers(row.runs), _unpack_numbers(row.uses), 4 + int.from_bytes(row.counts[:4], "little")
    ranked = _unpack_steps(row.list)[np.argsort(-uses, kind="stable")]
    bits = _unpack(row.counts[4:more], "<u4").astype(np.int64)
    counts = np.stack([bits >> (2 * f) & 3 for f in range(FOLDS)])
    counts[counts == 3] += _unpack_numbers(row.counts[more:])
    return _unpack_steps(row.firsts), runs, ranked[_unpack_rising(row.seconds, runs)], counts


def mixed(keys: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of a bigram."""
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + mixed(second))


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that the words of one lie close together."""
    return ((words >> np.uint64(8 * WORD_BYTES - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Hashes(dict):
    """word -> hash, of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word, digest_size=WORD_BYTES).digest(), "little")
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _before(words: np.ndarray) -> np.ndarray:
    return np.concatenate((np.array([BEGIN], dtype=np.uint64), words[:-1]))


def _slices(place: np.ndarray):
    """(value, rows that have it, in order) of each value."""
    by = np.argsort(place, kind="stable")
    values, starts = np.unique(place[by], return_index=True)
    return zip(values.tolist(), np.split(by, starts[1:]))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key starts in rows sorted by the keys."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _columns(counts: np.ndarray) -> np.ndarray:
    """FOLDS x n counts -> columns of Totals x n."""
    total = counts.sum(axis=0)
    return np.concatenate((total - counts, total[None]))


def _summed(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    at = _starts(first, second)
    return first[at], second[at], np.add.reduceat(counts[:, order], at, axis=1) if len(at) else counts


def count_bigrams(docs: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its pairs, sorted by first word, and their counts by fold."""

    def rows(parts) -> pa.RecordBatch:
        first, second, fold = (np.concatenate(p) for p in zip(*parts))
        counts = np.zeros((FOLDS, len(first)), dtype=np.int64)
        counts[fold, np.arange(len(first))] = 1
        first, second, counts = _summed(first, second, counts)
        return pa.RecordBatch.from_pylist(
            [{"shard": s, **_pack_counted(first[at], second[at], counts[:, at])} for s, at in _slices(shard_of(first, shards))], COUNTED)

    def run(batches):
        hashes, parts, held = Hashes(), [], 0
        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                words = hashes.of(text.as_py())
                if len(words):
                    parts.append((_before(words), words, np.full(len(words), fold, dtype=np.int8)))
                    held += len(words)
                if held > CHUNK_WORDS:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    def merge(table):
        columns = [[], [], []]
        for row in table.to_pandas().itertuples():
            first, runs, second, counts = _unpack_counted(row)
            for column, value in zip(columns, (np.repeat(first, runs), second, counts)):
                column.append(value)
        first, second, counts = _summed(*(np.concatenate(c, axis=-1) for c in columns))
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), **_pack_counted(first, second, counts)}], COUNTED)

    schema = "shard int, firsts binary, runs binary, list binary, uses binary, seconds binary, counts binary"
    texts = docs.select(F.col("text").cast("binary").alias("text"), fold_of(docs).alias("fold"))
    return texts.mapInArrow(run, schema).groupBy("shard").applyInArrow(merge, schema)


def fold_of(docs: DataFrame):
    """The fold of a text: copies of it are in the same one."""
    return F.pmod(F.xxhash64(docs["text"].cast("binary")), F.lit(FOLDS)).cast("int")


def discounts(occurring: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from how many n-grams occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in occurring)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1.0, 2.0, 3.0])


def _occurring(counts: np.ndarray) -> list[list[int]]:
    """Per column: how many counts are 1, 2, 3, 4, are any, and their sum."""
    return [[int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c > 0).sum()), int(c.sum())] for c in counts]


def second_words(counted: DataFrame, shards: int) -> DataFrame:
    """In how many bigrams each word comes second, by column: for the shard of the word (source -1), and for every shard that has
    a bigram with it. Those know the words: they are their second words in the range of the source. `occurring` describes the bigrams (source -2) or the words (source -1) of a shard."""
    schema = pa.schema([("shard", pa.int32()), ("source", pa.int32()), ("words", pa.binary()), ("before", pa.binary()),
                        ("occurring", pa.list_(pa.list_(pa.int64())))])
    written = "shard int, source int, words binary, before binary, occurring array<array<bigint>>"

    def ask(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                shard, (_, _, second, counts) = row.shard, _unpack_counted(row)
                counts = _columns(counts)
                order = np.argsort(second, kind="stable")
                at = _starts(second[order])
                word, before = second[order][at], np.add.reduceat((counts[:, order] > 0).astype(np.int64), at, axis=1)
                out = [{"shard": to, "source": shard, "words": _pack_steps(word[a]), "before": _pack(before[:, a])}
                       for to, a in _slices(shard_of(word, shards))]
                out.append({"shard": shard, "source": -2, "occurring": _occurring(counts)})
                yield pa.RecordBatch.from_pylist(out, schema)

    def answer(table):
        rows = table.to_pylist()
        asked = [(r["source"], _unpack_steps(r["words"]), _unpack(r["before"], "<i8").reshape(FOLDS + 1, -1))
                 for r in rows if r["source"] >= 0]
        out = [r for r in rows if r["source"] == -2]
        if asked:
            word, before = (np.concatenate([a[k] for a in asked], axis=-1) for k in (1, 2))
            order = np.argsort(word, kind="stable")
            at = _starts(word[order])
            word, before = word[order][at], np.add.reduceat(before[:, order], at, axis=1)
            out.append({"shard": rows[0]["shard"], "source": -1, "words": _pack_steps(word), "before": _pack(before),
                        "occurring": _occurring(before)})
            out += [{"shard": source, "source": rows[0]["shard"],
                     "before": _pack(before[:, np.searchsorted(word, w)])} for source, w, _ in asked]
        return pa.Table.from_pylist(out, schema)

    return counted.mapInArrow(ask, written).groupBy("shard").applyInArrow(answer, written)


def totals(seconds: DataFrame) -> Totals:
    one = F.posexplode("occurring").alias("fold", "n")
    found = seconds.where("source < 0").select("source", one).groupBy("source", "fold").agg(
        *[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(6)]).collect()
    n = np.zeros((2, FOLDS + 1, 6))
    for row in found:
        n[row["source"] + 2, row["fold"]] = row[2:]
    high, low = (np.array([discounts(c[:4]) for c in part]) for part in n)
    words = n[1]
    cut = (low * np.stack((words[:, 0], words[:, 1], words[:, 4] - words[:, 0] - words[:, 1]), axis=1)).sum(axis=1)
    types = np.maximum(words[:, 5], 1)
    left = np.where(words[:, 5] > 0, cut / types, 1.0)
    return Totals(high, low, types, left / (np.maximum(words[:, 4], VOCABULARY) + 1))


def _places(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(8 * WORD_BYTES - FILTER_BITS.bit_length() + 1)


def known_words(seconds: DataFrame, shards: int) -> Known:
    """Each shard sends its range of the bitmaps, and its share of the book: words that come second in most bigrams."""
    schema = pa.schema([("start", pa.int64()), ("any", pa.binary()), ("several", pa.binary()), ("book", pa.binary()), ("uses", pa.binary())])

    def ranges(batches):
        for batch in batches:
            for word, before in zip(*(batch.column(k).to_pylist() for k in range(2))):
                word, before = _unpack_steps(word), _unpack(before, "<i8").reshape(FOLDS + 1, -1)
                place = _places(word).astype(np.int64)
                several = (before > 0).all(axis=0)
                start = int(place[0]) & ~7
                bits = np.zeros((2, int(place[-1]) - start + 1), dtype=bool)
                bits[0, place - start] = True
                bits[1, place[several] - start] = True
                packed = [_pack(np.packbits(b, bitorder="little")) for b in bits]
                common = np.sort(np.argsort(-before[FOLDS], kind="stable")[:BOOK // shards])
                yield pa.RecordBatch.from_pylist([{"start": start, "any": packed[0], "several": packed[1],
                                                   "book": _pack_steps(word[common]), "uses": _pack_numbers(before[FOLDS, common])}], schema)

    found, book, uses = np.zeros((2, FILTER_BITS // 8), dtype=np.uint8), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    sent = seconds.where("source = -1").select("words", "before").mapInArrow(
        ranges, "start long, any binary, several binary, book binary, uses binary")
    for row in sent.toLocalIterator():
        for bitmap, data in zip(found, row[1:3]):
            part = _unpack(data, "u1")
            bitmap[row["start"] // 8: row["start"] // 8 + len(part)] |= part
        book.append(_unpack_steps(row["book"]))
        uses.append(_unpack_numbers(row["uses"]))
    by_use = np.concatenate(book)[np.argsort(-np.concatenate(uses), kind="stable")]
    return Known(_pack(found[0]), _pack(found[1]), _pack(np.concatenate((np.array([UNKNOWN, END], dtype=np.uint64), by_use))))


def _known(bitmap: np.ndarray, words: np.ndarray) -> np.ndarray:
    place = _places(words).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def gains(rows: pd.DataFrame, learned: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard of the model: its sorted keys and, per column, what each adds to a log probability."""
    keys, out = [np.empty(0, np.uint64)], [np.empty((FOLDS + 1, 0), dtype="<f4")]
    first, log_weight = np.empty(0, np.uint64), np.empty((FOLDS + 1, 0))
    for row in rows[rows["firsts"].notna()].itertuples():
        first, runs, second, counts = _unpack_counted(row)
        asked = rows[rows["source"] >= 0].sort_values("source")
        before = np.concatenate([_unpack(b, "<i8").reshape(FOLDS + 1, -1) for b in asked["before"]], axis=1)
        where = np.searchsorted(np.unique(second), second)
        lower = learned.lower(before)
        at = np.cumsum(runs) - runs
        of = np.repeat(np.arange(len(at)), runs)
        counts = _columns(counts)
        log_weight, gain = np.zeros((FOLDS + 1, len(at))), np.zeros(counts.shape, dtype="<f4")
        for k, c in enumerate(counts):
            cut = np.where(c > 0, learned.discounts[k][np.clip(c, 1, 3) - 1], 0.0)
            total = np.add.reduceat(c, at)
            weight = np.where(total > 0, np.add.reduceat(cut, at) / np.maximum(total, 1), 1.0)
            log_weight[k] = np.log(weight)
            back = weight[of] * lower[k][where]
            gain[k] = np.where(c > 0, np.log(((c - cut) / np.maximum(total[of], 1) + back) / back), 0.0)
        keys.append(pair(first[of], second))
        out.append(gain)
        begin = np.flatnonzero(first == np.uint64(BEGIN))
        keys.append(first[begin])
        out.append(log_weight[:, begin])
    for row in rows[rows["source"] == -1].itertuples():
        word, before = _unpack_steps(row.words), _unpack(row.before, "<i8").reshape(FOLDS + 1, -1)
        weight = np.zeros(before.shape)
        shared, at, of = np.intersect1d(word, first, assume_unique=True, return_indices=True)
        weight[:, at] = log_weight[:, of]
        keys += [word, pair(shared, np.array([END], dtype=np.uint64))]
        out += [np.log(learned.lower(before) / learned.unknown[:, None]) + weight, -weight[:, at]]
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate([g.astype("<f4") for g in out], axis=1)[:, order]


def train(docs: DataFrame) -> tuple[DataFrame, Totals, int, Known]:
    """(counts by shard, totals, number of shards, known words), from trusted documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-size // (4 * SHARD_WORDS)))
    counted = _settled(count_bigrams(docs, shards), "lm_bigrams")
    seconds = _settled(second_words(counted, shards), "lm_words")
    asked = seconds.where("source >= -1").select("shard", "source", "words", "before")
    return counted.unionByName(asked, allowMissingColumns=True), totals(seconds), shards, known_words(seconds, shards)


def chunks(docs: DataFrame, shards: int, shared: Broadcast) -> DataFrame:
    """Per chunk a header (ids, languages, folds, words) and the pairs of its documents that can add something, by shard."""
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), *SENT, ("doc_ids", pa.list_(pa.int64())),
                        ("langs", pa.list_(pa.string())), ("folds", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))])

    def rows(bitmaps, book, chunk, ids, langs, folds, hashed):
        columns = np.array([FOLDS if f is None else f for f in folds], dtype=np.uint8)
        out = [{"chunk": chunk, "shard": chunk % shards, "doc_ids": ids, "langs": langs, "folds": folds,
                "words": [len(w) for w in hashed]}]
        texts = [(i, w) for i, w in enumerate(hashed) if len(w)]
        if texts:
            begin, end = (np.array([x], dtype=np.uint64) for x in (BEGIN, END))
            first = np.concatenate([w for _, text in texts for w in (begin, text)])
            second = np.concatenate([w for _, text in texts for w in (text, end)])
            member = np.repeat(np.array([i for i, _ in texts], dtype="<u2"), [len(w) + 1 for _, w in texts])
            own = columns[member] < FOLDS
            adds = [np.where(own, _known(bitmaps[1], w), _known(bitmaps[0], w)) for w in (first, second)]
            second[~adds[1] & (second != end)] = UNKNOWN
            kept = adds[0] | (first == begin)
            first, second, member = first[kept], second[kept], member[kept]
            for s, at in _slices(shard_of(first, shards).astype(np.int16 if shards < 32768 else np.int64)):
                at = at[np.argsort(first[at], kind="stable")]
                out.append({"chunk": chunk, "shard": s, **_pack_sent(first[at], second[at], member[at], book),
                            "columns": _pack(columns)})
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        known = shared.value
        bitmaps, book = [_unpack(data, "u1") for data in (known.any, known.several)], Book(known.book)
        hashes = Hashes()
        ids, langs, folds, hashed, held = [], [], [], [], 0
        for batch in batches:
            for doc_id, lang, text, fold in zip(*(batch.column(k) for k in range(4))):
                ids.append(doc_id.as_py())
                langs.append(lang.as_py())
                folds.append(fold.as_py())
                hashed.append(hashes.of(text.as_py()))
                held += len(hashed[-1])
                if held >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield rows(bitmaps, book, (part << 32) + made, ids, langs, folds, hashed)
                    ids, langs, folds, hashed, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield rows(bitmaps, book, (part << 32) + made, ids, langs, folds, hashed)

    fold = F.col("fold") if "fold" in docs.columns else F.lit(None).cast("int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("binary"), fold)
    return texts.mapInArrow(run, "chunk long, shard int, firsts binary, runs binary, seconds binary, others binary, "
                                 "members binary, columns binary, doc_ids array<long>, langs array<string>, folds array<int>, words array<long>")


def find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 where one is missing."""
    order = np.argsort(asked)
    at = np.empty(len(asked), dtype=np.int64)
    at[order] = np.minimum(np.searchsorted(keys, asked[order]), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def score(docs: DataFrame, model: DataFrame, learned: Totals, shards: int, known: Known) -> DataFrame:
    """doc_id, lang, fold, n_words, log_probability of every row. A row with a `fold` is scored without the texts of that fold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, -(-2 * size // (SALT_BYTES * shards)))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    sent = chunks(docs, shards, shared).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    held = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    heads = ["doc_ids", "langs", "folds", "words"]

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, values = gains(right, learned)
        book, out = Book(shared.value.book), []
        for row in left.itertuples(index=False):
            if row.firsts is None:
                out.append((row.chunk, None, row.doc_ids, row.langs, row.folds, row.words))
            elif len(keys):
                first, runs, second, members = _unpack_sent(row, book)
                column = _unpack(row.columns, "u1")[members]
                gain = np.repeat(find(keys, first), runs), find(keys, pair(np.repeat(first, runs), second))
                gain = sum(np.where(at >= 0, values[column, at], 0.0) for at in gain)
                out.append((row.chunk, _pack(np.bincount(members, weights=gain).astype("<f4")), None, None, None, None))
        return pd.DataFrame(out, columns=["chunk", "sums", *heads])

    answers = sent.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInPandas(
        answer, "chunk long, sums binary, doc_ids array<long>, langs array<string>, folds array<int>, words array<long>")
    unknown = np.log(learned.unknown)

    def total_of(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["sums"].isna()].iloc[0]
        folds = pd.array(head["folds"], dtype="Int32")
        words = np.asarray(head["words"], dtype=np.int64)
        logs = words * unknown[folds.fillna(FOLDS).to_numpy(dtype=np.int64)]
        for data in rows["sums"].dropna():
            sums = _unpack(data, "<f4")
            logs[: len(sums)] += sums
        return pd.DataFrame({"doc_id": pd.array(head["doc_ids"], dtype="Int64"), "lang": head["langs"], "fold": folds,
                             "n_words": words, "log_probability": logs})

    return answers.groupBy("chunk").applyInPandas(
        total_of, "doc_id long, lang string, fold int, n_words long, log_probability double")


def judge(scored: DataFrame) -> DataFrame:
    """Adds log_perplexity, threshold (of the language) and kept. Rows with a fold are trusted."""
    rows = _settled(scored.withColumn("language", F.coalesce("lang", F.lit(""))).withColumn(
        "own", F.when(F.col("n_words") > 0, -F.col("log_probability") / F.col("n_words"))), "lm_scored")
    drawn = _of_language(rows, "own", 0.5, "middle").withColumn("log_perplexity", (
        F.col("own") * F.col("n_words") + F.coalesce("middle", "own") * PRIOR) / (F.col("n_words") + PRIOR))
    judged = _of_language(drawn, "log_perplexity", LEVEL, "threshold")
    within = (F.col("log_perplexity") <= F.col("threshold")) | (F.col("threshold").isNull() & (F.col("n_words") > 0))
    return judged.select("doc_id", "lang", "n_words", "log_perplexity", "threshold", F.coalesce(within, F.lit(False)).alias("kept"))


def _of_language(rows: DataFrame, measure: str, level: float, name: str) -> DataFrame:
    """Adds the quantile of the trusted rows of a row's language, of all trusted rows if the language has none."""
    held = rows.where(F.col("fold").isNotNull() & F.col(measure).isNotNull())
    quantile = F.percentile(F.round(measure, 3), F.lit(level))
    of_language = store(held.groupBy("language").agg(quantile.alias("of_language")), "lm_languages")
    few = of_language.count() <= MANY_LANGUAGES
    joined = rows.join(F.broadcast(of_language) if few else of_language, "language", "left")
    return joined.withColumn(name, F.coalesce("of_language", F.lit(held.agg(quantile).first()[0]).cast("double"))).drop("of_language")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, threshold, kept of every row."""
    ids, few = _trusted_ids(labels)
    marked = docs.select("doc_id", "lang", "text").join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    marked = marked.withColumn("fold", F.when(F.col("trusted_id").isNotNull(), fold_of(marked))).drop("trusted_id")
    if not few:  # chunks go by the order of rows, which a task that is run again must find unchanged
        marked = store(marked, "lm_marked")
    return judge(score(marked, *train(marked.where("fold is not null"))))
