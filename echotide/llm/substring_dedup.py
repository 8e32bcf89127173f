"""Substring deduplication: words under a window of WINDOW words whose sequence starts earlier in the corpus are removed.

An index of the whole corpus for every document would compare everything with everything, so text is first routed:
1. Anchors. Each window picks the smallest hash among its GRAM-word grams, so equal windows pick equal grams. Anchors are counted
   over all documents, chunk by chunk and shard by shard; a window can repeat only if its anchor does.
2. Segments. Runs of windows with one repeated anchor go, as text, to the shard of the anchor. An anchor that comes more than HOT
   times would fill a shard: its windows go one by one to the shard of their own content instead, equal ones of a batch once.
3. Index. A shard sorts its distinct segments by place and builds an FM-index: suffixes sorted as deep as needed, their
   Burrows-Wheeler transform in a wavelet matrix of packed bits with popcount ranks, and per group of suffixes that agree in
   WINDOW words the earliest place. Segments stream through it by backward search, one step per word: the interval is cut
   back to the last WINDOW words as it grows. A window is reported when the earliest place of its interval is not its own.
4. The reported starts go back to their documents, which drop the words that they cover.

Defined cases: a null text has no words; texts shorter than a window stay. Documents are ordered by doc_id, null last; different
texts of one doc_id by a hash of the text; rows equal in both are one document. Other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store
from echotide.llm.near_dedup import WordHashes, mix

WINDOW, GRAM = 20, 6
PER_WINDOW = WINDOW - GRAM + 1
HOT = 10_000
ANCHOR_SHARD_BYTES = 200_000_000  # of text for one shard of the anchor count
SHARD_ANCHORS = 30_000  # about eight windows each
CHUNK_WORDS, CHUNK_DOCS = 1_000_000, 8192
LAST_ID = (1 << 63) - 1


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(ids: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    h = np.full(max(len(ids) - size + 1, 0), seed, dtype=np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(h)])
    return h


def window_anchors(gram_hashes: np.ndarray) -> np.ndarray:
    """For each window the position of its smallest gram, the leftmost of equal ones."""
    if len(gram_hashes) < PER_WINDOW:
        return np.empty(0, dtype=np.int64)
    return sliding_window_view(gram_hashes, PER_WINDOW).argmin(axis=1) + np.arange(len(gram_hashes) - PER_WINDOW + 1)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """id, version, positions (of anchors that repeat, packed), hot (which of them are hot, packed), n."""
    text_bytes = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(5, int(text_bytes // ANCHOR_SHARD_BYTES).bit_length())
    names = ["chunk", "shard", "keys", "counts", "ids", "versions", "sizes", "positions", "places"]
    schema = "chunk long, shard long, " + ", ".join(f"{name} binary" for name in names[2:])

    def batch_of(chunk, ids, versions, found):
        sizes = np.array([len(p) for p, _ in found])
        keys, places, counts = np.unique(np.concatenate([h for _, h in found]), return_inverse=True, return_counts=True)
        head = dict.fromkeys(names) | {
            "chunk": chunk, "shard": -1, "ids": _pack(np.array(ids), "<i8"), "versions": _pack(np.array(versions), "<i8"),
            "sizes": _pack(sizes, "<u4"), "positions": _pack(np.concatenate([np.diff(p, prepend=0) for p, _ in found]), "<u4"),
            "places": _pack(places, "<u4")}
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
        out = [head]
        for s, first, size in zip(*np.unique(shard, return_index=True, return_counts=True)):
            part = slice(first, first + size)
            out.append(dict.fromkeys(names) | {"chunk": chunk, "shard": int(s), "keys": keys[part].tobytes(),
                                               "counts": _pack(counts[part], "<u4")})
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, kinds)], names)

    def run(batches):
        hashes, made = WordHashes(), 0
        part = TaskContext.get().partitionId()
        ids, versions, found, held = [], [], [], 0
        for batch in batches:
            for i, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = grams(hashed(text.as_py().split(), hashes), GRAM)
                at = np.unique(window_anchors(h))
                if len(at):
                    ids.append(i)
                    versions.append(v)
                    found.append((at, h[at]))
                    held += len(h)
                if held >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield batch_of((part << 32) + made, ids, versions, found)
                    ids, versions, found, held, made = [], [], [], 0, made + 1
        if ids:
            yield batch_of((part << 32) + made, ids, versions, found)

    sent = store(rows.select("id", "version", "text").mapInArrow(run, schema), "anchor_chunks")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype="<u8") for k in group["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(c, "<u4") for c in group["counts"]])
        total = np.bincount(at, weights=counts)[at]
        flags = (total > 1).astype(np.uint8) + (total > HOT)
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"chunk": group["chunk"], "shard": group["shard"],
                             "flags": [_pack(f, "u1") for f in np.split(flags, ends[:-1])]})

    answers = sent.where("shard >= 0").select("chunk", "shard", "keys", "counts").groupBy("shard").applyInPandas(
        count, "chunk long, shard long, flags binary")

    def back(head: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        head = head.iloc[0]
        of_key = np.concatenate([_unpack(f, "u1") for f in answer.sort_values("shard")["flags"]])
        flags = of_key[_unpack(head["places"], "<u4")]
        ends = np.cumsum(_unpack(head["sizes"], "<u4"))[:-1]
        out = []
        for i, v, steps, f in zip(_unpack(head["ids"], "<i8"), _unpack(head["versions"], "<i8"),
                                  np.split(_unpack(head["positions"], "<u4"), ends), np.split(flags, ends)):
            if f.any():
                at = np.cumsum(steps)[f > 0]
                out.append((i, v, _pack(at, "<u4"), _pack(f[f > 0] > 1, "u1"), len(at)))
        return pd.DataFrame(out, columns=["id", "version", "positions", "hot", "n"])

    heads = sent.where("shard = -1").select("chunk", "ids", "versions", "sizes", "positions", "places")
    marked = heads.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        back, "id long, version long, positions binary, hot binary, n long")
    return store(marked.dropDuplicates(["id", "version"]), "anchor_marked")


def segments(rows: DataFrame, marked: DataFrame, shards: int) -> DataFrame:
    """shard, words, ids, versions, starts, sizes: the segments of a batch for a shard. Shard -1: windows known to repeat."""

    def blob(shard, parts):
        texts, ids, versions, starts, sizes = zip(*parts)
        return (shard, zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts)), _pack(np.array(ids), "<i8"),
                _pack(np.array(versions), "<i8"), _pack(np.array(starts), "<u4"), _pack(np.array(sizes), "<u2"))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out: dict[int, list] = {}
            hot: dict[int, list] = {}
            for i, v, text, positions, is_hot in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words = text.split()
                ids = hashed(words, hashes)
                h = grams(ids, GRAM)
                anchors = window_anchors(h)
                flag = np.zeros(len(h), dtype=np.uint8)
                flag[_unpack(positions, "<u4")] = 1 + _unpack(is_hot, "u1")
                kind = flag[anchors]
                route = (h[anchors] % np.uint64(shards)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(anchors, prepend=-1))
                for start, end in zip(cuts, np.append(cuts[1:], len(anchors))):
                    if kind[start] == 1:
                        out.setdefault(int(route[start]), []).append(
                            (b" ".join(words[start : end + WINDOW - 1]), i, v, int(start), int(end - start)))
                if (kind == 2).any():
                    content = grams(ids, WINDOW, seed=1)
                    for start in np.flatnonzero(kind == 2):
                        hot.setdefault(int(content[start]), []).append((i, v, int(start), words[start : start + WINDOW]))
            for key, found in hot.items():
                found.sort(key=lambda x: x[:3])
                first = found[0]
                out.setdefault(key % shards, []).append((b" ".join(first[3]), *first[:3], 1))
                for other in found[1:]:
                    if other[3] != first[3]:
                        out.setdefault(key % shards, []).append((b" ".join(other[3]), *other[:3], 1))
                    elif other[:3] != first[:3]:  # else rows that repeat: one window
                        out.setdefault(-1, []).append((b"", *other[:3], 1))
            made = [blob(s, p) for s, p in out.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in made], t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 5))],
                ["shard", "words", "ids", "versions", "starts", "sizes"])

    joined = rows.select("id", "version", "text").join(marked.select("id", "version", "positions", "hot"), ["id", "version"])
    return joined.mapInArrow(run, "shard long, words binary, ids binary, versions binary, starts binary, sizes binary")


class Wavelet:
    """A wavelet matrix: per bit of the symbols, from the highest, a packed bit row with counts before each machine word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        self.bits = bits
        for level in reversed(range(bits)):
            ones = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(ones) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            zeros = len(ones) - int(ones.sum())
            self.levels.append((level, packed, before, zeros))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))
        self.base = self.descend(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, before, zeros in self.levels:
            place = at >> 6
            ones = before[place] + np.bitwise_count(packed[place] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Backward search for patterns of up to `depth` symbols; `earliest` is the first allowed start among the matches."""

    def __init__(self, text: np.ndarray, allowed: np.ndarray, depth: int = WINDOW):
        n = len(text)
        ranks, kept, k = text, {1: text}, 1
        while k < depth:
            ranks = kept[2 * k] = self.pair(ranks, ranks, k)
            k *= 2
        # Suffixes that agree in `depth` symbols, as sums of powers of two.
        agree, length = None, 0
        for size in sorted(kept, reverse=True):
            if size <= depth - length:
                agree = kept[size] if agree is None else self.pair(agree, kept[size], length)
                length += size
        order = np.argsort(ranks, kind="stable")
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.wavelet = Wavelet(text[order - 1], max(1, int(text.max()).bit_length()))
        starts = np.flatnonzero(np.diff(agree[order], prepend=-1))
        group = np.cumsum(np.diff(agree[order], prepend=-1) != 0) - 1
        ends = np.append(starts[1:], n)
        self.low, self.high = starts[group], ends[group]
        self.earliest = np.minimum.reduceat(np.where(allowed[order], order, n), starts)[group]
        self.size = n

    @staticmethod
    def pair(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros_like(second)
        later[: len(second) - shift] = second[shift:] if shift < len(second) else 0
        return np.unique(first * (int(second.max()) + 1) + later, return_inverse=True)[1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left."""
        return self.counts[symbol] + self.wavelet.rank(symbol, low), self.counts[symbol] + self.wavelet.rank(symbol, high)


def repeated_windows(segment_words: list[list[bytes]], hashes: WordHashes) -> list[np.ndarray]:
    """For each segment, the offsets of its windows that start earlier in another one before it, or in itself."""
    if not segment_words:
        return []
    ids = hashed([w for words in segment_words for w in words], hashes)
    symbols = np.unique(ids, return_inverse=True)[1] + 1
    sizes = np.array([len(w) for w in segment_words])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[begins + sizes] = False  # separators
    text[inside] = symbols
    allowed = np.zeros(len(text), dtype=bool)
    windows = sizes - WINDOW + 1
    allowed[np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)] = True
    index = FMIndex(text, allowed)
    found = np.zeros(len(text), dtype=bool)
    rows = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), index.size, dtype=np.int64)
    for step in range(int(sizes.max())):
        rows = rows[: np.searchsorted(-sizes[rows], -step)]  # segments with a word left
        at = (begins + sizes)[rows] - 1 - step
        l, h = index.extend(text[at], low[: len(rows)], high[: len(rows)])
        if step >= WINDOW:
            l, h = index.low[l], index.high[l]
        low[: len(rows)], high[: len(rows)] = l, h
        if step >= WINDOW - 1:
            found[at] = (h > l) & (index.earliest[l] < at)
    return [np.flatnonzero(found[b : b + n]) for b, n in zip(begins, windows)]


def find_repeats(sent: DataFrame) -> DataFrame:
    """id, version, starts (packed): windows that start earlier, from the segments of each shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        places, texts = [], []
        for row in group.itertuples():
            texts += zstandard.ZstdDecompressor().decompress(row.words).split(b"\n")
            places += zip(_unpack(row.ids, "<i8").tolist(), _unpack(row.versions, "<i8").tolist(),
                          _unpack(row.starts, "<u4").tolist(), _unpack(row.sizes, "<u2").tolist())
        order = sorted(range(len(places)), key=places.__getitem__)
        first: dict[bytes, int] = {}
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for k in order:
            one = places[first.setdefault(texts[k], k)]
            if one[:3] != places[k][:3]:  # a later copy of a whole segment
                out.setdefault(places[k][:2], []).append(places[k][2] + np.arange(places[k][3]))
        chosen = list(first.values())
        for k, at in zip(chosen, repeated_windows([texts[k].split(b" ") for k in chosen], WordHashes())):
            if len(at):
                out.setdefault(places[k][:2], []).append(places[k][2] + at)
        return pd.DataFrame([(*key, _pack(np.concatenate(x), "<u4")) for key, x in out.items()],
                            columns=["id", "version", "starts"])

    def sure(batches):
        for batch in batches:
            out: dict[tuple[int, int], list[int]] = {}
            for k in range(batch.num_rows):
                ids, versions, starts = (_unpack(batch.column(c)[k].as_py(), t).tolist() for c, t in enumerate(("<i8", "<i8", "<u4")))
                for i, v, start in zip(ids, versions, starts):
                    out.setdefault((i, v), []).append(start)
            rows = [(*key, _pack(np.array(starts), "<u4")) for key, starts in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.binary()))], ["id", "version", "starts"])

    schema = "id long, version long, starts binary"
    indexed = sent.where("shard >= 0").groupBy("shard").applyInPandas(run, schema)
    return indexed.union(sent.where("shard = -1").select("ids", "versions", "starts").mapInArrow(sure, schema))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space) of every row."""
    rows = _rows(docs)
    marked = repeated_anchors(rows)
    anchors = marked.agg(F.sum("n")).first()[0] or 0
    sent = store(segments(rows, marked, max(1, -(-anchors // SHARD_ANCHORS))), "repeat_segments")
    starts = store(find_repeats(sent).groupBy("id", "version").agg(F.collect_list("starts").alias("starts")), "repeat_starts")

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                removed = 0
                if packed:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.concatenate([_unpack(p, "<u4") for p in packed])).astype(np.int64)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    removed = len(words) - int(stays.sum())
                    kept = [w for w, s in zip(words, stays) if s]
                else:
                    kept = words
                for column, value in zip(out, (len(words), removed, b" ".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "text"])

    joined = rows.join(starts, ["id", "version"], "left").select(F.col("doc_id").cast("long"), "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
