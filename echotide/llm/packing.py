"""Packing documents into sequences of at most CAPACITY tokens, by minimum bin slack.

A document's ids, and id 0 at its end, are cut into pieces of CAPACITY tokens, full sequences by themselves, and a tail. Tails are
dealt to shards of about SHARD tails by a hash, and packed per shard: the longest tail opens a window, and a subset-sum
dynamic program over the multiset of remaining lengths, one bitset per step, finds the lengths that fill the rest of the
window closest to capacity. It works on counts per length, so one backtracked solution is used as often as the counts allow.
Only the last window or two of a shard are left with padding. Full sequences are numbered in shards of their own, of about SHARD
too, and rows that repeat are dealt round the shards, so no shard grows with the length of documents or with repeats.

Defined cases: a null or empty text is the single id 0. Every row is packed, also rows that repeat or have no doc_id. Texts
of any length are tokenised whole. An empty table gives no pieces. Other columns take no part.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store

CAPACITY = 1024
SHARD = 4096
REMEMBERED = 200_000
END = 0


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The letter that stands for each byte: itself if it prints, else the next letter from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, those of the `tokenizers` file. Its merges are in the order of their ids, so `tiktoken` finds the same ones
    several times faster; texts that hold an added token, and texts where `tiktoken` gives up, go through `tokenizers`."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], [token["content"] for token in file["added_tokens"]]
    letters = _byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)
             and token not in added}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in added):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, repeat: each document cut every `capacity` ids. `repeat` counts the equal
    rows that a task has met before (it forgets them all after REMEMBERED different ones)."""

    def cut(batches):
        encode = encoder(path)
        met: dict[tuple, int] = {}
        for batch in batches:
            columns = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    crc = zlib.crc32(part.tobytes())
                    key = (doc_id, start, crc)
                    repeat = met.get(key, -1) + 1
                    if len(met) >= REMEMBERED and not repeat:
                        met.clear()
                    met[key] = repeat
                    for column, value in zip(columns, (doc_id, start, len(part), crc, len(ids), repeat)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "repeat"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, repeat long")


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` as far as possible: bitsets of reachable sums, the latest ones backtracked."""
    reachable, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left:
            times = min(times, left)
            steps.append((reachable, length, times))
            reachable |= (reachable << (length * times)) & ((2 << room) - 1)
            left -= times
            times *= 2
        if reachable >> room & 1:
            break
    at, used = reachable.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return used


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each length."""
    order = np.argsort(lengths, kind="stable")
    waiting = {int(n): list(map(int, part)) for n, part in zip(
        np.unique(lengths), np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1))} if len(lengths) else {}
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    at = 0
    while waiting:
        longest = max(waiting)
        counts = {n: len(rows) for n, rows in waiting.items()}
        counts[longest] -= 1
        fill = closest_fill({n: c for n, c in counts.items() if c}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        for _ in range(min(len(waiting[n]) // k for n, k in fill.items())):
            place = 0
            for n, k in fill.items():
                for _ in range(k):
                    row = waiting[n].pop()
                    window[row], offset[row] = at, place
                    place += n
            at += 1
        for n in fill:
            if not waiting[n]:
                del waiting[n]
    return window, offset


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = store(pieces(docs, path or vocabulary(), capacity), "pack_pieces")
    is_tail = F.col("length") < capacity
    tails, full = (max(1, round((n or 0) / SHARD)) for n in cut.agg(F.count_if(is_tail), F.count_if(~is_tail)).first())

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        tail = (group["length"] < capacity).to_numpy()
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        sequence[tail], offset[tail] = windows(group["length"].to_numpy()[tail], capacity)
        first = sequence.max() + 1 if tail.any() else 0
        sequence[~tail] = first + np.arange((~tail).sum())
        return group.assign(sequence_id=group["shard"] * (1 << 32) + sequence, offset=offset).drop(columns=["shard", "repeat"])

    def dealt_to(shards: int):
        hashed = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards).cast("long"))
        return F.pmod(hashed + F.col("repeat"), F.lit(shards).cast("long"))

    dealt = cut.withColumn("shard", F.when(is_tail, dealt_to(tails)).otherwise(dealt_to(full) + F.lit(tails)))
    return dealt.groupBy("shard").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
