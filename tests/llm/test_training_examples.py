"""Chat formatting, fill-in-middle and resampling against brute-force versions on hand-made rows: nulls, repeats, empty and
very long texts, hot keys, and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotide.llm import chat_format, fill_in_middle, resampling

CHATS = "conv_id long, turn long, role string, text string, Formatted string, start string, part string, position string"
DOCS = "doc_id long, text string, output string, Form string, n string, score string, rank string, place string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 chat formatting -------------------------------------------------------------------------------------------------

def chats():
    make = random.Random(1)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<\\/s>", "<\\\\s>", "\\", "\n", "<", "[", "ä", "word ", "<|im_end|>", "s>"]
    say = lambda: "".join(make.choices(parts, k=make.randrange(12)))
    rows = [(c, t, ["system", "user", "assistant"][(t > 0) + (t % 2 == 0 and t > 0)], say()) for c in range(30) for t in range(c % 9 + 1)]
    rows += [(99, t, ["user", "assistant"][t % 2], say()) for t in range(600)]  # a hot conversation
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "first"), (51, 1, "tool\nb\\n</s>", say()),
             (51, 2, "assistant", ""), (52, 0, "user", ""), (None, 1, "assistant", "no id"), (None, 0, "user", "nor here"),
             (53, 1, "assistant", "long " * 50_000), (54, 1, "assistant", "same"), (54, 1, "assistant", "same")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "s", "p", "q") for r in rows], CHATS)


def by_conversation(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_chats_are_read_back_whole(spark, tasks):
    rows = chats()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = chat_format.turns(frame(spark, rows).repartition(5))
        examples = chat_format.examples(stream)
        found = {r.conv_id: r for r in chat_format.read_back(stream, examples).collect()}
        written = chat_format.example_texts(stream, examples).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = by_conversation(rows)
    assert set(found) == set(wanted)
    for conv, said in wanted.items():
        replies = [text for role, text in said if role == "assistant"]
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{role}\n{text}\n" for role, text in said)))
        assert (r.loss_chars, r.loss_sha256) == (len("".join(replies)), sha("".join(replies)))
        own = sorted((w for w in written if w.conv_id == conv), key=lambda w: w.example)
        assert r.formatted_chars == sum(len(w.text) for w in own)
        assert len(own) == len(replies) + (said[-1][0] != "assistant")
        assert [chat_format.unescaped(w.text[w.loss_start:w.loss_end]) for w in own][:len(replies)] == replies
        for w in own:  # every turn up to the example's own, and nothing else
            turns = re.findall(r"<s>.*?</s>", w.text, re.S)
            assert [chat_format.parse_turn(t) for t in turns] == said[:w.example + 1] and "".join(turns) == w.text


def test_chats_escape_is_reversible(spark):
    make = random.Random(2)
    texts = ["".join(make.choices(["<", "[", "\\", "/", "s>", "SYS>>", "INST]", "|im_start|>", "a", "\n"], k=9)) for _ in range(4000)]
    pairs = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e")).collect()
    for r in pairs:
        assert chat_format.unescaped(r.e) == r.t
        assert not any(c in r.e for c in chat_format.CONTROLS)


def test_no_chats(spark):
    stream = chat_format.turns(frame(spark, []))
    assert chat_format.read_back(stream, chat_format.examples(stream)).count() == 0


# -- 12 fill-in-middle --------------------------------------------------------------------------------------------------

def documents():
    make = random.Random(3)
    say = lambda n: "".join(make.choices(["word", "Ünï", " ", ".", "\n", "Zz", "7", "ſ", "😀"], k=n))
    rows = [(i, say(i % 60)) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "no id at all"), (None, None), (302, "has <M> inside"), (303, "<P>"), (304, "a" * 100_000),
             (305, say(200_000)), (5, "twice"), (5, "twice"), (306, "end\n"), (307, "<\n>"), (308, "x<S")]
    return rows


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "o", "f", "n", "s", "r", "p") for r in rows], DOCS).repartition(3)


def fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rows = documents()
    df = fill_in_middle.transform(doc_frame(spark, rows))
    found = df.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert [tuple(r)[:6] for r in sorted(found, key=key)] == sorted((fim(*r) for r in rows), key=key)
    assert Counter(r.back for r in found) == Counter(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(doc_frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", "a", "aaaa bb", "a" * 50, "é" * 50, "ab1cd" * 20, " " * 9 + "b" * 30, "x " * 40])
def test_units_by_blocks(text):
    ends = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
    for block in (1, 2, 3, 7, 1000):
        assert fill_in_middle.unit_ends(text, block).tolist() == ends


# -- 13 resampling ------------------------------------------------------------------------------------------------------

def test_crc_matrices():
    make = random.Random(4)
    features = [make.randbytes(make.choice([0, 1, 2, 3, 3, 3, 9, 250, 256, 257, 3000])) for _ in range(500)]
    assert resampling.crcs(features).tolist() == [zlib.crc32(f) for f in features]
    assert resampling.crcs([]).tolist() == []


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def runs(words, least, most):
    return [" ".join(words[i:i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, least, most):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in runs(words_of(t), least, most))
    t = Counter(bucket(f) for x in target for f in runs(words_of(x), least, most))
    size, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
    rows, eligible = [], []
    for doc_id, text in docs:
        found = [gain(bucket(f)) for f in runs(words_of(text), least, most)]
        weight = sum(found) // len(found) if found else 0
        h = int(sha(f"2024:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score))
        if len(words_of(text)) >= 20:
            eligible.append(rows[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {}
    for place, row in enumerate(eligible[:len(eligible) * 10 // 100], 1):
        rank.setdefault(row, []).append(place)
    out = [(*row, rank[row].pop(0) if len(words_of(text)) >= 20 and rank.get(row) else None) for row, (_, text) in zip(rows, docs)]
    return sorted(out, key=repr)


def corpus():
    make = random.Random(5)
    words = [f"W{i}x" for i in range(80)] + ["Ä", "ß9", "日本", "İ"]
    rows = [(i, "-".join(make.choices(words, k=make.randrange(60))) + "!") for i in range(400)]
    rows += [(400, None), (401, ""), (402, "\x00 -- "), (None, "no id " * 30), (None, None), (403, "z" * 100_000), (404, "word " * 300_000),
             (7, "w1x " * 25), (7, "w1x " * 25), (405, "é" * 400 + " a b")]
    return rows, [" ".join(make.choices(words[:20], k=50)) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("least, most", [(1, 1), (1, 2), (2, 3)])
def test_resampling(spark, least, most):
    docs, target = corpus()
    target_df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    found = resampling.resample(doc_frame(spark, docs), target_df, least=least, most=most)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == resampled(docs, target, least, most)


def test_resampling_pieces_do_not_matter():
    docs, _ = corpus()
    texts = [t and t.encode() for _, t in docs if t is None or len(t) < 5000]
    for least, most in ((1, 1), (1, 3)):
        whole = [(p.tolist(), b.tolist()) for p, b in resampling.hashed(texts, least, most)]
        cut = [(p, b) for p, b in resampling.hashed(texts, least, most, size=50)]
        assert sorted(sum((b.tolist() for _, b in cut), [])) == sorted(sum((b for _, b in whole), []))
        assert sum(int(p[1].sum()) for p, _ in cut) == sum(sum(p[1]) for p, _ in whole)


@pytest.mark.parametrize("tasks", [1, 13])
def test_ranks_do_not_depend_on_tasks(spark, tasks):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(1).cast("long").alias("n_features"),
                                    (F.col("id") % 3).alias("weight"), (F.col("id") % 4).alias("score"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        found = [tuple(r) for r in resampling.ranked(rows).orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r[-1] for r in found] == list(range(1, 5001))
    assert [r[:-1] for r in found] == sorted((r[:-1] for r in found), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(doc_frame(spark, []), none).count() == 0
    found = resampling.resample(doc_frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in found) == [(1, 2, None), (2, 0, None)]
    assert np.array_equal(resampling.gains(none, none), np.zeros(resampling.BUCKETS))
