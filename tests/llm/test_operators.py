"""Each operator against a brute-force version or SQL on whole small tables, and on hand-made rows with nulls, repeats,
empty and very long texts, and clashing extra columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from conftest import SMALL
from echotide.llm import (components, exact_dedup, langid, line_dedup, mixing, near_dedup, packing, quality_lm, quality_rules, queries,
                          secrets, substring_dedup)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text_SHA256 string, kept string, id string, place string"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.Random(5).choices(WORDS, k=30_000))
PASSAGE = " ".join(random.Random(6).choices(WORDS, k=60))


def odd_rows():
    """Nulls in every column, repeated rows, a doc_id with two texts, empty, letterless and very long texts."""
    make = random.Random(7)
    rows = [(i, " ".join(make.choices(WORDS, k=40)) + f"\nline of {i % 7}, the same\n" + " ".join(make.choices(WORDS, k=30)),
             "ab"[i % 2], "src%d" % (i % 3), 1) for i in range(40)]
    rows += [(100 + i, rows[3][1], "a", "src1", 1) for i in range(5)]
    rows += [(200 + i, rows[4][1].replace("w1 ", "x ", 1) + f" end{i}", "b", None, 1) for i in range(5)]
    rows += [(300, f"start {PASSAGE} stop", "a", "src0", 1), (301, f"{PASSAGE} other\n\n", None, "src0", None)]
    rows += [(None, None, None, None, None), (None, "a b c", "a", None, 3), (None, "a b c", "a", None, 3), (400, "", "a", "src2", 0),
             (401, None, "b", "src2", None), (402, "12 %% 34", "a", "src2", 8), (403, LONG, "b", "src1", 1), (404, LONG, "b", "src1", 1),
             (405, "twice", "a", "src1", 5), (405, "twice", "a", "src1", 5), (406, "one text", "a", "src0", 8),
             (406, "another text of it", "a", "src0", 8), (407, "Ä ß x", "b", "src0", 5), (408, "   \n\t ", "b", "src0", 6)]
    return [(*r, "sha", "k", "i", "p") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE[name]) is None


# -- 1 secrets ----------------------------------------------------------------------------------------------------------

def plain_spans(text):
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24)]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, flags, group, least) in enumerate(kinds)
             for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return [(name, start, end) for start, _, end, name in sorted(found)]


def test_secrets_base_spans(small):
    make = random.Random(1)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "Z9" * 9, "0af3" * 7, "ſecret", "\n"]
    made = ["".join(make.choices(parts, k=14)) for _ in range(3000)]
    for text in made + [t for _, t in texts(small)]:
        base = [(secrets.KINDS[s.kind], s.start, s.end) for s in secrets.scan_text(text) if s.kind < 3]
        assert base == plain_spans(text), text


@pytest.mark.parametrize("text, literals", [
    ('key = "aB3dE5fG7hI9"\ndb_pwd = key', ["aB3dE5fG7hI9"]),
    ('{"client_credential": "Zx9Qw8Er7Ty6"}', ["Zx9Qw8Er7Ty6"]),
    ("auth-key => 'Zx9Q' + 'w8Er7Ty6'", ["Zx9Q", "w8Er7Ty6"]),
    ('password: str = "Zx9!kQ2#mLp8"', ["Zx9!kQ2#mLp8"]), ('const dbPassword: string = "Zx9!kQ2#mLp8"', ["Zx9!kQ2#mLp8"]),
    ('var apiSecret string = "Zx9!kQ2#mLp8"', ["Zx9!kQ2#mLp8"]), (r'db_pwd = "Zx9!k\"Q2#mLp8"', [r'Zx9!k\"Q2#mLp8']),
    ('db_pwd = """Zx9!k\nQ2"mLp8"""', ['Zx9!k\nQ2"mLp8']), ("db_pwd = rb'Zx9!kQ2#mLp8'", ["Zx9!kQ2#mLp8"]),
    ('db_pwd = "Zx9 kQ2 mLp8"', ["Zx9 kQ2 mLp8"]), ("db_pwd = 'Enter your password please'", []),
    ("db_pwd = os.getenv('DB_PWD9')", []), ('tokenizer_name = "Bert-base-uncased9"', []), ("max_tokens: 4096AbcDef", []),
    ('my_pwd = "Zx9kQ2mLp8"\nif my_pwd == y:\n  z = my_pwd\nother_pwd = z', ["Zx9kQ2mLp8"]), ('if db_pwd == "Zx9kQ2mLp8":', []),
    ('a = "Zx9k"\nb = a + "Q2mLp8"\na = "other one"\ndb_pwd = b', ["Zx9k", "Q2mLp8"]),
    ('k = "Zx9kQ2mLp8"\n' + "k = k + k\n" * 1000 + "db_pwd = k", ["Zx9kQ2mLp8"]),
    ("db_pwd = changeme", []), ("db_pwd = aaaaaaaaaaaa", []), ("the note: something long and clean", []), ("colour = Zx9Qw8Er7Ty6", []),
])
def test_secrets_named_literals(text, literals):
    assert [text[s.start:s.end] for s in secrets.scan_text(text) if s.kind == 3] == literals


@pytest.mark.parametrize("text", [
    "password_" + "x" * 200 + ' = "Zx9Qw8Er7Ty6"', "db_pwd" + " " * 200 + '= "Zx9Qw8Er7Ty6"',
    "k" * 200 + ' = "Zx9Qw8Er7Ty6"\ndb_pwd = ' + "k" * 200,
])
def test_secrets_long_names(text):
    assert [text[s.start:s.end] for s in secrets.scan_text(text) if s.kind == 3] == ["Zx9Qw8Er7Ty6"]


def test_secrets_names_between_signs():
    make = random.Random(3)
    pattern = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*)["']?\s*(?:\])?\s*$""", re.A)
    for _ in range(5000):
        gap = "".join(make.choices("aZ_9.-\"'] \n[é\x1c", k=make.randint(0, 8)))
        found = pattern.search(gap)
        assert secrets.name_before(gap) == (found[1] if found else ""), gap


@pytest.mark.parametrize("text", [
    'k = "Zx9kQ2mLp8"\n' + "k = k + k\n" * 20_000 + "db_pwd = k\n", 'pwd = "Zx9kQ2mLp8"\n' + 'pwd = pwd + "Ab1"\n' * 20_000,
    'pwd = "' + "\\" * 200_000, 'pwd = """' + '"a\\"' * 100_000, "a: b " * 50_000, 'pwd = "' * 20_000, 'pwd = """' * 20_000,
], ids=range(7))
def test_secrets_take_time_in_proportion(text):
    start = time.process_time()
    secrets.scan_text(text)
    assert time.process_time() - start < 20


def test_secrets_odd_rows(odd, empty):
    assert secrets.scan(odd).count() == odd.count()
    assert secrets.scan(odd).where("doc_id in (400, 401) and size(spans) > 0").count() == 0
    assert secrets.scan(empty).count() == 0


# -- 2 lines ------------------------------------------------------------------------------------------------------------

def test_lines_odd_rows(odd, empty):
    blank = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, (t or "").split("\n")) for i, t in texts(odd)]
    rank = lambda i: line_dedup.LAST_ID if i is None else i
    key = lambda line: line.strip(blank).translate(lower)
    first = defaultdict(lambda: line_dedup.LAST_ID)
    for i, lines in rows:
        for line in lines:
            first[key(line)] = min(first[key(line)], rank(i))
    want = []
    for i, lines in rows:
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert collected(line_dedup.dedup_lines(odd)) == sorted(want, key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


# -- 3 near duplicates --------------------------------------------------------------------------------------------------

def near_brute(rows, size, percent):
    sets, up = {}, {}
    for k, (i, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[k] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        if rows[k][0] is None:
            continue
        common = Counter(j for x in s for j in index[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(k)] = root(j)
        for x in s:
            index[x].append(k)
    by_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            up[root(k)] = root(by_id.setdefault(i, k))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[root(k)], i is None or least[root(k)] == i)
                   for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(small, odd, size, percent):
    for docs in (small, odd):
        assert collected(near_dedup.near_duplicates(docs, size, percent)) == near_brute(texts(docs), size, percent)


def test_near_duplicates_of_a_family(spark):
    """An original, copies that are like it but not like each other, and a chain: block against block must find every link."""
    make = random.Random(3)
    origin = make.choices(WORDS, k=200)
    rows = [(900, " ".join(origin))]
    for i in range(150):
        copy = list(origin)
        for at in make.sample(range(200), make.choice([2, 3, 4, 5, 8])):
            copy[at] = f"new{make.random()}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_dedup.near_duplicates(docs, 3, 85)) == near_brute(texts(docs), 3, 85)


def test_near_estimate_is_close():
    draw = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.9):
        pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        a, b = pool[:2000], pool[2000 - n:4000 - n]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one, two = near_dedup.registers(a)[None], near_dedup.registers(b)[None]
        found = near_dedup.similarity(one, two, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - true) < 0.15
        union = near_dedup.registers(np.union1d(a, b))
        assert (union == np.maximum(one, two)[0]).all()


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    make = random.Random(8)
    edges = [(make.randint(0, 150), make.randint(0, 150)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert collected(found) == sorted(((x, c) for x, c in up.items() if x not in alone), key=repr)


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


# -- 4 quality model ----------------------------------------------------------------------------------------------------

def kneser_ney(trained, vocabulary):
    """Straight from the formulas, with dictionaries."""
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    pairs = Counter()
    words = set()
    for text in trained:
        w = text.split()
        words |= set(w)
        ids = [number.get(x, 0) for x in w]
        pairs.update(zip([quality_lm.BEGIN, *ids], ids))
    d = quality_lm.discounts(np.array([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))
    before = Counter(w for _, w in pairs)
    low = quality_lm.discounts(np.array([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)]))
    total, left = Counter(), Counter()
    for (v, _), c in pairs.items():
        total[v] += c
        left[v] += d[min(c, 3) - 1]
    spare = sum(low[min(c, 3) - 1] for c in before.values()) / len(pairs)

    def p1(w):
        return (max(before[w] - low[min(before[w], 3) - 1], 0) if before[w] else 0) / len(pairs) + spare / (quality_lm.VOCABULARY + 1)

    def log(text):
        out, v = 0.0, quality_lm.BEGIN
        for x in text.split():
            w = number.get(x, 0)
            p = p1(w)
            if total[v]:
                c = pairs[v, w]
                p = (c - d[min(c, 3) - 1] if c else 0) / total[v] + left[v] / total[v] * p
            out += np.log(p) - (np.log(max(len(words) - len(vocabulary), 1)) if w == 0 else 0)
            v = w
        return out

    return log


def test_quality_model_matches_the_formulas(spark, small, monkeypatch):
    monkeypatch.setattr(quality_lm, "CHUNK_DOCS", 17)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = [t.encode() for _, t in texts(quality_lm.trusted(small, labels))]
    counts = Counter(w for t in good for w in t.split())
    vocabulary = sorted(counts, key=lambda w: (-counts[w], w))[:quality_lm.VOCABULARY]
    log = kneser_ney(good, vocabulary)
    found = quality_lm.score(small, *quality_lm.train(quality_lm.trusted(small, labels))).collect()
    text_of = dict(texts(small))
    assert len(found) == small.count()
    for row in found:
        text = text_of[row.doc_id].encode()
        assert row.n_words == len(text.split())
        assert row.log_probability == pytest.approx(log(text), rel=1e-4, abs=1e-3)


def test_quality_model_has_every_trusted_word(spark, monkeypatch):
    make = random.Random(8)
    rows = [(k, " ".join(f"w{i}" for i in make.choices(range(k * 2000, k * 2000 + 2000), k=6000)), "a") for k in range(12)]
    rows.append((12, " ".join(f"rare{i} w{i}" for i in range(3000)), "a"))
    docs = spark.createDataFrame([*rows, (13, "rare7 w7 rare9 unseen w9 rare2", "b")], "doc_id long, text string, lang string")
    found = quality_lm.score(docs, *quality_lm.train(docs.where("doc_id < 13"))).collect()
    words = sorted({w for _, t, _ in rows for w in t.encode().split()})
    assert len(words) > quality_lm.VOCABULARY
    monkeypatch.setattr(quality_lm, "VOCABULARY", len(words))
    log = kneser_ney([t.encode() for _, t, _ in rows], words)
    text_of = {r.doc_id: r.text.encode() for r in docs.collect()}
    for row in found:
        assert row.log_probability == pytest.approx(log(text_of[row.doc_id]), rel=1e-4, abs=1e-3)


def test_quality_verdicts(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_lm.classify(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(not r.kept for r in found if r.n_words == 0) and any(r.kept for r in found)
    assert quality_lm.classify(empty, labels).count() == 0


def test_quality_folds_leave_their_own_texts_out(spark, small, monkeypatch):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = quality_lm.trusted(small, labels)
    good = good.withColumn("fold", quality_lm.fold_of(good)).cache()
    found = quality_lm.score(good, *quality_lm.train(good)).collect()
    rows = {r.doc_id: (r.fold, r.text.encode()) for r in good.collect()}
    logs = []
    for fold in range(quality_lm.FOLDS):
        others = [t for f, t in rows.values() if f != fold]
        logs.append(kneser_ney(others, sorted({w for t in others for w in t.split()})))
    assert len(found) == len(rows) and {r.fold for r in found} == set(range(quality_lm.FOLDS))
    for row in found:
        fold, text = rows[row.doc_id]
        assert row.fold == fold
        assert row.log_probability == pytest.approx(logs[fold](text), rel=1e-4, abs=1e-3)


def test_quality_book_saves_bytes_and_changes_no_result(spark, small, monkeypatch):
    good = quality_lm.trusted(small, spark.read.parquet(f"{SMALL}/labels.parquet"))
    sent, scores = {}, {}
    for book in (0, 3200, quality_lm.BOOK):
        monkeypatch.setattr(quality_lm, "BOOK", book)
        model = quality_lm.train(good)
        parts = quality_lm.chunks(small.coalesce(1), model[2], spark.sparkContext.broadcast(model[3]))
        sent[book] = parts.agg(F.sum(sum(F.octet_length(c) for c in ("firsts", "runs", "seconds", "others")))).first()[0]
        scores[book] = {r.doc_id: r.log_probability for r in quality_lm.score(small, *model).collect()}
    none, some, most = sent
    assert scores[some] == pytest.approx(scores[none], rel=1e-6) and scores[most] == pytest.approx(scores[none], rel=1e-6)
    assert sent[most] < sent[some] < sent[none] and sent[most] < 0.7 * sent[none]


def test_quality_coding_is_exact_and_as_short_in_many_shards(small):
    of = quality_lm.Hashes()
    hashed = [w for w in (of.of((t or "").encode()) for _, t in texts(small)) if len(w)]
    second = np.concatenate(hashed)
    first = np.concatenate([quality_lm._before(w) for w in hashed])
    member = np.repeat(np.arange(len(hashed)), [len(w) for w in hashed])
    words, uses = np.unique(second, return_counts=True)
    known = words[np.argsort(-uses, kind="stable")][:len(words) // 2]
    book = quality_lm.Book(quality_lm._pack(np.concatenate((np.array([quality_lm.UNKNOWN, quality_lm.END], dtype="u8"), known))))
    size = {}
    for shards in (4, 64):
        size[shards] = 0
        for _, at in quality_lm._slices(quality_lm.shard_of(first, shards)):
            at = at[np.argsort(first[at], kind="stable")]
            packed = quality_lm._pack_sent(first[at], second[at], member[at], book)
            size[shards] += sum(map(len, packed.values()))
            firsts, runs, *found = quality_lm._unpack_sent(SimpleNamespace(**packed), book)
            for have, want in zip((np.repeat(firsts, runs), *found), (first, second, member)):
                assert np.array_equal(have, want[at])
    assert size[64] < 1.1 * size[4]
    counts = np.random.default_rng(3).integers(0, 9, (quality_lm.FOLDS, len(first)))
    summed = quality_lm._summed(first, second, counts)
    firsts, runs, *found = quality_lm._unpack_counted(SimpleNamespace(**quality_lm._pack_counted(*summed)))
    for have, want in zip(quality_lm._summed(np.repeat(firsts, runs), *found), summed):
        assert np.array_equal(have, want)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality_rejects_bad_labels_at_every_size(spark, size):
    folder = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_lm.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("n_words > 0")
    rejected = {r.quality: r.share for r in found.join(labels, "doc_id").groupBy("quality").agg(
        F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    assert rejected[0] > 0.8 and rejected[1] < 0.06


# -- 5 packing ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("which", ["small", "odd"])
def test_packing_round_trip(request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, text in texts(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 1024):
            part = ids[start:start + 1024]
            want[i, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    rows = packing.pack(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [p for p, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert len(places) <= sum(n for _, n in sum(places.values(), [])) / 1024 * 1.02 + 1


def test_packing_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    values = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "word " * 2000 + "<|endoftext|>" + " word" * 50]
    want = set()
    for i, text in enumerate(values):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want |= {(i, at, zlib.crc32(np.array(ids[at:at + 1024], dtype="<u4").tobytes()), len(ids)) for at in range(0, len(ids), 1024)}
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    assert {(r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in packing.pack(docs).collect()} == want
    assert list(packing.encoder(packing.vocabulary())(values[0])) == [64, 220, 50256, 275]


def test_packing_finds_the_closest_fill():
    make = random.Random(2)
    for _ in range(200):
        lengths = [make.randint(1, 30) for _ in range(8)]
        room = make.randint(1, 60)
        fill = packing.closest_fill(Counter(lengths), room)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= room)
        assert not Counter(fill) - Counter(lengths)


@pytest.mark.parametrize("rows", [[(1, "word " * 40_000), (2, " other" * 40_000)], [(None, "a b c d e f")] * 5000])
def test_packing_shards_are_bounded(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "SHARD", 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = packing.pack(docs, capacity=16).collect()
    shards = Counter(r.sequence_id >> 32 for r in found)
    assert len(found) >= 5000 and max(shards.values()) < 500
    used = Counter()
    for r in found:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 16


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


# -- 6 substrings -------------------------------------------------------------------------------------------------------

def substring_brute(rows):
    last = substring_dedup.LAST_ID
    order = sorted({(last if i is None else i, version, text or "") for i, version, text in rows})
    seen, kept = set(), {}
    for i, version, text in order:
        w = text.encode().split()
        covered = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k:k + 20])
            if x in seen:
                covered[k:k + 20] = [True] * 20
            seen.add(x)
        kept[i, version] = (len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode())
    return sorted(((i, *kept[last if i is None else i, v]) for i, v, _ in rows), key=repr)


@pytest.mark.parametrize("hot", [10_000, 3])
@pytest.mark.parametrize("which", ["small", "odd"])
def test_substrings(request, monkeypatch, which, hot):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = [tuple(r) for r in docs.select("doc_id", version, "text").collect()]
    assert collected(substring_dedup.remove_repeats(docs)) == substring_brute(rows)


def test_substrings_index_against_search():
    make = random.Random(4)
    segments = [[b"%d" % make.randint(0, 2) for _ in range(make.randint(20, 60))] for _ in range(60)]
    found = substring_dedup.repeated_windows(segments, near_dedup.WordHashes())
    seen = set()
    for words, at in zip(segments, found):
        want = []
        for k in range(len(words) - 19):
            x = tuple(words[k:k + 20])
            if x in seen:
                want.append(k)
            seen.add(x)
        assert at.tolist() == want


def test_substrings_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# -- 7 language ---------------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    found = queries.op7_language_id(spark, path).join(truth, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 100
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_fold(spark, odd):
    rows = odd.select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_odd_rows(odd, empty):
    model = langid.train(odd)
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (400, 401, 402, 408))
    assert langid.identify(odd, model).count() == odd.count()
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}
    assert langid.train(empty).languages == []
    kept = langid.known_language(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def bayes(trained, texts, size):
    """Dense naive Bayes, gram by gram: language and log scores of each text."""
    counts, seen = {}, Counter(lang for _, lang in trained)
    for text, lang in trained:
        counts.setdefault(lang, Counter()).update(b for part in langid.buckets(text, size) for b in part.tolist())
    names = sorted(counts)
    for text in texts:
        grams = [b for part in langid.buckets(text, size) for b in part.tolist()]
        yield {x: math.log(seen[x] / len(trained)) + sum(
            math.log((counts[x][b] + langid.ALPHA) / (counts[x].total() + langid.ALPHA * size)) for b in grams) for x in names}


@pytest.mark.parametrize("piece, batch, languages", [(1 << 18, 64, 64), (50, 3, 1)])
def test_language_matches_the_formula(spark, small, monkeypatch, piece, batch, languages):
    rows = [r for r in small.select("text", "lang").where("text is not null and lang is not null").collect()][:40]
    trained = [(r.text[:300], r.lang if i % 3 else f"dirty {i}") for i, r in enumerate(rows)]
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    model = langid.train(spark.createDataFrame(trained, "text string, lang string"), size=4096)
    asked = [r.text[:200] for r in rows if langid.has_letter(r.text[:200])]
    whole = langid.predictions(model, asked)
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "TEXTS", batch)
    assert langid.predictions(model, asked) == whole
    for (name, score, ratio), want in zip(whole, bayes(trained, asked, 4096)):
        best = max(want.values())
        assert want[name] == pytest.approx(best, abs=1e-2)
        assert score == pytest.approx(1 / sum(math.exp(v - want[name]) for v in want.values()), abs=1e-2)


def test_language_bound_is_checked(spark, small, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_CELLS", 100)
    with pytest.raises(ValueError, match="size"):
        langid.train(small)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_language_rejects_what_is_like_none(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    make, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(make.choices(letters, k=2000)), " ".join("".join(make.choices(letters, k=6)) for _ in range(500)),
            "今日は天気がいいですね。" * 200, "это русский текст о погоде " * 100]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    model = langid.train(docs.where(~langid.held_out()))
    kept = langid.known_language(docs.select("doc_id", "text").unionByName(extra), model)
    assert {i for i, _ in texts(kept)} == {i for i, t in texts(docs) if langid.has_letter(t)}


def test_language_pieces_hold_each_gram_once(monkeypatch):
    text = "abcdefghij" * 30
    whole = Counter(np.concatenate(list(langid.buckets(text))).tolist())
    monkeypatch.setattr(langid, "PIECE", 37)
    assert Counter(np.concatenate(list(langid.buckets(text))).tolist()) == whole


# -- 8 rules ------------------------------------------------------------------------------------------------------------

def test_rules_odd_rows(odd, empty):
    want = []
    for i, text in texts(odd):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)))
    book = quality_rules.ledger(odd)
    assert collected(book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == sorted(want, key=repr)
    assert quality_rules.ledger(empty).count() == 0


def test_rules_ablations(small):
    book = quality_rules.verdicts(quality_rules.ledger(small), 2).cache()
    rows = book.collect()
    for r in quality_rules.ablations(book, 2).collect():
        bit = quality_rules.BITS[r.rule]
        assert r.failing == sum(bool(x.failed & bit) for x in rows) and r.only_this == sum(x.failed == bit for x in rows)
    base = quality_rules.verdicts(book.drop("kept"), 1)
    assert base.where("not kept and n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").count() == 0


# -- 9 exact duplicates -------------------------------------------------------------------------------------------------

def test_exact_odd_rows(odd, empty):
    groups = defaultdict(list)
    for i, text in texts(odd):
        groups[text or ""].append(i)
    found = exact_dedup.duplicates(odd).collect()
    assert len(found) == odd.count()
    kept = defaultdict(list)
    for r in found:
        ids = groups[next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert all(len(ids) == 1 for ids in kept.values()) and len(kept) == len(groups)
    stays = exact_dedup.one_of_each(odd)
    assert stays.columns == odd.columns and stays.count() == len(groups)
    assert exact_dedup.duplicates(empty).count() == 0 and exact_dedup.one_of_each(empty).count() == 0


def test_exact_frequent_texts(spark):
    """A text with a third of all rows is spread over runs, and one of its rows stays; so does one of rows without doc_id."""
    rows = [(i if i % 5 else None, "hot" if i % 3 == 0 else ("" if i % 3 == 1 else f"t{i // 9}"), str(i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, exact_key string").repartition(7)
    best = {}
    for doc_id, text, _ in rows:
        best[text] = max(best.get(text, -1), -1 if doc_id is None else doc_id)
    found = exact_dedup.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in found.collect()) == sorted(best.items())
    groups = {r.text_sha256: r for r in exact_dedup.duplicates(docs).where("kept").collect()}
    assert {t: groups[hashlib.sha256(t.encode()).hexdigest()].keep_id or -1 for t in best} == best
    assert exact_dedup.frequent_hashes(docs).count() == 2
    nameless = spark.createDataFrame([(None, "x", str(i)) for i in range(100)], docs.schema)
    assert exact_dedup.one_of_each(nameless).count() == 1


# -- 10 mixing ----------------------------------------------------------------------------------------------------------

def wanted_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(docs):
    rows = mixing.taken_words(docs).collect()
    again = mixing.taken_words(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = wanted_targets(sizes)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").where("doc_id is not null").collect()}
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    return rows, taken, targets


def test_mixing_small(small):
    rows, taken, targets = check_mix(small)
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())


def test_mixing_small_sources_meet_their_targets(spark):
    make = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(make.choices(WORDS, k=make.randint(30, 119))), f"source {i % 1000:04}")
                                  for i in range(1500)], "doc_id long, text string, source string").repartition(7)
    rows, taken, targets = check_mix(docs)
    assert len(targets) == 1000 and all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())
    whole = {i: t.split() for i, t in texts(docs)}
    counts = {r.doc_id: r.taken for r in rows}
    for r in mixing.mixed(docs).collect():
        w = r.text.split()
        assert len(w) == counts.pop(r.doc_id) and not Counter(w) - Counter(whole[r.doc_id] * 3)
    assert not any(counts.values())


def test_mixing_odd_rows(odd, empty):
    check_mix(odd)
    assert mixing.taken_words(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and {i for i, _ in texts(kept)} <= {i for i, t in texts(odd) if t and t.split()}


def test_mixing_skewed_targets(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[:50]), s) for i, s in enumerate("a" + "b" * 2 + "c" * 60)], "doc_id long, text string, source string")
    _, taken, targets = check_mix(docs)
    assert targets["a"] == 150 and targets["b"] == 300
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())


def test_mixed_texts(small):
    counts = {r.doc_id: (r.size, r.taken) for r in mixing.taken_words(small).collect()}
    whole = dict(texts(small))
    mixed = mixing.mixed(small)
    assert mixed.columns == small.columns
    found = {r.doc_id: r for r in mixed.collect()}
    assert set(found) == {i for i, (_, t) in counts.items() if t}
    for i, r in found.items():
        assert len(r.text.encode().split()) == counts[i][1] and r.n_chars == len(r.text)
        if counts[i][0] == counts[i][1]:
            assert sorted(r.text.split()) == sorted(whole[i].split())


@pytest.mark.parametrize("n", [1, 2, 3, 8, 1000, 786433])
def test_permutation(spark, n):
    made = mixing.permutation(F.lit(n).cast("long"), F.lit(3))
    out = spark.range(n).select(mixing.permuted(F.col("id"), made).alias("x"))
    assert out.agg(F.count_distinct("x"), F.min("x"), F.max("x")).first() == (n, 0, n - 1)


# -- pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, small):
    docs = small
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        before, after = texts(docs), out
        if name == "language_id":
            assert {i for i, t in before if langid.has_letter(t)} == {i for i, _ in texts(out)}
        elif name == "exact_dedup":
            last = {}
            for i, t in before:
                last[t] = max(i, last.get(t, i))
            assert sorted(last.values()) == sorted(i for i, _ in texts(out))
        elif name == "near_dedup":
            assert sorted(r[0] for r in near_brute(before, 5, 80) if r[3]) == sorted(i for i, _ in texts(out))
        elif name == "mix_sources":
            assert {r.doc_id for r in mixing.taken_words(docs).where("taken > 0").collect()} == {i for i, _ in texts(out)}
        else:
            assert {i for i, _ in before} == {r.doc_id for r in out.collect()}
        if name != "pack":
            assert after.columns == small.columns
        docs = out
