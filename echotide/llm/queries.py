"""Registered queries of the operators, each over the whole `documents` table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echotide.llm import (
    chat_format, exact_dedup, fill_in_middle, langid, line_dedup, mixing, near_dedup, packing, quality_lm, quality_rules,
    resampling, secrets, substring_dedup,
)
from echotide.llm.common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[of(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs.where(~langid.held_out())))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.verdicts(quality_rules.stored_ledger(documents(spark, sf_dir)), version=2)
    failed = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "kept", "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of policy 2: documents that fail it, and those that only it removes."""
    return quality_rules.ablations(quality_rules.stored_ledger(documents(spark, sf_dir)), version=2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*extra.columns).unionByName(extra)
    stream = chat_format.turns(conversations)
    return chat_format.read_back(stream, chat_format.examples(stream))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.transform(documents(spark, sf_dir))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_line_dedup, op3_minhash_near_dedup, op4_quality_classifier, op5_packing, op6_substring_dedup,
    op7_language_id, op8_quality_rules, op9_exact_dedup, op10_mix_sources, op11_chat_format, op12_fill_in_middle,
    op13_target_resampling, quality_rule_ablations)}

ORACLE = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        judged AS (
            SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op8_quality_rules": r"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents),
        each AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS w0 FROM split),
        grams AS (
            SELECT *, lead(w0, 1) OVER d AS w1, lead(w0, 2) OVER d AS w2, lead(w0, 3) OVER d AS w3, lead(w0, 4) OVER d AS w4
            FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        flagged AS (
            SELECT doc_id, pos, w4 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w0, w1, w2, w3, w4) > 1 AS twice FROM grams),
        covered AS (
            SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
            FROM flagged),
        repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM covered GROUP BY doc_id),
        measured AS (
            SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
                   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                   len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS n_separators,
                   length(regexp_replace(text, '\P{Lu}', '', 'g')) AS n_capitals,
                   length(regexp_replace(text, '\P{L}', '', 'g')) AS n_letters
            FROM split LEFT JOIN repeats USING (doc_id)),
        judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                   + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
                   + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
                   + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                   + CASE WHEN 10 * n_separators > 3 * n_words THEN 64 ELSE 0 END
                   + CASE WHEN n_letters >= 50 AND 10 * n_capitals > 7 * n_letters THEN 128 ELSE 0 END AS failed
            FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, failed
        FROM judged
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        written AS (
            SELECT *, regexp_replace(regexp_replace(text,
                '<(\\*(?:s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>))', '<\\\1', 'g'),
                '\[(\\*(?:INST\]|/INST\]))', '[\\\1', 'g') AS body FROM said),
        placed AS (
            SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
                   sum(length('<s>' || role || chr(10) || body || '</s>')) OVER w AS stop
            FROM written WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(stop) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id
    """,
    "op12_fill_in_middle": """
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   sha256('1:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
        numbered AS (
            SELECT *, len(units) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
                   CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM hashed),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                        THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
        parts AS (
            SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                   array_to_string(units[b + 1:], '') AS suffix FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "op13_target_resampling": r"""
        WITH RECURSIVE steps(byte, round, crc) AS (
            SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
            UNION ALL
            SELECT byte, round + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END
            FROM steps WHERE round < 8),
        crc_table AS (SELECT list(crc ORDER BY byte) AS t FROM steps WHERE round = 8),
        folded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS side FROM documents
            UNION ALL
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1 FROM benchmark),
        each AS (SELECT doc_id, side, unnest(w) AS word FROM folded),
        bytes AS (
            SELECT word, list_transform(range(1, CAST(len(hex(encode(word))) // 2 + 1 AS BIGINT)),
                       lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS UBIGINT)) AS b
            FROM (SELECT DISTINCT word FROM each)),
        buckets AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda crc, x:
                       xor(crc >> 8, t[CAST(xor(crc, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS bucket
            FROM bytes, crc_table),
        counted AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
            FROM each JOIN buckets USING (word) GROUP BY bucket),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted),
        summed AS (
            SELECT doc_id, sum(gain) AS total FROM each JOIN buckets USING (word) JOIN gains USING (bucket)
            WHERE side = 0 GROUP BY doc_id),
        weighed AS (
            SELECT doc_id, len(w) AS n_features,
                   CASE WHEN len(w) = 0 THEN 0 ELSE CAST((total - ((total % len(w)) + len(w)) % len(w)) // len(w) AS BIGINT) END AS weight,
                   CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h
            FROM folded LEFT JOIN summed USING (doc_id) WHERE side = 0),
        scored AS (
            SELECT doc_id, n_features, weight,
                   weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
        placed AS (
            SELECT *, n_features >= 20 AS eligible, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * n // 100 THEN place END AS rank FROM placed
    """,
}

ORACLE["quality_rule_ablations"] = f"""
    WITH book AS ({ORACLE["op8_quality_rules"]}),
    rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8),
                                ('short_words', 16), ('long_words', 32), ('separators', 64), ('shouting', 128))
    SELECT rule, count(*) FILTER ((failed & bit) <> 0) AS failing, count(*) FILTER (failed = bit) AS only_this
    FROM book, rules GROUP BY rule
"""
