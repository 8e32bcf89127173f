"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of `(unit)*` keeps the end of every repetition: their number is n, and both cuts are read from them by index.
Text reaches Python once and three numbers come back; the rest is columns. Texts beyond BLOCK code points are matched block
by block, cut where a unit ends, so that the captures held at once are bounded; the ends are kept as packed integers.

Defined cases: a null text is empty; an empty text has no unit and is plain. A null doc_id hashes like an empty one. Repeated
rows each give a row. A text that holds a sentinel is plain, so every other output can be taken apart again. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
NOT_LETTER = regex.compile(r"[^A-Za-z]")
BLOCK = 1 << 20
CUTS = "n long, prefix_end long, middle_end long"


def unit_ends(text: str, block: int = BLOCK) -> np.ndarray:
    """Code points at which the units of a text end."""
    if len(text) <= block:
        return np.array(UNITS.fullmatch(text).ends(1), dtype=np.int64)
    found, start = [], 0
    while start < len(text):
        cut = NOT_LETTER.search(text, min(start + block, len(text)))
        stop = cut.start() if cut else len(text)
        found.append(np.array(UNITS.fullmatch(text, start, stop).ends(1), dtype=np.int64))
        start = stop
    return np.concatenate(found)


def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Number of units, and where prefix and middle end, from two hashes."""
    out = []
    for text, one, two in zip(texts, first, second):
        ends = unit_ends(text)
        low, high = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
        out.append((len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0))
    return pd.DataFrame(out, columns=["n", "prefix_end", "middle_end"])


def _hash(digest: Column, number: int) -> Column:
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output. Of 100 hash values those from `plain_from` on leave a text as it
    is; of 100 others those under `spm_below` put the suffix first."""
    cuts = F.pandas_udf(_cuts, CUTS)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(key, 256).alias("digest"))
    cut = rows.select("doc_id", "text", "digest", cuts("text", _hash(F.col("digest"), 0), _hash(F.col("digest"), 1)).alias("cut"))
    text, first, second = F.col("text"), F.col("cut.prefix_end"), F.col("cut.middle_end")
    marked = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when(marked | (_hash(F.col("digest"), 2) % 100 >= plain_from), "plain")
            .when(_hash(F.col("digest"), 3) % 100 < spm_below, "spm").otherwise("psm"))
    prefix = F.substr(text, F.lit(1), first.cast("int"))
    middle = F.substr(text, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substr(text, (second + 1).cast("int"))
    split = cut.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), prefix.alias("prefix"),
                       middle.alias("middle"), suffix.alias("suffix"), first.alias("first"), (second - first).alias("length"))
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
              .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")))
    moved = F.col("form") != "plain"
    return split.select("doc_id", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"),
                        F.when(moved, F.col("length")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    take = lambda order, result: F.regexp_replace(output, "(?s)^" + "".join(f"{o}(.*)" for o in order) + r"\z", result)
    return (F.when(form == "psm", take((PREFIX, SUFFIX, MIDDLE), "$1$3$2"))
            .when(form == "spm", take((SUFFIX, PREFIX, MIDDLE), "$2$3$1")).otherwise(output))
