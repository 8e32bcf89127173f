"""Review CSV files with varying headers -> typed, deduplicated reviews."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from echotide.functions.fixed_values import HEADER_ALIASES
from echotide.functions.text import blank_to_null

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIMESTAMP_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d")


def scan_csv(spark: SparkSession, path: str, quoted_newlines: bool = True, sep: str = ",") -> DataFrame:
    """All columns as text, read by position under the names of the header line, which is skipped in every file. Files whose
    fields never hold a newline should be read with quoted_newlines=False: Spark then splits a big file over many tasks."""
    reader = spark.read.option("inferSchema", False).option("multiLine", quoted_newlines).option("escape", '"').option("sep", sep)
    try:
        header = reader.option("header", False).csv(path).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        raise FileNotFoundError(f"review file not found: {path}") from error
    schema = StructType([StructField(name, StringType()) for name in column_names(header or ())])
    return reader.schema(schema).option("header", True).csv(path)


def bare(header: str | None) -> str:
    """A header without case, blanks and punctuation."""
    return re.sub(r"[\W_]+", "", header or "").casefold()


def column_names(header: Iterable[str | None]) -> list[str]:
    """A name for every place of a header line: of headers that are the same but for case and punctuation the last one keeps
    the name, the others and blank ones are named by their place."""
    header = list(header)
    last = {bare(name): place for place, name in enumerate(header)}
    return [name if bare(name) and last[bare(name)] == place else f"_c{place}" for place, name in enumerate(header)]


_TARGETS = {bare(alias): (rank, target) for target, aliases in HEADER_ALIASES.items() for rank, alias in reversed([*enumerate(aliases)])}


def resolve_headers(headers: Iterable[str]) -> dict[str, str]:
    """Target column -> header in the file. The first alias of a target counts before the others, the later of equal headers."""
    offers: dict[str, list[tuple[int, str]]] = {target: [] for target in HEADER_ALIASES}
    for header in headers:
        if known := _TARGETS.get(bare(header)):
            rank, target = known
            offers[target].append((rank, header))
    missing = [target for target, found in offers.items() if not found]
    if missing:
        raise ValueError(f"required columns missing: {', '.join(missing)}")
    return {target: min(reversed(found), key=lambda offer: offer[0])[1] for target, found in offers.items()}


def to_int(text: Column) -> Column:
    """Whole number from text; decimals round, exponents count, anything else is null, also number suffixes and hexadecimals."""
    bare = blank_to_null(text)
    return F.round(F.when(F.rlike(bare, F.lit(NUMBER)), bare).try_cast("double")).try_cast("int")


def to_timestamp(text: Column) -> Column:
    """Zone-free time from text. It is parsed as UTC and counted in seconds, so the time zone of
    the session, with its missing and repeated hours, plays no part."""
    stamped = F.concat(blank_to_null(text), F.lit("+0000"))
    parsed = F.coalesce(*[F.try_to_timestamp(stamped, F.lit(f"{f}Z")) for f in TIMESTAMP_FORMATS])
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=F.unix_seconds(parsed))


def typed_reviews(source: DataFrame) -> DataFrame:
    """Resolve headers, trim, turn blanks into nulls, and cast."""
    headers = resolve_headers(source.columns)
    casts = {"score": to_int, "thumbs_up": to_int, "at_ts": to_timestamp}

    def column(target: str) -> Column:
        raw = F.col("`" + headers[target].replace("`", "``") + "`")
        return casts.get(target, blank_to_null)(raw).alias(target)

    return source.select(*[column(target) for target in HEADER_ALIASES])


def combine(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one frame, each row labelled with where it came from."""
    parts = [typed_reviews(df).withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def latest_per_review(staged: DataFrame) -> DataFrame:
    """The newest row of every review id; all other columns settle ties.

    Spark limits each id to one row per task before the shuffle, so a hot id stays small.
    """
    ties = ("score", "thumbs_up", "content", "app_version", "user_name", "review_created_version", "category_raw")
    newest = Window.partitionBy("review_id").orderBy(
        F.desc_nulls_last("at_ts"), *[F.desc_nulls_last(c) for c in ties]
    )
    return (
        staged.filter(F.col("review_id").isNotNull())
        .withColumn("newest", F.row_number().over(newest))
        .filter("newest = 1")
        .select(*HEADER_ALIASES)
    )


def ingest_counters(staged: DataFrame, sources: list[str]) -> DataFrame:
    """Rows per source, rows in all, rows removed by deduplication, rows kept. One pass: only
    ids and counts are shuffled."""
    loaded = {name: f"_{i}" for i, name in enumerate(sources)}
    per_id = staged.groupBy("review_id").agg(
        *[F.count_if(F.col("source") == name).alias(column) for name, column in loaded.items()]
    )
    totals = per_id.agg(
        F.count("review_id").alias("kept"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in loaded.values()]
    )
    combined = reduce(add, [F.col(c) for c in loaded.values()])
    counters = {f"loaded:{name}": F.col(column) for name, column in loaded.items()}
    counters |= {"combined": combined, "deduped_out": combined - F.col("kept"), "inserted": F.col("kept")}
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("counter"), value.alias("row_count")) for name, value in counters.items()
    ])))
