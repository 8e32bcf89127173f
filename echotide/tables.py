"""Reading, writing and staging of tables as parquet on shared storage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from echotide.schemas import TABLES, empty_table

_staged: dict[tuple[str, ...], tuple[str, StructType]] = {}


def read_table(spark: SparkSession, root: str | None, name: str) -> DataFrame:
    """A stored table. It must exist and have the columns of its schema; only without a root, before the first run, it is empty."""
    if root is None:
        return empty_table(spark, name)
    try:
        stored = spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        raise FileNotFoundError(f"no stored table {name} in {root}") from error
    schema = empty_table(spark, name).schema
    absent = sorted(set(schema.fieldNames()) - set(stored.columns))
    if absent:
        raise ValueError(f"table {name} in {root} lacks columns: {', '.join(absent)}")
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Write parquet. Rows of one partition value are first brought together in few files;
    the rebalance hint lets adaptive execution split a value that holds too much."""
    if partition_by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)


def csv_writer(df: DataFrame) -> DataFrameWriter:
    """Values as they are: quotes doubled, blanks at their ends kept."""
    return (df.write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session may go without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="echotide-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _fingerprint(spark: SparkSession, path: str) -> str:
    """Size and change time of an input, so that changed input is staged anew."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(hadoop_path)
    changed = files.getFileStatus(hadoop_path).getModificationTime()
    return f"{changed}-{size.getLength()}-{size.getFileCount()}"


def _write_once(
    spark: SparkSession, source: str, name: str, write: Callable[[str], StructType]
) -> tuple[str, StructType]:
    root = staging_root(spark)
    key = (spark.sparkContext.applicationId, root, source, _fingerprint(spark, source), name)
    if key not in _staged:
        folder = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        path = f"{root}/echotide/{name}/{folder}-{uuid.uuid4().hex[:8]}"
        _staged[key] = (path, write(path))
    return _staged[key]


def stage(
    spark: SparkSession,
    source: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: str | None = None,
) -> DataFrame:
    """Write a derived table once per application and input, then read it back.

    Several reports read the enriched reviews; writing them once replaces repeated
    deduplication and text work, and a written table survives the loss of executors.    """

    def write(path: str) -> StructType:
        df = build()
        write_table(df, path, partition_by)
        return df.schema

    path, schema = _write_once(spark, source, name, write)
    return spark.read.schema(schema).parquet(path)


def stage_folder(spark: SparkSession, source: str, name: str, fill: Callable[[str], None]) -> str:
    """A folder of tables, filled once per application and input."""

    def write(path: str) -> StructType:
        fill(path)
        return StructType()

    return _write_once(spark, source, name, write)[0]


def stage_csv(spark: SparkSession, source: str, name: str, df: DataFrame) -> str:
    """Write a frame as CSV files once and return their folder."""

    def write(path: str) -> StructType:
        csv_writer(df).csv(path)
        return df.schema

    return _write_once(spark, source, name, write)[0]
