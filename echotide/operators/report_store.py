"""Stored reports under their key: returned if they exist, else generated and stored once.

Each report is one small file named by its key. Generating comes first, then the file is created exclusively: of several runs
that miss at the same time one creates it, the others find it there and return what it holds. This needs a file system whose
create without overwrite is exclusive, as that of HDFS and of local disks is.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from echotide.operators.reports import report_key, stored_reports
from echotide.operators.scope import Scope
from echotide.schemas import INSIGHT_REPORTS, empty_table

#: Seconds that a run waits for a report which another one has begun to write.
PATIENCE = 30


def all_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every stored report."""
    return _read(spark, f"{root}/reports")


def find_report(spark: SparkSession, root: str, report_type: str, scope: Scope) -> DataFrame | None:
    """The stored report of a type and scope: its file alone is opened."""
    found = _read(spark, _path(root, report_key(report_type, scope)))
    return None if found.isEmpty() else found


def report_for(spark: SparkSession, root: str, report_type: str, scope: Scope, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored report, which is made from `build` (report_type, scope, content_json) if there is none yet."""
    found = find_report(spark, root, report_type, scope)
    if found is not None:
        return found
    row = stored_reports(build()).toJSON().first()
    _create(spark, _path(root, report_key(report_type, scope)), row)
    end = time.monotonic() + PATIENCE
    while (found := find_report(spark, root, report_type, scope)) is None:
        if time.monotonic() > end:
            raise TimeoutError(f"report {report_key(report_type, scope)} in {root} was begun but never finished; remove its file")
        time.sleep(0.2)
    return found


def _path(root: str, key: str) -> str:
    return f"{root}/reports/{key}.json"


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(INSIGHT_REPORTS).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return empty_table(spark, "insight_reports")


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist yet; False if it does. Hadoop's create is not exclusive on local disks, Python's is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if files.getScheme() == "file":
            local = target.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            stream = open(local, "xb")
        else:
            stream = files.create(target, False)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    try:
        stream.write(text.encode() + b"\n")
    finally:
        stream.close()
    return True
