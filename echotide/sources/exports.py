"""File exports of finished reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from echotide.tables import csv_writer


def export_csv(df: DataFrame, path: str) -> bool:
    """Write a report table as CSV; nothing is written when it is empty."""
    if df.isEmpty():
        return False
    csv_writer(df).csv(path)
    return True


def export_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)
