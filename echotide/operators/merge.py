"""Insert-or-replace by key, as a plan over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch replace stored rows with the same key; all other rows stay.

    The anti join lets adaptive execution broadcast the keys of a small batch, so the stored
    table is then not shuffled. A null key cannot identify a row and is not stored.
    """
    fresh = batch.filter(F.col(key).isNotNull()).select(*existing.columns)
    return existing.join(fresh.select(key), key, "left_anti").select(*existing.columns).unionByName(fresh)
