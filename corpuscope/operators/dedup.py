"""Keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: Column, order: str) -> DataFrame:
    """by (as hash), first (smallest order) and copies of each group; partial aggregation leaves one row a task and group."""
    return df.groupBy(by.alias("hash")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
