"""Sinks: single files for small exports, appended JSON lines, documents, splits, reports and sinks that may fail."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small exports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_parquet(df: DataFrame, path: str, single: bool = False) -> None:
    """Parquet in place of what was there; one file for small exports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """A frame of one row as one indented JSON document."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, split: Column, key: str, path: str, dataset: str, version: str) -> None:
    """Ids of each split as text, in a folder for each, and a document with counts beside them."""
    rows = df.select(split.alias("split"), F.col(key).cast("string").alias("value"))
    rows.write.mode("overwrite").partitionBy("split").text(f"{path}/ids")
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    whole = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("counts"))  # one entry a split
    write_document(whole.select(F.lit(dataset).alias("datasetId"), F.lit(version).alias("version"), "counts"), f"{path}/split")


def append_report(df: DataFrame, path: str) -> None:
    """Reports (suite, generated_at and more) are added, never replaced; the latest is looked up."""
    df.write.mode("append").parquet(path)


def latest_reports(reports: DataFrame) -> DataFrame:
    """The last report of each suite, and the score of the one before it."""
    rest = [c for c in reports.columns if c not in ("suite", "generated_at")]
    two = reports.groupBy("suite").agg(F.max(F.struct("generated_at", *rest)).alias("last"))
    before = reports.join(two.select("suite", F.col("last.generated_at").alias("now")), "suite").where("generated_at < now").groupBy("suite").agg(F.max_by("score", "generated_at").alias("previous_score"))
    return two.select("suite", "last.*").join(before, "suite", "left")


def best_effort(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame], bool]:
    """A sink whose failures are logged and swallowed: whether it worked is its result."""

    def write(df: DataFrame) -> bool:
        try:
            sink(df)
        except Exception as error:  # noqa: BLE001  (telemetry must never stop what it watches)
            _log.warning("sink failed: %s", error)
            return False
        return True

    return write
