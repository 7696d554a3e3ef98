"""Structured Streaming over append-only events: ingest, running metrics, windows with late data, exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def running(events: DataFrame) -> DataFrame:
    """Count, sum, least and largest value of each event type so far; works on streams and tables alike."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("largest"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their mean value by type and tumbling window, rows later than `late` dropped by streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def unique(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with each id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Everything that is there now, then stop."""
    return df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines of JSON (column value) as columns of the schema, with an error for those that can't be parsed; blank lines go.

    A bad line is a row with an error, on streams and tables alike, and never stops the others.
    """
    rows = lines.where(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    fields = [f.name for f in rows.schema["r"].dataType.fields if f.name != "_corrupt"]
    return rows.select(*(F.col(f"r.{f}").alias(f) for f in fields), F.when(F.col("r._corrupt").isNotNull(), F.concat(F.lit("bad line: "), F.substring("value", 1, 200))).alias("error"))
