"""Sources: files, JSON lines and arrays, CSV, Parquet, JDBC, guarded SQL, probes and descriptions of schemas."""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and binary flag (a NUL among the first 8192 bytes) of every file below a folder; broken UTF-8 is replaced.

    Readers sort by path where the order matters; files of a folder are read side by side.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    binary = F.contains(F.substring("content", 1, 8192).cast("string"), F.lit("\x00"))
    return files.select("path", F.when(~binary, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), binary.alias("is_binary"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, blank ones skipped; lines that can't be parsed are in _corrupt_record if the schema names it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_tasks(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Files with JSON arrays of tasks; bad files are skipped, strict ones fail, as do missing and repeated task ids."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if strict:
        bad = rows.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1 or task_id is null or task_id = ''").first()
        if bad is not None:
            raise ValueError(f"{'duplicate' if bad['task_id'] else 'missing'} task_id: {bad['task_id']}")
    return rows


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> DataFrame:
    """A table of a database; with a numeric column and its bounds, read in so many ranges side by side."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties)


def select_only(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """At most `limit` rows of a statement that begins with SELECT; others are refused."""
    if not re.match(r"\s*select\b", sql, re.IGNORECASE):
        raise ValueError("only SELECT is allowed")
    return spark.sql(sql).limit(limit)


def passed_through(spark: SparkSession, sql: str, limit: int = 1000, seconds: float = 10.0) -> dict:
    """columns, rows (at most `limit`) and error of a SELECT; errors and timeouts are values and never raised."""
    group = uuid.uuid4().hex
    context = spark.sparkContext
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    try:
        rows = select_only(spark, sql, limit)
        context.setJobGroup(group, "guarded select", interruptOnCancel=True)
        timer.start()
        return {"columns": rows.columns, "rows": [tuple(r) for r in rows.collect()], "error": None}
    except Exception as error:  # noqa: BLE001  (whatever went wrong is the result)
        return {"columns": [], "rows": [], "error": f"{type(error).__name__}: {error}"[:500]}
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def probe(spark: SparkSession, sql: str = "SELECT 1 AS one") -> dict:
    """Whether a statement is answered, with which rows, and in how many milliseconds."""
    began = time.monotonic()
    found = passed_through(spark, sql)
    return {"healthy": found["error"] is None and len(found["rows"]) > 0, "rows": found["rows"], "latency_ms": int((time.monotonic() - began) * 1000), "error": found["error"]}


def described(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, position (from 1) and type of each column."""
    rows = [(name, f.name, n, f.dataType.simpleString()) for name, df in tables.items() for n, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def next_batch(df: DataFrame, key: str, after: object, missing: str, size: int = 500) -> DataFrame:
    """The next rows of a migration behind a key, of those that still lack a value; a repeated run takes what is left."""
    return df.where((F.col(key) > F.lit(after)) & F.col(missing).isNull()).orderBy(key).limit(size)
