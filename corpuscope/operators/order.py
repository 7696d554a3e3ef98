"""Global order without a single task: range partitions are sorted side by side, their totals shift what each holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.cut import cut


def running_total(df: DataFrame, order: list[Column], size: Column, out: str = "before") -> DataFrame:
    """df and the sum of `size` over the rows before each one in the given order, whose keys must tell rows apart.

    Each partition's rows are summed up within the partition; what stands before a partition is one row for each of them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__size", size.cast("long")).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    rows = cut(rows, "ordered")
    parts = rows.groupBy("__part").agg(F.sum("__size").alias("__total"))
    parts = parts.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__size").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, inside).join(parts, "__part").withColumn(out, F.col(out) + F.col("__start")).drop("__part", "__size", "__start")


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """df and the number of each row, from 0, in the given order."""
    return running_total(df, order, F.lit(1), out)
