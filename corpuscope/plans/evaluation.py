"""Queries over evaluation facts: lineitem plays task runs, orders benchmark runs, part hardware."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.registry import query, table


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, tasks and hardware joined on their keys; Catalyst prunes columns and picks the joins."""
    tasks = table(spark, sf_dir, "lineitem")
    runs = table(spark, sf_dir, "orders")
    hardware = table(spark, sf_dir, "part")
    return tasks.join(hardware, tasks["l_partkey"] == hardware["p_partkey"]).join(runs, tasks["l_orderkey"] == runs["o_orderkey"])


@query("""
SELECT p_brand AS model_variant_id, o_orderpriority AS task_type,
       avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS quality,
       quantile_disc(l_quantity, 0.5) AS latency_p50, round(avg(p_retailprice), 6) AS params, avg(p_size) AS memory
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY ALL""")
def quality_vs_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, exact median latency and size by model and type of task.

    Equal quantities of a group are counted before they are ordered.
    """
    group = ["model_variant_id", "task_type"]
    counts = (
        star(spark, sf_dir)
        .groupBy(F.col("p_brand").alias("model_variant_id"), F.col("o_orderpriority").alias("task_type"), "l_quantity")
        .agg(
            F.count("*").alias("n"),
            F.count("l_quantity").alias("known"),
            F.count_if(F.col("l_returnflag") == "R").alias("good"),
            F.sum("p_retailprice").alias("prices"),
            F.count("p_retailprice").alias("priced"),
            F.sum("p_size").alias("sizes"),
            F.count("p_size").alias("sized"),
        )
    )
    every = Window.partitionBy(*group)
    placed = counts.withColumns({"upto": F.sum("known").over(every.orderBy(F.asc_nulls_first("l_quantity"))), "all": F.sum("known").over(every)})
    return (
        placed.groupBy(*group)
        .agg(
            (F.sum("good") / F.sum("n")).alias("quality"),
            F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("l_quantity"))).alias("latency_p50"),
            F.round(F.try_divide(F.sum("prices"), F.sum("priced")), 6).alias("params"),
            F.try_divide(F.sum("sizes"), F.sum("sized")).alias("memory"),
        )
        .orderBy(F.desc("quality"), "model_variant_id", "task_type")
    )
