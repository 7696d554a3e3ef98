"""Migrations in keyset batches that go on after a kill.

A plan, made once, cuts the keys into goes of several batches each. A go writes its rows to a place of its own, in place of
what an interrupted try left there, and is marked as done after that; a later run takes the goes that have no mark.
So every row is filled once, whenever the run was stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import order


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None if there is none yet; one without a mark of success doesn't count."""
    try:
        spark.read.text(f"{path}/_SUCCESS").schema  # noqa: B018  (looks it up)
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def planned(rows: DataFrame, key: str, folder: str, size: int, batches: int) -> DataFrame:
    """go, hi (its largest key) and rows of each go; made once and read again later."""
    path = f"{folder}/plan"
    if (plan := _read(rows.sparkSession, path)) is None:
        numbered = order.numbered(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")), [F.col("key"), F.col("row")])
        numbered.groupBy(F.expr(f"place div {size * batches}").alias("go")).agg(F.max("key").alias("hi"), F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(path)
        plan = rows.sparkSession.read.parquet(path)
    return plan


def migrated(rows: DataFrame, key: str, fill: Callable[[DataFrame], DataFrame], folder: str, size: int = 500, batches: int = 200, most: int | None = None) -> DataFrame:
    """What fill makes of the rows, and `go`, once all goes are done; with `most` no more goes than that are run now.

    Goes are ranges of keys: each takes the keys above the last one's largest, up to its own, so keys that repeat stay
    together; rows without a key belong to the first. fill has to leave filled rows as they are.
    """
    spark = rows.sparkSession
    plan = sorted(tuple(r) for r in planned(rows, key, folder, size, batches).select("go", "hi").collect())  # a row for each go
    done = {g for g, _ in plan if _read(spark, f"{folder}/done/{g}") is not None}
    ran = 0
    for n, (go, hi) in enumerate(plan):
        if go in done:
            continue
        if most is not None and ran >= most:
            break
        mine = F.col(key) <= F.lit(hi)
        mine = F.coalesce(mine, F.lit(True)) if n == 0 else mine & (F.col(key) > F.lit(plan[n - 1][1]))
        fill(rows.where(mine)).write.mode("overwrite").parquet(f"{folder}/out/go={go}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/{go}")
        ran += 1
    done = [go for go, _ in plan if _read(spark, f"{folder}/done/{go}") is not None]
    if not done:
        return fill(rows.limit(0)).withColumn("go", F.lit(0).cast("int"))
    return spark.read.option("basePath", f"{folder}/out").parquet(*(f"{folder}/out/go={g}" for g in done))
