"""Exact percentiles of large groups: an approximate pass brackets them, an exact one counts what lies in the brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.cut import cut

#: An approximate percentile is off by less than one in ACCURACY places; smaller groups are bracketed by their whole range.
ACCURACY = 10_000


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and a column for each share: the percentile, interpolated between the two values beside it; nulls don't count.

    Two passes whatever the values are. Of a group, the values between the brackets of a share are counted by value, some
    thousandths of it at most where they all differ, and only these counts are ordered.
    """
    rows = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("value")).where("value is not null")
    around = [x for s in shares.values() for x in (max(0.0, s - 4 / ACCURACY), min(1.0, s + 4 / ACCURACY))]
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile_approx("value", around, ACCURACY).alias("near"))
    sizes = cut(sizes)
    at = lambda share: (F.col("n") - 1) * share
    few = F.col("n") <= ACCURACY
    brackets = [F.struct(F.lit(s).cast("double").alias("share"), F.when(few, F.col("lo")).otherwise(F.col("near")[2 * i]).alias("a"), F.when(few, F.col("hi")).otherwise(F.col("near")[2 * i + 1]).alias("b")) for i, s in enumerate(shares.values())]
    wanted = sizes.select("group", "n", F.explode(F.array(*brackets)).alias("w")).select("group", "n", "w.*")
    # Smaller values are one row (no value), larger ones don't matter.
    inside = rows.alias("r").join(wanted.alias("w"), F.expr("r.group <=> w.group and r.value <= w.b"))
    inside = inside.select("w.group", "n", "share", F.when(F.col("value") >= F.col("a"), F.col("value")).alias("value"))
    counts = inside.groupBy("group", "n", "share", "value").agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("group", "share").orderBy(F.asc_nulls_first("value")))
    placed = counts.withColumn("upto", upto)
    rank = F.floor(at(F.col("share")))
    holds = lambda r: F.min(F.when(F.col("upto") > r, F.col("value")))
    found = placed.groupBy("group", "n", "share").agg(holds(rank).alias("low"), holds(F.least(rank + 1, F.col("n") - 1)).alias("high"))
    exact = F.col("low") + (F.col("high") - F.col("low")) * (at(F.col("share")) - rank)
    of = lambda s: F.max(F.when(F.col("share") == F.lit(s).cast("double"), exact))
    return found.groupBy("group", "n").agg(*(of(s).alias(name) for name, s in shares.items())).withColumnRenamed("group", group)
