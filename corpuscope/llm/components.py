"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import stored


#: Keys into which the neighbours of a node are dealt where some node has more than HUB of them.
SALTS, HUB = 16, 50_000


def _with_least(links: DataFrame, hubs: bool) -> DataFrame:
    """u, v and m, the smallest v of each u. With hubs only the minima of a hub's shares meet, never all of its neighbours."""
    if not hubs:
        return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    shares = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = shares.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("u", "m", F.explode("salts").alias("salt"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _large(links: DataFrame, hubs: bool) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest of it and its neighbours."""
    both = _with_least(links.union(links.select("v", "u")), hubs)
    return both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small(links: DataFrame, hubs: bool) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = _with_least(links, hubs)  # what _large gives leads downwards
    # The row whose v is the smallest links u with it, any other row links v with it.
    return down.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that isn't the smallest of its component; links has u and v.

    Rounds alternate the two steps until the links are stars around the smallest nodes; each round is a stored table. How
    many neighbours a node has at most decides between two plans for the same rows.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "stars")
    for _ in range(most_rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        shape = each.agg(F.max("n").alias("degree"), F.max("up").alias("up"), F.max(F.least("up", F.col("n") - F.col("up"))).alias("between")).first()
        if shape["degree"] is None or (shape["up"] == 1 and shape["between"] == 0):
            break
        hubs = shape["degree"] > HUB
        now = stored(_small(_large(now, hubs), hubs), "stars")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
