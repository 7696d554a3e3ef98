"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words. Sources weigh by their rank in code point order (nulls last) and share the
mix; a target stops at `most` times its source's size and the excess goes to the others by weight. Each document of a
source is taken once for every complete epoch that fits the target; of the rest a part is taken: documents have
exponential keys -ln(u) / quality, u being a hash of the id, and in the order of these keys they are taken while
their sizes' prefix sum is within the remaining budget.

The cut is found without sorting a source in one task: keys are counted in coarse buckets, the bucket in which the
budget ends is counted in finer ones, and only the last one is sorted. What follows is one row for each source, so
documents are decided where they are, without a shuffle of texts; only with more than BROADCAST_SOURCES sources are they
joined by a shuffle, salted so that a hot source is many keys.

Null and empty texts have size 0; they are repeated for whole epochs and taken in the order of keys like others. Rows
that repeat id and size share their decision. A null source is a source of its own; an empty table gives an empty mix.
Whole texts of any length are measured. Columns of the caller may have any names; none is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.shared import stored

WEIGHTS = (5, 2, 1)
MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: Buckets of each of two levels.
BUCKETS = 1024
#: More sources than this (some 10 MB) aren't broadcast but joined by a shuffle, with so many salts for each source.
BROADCAST_SOURCES, SALTS = 50_000, 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_of(size: Column) -> Column:
    """0.25 to 1: very short documents are less likely to be in a partial epoch."""
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), size / F.lit(100.0)))


def key_of(key: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality; u in (0, 1) has 52 bits of md5 of id and seed, which SQL engines agree on."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def sized(docs: DataFrame, text: str, source: str, key: str, seed: int, *more: Column) -> DataFrame:
    """__null, __source, __id, __size and __key of each row, and more columns."""
    out = docs.select(*more, F.col(source).isNull().alias("__null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.col(key).alias("__id"), size_of(F.col(text)).alias("__size"))
    return out.withColumn("__key", key_of(F.col("__id"), quality_of(F.col("__size")), seed))


SOURCE = ["__null", "__source"]


def targets(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """__source_size, __target, __epochs and __rest of each source.

    Targets are least(most * size, level * weight) with the level at which they add up to the whole size: sources are
    walked by most * size / weight, and the level is the first that the next source would not cut.
    """
    by_name = Window.orderBy("__null", "__source")  # one row a source
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__null", "__source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = thin.groupBy(*SOURCE).agg(F.sum("__size").alias("__source_size"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")).withColumn("__cap", F.col("__source_size") * most)
    level = (F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0.0)))
    sources = sources.withColumn("__level", level)
    ratio = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__cap") / F.col("__w"))
    first = F.min(F.when(ratio.isNotNull(), F.struct(ratio.alias("ratio"), "__null", "__source", "__level"))).over(everything)
    sources = sources.withColumn("__level", first["__level"])
    sources = sources.withColumn("__target", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w")))
    epochs = F.when(F.col("__source_size") > 0, F.least(F.lit(most), F.floor(F.col("__target") / F.col("__source_size")).cast("int"))).otherwise(0)
    return sources.withColumn("__epochs", epochs).select(*SOURCE, "__source_size", "__target", "__epochs", (F.col("__target") - F.col("__epochs") * F.col("__source_size")).alias("__rest"))


def fits_join(left: DataFrame, sources: DataFrame, bounded: bool, keys: list[str] = SOURCE) -> DataFrame:
    """left with the one row of its source; both plans give the same rows, whatever the number of sources."""
    if bounded:
        return left.join(F.broadcast(sources), keys)
    if "__id" not in left.columns:  # counts: at most BUCKETS rows for each source
        return left.join(sources, keys)
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64("__id", "__size"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def plan(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """One row for each source with its target, epochs and the cut (__cut: key, id and size of the last document of
    the partial epoch; null if none), and whether the sources are few enough to be broadcast."""
    sources = stored(targets(thin, weights, most), "mix-targets")
    bounded = sources.count() <= BROADCAST_SOURCES
    place = F.least(F.lit(BUCKETS * BUCKETS - 1), F.floor((1 - F.exp(-F.col("__key") * 0.5)) * (BUCKETS * BUCKETS)))
    rows = thin.withColumn("__place", place).withColumns({"__b1": F.floor(F.col("__place") / BUCKETS), "__b2": F.col("__place") % BUCKETS})

    def crossing(rows: DataFrame, buckets: list[str], budget: DataFrame) -> DataFrame:
        """The bucket in which each source's budget ends, and the size before it."""
        sums = rows.groupBy(*SOURCE, *buckets).agg(F.sum("__size").alias("__sum"))
        before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*SOURCE).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = fits_join(sums.withColumn("__before", before), budget, bounded)
        inside = sums.where((F.col("__before") <= F.col("__left")) & (F.col("__left") <= F.col("__before") + F.col("__sum")))
        return inside.groupBy(*SOURCE).agg(F.max(F.struct(*buckets, "__before", "__left")).alias("__at")).select(*SOURCE, *(F.col(f"__at.{b}").alias(b) for b in buckets), (F.col("__at.__left") - F.col("__at.__before")).alias("__left"))

    one = stored(crossing(rows, ["__b1"], sources.select(*SOURCE, F.col("__rest").alias("__left")).where("__left > 0")), "mix-coarse")
    inner = lambda r, s, keys: fits_join(r, s, bounded, [*SOURCE, *keys])
    two = stored(crossing(inner(rows, one.drop("__left"), ["__b1"]), ["__b1", "__b2"], one.select(*SOURCE, "__left")), "mix-fine")
    last = inner(rows, two, ["__b1", "__b2"]).groupBy(*SOURCE, "__left", "__key", "__id", "__size").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum(F.col("__size") * F.col("__n")).over(Window.partitionBy(*SOURCE).orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The document over whose middle the budget ends is the first that isn't taken.
    last = last.withColumn("__before", before).where(F.col("__before") + F.col("__size") * F.col("__n") / 2 >= F.col("__left"))
    cuts = last.groupBy(*SOURCE).agg(F.min(F.struct("__key", "__id", "__size")).alias("__cut"))
    # If it takes all of the bucket, the cut is behind the bucket.
    cuts = two.join(cuts, SOURCE, "left").select(*SOURCE, "__b1", "__b2", "__cut")
    return sources.join(cuts, SOURCE, "left"), bounded


def decided(rows: DataFrame, chosen: DataFrame, bounded: bool) -> DataFrame:
    """__copies: how often each row is taken."""
    rows = rows.withColumn("__place", F.least(F.lit(BUCKETS * BUCKETS - 1), F.floor((1 - F.exp(-F.col("__key") * 0.5)) * (BUCKETS * BUCKETS))))
    rows = fits_join(rows, chosen, bounded)
    end = F.col("__b1") * BUCKETS + F.col("__b2")
    part = F.when(F.col("__rest") <= 0, False).when(F.col("__b1").isNull(), False).when(F.col("__place") != end, F.col("__place") < end)
    part = part.when(F.col("__cut").isNull(), True).otherwise(F.struct("__key", "__id", "__size") < F.struct("__cut.__key", "__cut.__id", "__cut.__size"))
    return rows.withColumn("__copies", F.col("__epochs") + F.coalesce(part, F.lit(False)).cast("int"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, size, source_size, target and taken (words, repeats counted) of each row."""
    thin = stored(sized(docs, text, source, key, seed), "mix-sizes")
    out = decided(thin, *plan(thin, weights, most))
    return out.select(F.col("__id").alias(key), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; texts aren't shuffled while the sources can be broadcast."""
    chosen, bounded = plan(stored(sized(docs, text, source, key, seed), "mix-sizes"), weights, most)
    rows = decided(sized(docs, text, source, key, seed, F.struct(*docs.columns).alias("__row")), chosen, bounded).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
