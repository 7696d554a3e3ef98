"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the `k` smallest of the distinct 64-bit hashes of a text's shingles (runs of `shingle`
words; a shorter text is one shingle, an empty one has none). Sketches of parts merge into the sketch of the whole,
and give estimates of the number of distinct shingles, of resemblance and of containment; with fewer than k shingles
all of these are exact.

Null text counts as empty: its sketch is empty. Two empty texts are alike (1.0), an empty and another one aren't (0.0).
Equal texts have equal sketches, wherever they stand; whole texts of any length are sketched. Ids may be null (null comes
before all others) or repeat. Only the text and the id are read, so other columns may have any names. An empty table
gives an empty one; a single document is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.shared import stored

K = 128
SHINGLE = 5
#: What separates words (ASCII white space), and the hashes' range: 48 bits, from 0.
BLANKS = r"[\x20\x09-\x0D]+"
RANGE = float(1 << 48)

#: Rows of an id from which on they are dealt over SALTS keys, unless more than MOST_HOT ids have more.
HOT_ROWS, MOST_HOT, SALTS = 5000, 1000, 32


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, BLANKS), "")


def hashes_of(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles, repeats included: each word is hashed once, a shingle's hash is that of its words' hashes."""
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    # Nested so that the array of word hashes is computed once.
    def joined(h: Column) -> Column:
        last = F.greatest(F.size(h) - (shingle - 1), F.least(F.lit(1), F.size(h)))
        return F.transform(F.slice(h, F.lit(1), last), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, shingle))), 16))

    return F.get(F.transform(F.array(words), joined), F.lit(0))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return bottom(hashes_of(text, shingle), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return bottom(F.concat(a, b), k)


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """The sketch of all rows of each group: the k smallest distinct hashes, deduplicated before the shuffle."""
    rows = df.select(*keys, F.explode(column).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))  # Spark limits each task's rows before the shuffle
    return rows.withColumn("__n", rank).where(F.col("__n") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.element_at(a, -1).cast("double") + 1) / F.lit(RANGE)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1.0 if a is empty."""
    union = distinct_count(merged(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def neighbours(docs: DataFrame, text: str, key: str) -> DataFrame:
    """__id, __rows (how many share it), __next, __before (the documents after and before it, in a ring) and __asks: how many code points the
    document before it wants. Rows that share an id are one place. The order is made by a distributed sort of ids."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).alias("__id"), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).alias("__quarter"))
    ids = ids.groupBy("__id").agg(F.max("__quarter").alias("__quarter"), F.count("*").alias("__rows"))
    ids = stored(ids.repartitionByRange(n, F.asc_nulls_first("__id")).withColumn("__part", F.spark_partition_id()), "ids")
    order = Window.partitionBy("__part").orderBy(F.asc_nulls_first("__id"))
    here = F.struct("__id", "__quarter")
    # One row for each part: its first and last document, and those of the parts beside it.
    edges = ids.groupBy("__part").agg(F.min(here).alias("__first"), F.max(here).alias("__last"))
    ring = Window.orderBy("__part")
    every = Window.partitionBy()
    edges = edges.select(
        "__part",
        F.coalesce(F.lead("__first").over(ring), F.min_by("__first", "__part").over(every)).alias("__after_part"),
        F.coalesce(F.lag("__last").over(ring), F.max_by("__last", "__part").over(every)).alias("__before_part"),
    )
    rows = ids.select("__part", "__id", "__rows", F.lead(here).over(order).alias("__n"), F.lag(here).over(order).alias("__p")).join(edges, "__part")
    return rows.select("__id", "__rows", F.coalesce("__n", "__after_part")["__id"].alias("__next"), F.coalesce("__p", "__before_part").alias("__p")).select("__id", "__rows", "__next", F.col("__p.__id").alias("__before"), F.col("__p.__quarter").alias("__asks"))


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """key, text, edited text and the sketches of the text, the edited text and the next document's text.

    The edit replaces the last quarter of a text's code points by the first as many of the next document's, in the order
    of ids, the first following the last. Of rows that share an id the smallest text is what the document before gets.
    """
    near = stored(neighbours(docs, text, key), "neighbours")
    # An id that very many rows share (null, above all) is dealt over SALTS keys; at most MOST_HOT ids are.
    bound = max(HOT_ROWS, (near.agg(F.sum("__rows")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(stored(near.where(F.col("__rows") > bound).select(F.col("__id").alias("__hot"), F.lit(SALTS).alias("__salts")), "hot-ids"))
    salts_of = lambda df, c: df.join(hot, F.col(c).eqNullSafe(F.col("__hot")), "left").withColumn("__salts", F.coalesce("__salts", F.lit(1))).drop("__hot")
    every = F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    # Ids are joined as structs of one type: a null id equals itself, and every step finds rows dealt by the same key.
    own = lambda c, salt: F.struct(F.col(c).alias("id"), F.coalesce(salt.cast("int"), F.lit(0)).alias("salt"))
    near = salts_of(near, "__id").select("__id", "__before", "__asks", every.alias("__salt"))
    near = near.select(own("__id", F.col("__salt")).alias("__id"), "__before", "__asks")
    # Each text is sketched once, before it is shuffled; its neighbour gets the sketch and the head.
    rows = salts_of(docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")), "__id")
    rows = rows.select(own("__id", F.pmod(F.xxhash64("__text"), F.col("__salts"))).alias("__id"), "__text")
    beside = rows.withColumn("__sketch", sketch(F.col("__text"), k, shingle)).join(near, "__id")
    sent = salts_of(beside, "__before").select(F.struct(F.expr("substring(__text, 1, int(__asks))").alias("head"), F.col("__sketch").alias("sketch")).alias("__sent"), "__before", every.alias("__salt"))
    sent = sent.select(own("__before", F.col("__salt")).alias("__id"), "__sent").groupBy("__id").agg(F.min("__sent").alias("__sent"))
    out = beside.select("__id", "__text", "__sketch").join(sent, "__id")
    long = F.length("__text")
    changed = F.concat(F.substring("__text", F.lit(1), long - F.floor(long / 4).cast("int")), F.substring(F.col("__sent.head"), F.lit(1), F.floor(long / 4).cast("int")))
    out = out.select("__id", "__text", changed.alias("__edited"), "__sketch", F.col("__sent.sketch").alias("__next_sketch"))
    return out.select(F.col("__id.id").alias(key), F.col("__text").alias(text), F.col("__edited").alias("edited"), F.col("__sketch").alias("sketch"), sketch(F.col("__edited"), k, shingle).alias("edited_sketch"), F.col("__next_sketch").alias("next_sketch"))
