"""Reference-compatible MinHash signatures and keep-first band dedup, without pairs of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import word_tokens
from corpuscope.operators.cut import cut

#: Most words whose values all workers know, 34 MB, and the length from which on a word is known by its digest.
HOT, HOT_BYTES = 65_536, 64
#: A text with fewer known words gets the values of as many others at once, so that few of the rest can matter.
SURE = 32
#: Rows of values that are looked at together.
BLOCK = 4096


def word_values(words: list[str], slots: int, seed: int) -> np.ndarray:
    """A row for each word, with its hash for each slot."""
    prefixes = [f"{seed}:{2 * i + 1}:{2 * i + 2}:".encode() for i in range(slots)]
    out = np.empty((len(words), slots), np.uint32)
    for row, word in zip(out, words, strict=True):
        raw = word.encode()
        row[:] = np.frombuffer(b"".join([hashlib.sha256(p + raw).digest()[:4] for p in prefixes]), ">u4")
    return out


def word_keys(words: pa.Array) -> pa.Array:
    """Words as bytes, long ones as their digest behind a byte that no word has."""
    raw = words.cast(pa.binary())
    if (pc.max(pc.binary_length(raw)).as_py() or 0) <= HOT_BYTES:
        return raw
    return pa.array([w if len(w) <= HOT_BYTES else b"\0" + hashlib.sha256(w).digest() for w in raw.to_pylist()], pa.binary())


def hot_values(words: DataFrame, slots: int, seed: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and values of the most frequent words (at most HOT), which are hashed in tasks; words has a row for each text and word."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(words.groupBy("word").agg(F.floor(F.log2(F.count("*")) * 8).alias("level")), "words")
    total, least = 0, float("inf")
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundreds of rows
        total += r["count"]
        if total > HOT:
            break
        least = float(r["level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = word_values(batch.column(0).to_pylist(), slots, seed)
            yield pa.RecordBatch.from_arrays([word_keys(batch.column(0)), pa.array([v.tobytes() for v in values], pa.binary())], ["key", "value"])

    found = counts.where(F.col("level") >= least).select("word").repartition(n).mapInArrow(run, "key binary, value binary").toArrow()
    values = np.frombuffer(b"".join(found.column("value").to_pylist()), np.uint32).reshape(-1, slots)
    return found.column("key").combine_chunks(), values


def signatures(docs: DataFrame, key: str, text: str, slots: int = 128, seed: int = 7) -> DataFrame:
    """key and signature: in each slot the least hash of the text's distinct words, null for texts without words.

    The most frequent words are hashed once and known to all workers, so that a text has their minima at once. Its other words
    meet those of other texts, each is hashed once where it meets, and only hashes below the text's largest minimum go back
    to it; no other can be a minimum. Rows of keys that occur once are final; of repeated keys the slot-wise least values
    are kept.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = F.array_distinct(F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>")))
    src = docs.select(F.col(key).alias("__key"), words.alias("words"))
    shared = spark.sparkContext.broadcast(hot_values(src.select(F.explode("words").alias("word")), slots, seed))
    kind = src.schema["__key"].dataType.simpleString()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat, size = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy()
            ends = np.concatenate([[0], np.cumsum(size)])
            at = pc.fill_null(pc.index_in(word_keys(flat), value_set=keys), -1).to_numpy().copy()
            least = np.full((len(size), slots), 0xFFFFFFFF, np.uint32)
            for d, (a, b) in enumerate(zip(ends, ends[1:])):
                mine = at[a:b]
                rows = mine[mine >= 0]
                for k in range(0, len(rows), BLOCK):
                    np.minimum(least[d], values[rows[k : k + BLOCK]].min(0), out=least[d])
                if len(rows) < SURE and len(rows) < b - a:
                    more = np.flatnonzero(mine < 0)[: SURE - len(rows)]
                    np.minimum(least[d], word_values(flat.take(pa.array(a + more)).to_pylist(), slots, seed).min(0), out=least[d])
                    mine[more] = len(keys)  # settled
            cold = np.flatnonzero(at < 0)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, ends), pa.int32()), flat.take(pa.array(cold)))
            columns = [np.arange(row, row + len(size)), batch.column(0), size > 0, [v.tobytes() for v in least], least.max(1, initial=0).astype(np.int64), rare]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["__row", "__key", "said", "least", "most", "rare"])
            row += len(size)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(2).dictionary_encode()
            values, which = word_values(code.dictionary.to_pylist(), slots, seed), code.indices.to_numpy()
            row, most = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(row), BLOCK):
                some = values[which[a : a + BLOCK]]
                pair, slot = np.nonzero(some < most[a : a + BLOCK, None])
                met, count = np.unique(pair, return_counts=True)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(slot << 32 | some[pair, slot]))
                yield pa.RecordBatch.from_arrays([pa.array(row[a + met]), found], ["__row", "found"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, slots).astype(np.int64)
            found, size = batch.column(3).flatten().to_numpy(), pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy()
            np.minimum.at(least, (np.repeat(np.arange(len(size)), size), found >> 32), found & 0xFFFFFFFF)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, slots), pa.int32()), pa.array(least.ravel()), mask=pc.invert(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), signature], ["__key", "signature"])

    base = cut(src.mapInArrow(known, f"__row bigint, __key {kind}, said boolean, least binary, most bigint, rare array<string>"), "least")
    rare = base.select("__row", "most", F.explode("rare").alias("word")).repartition(n, "word").sortWithinPartitions("word")
    found = rare.mapInArrow(below, "__row bigint, found array<bigint>").groupBy("__row").agg(F.flatten(F.collect_list("found")).alias("found"))
    whole = base.select("__row", "__key", "said", "least").join(found, "__row", "left").select("__key", "said", "least", "found")
    each = whole.mapInArrow(merged, f"__key {kind}, signature array<bigint>")
    # A key's rows are told by its count; only those of repeated keys are taken apart, a row for each slot, and merged by partial minima.
    each = cut(each, "signatures")
    repeated = each.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    repeated, same = repeated.withColumnRenamed("__key", "again"), F.col("__key").eqNullSafe(F.col("again"))
    marked, single = each.join(repeated, same, "left_semi"), each.join(repeated, same, "left_anti")
    slot = marked.select("__key", F.posexplode_outer("signature").alias("slot", "value")).groupBy("__key", "slot").agg(F.min("value").alias("value"))
    least = slot.groupBy("__key").agg(F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value")))).alias("s"))
    least = least.select("__key", F.when(F.size("s") > 0, F.transform("s", lambda x: x["value"])).alias("signature"))
    return single.unionByName(least).select(F.col("__key").alias(key), "signature")


def similarity(a: Column, b: Column) -> Column:
    """Share of equal slots; 0 for missing or unequally long signatures."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)), F.lit(0.0))


def keep_first(sigs: DataFrame, key: str, bands: int = 16, rows: int = 8) -> DataFrame:
    """key and kept: a row goes if any of its bands equals a band of an earlier row that stays.

    Of equal signatures only the first one can stay. Each round keeps the rows that are first in all their bands among
    the undecided, then drops the rows that share a band with those; work is linear in rows and bands. Missing signatures
    equal each other.
    """
    whole = sigs.select(F.col(key).alias("id"), F.coalesce("signature", F.array(F.lit(-1).cast("long"))).alias("s"))
    firsts = whole.groupBy("s").agg(F.min("id").alias("id"))
    part = lambda b: F.xxhash64(F.lit(b), F.concat_ws(",", F.transform(F.slice("s", b * rows + 1, rows), lambda x: x.cast("string"))))
    band = F.when(F.size("s") > 1, F.array(*map(part, range(bands)))).otherwise(F.array(F.xxhash64(F.lit("none"))))
    left = cut(firsts.select("id", F.explode(band).alias("band")))
    kept = None
    while not left.isEmpty():
        lead = left.groupBy("band").agg(F.min("id").alias("lead"))
        now = left.join(lead, "band").groupBy("id").agg(F.min((F.col("lead") == F.col("id")).cast("int")).alias("first")).where("first = 1").select("id")
        now = cut(now)
        taken = left.join(now, "id", "left_semi").select("band").distinct()
        gone = left.join(taken, "band", "left_semi").select("id").distinct()
        left = cut(left.join(gone, "id", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
    ids = sigs.select(F.col(key))
    if kept is None:
        return ids.withColumn("kept", F.lit(False))
    return ids.join(kept.select(F.col("id").alias(key), F.lit(True).alias("kept")), key, "left").select(key, F.coalesce("kept", F.lit(False)).alias("kept"))
