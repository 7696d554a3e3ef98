"""Benchmark decontamination by winnowing.

Of every run of `window` words (WIDTH = window - k + 1 overlapping k-grams of words) the smallest k-gram hash is its
fingerprint, so a test passage of that length that stands in a document has the same fingerprint there: none is missed.
The test side's fingerprints, as a bitmap of fixed size, tell each document's task which of its runs to keep; these are
joined with the test runs by fingerprint and extended to the whole run, whose digest must agree. An item with fewer words
is one run of its length, which is its own k-gram; there are at most window - 1 such lengths.

A run that stands in very many documents is dealt over SALTS keys, and test runs are distinct rows, so no task gets a
hot run whole and no pairs of documents and items are made to find what is covered. Which items a document holds is found
once for each distinct set of runs, where runs that stand in the same items count as one, and not for each document.

Null texts have no words. Rows of documents are judged each for itself, so ids may repeat or be null. Items that repeat an id
are one item in counts and digests; items without an id are left out of both, but what they cover is hit. Empty
tables: no rows, or no hits. Whole texts of any length; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, given_back, mixed, parts, slice_hashes, stored, utf8, word_slices

#: The bitmap's bits (4 MB at any size of the tables) and the keys that a run's rows are dealt over.
BITS, SALTS = 1 << 25, 32
#: Runs in one row of a batch that leaves Python.
ROWS = 50_000


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, by where they start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + words[j : n + j])
    return out


def fingerprints(words: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each run of `length` words, by where it starts, its smallest k-gram hash."""
    g = grams(words, k)
    width = length - k + 1
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, width):
        np.minimum(out, g[j : n + j], out=out)
    return out


def _bit(hashes: np.ndarray) -> np.ndarray:
    """Positions in the bitmap, from 1 as Spark's bitmap functions count."""
    return (hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64) + 1


def _digests(flat: np.ndarray, at: np.ndarray, starts: np.ndarray, length: int) -> list[bytes]:
    """Digests of runs of words, spelled with a space after each word."""
    data, at = flat.tobytes(), at.tolist()
    out = []
    for s in starts.tolist():
        said = b" ".join([data[at[j] : at[j + 1]] for j in range(s, s + length)])
        out.append(hashlib.blake2b(said, digest_size=16).digest())
    return out


def _whole(starts: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The starts whose runs end in the row they begin in; first: word ranges of the rows."""
    row = np.searchsorted(first, starts, side="right") - 1
    return starts[starts + length <= first[row + 1]]


def _gram_of(length: int, window: int) -> int:
    return (window + 1) // 2 if length == window else length


_RUN = ["length", "gram", "run"]


def item_runs(items: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """item_id, length, gram (fingerprint) and run (digest) of every run of every item."""
    batches_of(items.sparkSession)
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            data, offsets = utf8(batch.column(1))
            for a, b in parts(offsets):
                flat, at, first = word_slices(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words, sizes = slice_hashes(flat, at), np.diff(first)
                for length in range(1, window + 1):
                    rows = np.flatnonzero(sizes >= length if length == window else sizes == length)
                    if len(rows) == 0:
                        continue
                    starts = np.concatenate([np.arange(first[r], first[r + 1] - length + 1) for r in rows])
                    of = np.repeat(rows, sizes[rows] - length + 1)
                    gram = fingerprints(words, length, _gram_of(length, window))[starts]
                    for c in range(0, len(starts), ROWS):
                        s = starts[c : c + ROWS]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + of[c : c + ROWS])), pa.array(np.full(len(s), length)), pa.array(gram[c : c + ROWS].view(np.int64)), pa.array(_digests(flat, at, s, length), pa.binary())], ["item_id", *_RUN])

    return items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, length bigint, gram bigint, run binary")


def bitmap(runs: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bits of all fingerprints, as bytes of fixed number, and the lengths of runs that occur."""
    shift = 64 - BITS.bit_length() + 1
    bit = F.shiftrightunsigned("gram", shift) + 1
    buckets = runs.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"), F.collect_set("length").alias("lengths"))
    out, lengths = np.zeros(BITS // 8, np.uint8), set()
    for bucket, data, found in zip(*(c.to_pylist() for c in buckets.toArrow().columns), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(data, np.uint8)
        lengths |= set(found)
    return out, sorted(lengths)


def document_runs(docs: DataFrame, bits: np.ndarray, lengths: list[int], text: str, key: str, window: int) -> DataFrame:
    """Two kinds of rows, told apart by `run`: each document's own (doc_id, n_words), and its runs that the bitmap lets pass.

    `row` numbers a document within its task.
    """
    batches_of(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    kind = docs.schema[key].dataType
    names = ["doc_id", "row", "n_words", "start", *_RUN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, row = np.frombuffer(sent.value, np.uint8), 0
        for batch in given_back(batches):
            data, offsets = utf8(batch.column(1))
            for a, b in parts(offsets):
                flat, at, first = word_slices(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words, m = slice_hashes(flat, at), b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(np.arange(row, row + m)), pa.array(np.diff(first)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
                for length in lengths:
                    gram = fingerprints(words, length, _gram_of(length, window))
                    bit = _bit(gram) - 1
                    starts = _whole(np.flatnonzero(have[bit >> 3] >> (bit & 7).astype(np.uint8) & 1), first, length)
                    for c in range(0, len(starts), ROWS):
                        s = starts[c : c + ROWS]
                        of = np.searchsorted(first, s, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(s), batch.column(0).type), pa.array(row + of), pa.nulls(len(s), pa.int64()), pa.array(s - first[of]), pa.array(np.full(len(s), length)), pa.array(gram[s].view(np.int64)), pa.array(_digests(flat, at, s, length), pa.binary())], names)
                row += m

    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, row bigint, n_words bigint, start bigint, length bigint, gram bigint, run binary")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    A word is hit if it is in an occurrence of a run of `window` consecutive words of an item (or of a whole item with
    fewer); items are those with a run that occurs; the digest is that of their ids as strings, sorted and comma-joined.
    """
    known = stored(item_runs(items, item_text, item_key, window), "item-runs")
    bits, lengths = bitmap(known)
    rows = document_runs(docs, bits, lengths, text, key, window)
    rows = stored(rows.withColumn("id", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("row")), "document-runs")
    own, found = rows.where("run is null").select("id", "doc_id", "n_words"), rows.where("run is not null")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = lambda *of: F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int").alias("salt")
    tests = known.select("gram", "run").distinct().select("gram", "run", salts)
    hits = stored(found.select("id", "start", "length", "gram", "run", salt("id", "start")).join(tests, ["gram", "run", "salt"]).select("id", "start", "length", "run"), "hits")

    # Words covered by runs: each run adds what reaches beyond all runs that start before it.
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.select("id", F.greatest(end - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)).alias("fresh"))
    covered = fresh.groupBy("id").agg(F.sum("fresh").alias("n_hit"))

    # Runs that stand in the same items are one class, named by its smallest run; documents with the same classes share their items.
    holding = known.where("item_id is not null").select("run", F.col("item_id").cast("string").alias("item")).distinct()
    alike = [F.bit_xor(F.xxhash64("item", F.lit(k))).alias(f"x{k}") for k in range(2)]
    of_run = holding.groupBy("run").agg(*alike)
    of_run = stored(of_run.withColumn("class", F.min("run").over(Window.partitionBy("x0", "x1"))).select("run", "class"), "run-classes")
    tested = of_run.select("run", "class", salts)
    classes = hits.select("id", "run", salt("id", "start")).join(tested, ["run", "salt"]).select("id", "class").distinct()
    sets = classes.groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    sets = stored(sets.withColumn("set", F.sha2(F.concat_ws("", F.transform("classes", F.hex)).cast("binary"), 256)), "item-sets")
    runs = sets.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("run"))
    holds = runs.join(holding, "run").select("set", "item").distinct()
    listed = holds.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    named = sets.select("id", "set", salt("id")).join(listed.select("*", salts), ["set", "salt"]).select("id", "n_items", "items_sha256")

    out = own.join(covered, "id", "left").join(named, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("doc_id").alias(key),
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
