"""Near duplicates by an LSH forest over MinHash signatures.

Texts with equal shingle sets are one class. Each class representative has TREES signatures of DEPTH short minimum
hashes; for each tree the representatives are sorted by signature (one distributed sort of all trees), and rows near
each other in that order with a common prefix of MIN_DEPTH values are candidates. The nearest rows of the order have
the longest prefixes, so the depth adapts to how crowded a region is. A small sketch and the set sizes discard
candidates that can't be similar. What remains is confirmed on full shingle sets, in waves: the likeliest partners first,
and later only pairs whose ends aren't connected yet, so a large group of near copies needs few comparisons for
each member instead of all pairs. Rows of a run too long for the window are joined once more, exactly (exact_join),
where they aren't connected yet. Components of confirmed links come from star contraction, never from the driver.

Classes are numbered by rows of a stored table, in the order of their smallest ids, so an id may repeat: rows that repeat
id and text share their class, rows that repeat an id with other texts are judged by their own texts. Null and empty texts
have empty sets and are linked with nothing; rows with a null id stay apart. Which rows lie in which partition changes
nothing: windows reach over any number of partitions, and keys that tie are ordered by the class's number. Whole texts of any length are compared. Extra
columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.components import SALTS, components
from corpuscope.llm.exact_join import similar_candidates
from corpuscope.llm.shared import batches_of, parts, shingle_hashes, stored, utf8, word_hashes

TREES, DEPTH, MIN_DEPTH = 24, 6, 3
#: Neighbours in a tree's order that are looked at, and the stride of rows that all rows up to the next are compared with.
NEAR, STRIDE = 8, 64
#: Bytes of the sketch; of them must agree (five standard deviations below what a similarity of 0.8 gives).
SKETCH, AGREE = 32, 14

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit values of TREES * DEPTH minimum hashes of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        least = np.minimum(least, (x[k : k + 2048, None] * _A + _B).min(0))
    least = least ^ (least >> np.uint32(15))
    return ((least * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(">u2")


def signatures(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (digest of the set, null if empty), sig and sketch of each row."""
    batches_of(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            counts, sets, sigs, sketches = [], [], [], []
            for a, b in parts(offsets):
                words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    s = shingle_hashes(words[first[k] : first[k + 1]], shingle)
                    counts.append(len(s))
                    if len(s):
                        sig = signature(s)
                        sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        sigs.append(sig.tobytes())
                        sketches.append(sig[:: TREES * DEPTH // SKETCH][:SKETCH].astype(np.uint8).tobytes())
                    else:
                        sets.append(None), sigs.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, sigs, sketches))], ["doc_id", "text_hash", "n_shingles", "set_id", "sig", "sketch"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_shingles bigint, set_id binary, sig binary, sketch binary")


def near_pairs(tree: np.ndarray, keys: np.ndarray, rep: np.ndarray, size: np.ndarray, sketch: np.ndarray, base: int, fresh: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows in a tree's order; rows before `fresh` were looked at already; base: the first row's number."""
    n = len(rep)
    prefix = np.zeros(n, np.uint64)
    for k in range(2 * MIN_DEPTH):
        prefix = prefix << np.uint64(8) | keys[:, k].astype(np.uint64)
    left, right = [], []
    row = np.arange(n)
    heads = row - (row + base) % STRIDE
    for lag in range(NEAR + 1):
        if lag:
            i = row[max(fresh, lag) :]
            j = i - lag
        else:
            i = row[(row >= fresh) & (heads >= 0) & (row - heads > NEAR)]
            j = heads[i]
        good = (tree[i] == tree[j]) & (prefix[i] == prefix[j]) & (np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j]))
        i, j = i[good], j[good]
        good = (sketch[i] == sketch[j]).sum(1) >= AGREE
        left.append(i[good]), right.append(j[good])
    # Runs with rows farther apart than the window: each of their rows is paired with itself, for the exact join.
    end = row[max(fresh, NEAR + 1) :]
    end = end[(tree[end] == tree[end - NEAR - 1]) & (prefix[end] == prefix[end - NEAR - 1])]
    crowded = np.unique(rep[np.unique((end[:, None] - np.arange(NEAR + 2)).ravel())])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.concatenate([np.minimum(rep[i], rep[j]), crowded]), np.concatenate([np.maximum(rep[i], rep[j]), crowded])


_ROWS = ["tree", "key", "rep", "n_shingles", "sketch"]


def _arrays(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    def fixed(name: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(-1, width)

    return t.column("tree").to_numpy(), fixed("key", 2 * DEPTH), t.column("rep").to_numpy(), t.column("n_shingles").to_numpy(), fixed("sketch", SKETCH)


#: Rows at the ends of a partition, and all rows of one that holds less than a window.
TAIL, HEAD, WHOLE = 0, 1, 2
_FOUND = "a bigint, b bigint, part int, side int, tree int, key binary, rep bigint, n_shingles bigint, sketch binary"


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of representatives and the number of trees in which they are near each other; a = b marks one of a long run."""
    spark = reps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = reps.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "n_shingles", "sig", "sketch")
    forest = forest.select("tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "rep", "n_shingles", "sketch")
    forest = forest.repartitionByRange(n, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    names = [x.split(" ")[0] for x in _FOUND.split(", ")]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        null = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *null], names)

    def border(t: pa.Table, part: int, side: int) -> Iterator[pa.RecordBatch]:
        m = len(t)
        cols = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([part] * m, pa.int32()), pa.array([side] * m, pa.int32()), *(t.column(c).combine_chunks() for c in _ROWS)]
        yield from pa.Table.from_arrays(cols, names).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held, base, kept, waiting = 0, 0, None, []
        started = small = False
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            if batch is not None and len(batch):
                waiting.append(batch)
            if waiting and (batch is None or sum(map(len, waiting)) >= 20_000):
                t = pa.Table.from_batches(waiting)
                waiting = []
                if not started:
                    small = batch is None and len(t) < NEAR + 2
                    yield from border(t.slice(0, NEAR + 2), pid, WHOLE if small else HEAD)
                    started = True
                if kept is not None:
                    t = pa.concat_tables([kept, t])
                yield out(*near_pairs(*_arrays(t), base, held, percent))
                kept = t.slice(max(0, len(t) - STRIDE))
                base += len(t) - len(kept)
                held = len(kept)
            if batch is None:
                break
        if kept is not None and not small:
            yield from border(kept.slice(max(0, len(kept) - NEAR - 2)), pid, TAIL)

    found = stored(forest.mapInArrow(scan, _FOUND), "forest")

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tree", "ascending"), ("key", "ascending"), ("rep", "ascending")])
        a, b = near_pairs(*_arrays(t), 1, int((t.column("side").to_numpy() == TAIL).sum()), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # A gap lies between two partitions that hold a window each: the end of one, all smaller partitions between, the start
    # of the other. So neighbours meet however the rows are dealt; a row for each partition tells which gap is which.
    ends = found.where("part is not null")
    gaps = ends.groupBy("part").agg((F.min("side") != WHOLE).cast("int").alias("wide"))
    gaps = gaps.withColumn("gap", F.sum("wide").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    near_gap = ends.join(gaps.select("part", "gap"), "part").withColumn("gap", F.col("gap") - (F.col("side") == HEAD).cast("int"))
    borders = near_gap.select("gap", "side", *_ROWS).groupBy("gap").applyInArrow(across, "a bigint, b bigint")
    pairs = found.where("part is null").select("a", "b").union(borders).where("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("hits"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts: rep and its compressed text."""
    both = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("text_b")), "b")
    both = both.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kept: dict[int, np.ndarray] = {}

        def set_of(node: int, packed: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                data = np.frombuffer(unpack(packed), np.uint8)
                kept[node] = shingle_hashes(word_hashes(data, np.array([0, len(data)]))[0], shingle)
            return kept[node]

        for batch in batches:
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = set_of(a, x), set_of(b, y)
                at = np.searchsorted(s, t)
                both = int((s[np.minimum(at, len(s) - 1)] == t).sum())
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def packed_texts(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """rep and its compressed text, for the representatives in wanted (rep, doc_id and text_hash)."""
    batches_of(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "text_hash", "packed"])

    # Compressed before the shuffle; wanted grows with the corpus, so it is never broadcast.
    packed = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash bigint, packed binary")
    return packed.join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("rep", "packed").dropDuplicates(["rep"])  # rows that repeat id and text


def numbered(full: DataFrame) -> DataFrame:
    """One row for each distinct set: rep (numbers that rise with doc_id), the smallest doc_id and its text_hash, size and signature."""
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = full.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    order = ["doc_id", "text_hash", "set_id"]
    sets = sets.select("set_id", "at.doc_id", "at.text_hash", "n_shingles", "sig", "sketch").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(sets.withColumn("rep", F.monotonically_increasing_id()), "representatives")


def solved(docs: DataFrame, text: str, key: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, representatives, and (id, component) of the representatives that aren't the first of their component."""
    sigs = stored(signatures(docs, text, key, shingle), "minhash")
    reps = numbered(sigs.where("set_id is not null and doc_id is not null"))
    found = stored(candidates(reps, percent), "candidates")
    pairs, crowded = found.where("a < b"), found.where("a = b").select(F.col("a").alias("rep"))
    ends = found.select(F.col("a").alias("rep")).union(found.select("b")).distinct()
    texts = stored(packed_texts(docs, reps.select("rep", "doc_id", "text_hash").join(ends.hint("merge"), "rep", "left_semi"), text, key), "texts")
    # First the likeliest partner of each row, near it in most trees, and the smallest one: long chains of links would need
    # many rounds. Then the rest, where the ends aren't connected yet.
    of = Window.partitionBy("b")
    ranked = stored(pairs.select("a", "b", F.row_number().over(of.orderBy(F.desc("hits"), "a")).alias("turn"), F.min("a").over(of).alias("least")), "ranked")
    early = (F.col("turn") == 1) | (F.col("a") == F.col("least"))
    linked = lambda wave: confirmed(wave.select("a", "b"), texts, shingle, percent).select(F.col("b").alias("u"), F.col("a").alias("v"))
    stars = components(linked(ranked.where(early)))
    at = lambda end: stars.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    rest = ranked.where(~early).join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    more = lambda links: links.union(stars.select(F.col("id").alias("u"), F.col("component").alias("v")))
    stars = components(more(linked(rest)))
    if not crowded.isEmpty():
        sets = texts.join(crowded.hint("merge"), "rep", "left_semi").join(stars.select(F.col("id").alias("rep"), "component"), "rep", "left")
        sets = stored(sets.select("rep", F.coalesce("component", "rep").alias("component"), "packed"), "crowded")
        stars = components(more(linked(similar_candidates(sets, shingle, percent))))
    return sigs, reps, stars


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the component) and kept (doc_id = component_id) of each row."""
    sigs, reps, stars = solved(docs, text, key, shingle, percent)
    # The number of a component is that of its first representative, whose id is the smallest; a large component is dealt by salt.
    roots = reps.select(F.col("rep").alias("component"), F.col("doc_id").alias("component_id")).join(stars.select("component").distinct(), "component")
    roots = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = stars.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(roots, ["component", "salt"]).select(F.col("id").alias("rep"), "component_id")
    named = reps.select("set_id", "rep", "doc_id").join(linked, "rep", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each group one, with its smallest id; all without an id; those without words once for each id and text."""
    sigs, reps, stars = solved(docs, text, key, shingle, percent)
    first = reps.join(stars.select(F.col("id").alias("rep")), "rep", "left_anti").select("doc_id", "text_hash")
    stay = first.union(sigs.where("set_id is null and doc_id is not null").select("doc_id", "text_hash").distinct())
    mark = "text_hash"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.xxhash64(text))
    kept = rows.join(stay.toDF(key, mark).hint("merge"), [key, mark], "left_semi").dropDuplicates([key, mark]).drop(mark)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
