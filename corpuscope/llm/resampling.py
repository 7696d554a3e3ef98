"""Importance resampling towards a target distribution by hashed word n-grams.

Each task keeps a trie of words: a node is a run of words, it holds how often the run occurs and the CRC of its bytes, so
that a child's CRC goes on from its parent's. Texts are walked level by level over whole batches. A trie that has grown
to NODES nodes adds its counts to the task's bucket totals and starts anew, so memory is bounded; the totals, as many
numbers as there are buckets, are all that leaves a task. The merged totals of both tables give each bucket a gain, and
a second walk, with the gains attached to the nodes, sums them up along each document. Draws by Gumbel keys are placed by
a distributed sort.

Null texts have no features; their weight is 0. Rows that repeat an id draw the same Gumbel key and count each; a null id
draws that of an empty string and comes before all others in ties. Ties of score and id go to fewer features; rows alike in
these also get ranks of their own. An empty table gives an empty result, an empty target table leaves all counts of it 0.
Whole texts of any length are walked; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, given_back, parts, stored, utf8, word_slices
from corpuscope.operators.order import numbered

#: Nodes after which a trie starts anew.
NODES = 200_000


class Trie:
    """Runs of 1 to `most` words; the nodes' CRC states and counts are arrays by node number."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spelled: list[bytes] = []
        self.children: dict[int, int] = {}  # parent << 32 | word -> node; the root's number is 0
        self.crc = [0]
        self.counts = np.zeros(1, np.int64)
        self.dealt = np.zeros(0, np.int64)

    def _nodes(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of (parent << 32 | word) keys, new ones are added."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.empty(len(distinct), np.int64)
        for i, key in enumerate(distinct.tolist()):
            node = self.children.get(key)
            if node is None:
                parent, word = key >> 32, self.spelled[key & 0xFFFFFFFF]
                node = self.children[key] = len(self.crc)
                self.crc.append(zlib.crc32(word if parent == 0 else b" " + word, self.crc[parent]))
            out[i] = node
        return out[back]

    def walk(self, flat: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each level, the node of the run that starts at each word, -1 where it would leave the row."""
        n = len(at) - 1
        if n == 0:
            return [np.zeros(0, np.int64)] * self.most
        slices = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
        known = []
        for w in slices.dictionary.to_pylist():
            number = self.words.setdefault(w, len(self.words))
            if number == len(self.spelled):
                self.spelled.append(w)
            known.append(number)
        word = np.array(known, np.int64)[slices.indices.to_numpy()]
        end = np.repeat(first[1:], np.diff(first))
        levels, node = [], np.zeros(n, np.int64)
        for k in range(self.most):
            fits = np.flatnonzero(np.arange(n) + k < end)
            following = np.full(n, -1, np.int64)
            following[fits] = self._nodes((node[fits] << 32) | word[fits + k])
            levels.append(following)
            node = following
        return levels

    def count(self, levels: list[np.ndarray]) -> None:
        self.counts = np.pad(self.counts, (0, len(self.crc) - len(self.counts)))
        for nodes in levels:
            self.counts += np.bincount(nodes[nodes >= 0], minlength=len(self.counts))

    def buckets(self, n: int) -> np.ndarray:
        """Each node's bucket, by the CRC of its run."""
        if len(self.dealt) < len(self.crc):
            self.dealt = np.concatenate([self.dealt, np.array(self.crc[len(self.dealt) :], np.int64) % n])
        return self.dealt


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in parts(offsets):
        yield word_slices(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def bucket_totals(texts: DataFrame, text: str, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; `buckets` numbers reach the driver."""
    batches_of(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(most), np.zeros(buckets, np.int64)

        def merge() -> None:
            np.add.at(totals, trie.buckets(buckets)[: len(trie.counts)], trie.counts)
            trie.clear()

        for batch in given_back(batches):
            for piece in _slices(batch.column(0)):
                trie.count(trie.walk(*piece))
                if len(trie.crc) > NODES:
                    merge()
        merge()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the floored thousandfold logarithm of its share of the target by its share of the source."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + float(n)) / ((source + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str, key: str, most: int) -> DataFrame:
    """The key, n_features, words (how many) and weight of each row."""
    batches_of(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(most)
        for batch in given_back(batches):
            features, words, weights = [], [], []
            for piece in _slices(batch.column(1)):
                if len(trie.crc) > NODES:
                    trie.clear()
                levels = trie.walk(*piece)
                of = gain[trie.buckets(len(gain))]
                first = piece[2]
                total = np.zeros(len(first) - 1, np.int64)
                n = np.zeros(len(first) - 1, np.int64)
                for nodes in levels:
                    there = nodes >= 0
                    for out, values in ((total, np.where(there, of[nodes], 0)), (n, there.astype(np.int64))):
                        sums = np.concatenate([[0], np.cumsum(values)])
                        out += sums[first[1:]] - sums[first[:-1]]
                features.append(n), words.append(np.diff(first)), weights.append(np.where(n > 0, total // np.maximum(n, 1), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (features, words, weights))], ["id", "n_features", "words", "weight"])

    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_features bigint, words bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """The floored thousandfold Gumbel key of an id, drawn by a hash of seed and id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """The key, n_features, weight, score and rank (1 is drawn first, null is not drawn) of each document.

    Of the documents with at least `least_words` words, `percent` of a hundred are drawn, rounded down.
    """
    gain = gains(bucket_totals(docs, text, most, buckets), bucket_totals(target, target_text, most, buckets))
    rows = weighted(docs, gain, text, key, most)
    rows = stored(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "weights")
    fit = rows.where(F.col("words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = numbered(fit, [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("row")])
    out = [F.col("id").alias(key), "n_features", "weight", "score"]
    ranked = placed.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))
    return ranked.unionByName(rows.where(F.col("words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
