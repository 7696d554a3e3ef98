"""Token counts without ids: each distinct pre-token is counted once, and counts are joined to documents' frequencies.

1. Texts are cut into pre-tokens (bpe.pieces, the encoder's scan); distinct ones of each batch are added up, and every
   distinct pre-token of the corpus becomes one row of a stored table, with its occurrences and its number of tokens.
2. Texts are cut again into (document, pre-token, frequency). The most frequent pre-tokens, at most HOT of at most
   HOT_BYTES bytes, meet their counts through a broadcast table; the others, which none of the hot keys is among, are rows
   that meet theirs in a join. Frequencies times counts are summed by document. No ids exist at any time.

The tokenizer file is the `tokenizers` library's JSON of a byte-level BPE. Added special strings inside a text count as
one token each and part it, which is the library's default. Null text counts as empty; repeated rows are counted alike;
ids may be null or repeat, as rows are numbered. Whole texts of any length are counted. Columns named like the results are
replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.bpe import Merger, distinct_slices, pieces
from corpuscope.llm.shared import batches_of, given_back, parts, stored, utf8

#: Bounds of the broadcast table: pre-tokens, and bytes of each.
HOT, HOT_BYTES = 1 << 17, 64


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_letters()
        raw = lambda s: bytes(as_byte[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec.get("added_tokens", [])}}
        sides = np.array([(vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in pairs], np.int64)
        self.merger = Merger(np.array([vocab[bytes([b])] for b in range(256)]), sides[:, 0], sides[:, 1], np.arange(len(sides)), sides[:, 2])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))).encode()) if special else None

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens (large_binary); document and pre-token's number of each occurrence; special tokens of each document."""
        raw = data.tobytes()
        n = len(offsets) - 1
        extra = np.zeros(n, np.int64)
        owner, bounds = np.arange(n), offsets
        if self.special and (found := list(self.special.finditer(raw))):
            rows = np.searchsorted(offsets, [m.start() for m in found], side="right") - 1
            keep = [(m, r) for m, r in zip(found, rows.tolist(), strict=True) if m.end() <= offsets[r + 1]]
            np.add.at(extra, [r for _, r in keep], 1)
            marks = sorted({*offsets.tolist(), *(x for m, _ in keep for x in m.span())})
            inside = {m.start() for m, _ in keep}
            bounds = np.array(marks)
            owner = np.searchsorted(offsets, bounds[:-1], side="right") - 1
            owner[[k for k, x in enumerate(marks[:-1]) if x in inside]] = -1
        starts, first = pieces(data, bounds)
        row = np.repeat(owner, np.diff(first))
        found, which = distinct_slices(raw, starts)
        if (row < 0).any():  # special strings; as pre-tokens, their own letters have no occurrences
            row, which = row[row >= 0], which[row >= 0]
        return found, row, which, extra

    def frequencies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens; document, pre-token's number and frequency of each pair; special tokens of each document."""
        found, row, which, extra = self.occurrences(data, offsets)
        pairs, times = np.unique(row * max(1, len(found)) + which, return_counts=True)
        return found, pairs // max(1, len(found)), pairs % max(1, len(found)), times, extra


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """Read once for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def piece_counts(texts: DataFrame, path: str) -> DataFrame:
    """piece, freq (its occurrences) and tokens of each distinct pre-token; texts has one column."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in given_back(batches):
            data, offsets = utf8(batch.column(0))
            for a, b in parts(offsets):
                found, _, which, _ = tool.occurrences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), pa.array(np.bincount(which, minlength=len(found)))], ["piece", "freq"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tool.merger.counts(batch.column(0).to_pylist()))], ["piece", "freq", "tokens"])

    # A special string's own letters have no occurrences as a pre-token.
    distinct = texts.mapInArrow(cut, "piece binary, freq bigint").where("freq > 0").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return stored(distinct.mapInArrow(count, "piece binary, freq bigint, tokens bigint"), "pieces")


def hot_key(piece: bytes) -> bytes:
    """A pre-token, or a longer one's digest with a byte before it, so that no short pre-token is like it."""
    return piece if len(piece) <= HOT_BYTES else b"\0" + hashlib.sha512(piece).digest()


def hot_pieces(counts: DataFrame) -> tuple[dict[bytes, int], float]:
    """Tokens of the most frequent pre-tokens by their keys, and the level of frequency from which on they are taken."""
    level = F.floor(F.log2("freq") * 8)
    total, least = 0, float("inf")
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundreds of rows
        total += r["count"]
        if total > HOT:
            break
        least = float(r["level"])
    key = F.when(F.octet_length("piece") <= HOT_BYTES, F.col("piece")).otherwise(F.unhex(F.concat(F.lit("00"), F.sha2("piece", 512))))
    rows = counts.where(level >= least).select(key.alias("key"), "tokens").toArrow()  # at most HOT rows of at most 65 bytes
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), least


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """The columns `keep` (all if None), n_bytes and n_tokens of each text, and over_limit if a limit is given."""
    spark = df.sparkSession
    batches_of(spark)
    names = [c for c in (df.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    counts = piece_counts(df.select(text), path)
    hot, _ = hot_pieces(counts)
    shared = spark.sparkContext.broadcast(hot)
    src = df.select(F.struct(*names).alias("kept") if names else F.struct(F.lit(0).alias("none")).alias("kept"), F.col(text).alias("text"))
    kept = src.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = counter(path), shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in given_back(batches):
            data, offsets = utf8(batch.column(1))
            for a, b in parts(offsets):
                found, doc, which, times, total = tool.frequencies(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tokens = np.fromiter((known.get(hot_key(p), -1) for p in found.cast(pa.binary()).to_pylist()), np.int64, len(found))[which]
                np.add.at(total, doc[tokens >= 0], (times * tokens)[tokens >= 0])
                cold = np.flatnonzero(tokens < 0)
                rest = pa.StructArray.from_arrays([found.take(pa.array(which[cold])).cast(pa.binary()), pa.array(times[cold], pa.int64())], ["piece", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[cold], np.arange(b - a + 1)), pa.int32()), rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(total), rest], ["row", "kept", "n_bytes", "known", "rest"])
                row += b - a

    rows = stored(src.mapInArrow(run, f"row bigint, kept {kept}, n_bytes bigint, known bigint, rest array<struct<piece:binary,times:bigint>>"), "frequencies")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times")
    more = rare.join(counts.select("piece", "tokens").hint("merge"), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("more"))
    out = rows.select("row", "kept", "n_bytes", "known").join(more, "row", "left")
    out = out.select(*(F.col(f"kept.`{c}`").alias(c) for c in names), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
