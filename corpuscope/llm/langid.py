"""Language identification with string kernels.

A text is seen through windows of nearly equal length, at most `WINDOW` code points each, so that a long text is as
legible as a short one. A window's features are the blended spectrum of its case-folded n-grams of 1 to `MAX_N` code
points, as presence bits in a hashed space; the kernel of two windows is the number of n-grams that both hold, normalised
to the cosine. A bounded sample of labelled rows, one window of each, gives Nyström landmarks and training points;
one-versus-rest kernel ridge regression is solved in the landmarks' feature space. Scoring multiplies batches of presence
rows with the landmarks, then with the dual weights; a text's outputs are the means of those of all its windows.

Texts that are null or hold no letter are `und` with score 0, and never train; so is everything if nothing could be
learned (no labelled rows, an empty table). Any number of languages is learned. Ties go to the smaller language by code
point. Ids play no part, so they may be null or repeat; repeated rows are scored alike and train once. Whole texts of any
length are read, window by window. Other columns stay, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.shared import WORK_BYTES, batches_of, mixed, parts, stored, utf8

MAX_N = 4
BITS = 14
#: Code points of a window at most: their n-grams set well under half of the bits.
WINDOW = 2048
#: Bounds of the sample: training rows and landmarks in all, shared evenly by the languages, LEAST rows of each at least.
SAMPLE_ROWS = 1200
LANDMARKS = 160
LEAST = 4
RIDGE = 1e-2
UND = "und"


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded code points of the rows, and their offsets."""
    texts = [data[a:b].tobytes().decode().lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all rows' windows in a row, and each row's first window (and their number); an empty row is one window."""
    lens = np.diff(offsets)
    many = np.maximum(1, -(-lens // WINDOW))
    first = np.concatenate([[0], np.cumsum(many)])
    turn = np.arange(first[-1]) - np.repeat(first[:-1], many)
    starts = np.repeat(offsets[:-1], many) + turn * np.repeat(lens, many) // np.repeat(many, many)
    return np.append(starts, offsets[-1]), first


def presence(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of presence bits (uint8) of the hashed n-grams; runs of digits and of white space read as one kind each."""
    n, size = len(offsets) - 1, 1 << BITS
    out = np.zeros((n, size), np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(offsets))
    flat = out.reshape(-1)
    c = cp.astype(np.uint64)
    c[(cp >= 48) & (cp <= 57)] = 48
    c[(cp <= 32) | (cp == 160)] = 32
    h = c.copy()
    for k in range(MAX_N):
        if k:
            h = h[:-1] * np.uint64(1000003) + c[k:]
        if not len(h):
            break
        inside = row[: len(h)] == row[k:]
        at = (mixed(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) + row[: len(h)]
        flat[at if k == 0 else at[inside]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence rows as float32, each divided by its norm
    dual: np.ndarray  # landmarks x languages

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Ridge outputs of presence rows, about -1 to 1."""
        x = bits.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        return (x @ self.landmarks.T / norm) @ self.dual


def fitted(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """Nyström features of all sampled rows from evenly chosen landmarks, then ridge regression for each language."""
    if not len(labels):
        return None
    languages = sorted(set(labels))
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    each = max(1, landmarks // len(languages))
    lab = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(lab == one)[:each] for one in languages])
    z = x[chosen]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K_mm ** -1/2, without its null space
    phi = (x @ z.T).astype(np.float64) @ root
    y = np.where(lab[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.sqrt(len(lab) / (len(languages) * np.array([(lab == one).sum() for one in lab], float)))[:, None]
    a = (phi * weight).T @ (phi * weight) + RIDGE * len(lab) / 100 * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * weight).T @ (y * weight))
    return Model(languages, z, (root @ w).astype(np.float32))


def sample_bits(rows: DataFrame, text: str, lang: str) -> tuple[np.ndarray, list[str]]:
    """Presence bits of a window of each sampled text: SAMPLE_ROWS texts in all, or LEAST of each language if that is more.

    Distinct texts are drawn by their hash, so however often an id, a text or a language repeats, what is ranked, shuffled
    and collected stays bounded: only hashes below a bound that leaves about twice its quota of a language are ranked.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(17)))
    drawn = stored(rows.select("lang", "hash"), "language-hashes")
    sizes = drawn.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n"))
    languages = sizes.count()
    if not languages:
        return np.zeros((0, 1 << BITS), np.uint8), []
    each = max(LEAST, SAMPLE_ROWS // languages)
    share = (2 * each + 100) / F.col("n")
    bounds = sizes.select("lang", F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * float(2**64) - float(2**63)).cast("long")).alias("bound"))
    # One row for each language, as the model has too.
    few = drawn.join(F.broadcast(bounds), "lang").where("hash <= bound").select("lang", "hash").distinct()
    few = few.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("turn") <= each).select("lang", "hash")
    # At most SAMPLE_ROWS (or LEAST for each language) pairs of a language and a hash.
    picked = rows.join(F.broadcast(few), ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for k in range(len(batch)):  # one row at a time: bits of a batch would be large
                cp, off = codepoints(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k])
                cut, _ = windows(off)
                one = batch.column(2)[k].as_py() % (len(cut) - 1)
                bits = presence(cp[cut[one] : cut[one + 1]], np.array([0, cut[one + 1] - cut[one]]))
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits[0]).tobytes()]), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)], ["bits", "lang", "hash"])

    batches_of(spark)
    got = picked.select("text", "lang", "hash").mapInArrow(run, "bits binary, lang string, hash bigint").collect()
    got.sort(key=lambda r: (r.hash, r.lang))
    return np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), np.uint8)).reshape(len(got), 1 << BITS), [r.lang for r in got]


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from labelled rows; None if there are none. The model grows with the number of languages only."""
    return fitted(*sample_bits(rows, text, lang))


def predicted(model: Model | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    langs, scores = [UND] * n, [0.0] * n
    if model is None:
        return langs, scores
    for a, b in parts(offsets, WORK_BYTES // 4):
        cp, off = codepoints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        text = cp.tobytes().decode("utf-32-le")
        cut, first = windows(off)
        f = np.concatenate([model.scores(presence(cp[cut[c] : cut[d]], cut[c : d + 1] - cut[c])) for c in range(0, len(cut) - 1, 128) for d in [min(len(cut) - 1, c + 128)]])
        f = np.add.reduceat(f, first[:-1], axis=0) / np.diff(first)[:, None]
        best = f.argmax(1)
        for k in range(b - a):
            if any(map(str.isalpha, text[off[k] : off[k + 1]])):
                langs[a + k] = model.languages[best[k]]
                scores[a + k] = float(min(1.0, max(0.0, (f[k, best[k]] + 1) / 2)))
    return langs, scores


def identify(df: DataFrame, model: Model | None, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its score. The model's size is bounded by LANDMARKS, whatever the data."""
    batches_of(df.sparkSession)
    src = df.drop(lang_out, score_out) if text not in (lang_out, score_out) else df
    at = src.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predicted(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_out, score_out])

    return src.mapInArrow(run, f"{fields}, `{lang_out}` string, `{score_out}` double")


def in_training(key: Column) -> Column:
    """The fold that may be learned from: crc32 of the key as text leaves another remainder than 2 on division by 4."""
    return ~F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
