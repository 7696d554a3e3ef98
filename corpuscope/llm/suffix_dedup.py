"""Removal of repeated passages with a distributed, common-prefix-aware merge sort of suffixes.

Every byte covered by a string of LENGTH bytes that also starts earlier (in an earlier document, or earlier in the same
one) is removed. Strings never cross documents, and all are judged on the input.

1. Texts are packed into chunks, the unit of all later work.
2. In every window of LENGTH bytes the smallest hash of its GRAM-byte strings picks an anchor, so equal windows have
   equal anchors. Chunks exchange the hashes of their distinct anchors; what occurs once can't be in a repeat.
3. Anchors with equal surroundings hold the same windows, so all but the first are repeats: they are settled within each
   chunk, then between chunks, which exchange hashes of their surroundings and learn which of them are the first.
4. The suffixes at the anchors that are left are sorted in each chunk and leave as sorted, front-coded runs, dealt by ranges of
   suffixes. An anchor whose gram stands in more than HOT_CHUNKS chunks leaves as up to SIDES rows, each for the windows that
   hold the gram at some of its places: these windows share most of what is around the gram, and are dealt by it, so a
   common line is many groups. Very large corpora have several classes of grams, each with its own ranges.
5. Each range merges its runs with a loser tree that knows the common prefix of every player with the last winner and
   compares only what follows it. Suffixes that share a gram end up side by side; their windows are compared by hash,
   and all but the earliest of equal windows are repeats.
6. Repeats go back to their chunks, where the bytes they cover are cut out.

So of a passage that all documents hold one copy reaches a range, and what a task is sent for it is a hash from each chunk.

Null text counts as empty. A null id comes before all others; rows that repeat an id are ordered by where they are stored.
Texts shorter than LENGTH stay whole, longer ones are a chunk of their own, of any length. No column but text and key is
read, so others may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, mixed, powers, stored, utf8

LENGTH, GRAM = 100, 32
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of anchor hashes that one task collects.
BUCKET_BYTES = 32 << 20
#: Suffixes whose windows are hashed at once, and how many slices' windows are compared at once.
SLICE, SLICES = 6000, 8
#: Bytes of text for each range of suffixes, and ranges for each class of grams: beyond that there are several classes, each
#: with ranges of its own, so that neither a range nor the list of splitters grows with the corpus.
RANGE_BYTES, RANGES = 16 << 20, 4096
#: Chunks from which on a gram's windows are dealt by what they share, and into how many kinds they fall by the gram's place.
HOT_CHUNKS, SIDES = 64, 4
NO_ID = np.iinfo(np.int64).min


# --- chunks --------------------------------------------------------------------------------------------------------


def pack_chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """chunk, ids and lengths of its documents, their compressed bytes and a few prefixes (8 bytes, halved) as a sample."""
    batches_of(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made = TaskContext.get().partitionId(), 0
        ids, lens, held = [], [], []
        pack = zstandard.ZstdCompressor(level=6).compress  # kept and dealt twice

        def chunk() -> pa.RecordBatch:
            nonlocal made
            data = np.concatenate(held)
            at = np.linspace(0, max(0, len(data) - 8), 48).astype(np.int64) if len(data) >= 8 else np.zeros(0, np.int64)
            sample = (prefixes(data, at) >> np.uint64(1)).astype(np.int64)
            made += 1
            row = [pid << 24 | made, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(lens).astype("<i4").tobytes(), pack(data.tobytes()), sample.tolist(), len(data)]
            ids.clear(), lens.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()), strict=True)], ["chunk", "ids", "lens", "packed", "sample", "size"])

        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            number = batch.column(0).to_numpy(zero_copy_only=False)
            a = 0
            while a < len(number):
                b = int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES - size, side="right")) - 1
                b = min(len(number), max(b, a + (size == 0)))
                if b > a:
                    ids.append(number[a:b]), lens.append(np.diff(offsets[a : b + 1])), held.append(data[offsets[a] : offsets[b]].copy())
                    size += int(offsets[b] - offsets[a])
                if b < len(number) or size >= CHUNK_BYTES:
                    yield chunk()
                    size = 0
                a = b
        if ids:
            yield chunk()

    return src.mapInArrow(run, "chunk bigint, ids binary, lens binary, packed binary, sample array<bigint>, size bigint")


def prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as big-endian numbers."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, document offsets and ids of a chunk."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
    lens = np.frombuffer(row["lens"], "<i4").astype(np.int64)
    return data, np.concatenate([[0], np.cumsum(lens)]), np.frombuffer(row["ids"], "<i8")


# --- anchors -------------------------------------------------------------------------------------------------------


def rolling(data: np.ndarray, width: int, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the strings of `width` bytes at the given places."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    if isinstance(at, slice):
        return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, n)[: n - width + 1])
    return mixed((sums[at + width] - sums[at]) * powers(INVERSE, n)[at])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window start, and gram hash of each anchor; windows that cross documents don't count."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    grams = rolling(data, GRAM, slice(None))
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    least = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    edge = np.zeros(n + 2, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - (LENGTH - 1), -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)])
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    place = (least[starts] & bits).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # Minimum hashes crowd at zero; mixed once more they spread evenly over buckets.
    return place[first], starts[first], starts[last], mixed(grams[place[first]] + np.uint64(1))


def repeated_anchors(chunks: DataFrame, total: int) -> DataFrame:
    """chunk, bucket and bits for each of the chunk's distinct hashes in the bucket: does it occur elsewhere too, in very many chunks?"""
    bits = max(6, int(total * 0.03 * 8 / BUCKET_BYTES).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets, _ = opened(row)
                grams, counts = np.unique(anchors(data, offsets)[3], return_counts=True)
                bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(grams) else np.zeros(0, np.int64)
                ends = np.append(first[1:], len(grams))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[first], pa.int64()),
                        pa.array([row["chunk"]] * len(first), pa.int64()),
                        pa.array([grams[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                        pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                    ],
                    ["bucket", "chunk", "grams", "twice"],
                )

    def meet(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        lens = np.array([len(x) for x in rows])
        grams = np.concatenate(rows)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(t.column("twice").to_pylist(), lens, strict=True)]).astype(bool)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(grams), bool)
        again[order] = np.append(same, False) | np.append(False, same)
        again |= twice
        first = np.flatnonzero(np.append(True, ~same))
        sizes = np.diff(np.append(first, len(grams)))
        hot = np.zeros(len(grams), bool)
        hot[order] = np.repeat(sizes > HOT_CHUNKS, sizes)
        cut = np.cumsum(lens) - lens
        keep = np.add.reduceat(again, cut) > 0
        bits_of = lambda x: pa.array([np.packbits(x[a : a + n]).tobytes() for a, n, k in zip(cut, lens, keep, strict=True) if k], pa.binary())
        kept = pa.array(keep)
        return pa.table({"chunk": t.column("chunk").filter(kept), "bucket": t.column("bucket").filter(kept), "flags": bits_of(again), "hot": bits_of(hot)})

    sent = chunks.select("chunk", "ids", "lens", "packed").mapInArrow(send, "bucket bigint, chunk bigint, grams binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket bigint, flags binary, hot binary").withColumn("bits", F.lit(bits))


# --- sorted runs ---------------------------------------------------------------------------------------------------


#: Least and largest distance of the gram from the start of the windows of each kind.
_SIDES = [(a, a + (LENGTH - GRAM) // SIDES - 1 if k + 1 < SIDES else LENGTH - GRAM) for k in range(SIDES) for a in [k * ((LENGTH - GRAM) // SIDES)]]


def run_of(texts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Front coding of sorted suffixes (rows padded to LENGTH): common prefixes with the row before, and what follows."""
    common = np.zeros(len(texts), np.uint8)
    if len(texts) > 1:
        differ = texts[1:] != texts[:-1]
        common[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), LENGTH), np.minimum(lens[1:], lens[:-1]))
    column = np.arange(LENGTH)
    return common, texts[(column >= common[:, None]) & (column < lens[:, None])].tobytes()


class Repeated:
    """A chunk's anchors whose gram occurs elsewhere too. Of those with equal surroundings, all but the first are settled."""

    def __init__(self, row: dict, flags: list[dict]) -> None:
        self.data, self.offsets, self.ids = opened(row)
        data, offsets, ids = self.data, self.offsets, self.ids
        place, first, last, gram = anchors(data, offsets)
        grams, which = np.unique(gram, return_inverse=True)
        dup, common = np.zeros(len(grams), bool), np.zeros(len(grams), bool)
        for x in flags:
            lo, hi = np.searchsorted((grams >> np.uint64(64 - x["bits"])).astype(np.int64), [x["bucket"], x["bucket"] + 1])
            dup[lo:hi] = np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: hi - lo]
            common[lo:hi] = np.unpackbits(np.frombuffer(x["hot"], np.uint8))[: hi - lo]
        pick = dup[which]
        place, first, last, gram, hot = place[pick], first[pick], last[pick], gram[pick], common[which][pick]
        end = last + LENGTH
        doc = np.searchsorted(offsets, place, side="right") - 1
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
        around = mixed((sums[end] - sums[first]) * powers(INVERSE, len(data))[first]) + mixed((end - first).astype(np.uint64) << np.uint64(8) | (place - first).astype(np.uint64))
        order = np.lexsort((place, rank[doc], around, gram))
        again = np.append(False, (gram[order][1:] == gram[order][:-1]) & (around[order][1:] == around[order][:-1]))
        self.settled, self.kept = order[again], order[~again]
        self.sums, self.place, self.first, self.end, self.doc, self.gram, self.hot, self.around = sums, place, first, end, doc, gram, hot, around

    def dealt(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The kept anchors in the order of their buckets by surroundings, and these buckets."""
        bucket = (mixed(self.gram[self.kept] ^ mixed(self.around[self.kept])) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return self.kept[order], bucket[order]


def first_surroundings(chunks: DataFrame, flags: DataFrame, total: int) -> DataFrame:
    """chunk, bucket and bits for each of the chunk's kept anchors in the bucket: does an earlier document have the same surroundings?"""
    bits = max(6, int(total * 0.03 * 20 / BUCKET_BYTES).bit_length())

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(right) and len(left):
            r = Repeated(left.to_pylist()[0], right.to_pylist())
            kept, bucket = r.dealt(bits)
            for b, a, z in _spans(bucket):
                k = kept[a:z]
                rows.append((b, r.around[k].tobytes(), r.gram[k].astype("<u4").tobytes(), r.ids[r.doc[k]].astype("<i8").tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("around", "gram", "ids"), cols[1:], strict=True)}})

    def meet(t: pa.Table) -> pa.Table:
        flat = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        around, lens = flat("around", np.uint64), np.array([len(x) // 8 for x in t.column("around").to_pylist()])
        around, gram, ids = np.concatenate(around), np.concatenate(flat("gram", "<u4")), np.concatenate(flat("ids", "<i8"))
        chunk = np.repeat(t.column("chunk").to_numpy(), lens)
        order = np.lexsort((chunk, ids, gram, around))
        later = np.zeros(len(around), bool)
        later[order[1:]] = (around[order][1:] == around[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        cut = np.cumsum(lens) - lens
        some = np.add.reduceat(later, cut) > 0
        kept = pa.array(some)
        return pa.table({"chunk": t.column("chunk").filter(kept), "bucket": t.column("bucket").filter(kept), "flags": pa.array([np.packbits(later[a : a + n]).tobytes() for a, n, k in zip(cut, lens, some, strict=True) if k], pa.binary())})

    sent = chunks.select("chunk", "ids", "lens", "packed").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(send, "bucket bigint, chunk bigint, around binary, gram binary, ids binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket bigint, flags binary").withColumn("bits", F.lit(bits))


def _spans(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each span of equal values."""
    if len(values):
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        yield from zip(values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)], strict=True)


def sorted_runs(chunks: DataFrame, flags: DataFrame, splitters: list[int], classes: int) -> DataFrame:
    """Two kinds of rows by chunk: sorted runs for a range (part), and repeats settled in the chunk (part below 0).

    flags has the rows of repeated_anchors and those of first_surroundings, whose `hot` is null.
    """
    limits = np.array(splitters, np.int64)
    fields = "part int, chunk bigint, payload binary"

    def make(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        pack = zstandard.ZstdCompressor(level=3).compress
        told = right.to_pylist()
        if told and len(left):
            r = Repeated(left.to_pylist()[0], [x for x in told if x["hot"] is not None])
            data, offsets, ids, sums = r.data, r.offsets, r.ids, r.sums
            place, first, end, doc, gram, hot = r.place, r.first, r.end, r.doc, r.gram, r.hot
            settled, kept = r.settled, r.kept
            if later := [x for x in told if x["hot"] is None]:
                kept, bucket = r.dealt(later[0]["bits"])
                repeat = np.zeros(len(kept), bool)
                for x in later:
                    lo, hi = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
                    repeat[lo:hi] = np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: hi - lo]
                # What a chunk settled itself repeats its own first one, which may be a repeat in turn.
                settled, kept = np.concatenate([settled, kept[repeat]]), kept[~repeat]
            if len(settled):
                out.append((-1 - key[0].as_py() % (classes * (len(limits) + 1)), pack(np.stack([doc[settled], (first - offsets[doc])[settled], (end - offsets[doc])[settled]]).astype("<i4").tobytes())))
            place, first, end, doc, gram, hot = place[kept], first[kept], end[kept], doc[kept], gram[kept], hot[kept]
            part = np.searchsorted(limits, (prefixes(data, place) >> np.uint64(1)).astype(np.int64), side="right") + (gram % np.uint64(classes)).astype(np.int64) * (len(limits) + 1)
            rows_of = [(x[~hot] for x in (place, first, end, doc, part))]
            for side, (low, high) in enumerate(_SIDES if hot.any() else ()):
                # Windows that hold the gram `low` to `high` bytes from their start hold all from `low` bytes before it on.
                start = np.maximum(first[hot], place[hot] - high)
                stop = np.minimum(end[hot] - LENGTH, place[hot] - low)
                some = start <= stop
                at, start, stop = place[hot][some], start[some], stop[some]
                a, z = at - low, at + LENGTH - high
                shared = mixed(mixed((sums[z] - sums[a]) * powers(INVERSE, len(data))[a]) + np.uint64(side))
                rows_of.append((at, start, stop + LENGTH, doc[hot][some], classes * (len(limits) + 1) + (shared % np.uint64(classes * (len(limits) + 1))).astype(np.int64)))
            place, first, end, doc, part = map(np.concatenate, zip(*rows_of, strict=True))
            # Sorted suffixes at the anchors, as far as windows reach.
            lens = end - place
            column = np.arange(LENGTH)
            rows = np.where(column < lens[:, None], data[np.minimum(place[:, None] + column, len(data) - 1)], 0).astype(np.uint8)
            order = np.argsort(rows.view(f"S{LENGTH}").ravel(), kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            part, rows, lens, place, first, doc = part[order], rows[order], lens[order], place[order], first[order], doc[order]
            for p in np.unique(part):
                mine = slice(*np.searchsorted(part, [p, p + 1]))
                common, rest = run_of(rows[mine], lens[mine])
                ahead = place[mine] - first[mine]
                before = np.concatenate([data[a:b] for a, b in zip(first[mine], place[mine], strict=True)])
                body = [common, lens[mine].astype(np.uint8), ahead.astype(np.uint8), doc[mine].astype("<i4"), (place - offsets[doc])[mine].astype("<i4"), ids[doc[mine]].astype("<i8"), np.frombuffer(rest, np.uint8), before]
                head = np.array([len(common), len(rest), len(before)], "<i8")
                out.append((int(p), pack(head.tobytes() + b"".join(x.tobytes() for x in body))))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "payload": pa.array([x for _, x in out], pa.binary())})

    return chunks.select("chunk", "ids", "lens", "packed").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(make, fields)


# --- merging -------------------------------------------------------------------------------------------------------


class Run:
    """A decoded front-coded run."""

    def __init__(self, chunk: int, payload: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n, rest, before = np.frombuffer(raw, "<i8", 3).tolist()
        self.n, at = n, 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.common, self.lens, self.ahead = take("u1", n), take("u1", n), take("u1", n)
        self.doc, self.place, self.ids = take("<i4", n), take("<i4", n), take("<i8", n)
        self.rest, self.before = take("u1", rest).tobytes(), take("u1", before)
        self.chunk = np.full(n, chunk, np.int64)
        self.fronts = np.cumsum(np.append(0, self.ahead.astype(np.int64)))
        self.ends = np.cumsum(np.append(0, self.lens.astype(np.int64)))
        self.plain = b""

    def suffixes(self) -> Iterator[tuple[bytes, int]]:
        """Each suffix and its common prefix with the one before, undone from front coding."""
        at, last = 0, b""
        whole = []
        for common, size in zip(self.common.tolist(), self.lens.tolist(), strict=True):
            last = last[:common] + self.rest[at : at + size - common]
            at += size - common
            whole.append(last)
            yield last, common
        self.plain = b"".join(whole)

    def around(self, i: int) -> bytes:
        """What stands before an anchor, and its suffix; once all suffixes were read."""
        return self.before[self.fronts[i] : self.fronts[i + 1]].tobytes() + self.plain[self.ends[i] : self.ends[i + 1]]


def first_difference(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    most = min(len(a), len(b))
    while known < most and a[known : known + 8] == b[known : known + 8]:
        known += 8
    known = min(known, most)
    while known < most and a[known] == b[known]:
        known += 1
    return known


class LoserTree:
    """Merges sorted runs. Every player's common prefix with the last winner is known: of two players the one with the
    longer prefix is smaller, and only players with equal prefixes are compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]) -> None:
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.text: list[bytes | None] = [None] * self.k
        self.common = [0] * self.k
        for r, it in enumerate(runs):
            self.text[r], _ = next(it, (None, 0))
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner. Finished runs lose."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.common[a], self.common[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        same = first_difference(x, y, p)
        if x[same:] <= y[same:]:
            self.common[b] = same
            return a, b
        self.common[a] = same
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, loser = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Runs in the order of their suffixes, each with the common prefix with the suffix before."""
        text, common, losers = self.text, self.common, self.losers
        while text[self.winner] is not None:
            w = self.winner
            yield w, common[w]
            text[w], common[w] = next(self.runs[w], (None, 0))  # front coding has its prefix with the last winner
            node = (w + self.k) >> 1
            while node:
                w, losers[node] = self._play(w, losers[node])
                node >>= 1
            self.winner = w


def window_repeats(parts: list[Run], base: np.ndarray, pick: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Chunk, document, from and to of what repeats an earlier window among the picked suffixes of some groups."""
    owner = np.searchsorted(base, pick, side="right") - 1
    row = pick - base[owner]
    get = lambda name: np.array([getattr(parts[o], name)[i] for o, i in zip(owner.tolist(), row.tolist(), strict=True)], np.int64)
    lens, ahead, doc, place, ids, chunk = map(get, ("lens", "ahead", "doc", "place", "ids", "chunk"))
    early = np.empty(len(pick), np.int64)
    early[np.lexsort((place, doc, chunk, ids))] = np.arange(len(pick))
    low, high = np.full(len(pick), LENGTH * 4), np.full(len(pick), -1)
    # A group too large for memory is compared in passes, each for the windows whose hash falls to it.
    passes = -(-len(pick) // (SLICE * SLICES))
    for one in range(passes):
        got = []
        for lo in range(0, len(pick), SLICE):
            part = slice(lo, lo + SLICE)
            # Surroundings of the picked anchors in a row: what is before the anchor, then its suffix.
            flat = np.frombuffer(b"".join(parts[o].around(i) for o, i in zip(owner[part].tolist(), row[part].tolist(), strict=True)), np.uint8)
            size = ahead[part] + lens[part]
            at, windows = np.cumsum(size) - size, size - LENGTH + 1
            item = np.repeat(np.arange(len(size)), windows)
            step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            value = rolling(flat, LENGTH, at[item] + step)
            item += lo
            inside = (ahead[item] - step).astype(np.uint64)  # the anchor's place in the window
            value = mixed(value + mixed(group[item].astype(np.uint64) << np.uint64(8) | inside))
            if passes > 1:
                mine = value % np.uint64(passes) == one
                value, item, step = value[mine], item[mine], step[mine]
            got.append((value, item, step))
        value, item, step = map(np.concatenate, zip(*got, strict=True))
        by = np.lexsort((early[item], value))
        value, item, step = value[by], item[by], step[by]
        again = np.append(False, value[1:] == value[:-1])
        np.minimum.at(low, item[again], step[again])
        np.maximum.at(high, item[again], step[again])
    hit = np.flatnonzero(high >= 0)
    begin = place - ahead
    return np.stack([chunk[hit], doc[hit], begin[hit] + low[hit], begin[hit] + high[hit] + LENGTH])


def merged_repeats(runs: DataFrame) -> DataFrame:
    """Repeats found among the runs of each range, and those settled before: chunk and payload (document, from, to)."""

    def merge(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() < 0:
            return t.select(["chunk", "payload"])
        t = t.sort_by("chunk")
        parts = [Run(c, p) for c, p in zip(t.column("chunk").to_pylist(), t.column("payload").to_pylist(), strict=True)]
        base = np.cumsum([0, *(r.n for r in parts)]).tolist()
        seen = [0] * len(parts)
        order, common = [], []
        for r, c in LoserTree([r.suffixes() for r in parts]):
            order.append(base[r] + seen[r])
            seen[r] += 1
            common.append(c)
        order, common = np.array(order, np.int64), np.array(common, np.int64)
        group = np.cumsum(common < GRAM)  # suffixes that share their gram
        together = np.bincount(group)[group] > 1
        pick, group = order[together], group[together]
        chunks: list[int] = []
        payloads: list[bytes] = []
        # Whole groups at a time, about SLICE suffixes: windows are many times more than suffixes.
        fresh = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(pick) else np.zeros(0, np.int64)
        found: list[np.ndarray] = []
        lo = 0
        while lo < len(pick):
            hi = int(np.searchsorted(fresh, lo + SLICE))
            hi = int(fresh[hi]) if hi < len(fresh) else len(pick)
            found.append(window_repeats(parts, np.array(base), pick[lo:hi], group[lo:hi]))
            lo = hi
        hits = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        for c in np.unique(hits[0]):
            chunks.append(int(c))
            payloads.append(zstandard.ZstdCompressor(level=3).compress(hits[1:, hits[0] == c].astype("<i4").tobytes()))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return runs.groupBy("part").applyInArrow(merge, "chunk bigint, payload binary")


# --- removal -------------------------------------------------------------------------------------------------------


def removed(chunks: DataFrame, repeats: DataFrame, with_text: bool) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of each document."""
    more = ", kept binary" if with_text else ""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))}
        for row in left.to_pylist():
            data, offsets, ids = opened(row)
            edge = np.zeros(len(data) + 1, np.int64)
            for x in right.column("payload").to_pylist():
                doc, a, b = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i4").astype(np.int64).reshape(3, -1)
                np.add.at(edge, offsets[doc] + a, 1)
                np.add.at(edge, offsets[doc] + b, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                mask = gone[a:b]
                kept = data[a:b][~mask].tobytes()
                got["id"].append(None if ids[i] == NO_ID else int(ids[i]))
                got["n_bytes"].append(b - a)
                got["n_removed"].append(b - a - len(kept))
                got["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                got["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    got["kept"].append(kept)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items()})

    sides = chunks.select("chunk", "ids", "lens", "packed").groupBy("chunk").cogroup(repeats.groupBy("chunk"))
    return sides.applyInArrow(cut, f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")


def dedup_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the bytes that stay of each document."""
    spark = docs.sparkSession
    chunks = stored(pack_chunks(docs, text, key), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    classes = -(-ranges // RANGES)
    ranges = -(-ranges // classes)
    shares = [k / ranges for k in range(1, ranges)]
    splitters = chunks.select(F.explode("sample").alias("x")).agg(F.percentile_approx("x", shares or [0.5], 20_000)).first()[0] or []
    flags = stored(repeated_anchors(chunks, total), "flags")
    later = first_surroundings(chunks, flags, total).select("chunk", "bucket", "flags", F.lit(None).cast("binary").alias("hot"), "bits")
    repeats = merged_repeats(sorted_runs(chunks, flags.unionByName(later), splitters, classes))
    return removed(chunks, repeats, with_text).withColumnRenamed("id", key)
