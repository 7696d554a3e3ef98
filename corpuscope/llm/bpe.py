"""Byte-level BPE: encoding and decoding.

Pre-tokenisation needs no regular expressions: a table gives each code point's class, neighbours refine it to a symbol
(such as "blank before a word"), and each symbol is a transition function of a small automaton. Functions compose
associatively, so blocks of text are reduced side by side, their functions are combined by a parallel scan, and a second
pass from known states marks where pieces begin. The slices go through cached pair merging; their byte offsets are
kept, so that ids decode to the exact bytes and every token can be traced to its place.

Null text counts as empty and gives no tokens; repeated rows and ties are encoded alike; whole texts are encoded, of any
length; an empty table gives an empty one. Columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, given_back, parts, utf8

# --- classes and symbols -------------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, BLANK, SPACES, LONE_SPACE, QUOTE_2, QUOTE_3 = range(8)
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States: what the piece so far may still take. FRESH: nothing, the next code point begins a piece.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)

_BEGIN = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACES: IN_SPACES, LONE_SPACE: FRESH, QUOTE_2: ONE_LEFT, QUOTE_3: TWO_LEFT}
_JOINS = {
    (IN_LETTERS, LETTER): IN_LETTERS, (IN_NUMBERS, NUMBER): IN_NUMBERS, (IN_SPACES, SPACES): IN_SPACES,
    **{(s, c): IN_OTHER for s in (IN_OTHER, AFTER_BLANK) for c in (OTHER, QUOTE_2, QUOTE_3)},
    (AFTER_BLANK, LETTER): IN_LETTERS, (AFTER_BLANK, NUMBER): IN_NUMBERS, (ONE_LEFT, LETTER): FRESH, (TWO_LEFT, LETTER): ONE_LEFT,
}
#: Next state and "a piece begins here" by symbol (8 to 15: the same at the start of a text) and state.
_NEXT = np.zeros((16, 8), np.int64)
_CUT = np.zeros((16, 8), bool)
for _c in range(8):
    for _s in range(8):
        _NEXT[_c, _s] = _JOINS.get((_s, _c), _BEGIN[_c])
        _CUT[_c, _s] = (_s, _c) not in _JOINS
        _NEXT[_c + 8, _s], _CUT[_c + 8, _s] = _BEGIN[_c], True
BLOCK = 128

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES by code point, as the tokenizer library's own Unicode tables have it."""
    if not _CLASSES:
        import tiktoken

        out = np.full(0x110000, OTHER, np.uint8)
        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            for part in np.array_split(every, 256):
                found = probe.decode_bytes(probe.encode_ordinary("".join(map(chr, part.tolist())))).decode()
                out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
        out[WHITE_SPACE] = SPACES
        _CLASSES.append(out)
    return _CLASSES[0]


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; first: where texts begin."""
    n = len(cp)
    out = classes()[cp]
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = True
    ends[-1] = True
    space = out == SPACES
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = space[:-1] & ~space[1:]
    before_solid[ends] = False
    out[before_solid] = LONE_SPACE
    out[before_solid & (cp == 32)] = BLANK
    quotes = np.flatnonzero((cp == 39) & ~ends)
    if len(quotes):
        one = cp[quotes + 1]
        two = np.where(ends[quotes + 1] | (quotes + 2 >= n), 0, cp[np.minimum(quotes + 2, n - 1)])
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_2
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[long]] = QUOTE_3
    out[first] += 8
    return out


def cuts(symbol: np.ndarray) -> np.ndarray:
    """Where pieces begin: reduce blocks to transition functions, scan the functions, then walk from known states."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, SPACES, np.int64)
    padded[:n] = symbol
    by_step = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * 8
    nxt, cut = _NEXT.reshape(-1), _CUT.reshape(-1)
    function = np.tile(np.arange(8), (blocks, 1))
    merged = None
    for j in range(BLOCK):
        if merged is None:
            function = nxt.take(by_step[j][:, None] + function)
            if j % 8 == 7 and (function == function[:, :1]).all():  # every start has come to the same state
                merged = function[:, 0]
        else:
            merged = nxt.take(by_step[j] + merged)
    if merged is not None:
        function = np.repeat(merged[:, None], 8, axis=1)
    step = 1
    while step < blocks:  # function[i] becomes the composition of blocks 0..i
        function[step:] = np.take_along_axis(function[step:], function[:-step], axis=1)
        step *= 2
    state = np.empty(blocks, np.int64)
    state[0], state[1:] = FRESH, function[:-1, FRESH]
    out = np.empty((BLOCK, blocks), bool)
    for j in range(BLOCK):
        at = by_step[j] + state
        out[j] = cut.take(at)
        state = nxt.take(at)
    return np.flatnonzero(out.T.reshape(-1)[:n])


def distinct_slices(raw: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pieces (large_binary) between the starts, the last of which is the end, and each piece's number among them."""
    slices = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    coded = slices.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pieces begin (and the end of all), and each text's first piece (and the number of pieces)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    nonempty = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts = places[cuts(symbols(cp, np.searchsorted(places, nonempty)))]
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


# --- merging -------------------------------------------------------------------------------------------------------


NO_RANK = np.int64(1) << 40


class Merger:
    """Pair merging of many pieces at once: rounds over all of them, each merging every piece's lowest pair.

    pairs: (left id, right id) to (rank, merged id), kept as a hash table with open addressing in arrays.
    """

    #: Longer pieces are merged one by one with a heap.
    SHORT = 48

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.byte_ids = byte_ids.astype(np.int64)
        keys = left.astype(np.int64) << 24 | right.astype(np.int64)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64), np.zeros(size, np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several keys for a slot one stays
            mine = self.keys[at] == keys[todo]
            self.ranks[at[mine]], self.merged[at[mine]] = rank[todo[mine]], merged[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot without a key where a pair has no rank."""
        keys = left << 24 | right
        at = self._home(keys)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] >= 0)]
        return at

    def one(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, by heap and links."""
        out: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(out)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        slots = self.look_up(np.array(out[:-1], np.int64), np.array(out[1:], np.int64))
        heap = [(r, i, out[i], out[i + 1], m) for i, (r, m) in enumerate(zip(self.ranks[slots].tolist(), self.merged[slots].tolist(), strict=True)) if r < NO_RANK]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            slot = int(self.look_up(np.array([out[i]]), np.array([out[j]]))[0])
            if self.ranks[slot] < NO_RANK:
                heapq.heappush(heap, (int(self.ranks[slot]), i, out[i], out[j], int(self.merged[slot])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if out[i] != a or j >= n or out[j] != b:
                continue
            out[i], out[j] = m, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return np.array([x for x in out if x >= 0], np.int64)

    def merge(self, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty) in a row, and the offsets of each piece's ids."""
        short = [p for p in wanted if len(p) <= self.SHORT]
        done = list(self._settled(short))
        none = np.zeros(0, np.int64)
        ids, owner = np.concatenate([none, *(x for x, _ in done)]), np.concatenate([none, *(x for _, x in done)])
        order = np.argsort(owner, kind="stable")
        ids, sizes = ids[order], np.bincount(owner, minlength=len(short))
        if len(short) < len(wanted):
            rows = np.split(ids, np.cumsum(sizes)[:-1]) if len(short) else []
            it = iter(rows)
            rows = [next(it) if len(p) <= self.SHORT else self.one(p) for p in wanted]
            ids, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def counts(self, wanted: list[bytes]) -> np.ndarray:
        """Number of ids of each piece (none empty); symbols are dropped as soon as their piece is settled."""
        short = np.fromiter((len(p) <= self.SHORT for p in wanted), bool, len(wanted))
        out = np.zeros(len(wanted), np.int64)
        brief = np.zeros(int(short.sum()), np.int64)
        for _, owner in self._settled([p for p, s in zip(wanted, short.tolist(), strict=True) if s]):
            brief += np.bincount(owner, minlength=len(brief))
        out[short] = brief
        out[~short] = [len(self.one(p)) for p, s in zip(wanted, short.tolist(), strict=True) if not s]
        return out

    def _settled(self, short: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each round, the ids of the pieces in which nothing is left to merge, and the pieces' numbers."""
        ids = self.byte_ids[np.frombuffer(b"".join(short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), np.fromiter(map(len, short), np.int64, len(short)))
        slots = self.look_up(ids[:-1], ids[1:])
        rank, new = np.append(self.ranks[slots], NO_RANK), np.append(self.merged[slots], 0)
        rank[:-1][owner[:-1] != owner[1:]] = NO_RANK
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lens = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < NO_RANK, lens)
            if not live.all():
                yield ids[~live], owner[~live]
                least, lens = least[least < NO_RANK], lens[least < NO_RANK]
                ids, owner, rank, new = ids[live], owner[live], rank[live], new[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each piece
            ids[at] = new[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank, new = ids[stay], owner[stay], rank[stay], new[stay]
            at -= np.arange(len(at))
            touched = np.zeros(len(ids), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            fresh = np.flatnonzero(touched)
            inner = fresh[fresh + 1 < len(ids)]
            slots = self.look_up(ids[inner], ids[inner + 1])
            same = owner[inner] == owner[inner + 1]
            rank[fresh] = NO_RANK
            rank[inner], new[inner] = np.where(same, self.ranks[slots], NO_RANK), self.merged[slots]


class Cache(dict):
    """Results of merging by piece; bounded, so that a worker's memory is too. Long pieces aren't kept."""

    LIMIT, LONGEST = 400_000, 64

    def __init__(self, make: Callable[[list[bytes]], list]) -> None:
        self.make = make

    def all_of(self, slices: list[bytes]) -> list:
        """The result of each slice; what isn't kept yet is made for all distinct slices together."""
        out = list(map(self.get, slices))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            new = list({slices[i] for i in missing})
            made = dict(zip(new, self.make(new), strict=True))
            for i in missing:
                out[i] = made[slices[i]]
            if len(self) + len(made) > self.LIMIT:
                self.clear()
            self.update((p, x) for p, x in made.items() if len(p) <= self.LONGEST)
        return out


class Vocabulary:
    """Ranks of a .tiktoken file: base64 of a token's bytes, blank, rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.token_bytes = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_binary())
        ranks = self.ranks
        pairs = np.array([(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], np.int64)
        self.merger = Merger(np.array([ranks[bytes([b])] for b in range(256)]), pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 2])
        self.cache = Cache(self.ids_of_pieces)

    def ids_of_pieces(self, wanted: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece; a piece that is a token as a whole is that token."""
        whole = [self.ranks.get(p) for p in wanted]
        ids, offsets = self.merger.merge([p for p, w in zip(wanted, whole, strict=True) if w is None])
        raw, cut = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
        it = iter(zip(cut, cut[1:], strict=False))
        return [w.to_bytes(4, "little") if w is not None else raw.__getitem__(slice(*next(it))) for w in whole]

    def encoded(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the offsets of each piece's ids; each distinct piece is looked up once."""
        found, which = distinct_slices(raw, starts)
        packed = self.cache.all_of(found.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat, base = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[which])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(base[which] - (ends - sizes[which]), sizes[which])
        return flat[at], np.concatenate([[0], ends])

    def decoded(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that ids stand for, and the offset of each token in them (and the end)."""
        rows = self.token_bytes.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        return memoryview(rows.buffers()[2] or b""), offsets


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once for each worker process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# --- operators -----------------------------------------------------------------------------------------------------

#: Results that encode() can give, and their types.
OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "token_offsets": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "decoded": ("string", pa.string()),
}


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """The columns `keep` (all if None) and the outputs asked for; token_offsets are the bytes at which tokens begin.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that they decode to.
    """
    batches_of(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    src = df.select(*names, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        decodes = {"decoded_sha256", "decoded", "token_offsets"}.intersection(outputs)
        for batch in given_back(batches):
            data, offsets = utf8(batch.column(len(names)))
            got: dict[str, list] = {k: [] for k in outputs}
            for a, b in parts(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, first = pieces(part, offsets[a : b + 1] - offsets[a])
                every, at = vocab.encoded(part.tobytes(), starts)
                rows = at[first]
                plain, places = vocab.decoded(every) if decodes else (None, None)
                for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    ids = every[x:y]
                    if "n_tokens" in got:
                        got["n_tokens"].append(y - x)
                    if "ids" in got:
                        got["ids"].append(ids.astype(np.int32))
                    if "ids_sha256" in got:
                        got["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(plain[places[x] : places[y]]).hexdigest())
                    if "decoded" in got:
                        got["decoded"].append(bytes(plain[places[x] : places[y]]).decode())
                    if "token_offsets" in got:
                        got["token_offsets"].append((places[x:y] - places[x]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(got[k], OUTPUTS[k][1]) for k in outputs)], [*names, *outputs])

    return src.mapInArrow(run, ", ".join([*fields, *(f"`{k}` {OUTPUTS[k][0]}" for k in outputs)]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that its ids stand for; null ids give null."""
    src = df.drop(out)
    at = src.columns.index(ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            found = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return src.mapInArrow(run, f"{fields}, `{out}` binary")
