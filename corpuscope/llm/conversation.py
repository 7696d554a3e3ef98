"""Conversation structure repair: the cheapest edits after which roles are `(s?(ua)+)?` by their initials.

Rows are range-partitioned and sorted by conversation and turn, so a conversation of any size spreads over partitions, and are
read there in blocks of bounded size. A backward pass over a block's rows finds the cost to go from each state of the
grammar (nothing yet, after a system, user or assistant turn), a forward walk takes the ASCII-least edit among those that
keep to that cost. A conversation that lies within one block is solved at once. One that is cut by blocks is solved by
what its blocks exchange: which rows are the first of their kind (found by a grouped minimum), the block's cost from each
state to each (four backward passes), from the last block to the first the cost to go behind each block, and from
the first to the last the state in which each block is entered. These scans read a few numbers for each block, in order,
and hold one block's; texts of cut conversations are read in order to be hashed, and never held together.

A row's first fault counts: blank (nothing but spaces), duplicate (role and text stand earlier in the conversation) or
truncated (its last solid character doesn't end a sentence). Null roles and texts count as one space; null turns come first
and don't count for gaps; rows of the same turn are ordered by role, then by a hash of the text. A null conversation id is
a conversation of its own. Extra columns are ignored, whatever their names. No rows: no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, stored

#: A block ends with the row that reaches one of these.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after a system, a user, an assistant turn. Turns that may follow each, and the one an edit would add.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADD = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60
LEGAL = ("su", "ua", "au")
#: Costs to go where no row is left.
LAST = (0, 6, 3, 0)


class Turn(NamedTuple):
    """What the edits of a row depend on."""

    initial: str
    must_go: bool
    cut_off: bool


def fault(role: str, text: str, repeated: bool) -> str:
    """The row's first fault: blank, duplicate, truncated or none."""
    solid = text.rstrip(SPACES)
    return "blank" if not solid else "duplicate" if repeated else "truncated" if solid[-1] not in ENDS else ""


def costs(turns: list[Turn], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For the place before each row and the one behind the last, the cost to go from each state; the last is `after`."""
    out = [after]
    for initial, must_go, cut_off in reversed(turns):
        add = 3 if cut_off else 0
        best = [4 + c for c in after]
        if not must_go:
            for state in range(4):
                to = KEEP[state].get(initial)
                best[state] = min(best[state], add + 3 + after[ADD[state]], add + after[to] if to else FAR)
        _, _, u, a = best
        best[2], best[3] = min(u, 3 + a), min(a, 3 + u)
        best[0], best[1] = min(best[0], 3 + best[2]), min(best[1], 3 + best[2])
        after = tuple(min(c, FAR) for c in best)
        out.append(after)
    return out[::-1]


def walk(turns: list[Turn], togo: list[tuple[int, ...]], state: int, last: bool = True) -> tuple[list[tuple[str, int, int]], int]:
    """The ASCII-least cheapest edits as (initial, row or -1, state that follows), and the state behind the last row."""
    out, i = [], 0
    while i < len(turns) or last:
        here = togo[i][state]
        if i < len(turns):
            initial, must_go, cut_off = turns[i]
            after, add, to = togo[i + 1], 3 if cut_off else 0, KEEP[state].get(initial)
            if here == 4 + after[state]:
                out.append(("D", i, state))
                i += 1
                continue
            if here != 3 + togo[i][ADD[state]]:
                edit, to = ("K", to) if not must_go and to and here == add + after[to] else ("R", ADD[state])
                state = to
                out.append((edit, i, state))
                i += 1
                continue
        elif here == 0:
            break
        state = ADD[state]
        out.append(("I", -1, state))
    return out, state


def _repaired(edits: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """Initials of the edits, and roles and texts that they leave."""
    left = [(roles[i] if e == "K" else ROLES[to], texts[i] if i >= 0 else "") for e, i, to in edits if e != "D"]
    return "".join(e for e, _, _ in edits), [r for r, _ in left], [t for _, t in left]


def _faults(roles: list[str], texts: list[str], repeated: Callable[[int], bool]) -> tuple[list[Turn], list[int]]:
    found = [fault(r, t, repeated(i)) for i, (r, t) in enumerate(zip(roles, texts, strict=True))]
    return [Turn(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, found, strict=True)], [found.count(f) for f in ("blank", "duplicate", "truncated")]


def _illegal(roles: Iterable[str]) -> int:
    said = [r[:1] for r in roles]
    return sum(a + b not in LEGAL for a, b in zip(said, said[1:], strict=False))


def _span(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    have = [t for t in turns if t is not None]
    return (min(have), max(have), len(set(have))) if have else (None, None, 0)


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


class _Said:
    """The digest of turns that come one after another."""

    def __init__(self):
        self.sha, self.began = hashlib.sha256(), False

    def add(self, roles: list[str], texts: list[str]) -> None:
        for role, text in zip(roles, texts, strict=True):
            self.sha.update((("\n" if self.began else "") + f"{role}:{text}").encode())
            self.began = True


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda r: 1) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= 1 << 20 or len(held) >= 4096:
            yield _table(held, schema)
            held, weight = [], 0
    if held:
        yield _table(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _blocks(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Solved conversations (block null) and blocks of those that may go on in another block, by conversation and block number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "mark", "row"]  # the last parts rows that are alike, so that they spread as well
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    names = f"conv_id {kind['conv_id']}, block bigint, {counts}, audit string, repaired_sha256 string, turns array<{kind['turn']}>, roles array<string>, texts array<string>"

    def solved(conv: object, turns: list, roles: list, texts: list) -> tuple:
        seen: set[tuple[str, str]] = set()
        repeated = [False] * len(roles)
        for i, x in enumerate(zip(roles, texts, strict=True)):
            repeated[i] = x in seen
            seen.add(x)
        graded, n = _faults(roles, texts, repeated.__getitem__)
        togo = costs(graded, LAST)
        audit, left, said = _repaired(walk(graded, togo, 0)[0], roles, texts)
        digest = _Said()
        digest.add(left, said)
        counts = (_gaps(*_span(turns)), *n, _illegal(roles), togo[0][0])
        return (conv, None, *counts, audit, digest.sha.hexdigest(), None, *((left, said) if with_turns else (None, None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33

        def found() -> Iterator[tuple]:
            number, first, began, now, chars = 0, True, False, None, 0
            turns, roles, texts = [], [], []
            nothing = (None,) * (len(_COUNTS) + 2)
            for conv, turn, role, text in _rows(batches):
                if began and (conv != now or len(turns) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    if conv != now and not first:  # it began and ended here
                        yield solved(now, turns, roles, texts)
                    else:
                        yield (now, part + number, *nothing, turns, roles, texts)
                        number += 1
                    first = conv == now
                    turns, roles, texts, chars = [], [], [], 0
                now, began = conv, True
                turns.append(turn), roles.append(role), texts.append(text)
                chars += len(text)
            if began:
                yield (now, part + number, *nothing, turns, roles, texts)

        yield from _batches(found(), schema, lambda r: sum(map(len, r[-1] or [])) + 100)

    schema = _arrow(rows, names)
    return rows.mapInArrow(run, names)


def _arrow(df: DataFrame, names: str) -> pa.Schema:
    """The Arrow schema of a result's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(names))


def _in_order(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], names: str, backwards: bool = False) -> DataFrame:
    """Rows of run over each conversation's blocks, one after another."""
    block = F.desc("block") if backwards else F.asc("block")
    schema = _arrow(df, names)
    ordered = df.repartition("conv_id").sortWithinPartitions("conv_id", block)
    return ordered.mapInArrow(lambda batches: _batches(run(_rows(batches)), schema), names)


def _each(df: DataFrame, run: Callable[..., tuple], names: str) -> DataFrame:
    schema = _arrow(df, names)
    return df.mapInArrow(lambda batches: _batches((run(*r) for r in _rows(batches)), schema, lambda r: 1000), names)


def _cut_solved(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For conversations that lie in several blocks: counts by conversation, and each block's audit, roles and texts."""
    conv = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}"
    turn = blocks.schema["turns"].dataType.elementType.simpleString()
    rows = blocks.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "said"))
    digest = F.sha2(F.concat(F.length("said.roles").cast("string"), F.lit(":"), "said.roles", "said.texts").cast("binary"), 256)
    firsts = rows.groupBy("conv_id", digest.alias("digest")).agg(F.min(F.struct("block", "at")).alias("first"))
    firsts = firsts.groupBy("first.block").agg(F.collect_list("first.at").alias("firsts"))

    def grade(conv: object, block: int, turns: list, roles: list, texts: list, firsts: list | None) -> tuple:
        new = set(firsts or ())
        graded, n = _faults(roles, texts, lambda i: i not in new)
        ways = [costs(graded, tuple(0 if h == g else FAR for h in range(4)))[0] for g in range(4)]
        codes = [f"{'!' if t.must_go else '~' if t.cut_off else '.'}{t.initial}" for t in graded]
        return (conv, block, codes, [c for w in ways for c in w], n, _illegal(roles), roles[0][:1], roles[-1][:1], turns[0], turns[-1], *_span(turns))

    graded = _each(
        blocks.select("conv_id", "block", "turns", "roles", "texts").join(firsts, "block", "left").select("conv_id", "block", "turns", "roles", "texts", "firsts"),
        grade,
        f"{conv}, block bigint, codes array<string>, ways array<bigint>, n array<bigint>, illegal bigint, r0 string, r1 string, t0 {turn}, t1 {turn}, low {turn}, high {turn}, distinct_turns bigint",
    )
    graded = stored(graded, "graded")

    def behind(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, after = object(), LAST
        for conv, block, ways in rows:
            if conv != now:
                now, after = conv, LAST
            yield conv, block, list(after)
            after = tuple(min(FAR, *(ways[4 * h + g] + after[h] for h in range(4))) for g in range(4))

    after = _in_order(graded.select("conv_id", "block", "ways"), behind, f"{conv}, block bigint, after array<bigint>", backwards=True)
    after = stored(after, "behind")

    def turns_of(codes: list[str]) -> list[Turn]:
        return [Turn(c[1:], c[0] == "!", c[0] == "~") for c in codes]

    def leave(conv: object, block: int, codes: list, after: list) -> tuple:
        turns = turns_of(codes)
        togo = costs(turns, tuple(after))
        return conv, block, [walk(turns, togo, g, last=False)[1] if togo[0][g] < FAR else g for g in range(4)], togo[0][0]

    exits = _each(graded.select("block", "conv_id", "codes").join(after.select("block", "after"), "block").select("conv_id", "block", "codes", "after"), leave, f"{conv}, block bigint, exits array<bigint>, cost bigint")

    def enter(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Entry state and position of each block; whether it is the last is known one row later."""
        held, now = None, object()
        for conv, block, exits, cost, *rest in rows:
            fresh = conv != now
            if held is not None:
                yield (*held, fresh, *((None,) * len(_COUNTS) if not fresh else counts(stats)))
            if fresh:
                now, state, stats = conv, 0, None
            stats = merged(stats, cost, rest)
            held, state = (conv, block, state), exits[state]
        if held is not None:
            yield (*held, True, *counts(stats))

    def merged(stats: dict | None, cost: int, rest: list) -> dict:
        n, illegal, r0, r1, t0, t1, low, high, distinct = rest
        if stats is None:
            return {"cost": cost, "n": n, "illegal": illegal, "r1": r1, "t1": t1, "low": low, "high": high, "distinct": distinct}
        both = [t for t in (stats["low"], low) if t is not None], [t for t in (stats["high"], high) if t is not None]
        same = t0 is not None and t0 == stats["t1"]
        return {
            "cost": stats["cost"],
            "n": [a + b for a, b in zip(stats["n"], n, strict=True)],
            "illegal": stats["illegal"] + illegal + (stats["r1"] + r0 not in LEGAL),
            "r1": r1,
            "t1": t1,
            "low": min(both[0], default=None),
            "high": max(both[1], default=None),
            "distinct": stats["distinct"] + distinct - same,
        }

    def counts(stats: dict) -> tuple:
        return (_gaps(stats["low"], stats["high"], stats["distinct"]), *stats["n"], stats["illegal"], stats["cost"])

    narrow = graded.drop("codes", "ways")
    entered = exits.join(narrow.drop("conv_id"), "block").select("conv_id", "block", "exits", "cost", "n", "illegal", "r0", "r1", "t0", "t1", "low", "high", "distinct_turns")
    entered = stored(_in_order(entered, enter, f"{conv}, block bigint, state bigint, last boolean, {', '.join(f'{c} bigint' for c in _COUNTS)}"), "entered")

    def rebuild(conv: object, block: int, codes: list, after: list, state: int, last: bool, roles: list, texts: list) -> tuple:
        turns = turns_of(codes)
        edits, _ = walk(turns, costs(turns, tuple(after)), state, last)
        return (conv, block, *_repaired(edits, roles, texts))

    parts = graded.select("block", "codes").join(after.select("block", "after"), "block").join(entered.select("block", "state", "last"), "block").join(blocks.select("conv_id", "block", "roles", "texts"), "block")
    pieces = _each(parts.select("conv_id", "block", "codes", "after", "state", "last", "roles", "texts"), rebuild, f"{conv}, block bigint, audit string, roles array<string>, texts array<string>")
    return entered.where("last").select("conv_id", *_COUNTS), pieces


def _hashed(pieces: DataFrame) -> DataFrame:
    """audit and repaired_sha256 of conversations that lie in several blocks, which are read in order."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, began, audit, said = None, False, [], _Said()
        for conv, _, edits, roles, texts in rows:
            if began and conv != now:
                yield now, "".join(audit), said.sha.hexdigest()
                audit, said = [], _Said()
            now, began = conv, True
            audit.append(edits)
            said.add(roles, texts)
        if began:
            yield now, "".join(audit), said.sha.hexdigest()

    return _in_order(pieces, run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", with_turns: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """One row for each conversation, and the repaired turns (None without with_turns).

    The first has conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated,
    illegal (neighbours whose initials the grammar doesn't allow), cost, audit (initials of the edits: Delete 4, Insert 3,
    Keep 0, Rerole 3, and 3 for a truncated row that stays) and repaired_sha256; the second conv_id, block and place (in
    order within a conversation), role and text.
    """
    batches_of(rows.sparkSession)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    found = stored(_blocks(rows, with_turns), "conversations")
    whole, cut = found.where("block is null"), found.where("block is not null").select("conv_id", "block", "turns", "roles", "texts")
    counted, pieces = _cut_solved(cut)
    pieces = stored(pieces, "pieces")
    both = counted.withColumnRenamed("conv_id", "conv").join(_hashed(pieces), F.col("conv").eqNullSafe(F.col("conv_id"))).select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    out = whole.select("conv_id", *_COUNTS, "audit", "repaired_sha256").unionByName(both)
    if not with_turns:
        return out, None
    every = whole.select("conv_id", F.lit(0).cast("long").alias("block"), "roles", "texts").unionByName(pieces.select("conv_id", "block", "roles", "texts"))
    turns = every.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "said"))
    return out, turns.select("conv_id", "block", "place", F.col("said.roles").alias("role"), F.col("said.texts").alias("text"))
