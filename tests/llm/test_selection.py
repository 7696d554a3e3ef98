"""Decontamination, conversation repair and resampling against plain Python: their queries over odd rows, and small blocks."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from corpuscope.llm import conversation, decontamination, queries, resampling

WORDS = "the of and to in is that it was for on are with as at be this have from or é1 x9 ünd".split()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice(WORDS, n)) if n else ""
    own = lambda n: " ".join(f"{w}{rng.integers(50)}" for w in rng.choice(WORDS, n))
    shared = own(25)
    items = [(1, shared), (2, own(10)), (3, f"{own(5)} {shared} {own(4)}"), (10, "One two-three"), (11, "é1"), (4, None), (5, "..."), (2, own(12)), (None, own(11)), (6, shared), (20, own(60))]
    docs = [(i, own(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"{own(i)}. {(t or 'x').upper()}; {own(3)}") for i, (_, t) in enumerate(items)]
    docs += [(200 + i, f"{own(4)} {' '.join(words(shared)[i : i + 10 + i % 3])} {own(2)}") for i in range(14)]
    docs += [(300, f"{shared}!{shared}"), (300, own(30)), (300, shared), (301, None), (302, ""), (303, "…"), (304, "one, TWO three"), (305, "xone two three"), (None, f"{shared} {own(40)}"), (None, f"{shared} {own(40)}"), (306, " ".join(words(shared)[:9]))]
    docs += [(310 + i, say(25)) for i in range(30)] + [(400, f"{own(30_000)} {shared} {own(30_000)}"), (401, "ab" * 200_000)]
    return docs, items


def written(spark, folder, docs, items):
    spark.createDataFrame([(*d, "en", "s", 7) for d in docs], "doc_id long, text string, lang string, n_words string, row int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("sf")), *texts())


def same(df, want):
    assert Counter(map(repr, map(tuple, df.collect()))) == Counter(map(repr, want))


def contaminated(docs, items):
    out = []
    runs = {}
    for item, t in items:
        w = words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            runs.setdefault(tuple(w[i : i + m]), set()).add(item)
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in range(1, 11):
            for i in range(len(w) - m + 1):
                if (run := tuple(w[i : i + m])) in runs:
                    hit |= set(range(i, i + m))
                    found |= {str(x) for x in runs[run] if x is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("partitions", ["4", "300"])
def test_decontamination(spark, sf, partitions, monkeypatch):
    monkeypatch.setattr(decontamination, "ROWS", 13)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(queries.op11_decontamination(spark, sf), contaminated(*texts()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_decontamination_with_a_full_bitmap(spark, sf, monkeypatch):
    """Where every run passes the bitmap, the join alone decides."""
    bitmap = decontamination.bitmap
    monkeypatch.setattr(decontamination, "bitmap", lambda runs: (np.full(decontamination.BITS // 8, 255, np.uint8), bitmap(runs)[1]))
    docs = [d for d in texts()[0] if d[0] != 400]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(decontamination.contaminated(df, spark.read.parquet(f"{sf}/benchmark.parquet")), contaminated(docs, texts()[1]))


def test_every_window_has_one_of_its_grams():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    got = decontamination.fingerprints(h, 10, 5)
    g = decontamination.grams(h, 5)
    assert len(got) == 191 and all(got[i] == min(g[i : i + 6]) for i in range(191))
    assert len(decontamination.fingerprints(h[:9], 10, 5)) == 0


def drawn(docs, items, most=1, buckets=10_000):
    feats = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for _, x in rows for f in feats(x)) for rows in (docs, items))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets)))))
    rows = []
    for d, x in docs:
        f = feats(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(g)) for g in f) // len(f) if f else 0
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    take = len(fit) * 10 // 100
    return [(*r[:4], i + 1 if i < take else None) for i, r in enumerate(fit)] + [(*r[:4], None) for r in rows if r[4] < 20]


@pytest.mark.parametrize("nodes", [200_000, 20])
def test_resampling(spark, sf, nodes, monkeypatch):
    monkeypatch.setattr(resampling, "NODES", nodes)
    got = queries.op13_resampling(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got, drawn(*texts()))


def test_resampling_by_longer_runs(spark, sf):
    docs, items = texts()
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=3, buckets=500)
    same(got, drawn(docs, items, most=3, buckets=500))


def test_trie_states():
    trie = resampling.Trie(2)
    flat, at, first = resampling.word_slices(np.frombuffer(b"AB cd abab cd", np.uint8), np.array([0, 5, 13]))
    assert bytes(flat) == b"abcdababcd" and first.tolist() == [0, 2, 4]
    one, two = trie.walk(flat, at, first)
    trie.count([one, two])
    assert [trie.crc[n] for n in one] == [zlib.crc32(x) for x in (b"ab", b"cd", b"abab", b"cd")]
    assert [trie.crc[n] for n in two if n >= 0] == [zlib.crc32(x) for x in (b"ab cd", b"abab cd")] and two.tolist()[1::2] == [-1, -1]
    assert trie.counts[one[1]] == 2 and trie.counts.sum() == 6


def conversations():
    rng = np.random.default_rng(12)
    rows = []
    for c in range(120):
        n = int(rng.integers(1, 14))
        said = ["Yes.", "Is it?", "no end", "", " \n", "Oh!  ", "a. b", "One. Two! Three?"]
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.4 else str(rng.choice(["user", "assistant"])) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((c, turn if rng.random() < 0.9 else turn + 3, role, str(rng.choice(said)) if rng.random() < 0.4 else f"{rng.integers(99)} words.", "x"))
    rows += [(500, None, "user", "Hi.", "x"), (500, None, "assistant", None, "x"), (500, 1, None, "What?", "x"), (501, None, None, None, "x"), (None, 1, "user", "Hi.", "x"), (None, 2, "assistant", "Ho.", "x"), (None, 2, "tool", "ran.", "x")]
    rows += [(502, 7, "user", "Same.", "x")] * 40 + [(503, i, ("user", "assistant")[i % 2], f"{i} is long." * (3000 if i == 5 else 1), "x") for i in range(200)] + [(504, i, "", "…", "x") for i in range(3)]
    return rows


def repaired(rows):
    """A row for each conversation, by a memoised search over all edits; rows are (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
    seen, faults = set(), []
    for _, role, text, _ in rows:
        solid = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    add = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, fresh):
        """(cost, audit, said) from here; fresh counts inserts in a row, of which two are enough anywhere."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if fresh < 2:
            c, a, s = best(i, add[state], fresh + 1)
            ways.append((c + 3, "I" + a, (f"{name[add[state]]}:", *s)))
        if i < len(rows):
            _, role, text, _ = rows[i]
            c, a, s = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, s))
            if faults[i] not in ("b", "d"):
                extra = 3 if faults[i] == "t" else 0
                c, a, s = best(i + 1, add[state], 0)
                ways.append((c + 3 + extra, "R" + a, (f"{name[add[state]]}:{text}", *s)))
                if role[:1] and role[:1] in allowed[state]:
                    c, a, s = best(i + 1, role[:1], 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *s)))
        return min(ways, default=(1 << 40, "", ()))

    cost, audit, said = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha("\n".join(said)))


def damaged(rows):
    out = {r[0]: [] for r in rows}
    for c, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out[c] += [(turn, role, text, mark(text))] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def mark(text):
    import xxhash

    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("block", "partitions"), [(4096, "4"), (3, "4"), (1, "60"), (4096, "60")])
def test_conversations(spark, tmp_path, block, partitions, monkeypatch):
    monkeypatch.setattr(conversation, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = conversations()
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
        df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        got = queries.op12_conversation_repair(spark, str(tmp_path))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        want = [(c, *repaired(v)) for c, v in damaged(rows).items()]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        if block < 4096:
            _, turns = conversation.repair(queries.damaged(df))
            said = {}
            for r in sorted(turns.collect(), key=lambda r: (r.conv_id or -1, r.block, r.place)):
                said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert all(sha("\n".join(said.get(w[0], []))) == w[-1] for w in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sql_of_conversations(spark, tmp_path):
    rows = list({r[:2]: r for r in conversations()}.values())  # turns that tie are ordered by a hash, which SQL lacks
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(queries.oracle_sql()["op12_conversation_repair"]).fetchall()
    assert Counter(map(repr, found)) == Counter(map(repr, map(tuple, queries.op12_conversation_repair(spark, str(tmp_path)).collect())))


def test_empty_tables(spark, tmp_path):
    folder = written(spark, str(tmp_path), [], [])
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    for name in ("op11_decontamination", "op12_conversation_repair", "op13_resampling"):
        assert queries.queries()[name](spark, folder).count() == 0
    docs = spark.createDataFrame(texts()[0], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contaminated(docs, none).collect())
    same(resampling.resampled(docs, none), drawn(texts()[0], []))
