"""The registered queries and the pipeline against plain Python over a small table with odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from corpuscope.llm import fingerprint, langid, neardup, pii, queries

A = "the of and to in is that it was for on are with as at be this have from or".split()
B = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
BITS = ["a.b@x.org", "x@y", "@", "10.0.0.1", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111 1111 1111 1111 123", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49 30 1234567", "+1", "card", "12 34 56", "--", ". .", "é", "0", "(212) 555-0100", "\n", "a%b+c@d-e.f.gg", "123456789012345678901234"]


def documents():
    rng = np.random.default_rng(3)
    say = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, say((A, B)[i % 2], int(rng.integers(8, 90))) + f" {rng.integers(1 << 40)}", ("en", "de")[i % 2], f"s{i % 5}" if i % 7 else None) for i in range(120)]
    rows += [(200 + i, "".join(x + rng.choice(["", " ", ", "]) for x in rng.choice(BITS, 12)), None, "pii") for i in range(60)]
    rows += [(300 + i, rows[i][1] + " more", "en", "s0") for i in range(0, 20, 2)]
    rows += [(400 + i, rows[i][1], "en", "s0") for i in range(0, 20, 2)]
    rows += [(500, say(A, 12), "en", "s1") for _ in range(60)]  # an id with many texts
    rows += [(501, rows[0][1], "en", "s1"), (501, say(B, 40), "de", "s1"), (501, say(B, 40), "de", "s1")]
    rows += [(510, "it's 'll 're  x\n\n \tyou'd 1234 ①②   　中文字 ーа́б 'S <|endoftext|>", "en", None), (511, None, "en", None), (512, "", None, "s1"), (513, "...", "en", "s1"), (514, say(A, 20_000), "en", "s2")]
    return rows + [(None, say(A, 30), "en", "s2"), (None, say(A, 30), "en", "s2"), (None, None, None, None)]


def table(spark, folder, rows):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    table(spark, folder, documents())
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    table(spark, folder, [])
    return folder


def rows_of(df):
    return sorted(df.collect(), key=repr)


def same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op5_ann", "op7_url_filter", "op11_decontamination", "op12_conversation_repair", "op13_resampling")])
def test_empty_table(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_language(spark, sf):
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(documents())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, held(d)) for d, *_ in documents())
    truth = {(d, n): lang for n, (d, t, lang, _) in enumerate(documents())}
    sure = {d: lang for (d, _), lang in truth.items() if d is not None and d < 120}
    assert all(r.lang_pred == sure[r.doc_id] for r in got if r.doc_id in sure)
    silent = Counter(d for d, t, *_ in documents() if not any(map(str.isalpha, t or "")))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == silent and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)


def test_language_sample(spark):
    """Ids that repeat or are null don't matter, nor how many languages there are."""
    many = [(7 if i % 2 else None, " ".join([f"{w}{i % 300}" for w in A]), f"l{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    bits, labels = langid.sample_bits(df, "text", "lang")
    assert len(set(labels)) == 300 and len(labels) == len(bits) == 300  # copies train once
    assert langid.train(df.where("text is null")) is None


def base_spans(text):
    """The contract's rules, word for word."""
    text, out = text or "", []
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    for order, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(out)


def test_pii(spark, sf):
    want = []
    for d, t, *_ in documents():
        spans = base_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((d, *(sum(k == kind for _, _, k, _ in spans) for kind in ("email", "ip", "card", "phone")), sha(said.encode())))
    df = queries.op4_pii(spark, sf)
    same(df.drop("spans"), want)
    for r in df.collect():  # base spans stay among all spans
        listed = [x for x in r.spans.split(",") if x]
        assert len(listed) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_beside_other_digits():
    find = lambda t: [(s.kind, t[s.start : s.end], s.base) for s in pii.spans_of(t)]
    assert find("4111 1111 1111 1111 123") == [("card", "4111 1111 1111 1111", False)]
    assert ("card", "5555 5555 5555 4444", False) in find("card 1 2 3 4 5 6 5555 5555 5555 4444 9 9 9 1 2")
    many = "call 212 555-0100; " * 20_000
    assert len(pii.spans_of(many)) == 20_000


def test_bpe(spark, sf):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda t: lib.encode_ordinary(t or "")
    want = [(d, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode())) for d, t, *_ in documents()]
    same(queries.op6_bpe(spark, sf), want)


@pytest.mark.parametrize("hot", [1 << 17, 5])
def test_token_counts(spark, sf, hot, monkeypatch):
    from tokenizers import Tokenizer

    from corpuscope.llm import token_count

    monkeypatch.setattr(token_count, "HOT", hot)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    same(queries.op9_token_count(spark, sf), [(d, len((t or "").encode()), n(t), n(t) > 512) for d, t, *_ in documents()])


def sketch(text, size=fingerprint.SHINGLE):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(text)]
    out = set()
    for i in range(max(1, len(h) - size + 1) if h else 0):
        x = 42
        for w in h[i : i + size]:
            x = xxhash.xxh64_intdigest(struct.pack("<q", w), x)
        out.add(x >> 16)
    return sorted(out)[: fingerprint.K]


def likeness(a, b):
    union = sorted(set(a) | set(b))[: fingerprint.K]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def test_fingerprints(spark, sf):
    texts = {}
    for d, t, *_ in documents():
        texts[d] = min(texts.get(d, t or ""), t or "")
    ids = sorted(texts, key=lambda d: (d is not None, d or 0))
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    written = lambda s: "".join(f"{x:012x}" for x in s)
    want = []
    for d, t, *_ in documents():
        t, following = t or "", texts[after[d]]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        a, b, c = sketch(t), sketch(edited), sketch(following)
        want.append((d, len(t), sha(edited.encode()), written(a), written(b), likeness(a, b), likeness(a, c)))
    same(queries.op10_fingerprint(spark, sf), want)


def components(rows, size, percent=80):
    """Shingle sets by row, and each row's component as the numbers of its rows; rows without an id or words stand alone."""
    sets = []
    for d, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sets, [groups[find(i)] for i in range(len(rows))]


def test_near_duplicates(spark, sf):
    rows = documents()
    sets, group = components(rows, 2)
    want = []
    for i, (d, *_) in enumerate(rows):
        least = None if d is None else min(rows[j][0] for j in group[i])
        want.append((d, len(sets[i]), least, d is None or d == least))
    same(queries.op8_near_dedup(spark, sf), want)


def test_no_text_is_lost_with_its_id(spark):
    rows = [(1, " ".join(A), 1), (1, " ".join(B), 2), (1, " ".join(B), 3), (2, " ".join(A), 4), (None, " ".join(A), 5), (3, None, 6), (3, "", 7), (4, "...", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, " ".join(A)), (1, " ".join(B)), (None, " ".join(A)), (3, None), (3, ""), (4, "...")])


@pytest.mark.parametrize("most", [50_000, 0])
def test_mixing(spark, sf, most, monkeypatch):
    from corpuscope.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    found = con.execute(queries.oracle_sql()["op3_mixing"]).fetchall()
    plain = lambda r: repr((*r[:3], f"{r[3]:.9g}", r[4]))
    assert sorted(map(plain, queries.op3_mixing(spark, sf).collect())) == sorted(map(plain, found))
    clash = spark.read.parquet(f"{sf}/documents.parquet").withColumnsRenamed({"n_chars": "__size", "lang": "__source"})
    assert mixing.mixed_documents(clash).columns == clash.columns


def mixed(rows):
    """Copies of each row by the mixing rules, in plain Python; rows that repeat id and size share their decision."""
    size = [len(words(t)) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(size), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * total[s]]
        for s in full or open_:
            target[s] = float(3 * total[s]) if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    copies = [0] * len(rows)
    for s in names:
        epochs = min(3, int(target[s] // total[s])) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        keyed = {}
        for i, r in enumerate(rows):
            if r[3] == s:
                copies[i] = epochs
                u = (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                keyed.setdefault((-math.log(u) / max(0.25, min(1.0, size[i] / 100)), r[0] is not None, r[0] or 0, size[i]), []).append(i)
        for key, group in sorted(keyed.items()):
            n = key[-1] * len(group)
            for i in group if rest > 0 and before + n / 2 < rest else ():
                copies[i] += 1
            before += n
    return copies


def test_pipeline(spark, sf, empty):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in documents() if any(map(str.isalpha, r[1] or ""))]
    sets, group = components(rows, 5)
    stay, seen = [], set()
    for i, r in enumerate(rows):
        if r[0] is None:
            stay.append(r)
        elif i == min(group[i], key=lambda j: (rows[j][0], min(rows[k][0] for k in group[i] if sets[k] == sets[j]))) and id(group[i]) not in seen:
            seen.add(id(group[i]))
            stay.append(r)
    # One row of each group stays, one with its smallest id; which of several such rows isn't laid down.
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), sf).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in stay)
    # Each text's language is what the model says of it, labelled or not.
    labelled = [(r[1], r[2]) for r in documents() if r[1] and r[2] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)]
    model = langid.train(spark.createDataFrame(labelled, "text string, lang string"))
    said = dict(zip([r.text for r in kept], langid.predicted(model, pa.array([r.text for r in kept]))[0], strict=True))
    assert all(said[t] == lang for d, t, lang, _ in documents() if d is not None and d < 120 and t in said)
    rows = [(r.doc_id, pii.masked(r.text), said[r.text], r.source) for r in kept]
    assert {None, "en"} <= {r[2] for r in documents() if r[1] in said}
    want = []
    for (d, t, lang, s), n in zip(rows, mixed(rows), strict=True):
        ids = lib.encode_ordinary(t)
        want += [(d, lang, s, len(ids), ids, sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))] * n
    same(corpus_pipeline.run(spark, sf).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"), want)
    assert corpus_pipeline.run(spark, empty).count() == 0
    clash = spark.createDataFrame([(1, "the cat and the dog", None, "s", 19, "mine", 7)], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int").unionByName(spark.createDataFrame([(0, "the cat", "en", "s", 7, "mine", 7)], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int"))
    assert sorted(map(tuple, corpus_pipeline.language_stage(spark, clash, sf).collect())) == [(0, "the cat", "en", "s", 7, "mine", 7), (1, "the cat and the dog", "en", "s", 19, "mine", 7)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).columns == ["doc_id", "text", "lang", "source", "n_chars"], name
