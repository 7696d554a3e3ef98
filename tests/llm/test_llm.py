"""The training-data operators against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import ann, bpe, fingerprint, langid, mixing, neardup, pii, suffix_dedup, token_count, url_filter
from corpuscope.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents():
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(rng.choice(WORDS, n)) + f" {rng.integers(1 << 40)}."
    rows = [(i, make(int(rng.integers(3, 120))), ["en", "fr", None][i % 3], f"s{i % 4}" if i % 9 else None) for i in range(60)]
    rows += [(60 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    rows += [(80 + i, rows[30 + i][1] + " and more", "en", "s0") for i in range(10)]  # near copies
    return rows + [(100, None, "en", None), (101, "", None, "s1"), (102, "...", "en", "s1"), (103, "word " * 30_000, "en", "s2"), (103, "word " * 30_000, "en", "s2"), (104, "é" * 5000, "fr", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 7) for r in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_language(docs, none):
    model = langid.train(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text))) for r in rows)
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("partitions", [1, 5])
def test_passages(docs, none, partitions):
    got = sorted(suffix_dedup.dedup_passages(docs.repartition(partitions), with_text=True).collect(), key=lambda r: (r.doc_id, r.n_removed))
    seen, want = set(), []
    for d, t, *_ in sorted(documents(), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(b[i : i + 100])
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        want.append((d, len(b), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
    assert suffix_dedup.dedup_passages(none).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(int(rng.integers(0, 20)))) for _ in range(7)]

    def coded(run):
        last = b""
        for x in run:
            yield x, suffix_dedup.first_difference(last, x, 0)
            last = x

    out = []
    at = [0] * 7
    for r, common in suffix_dedup.LoserTree([coded(r) for r in runs]):
        x = runs[r][at[r]]
        at[r] += 1
        if out:
            assert common == suffix_dedup.first_difference(out[-1], x, 0)
        out.append(x)
    assert out == sorted(sum(runs, []))


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and mixing.mix(none).count() == 0
    assert sum({(r.source_size, r.target): r.target for r in rows}.values()) == pytest.approx(sum(len(words(t)) for _, t, *_ in documents()))
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9 for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns
    total = sum(r.taken for r in rows)
    assert mixing.mixed_documents(docs).select(F.sum(mixing.size_of(F.col("text")))).first()[0] == total


def test_pii(spark, docs, none):
    text = "mail a.b@x.org, ip 10.0.0.256 or 10.0.0.25; card 4111 1111 1111 1111, call +1 (017) 555-7713. IBAN DE89 3704 0044 0532 0130 00"
    found = {(s.kind, text[s.start : s.end]) for s in pii.spans_of(text)}
    assert found == {("email", "a.b@x.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713"), ("iban", "DE89 3704 0044 0532 0130 00")}
    masked = pii.mask_pii(spark.createDataFrame([(1, text, len(text)), (2, None, None), (3, "plain", 5)], "id long, text string, n_chars long")).collect()
    assert masked[0].text.startswith("mail [EMAIL], ip 10.0.0.256 or [IP]; card [CARD]") and masked[0].n_chars == len(masked[0].text) and tuple(masked[1]) == (2, None, None) and masked[2].text == "plain"
    assert pii.find_pii(none).count() == 0 and pii.spans_of("a" * 200_000 + "@") == []


def test_neighbours(spark):
    x = np.random.default_rng(4).standard_normal((400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0]), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df).collect()
    hits = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        hits += len({m[1] for m in mine} & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
    assert hits >= 0.9 * 400 and {r.query_id for r in got} == set(range(0, 400, 20))
    assert ann.nearest(df.limit(0)).count() == 0


def test_bpe_round_trip(docs, none):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, path, outputs=("n_tokens", "ids", "token_offsets")), path).collect()
    for r in rows:
        assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and len(r.token_offsets) == r.n_tokens
    assert bpe.encode(none, path).count() == 0


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    more = spark.createDataFrame([(1, "a<|endoftext|> b<|endoftext|>"), (2, "it's  \n\n 12 '")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), more):
        assert all(r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) for r in token_count.count_tokens(df, path).collect())
    assert token_count.count_tokens(none, path).count() == 0


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    urls = ["http://a.example.com/en/1", "HTTP://WWW.Example.com/en/1?x", "http://x.net/es/", "http://example.com", "nothing", None, "http://xample.com/en#/", "http://net/es/a"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    want = [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("net/es/", "block")]
    for most in (1 << 20, 0):
        rows = sorted(url_filter.filter_urls(df, rules, max_broadcast_bytes=most).collect())
        assert [(r.rule, r.verdict) for r in rows] == want


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, size):
    sets, parent = {}, {}
    for d, t, *_ in documents():
        w = words(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    rows = neardup.classes(docs, shingle=size).collect()
    assert len(rows) == docs.count()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id) for r in rows)
    stay = neardup.deduplicated(docs, shingle=size)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted({find(d) for d in ids})
    assert neardup.classes(none, shingle=size).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (3, 9), (20, 30), (30, 40), (40, 50), (50, 21)], "u long, v long")
    assert {r.id: r.component for r in components(links).collect()} == {9: 3, 8: 3, 7: 3, 30: 20, 40: 20, 50: 20, 21: 20}


def test_fingerprints(spark, docs, none):
    by_id = {d: t or "" for d, t, *_ in documents()}
    ids = sorted(by_id)
    for r in fingerprint.edited(docs).collect():
        t, following = by_id[r.doc_id], by_id[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert r.edited == t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        w = words(t)
        assert len(r.sketch) == min(128, len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert fingerprint.edited(none).count() == 0
    parts = spark.createDataFrame([("a", " ".join(WORDS[:12])), ("a", " ".join(WORDS[8:]))], "k string, t string").select("k", fingerprint.sketch(F.col("t"), 8).alias("s"))
    whole = fingerprint.merge_all(parts, ["k"], "s", 8).first()
    assert whole.s == sorted({x for r in parts.collect() for x in r.s})[:8]
    one = parts.select(fingerprint.containment(F.col("s"), F.col("s"), 8).alias("c"), fingerprint.resemblance(F.col("s"), F.col("s"), 8).alias("j")).first()
    assert (one.c, one.j) == (1.0, 1.0)
