"""Odd cases of the training-data operators: ties, several blocks, null ids, clashing names, very long texts, giant groups."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import ann, bpe, components, fingerprint, langid, mixing, neardup, pii, suffix_dedup, token_count, url_filter


def test_neighbours_over_several_tiles(spark, monkeypatch):
    """Blocks of few rows, groups of one query block, ties at the last rank go to the smaller id; more columns change nothing."""
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "GROUP", 1)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[100:140] = x[100]  # forty rows with the same score for every query
    rows = [(i, [float(v) for v in x[i]], "q", 1) for i in range(300)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, rank int")).collect()
    for q in range(0, 300, 20):
        s = np.array([float(np.sum(x[i].astype(float) * x[q].astype(float))) for i in range(300)])
        s[q] = -np.inf
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert mine == np.lexsort((np.arange(300), -s))[:20].tolist()


def windows_removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(b[i : i + 100])
        mask = np.cumsum(gone[:-1]) > 0
        out.append((len(b), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_a_line_in_many_surroundings(spark, monkeypatch, small):
    """One line stands in every text, each time among other words: a giant group of one gram. A null id comes first."""
    if small:  # several chunks, classes of grams, slices and passes
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 4000)
        monkeypatch.setattr(suffix_dedup, "RANGES", 4)
        monkeypatch.setattr(suffix_dedup, "SLICE", 7)
        monkeypatch.setattr(suffix_dedup, "SLICES", 2)
        monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", 3)
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    line = "This very line of more than thirty-two bytes stands in every text of the table. "
    base = [f"{' '.join(word() for _ in range(int(rng.integers(2, 20))))} {line}{' '.join(word() for _ in range(int(rng.integers(2, 20))))}" for _ in range(120)]
    texts = [base[0], *base, *(b[30:] + " and more" for b in base[:40]), None, "short"]
    rows = [(None if i == 0 else i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_passages(df, with_text=False).collect()}
    assert got == {d: w for (d, _, _), w in zip(rows, windows_removed(texts), strict=True)}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    links = [(i, 500) for i in range(501, 700)] + [(i, i + 1) for i in range(40)] + [(300, 10), (300, 600)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == dict.fromkeys([*range(1, 41), 300, 500, *range(501, 700)], 0)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "mail a@b.org 4111 1111 1111 1111", "old", "old", 7)], "doc_id long, text string, spans string, n_tokens string, ids int")
    assert pii.find_pii(df).columns == ["doc_id", "text", "n_tokens", "ids", "spans"] and len(pii.find_pii(df).first().spans) == 2
    one = bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), outputs=("n_tokens", "ids")).first()
    assert one.n_tokens == len(one.ids) and one.spans == "old"
    counted = token_count.count_tokens(df, P.path("byte_bpe_50k.json"), limit=1).first()
    assert counted.n_bytes == len(df.first().text) and counted.over_limit and counted.spans == "old"
    marked = fingerprint.edited(df.withColumnsRenamed({"spans": "__sketch", "ids": "sketch"})).first()
    assert marked.text == df.first().text and marked.sketch == marked.next_sketch  # a single document is its own neighbour


def test_urls_that_tie(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.org/" + "y/" * 50_000)], "page_id long, url string")
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", "a.org", "/y/y/")]
    for most in (1 << 20, 0):
        rows = sorted(url_filter.filter_urls(df, rules, max_broadcast_bytes=most).collect())
        assert [(r.rule, r.verdict) for r in rows] == [("a.org/x", "block"), ("a.org/y/y/", "allow")]
        assert url_filter.filter_urls(df.limit(0), rules, max_broadcast_bytes=most).count() == 0


def test_one_long_text(spark):
    """Two million characters in one row, no blank among half of them."""
    text = "x" * 1_000_000 + " word" * 200_000
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert pii.mask_pii(df, length=None).first().text == text
    row = bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), outputs=("n_tokens", "decoded_sha256")).first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.n_tokens > 200_000
    assert mixing.mix(df).first()["size"] == 200_001
    # The first x and the first " word" stay: each later one is covered by a string that also starts a period earlier.
    assert suffix_dedup.dedup_passages(df, with_text=False).first().n_removed == len(text) - 1 - 5


def test_ids_that_many_rows_share(spark, monkeypatch):
    """A third of all rows has no id, another id repeats: dealt over several keys they get the same neighbours and edits."""
    rows = [(None, f"null text number {i} of many words") for i in range(40)] + [(7, f"seven {i} and more words here") for i in range(30)] + [(i, f"text {i} has its own words too") for i in range(20)]
    df = spark.createDataFrame([r for r in rows if r[0] != 7 or r[1].startswith("seven")], "doc_id long, text string").repartition(5)
    want = sorted(map(repr, map(tuple, fingerprint.edited(df).collect())))
    monkeypatch.setattr(fingerprint, "HOT_ROWS", 5)
    assert sorted(map(repr, map(tuple, fingerprint.edited(df).collect()))) == want and len(want) == df.count()


def test_long_pieces_are_hot_too(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    line = "-" * 80
    df = spark.createDataFrame([(i, f"word {line}\n{line} {'x' * (70 + i % 3)}") for i in range(50)], "doc_id long, text string")
    counts = token_count.piece_counts(df.select("text"), P.path("byte_bpe_50k.json"))
    hot, _ = token_count.hot_pieces(counts)
    assert len(hot) == counts.count() and any(len(k) == 65 for k in hot)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json")).collect()} == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}


def test_urls_of_one_domain(spark):
    """Most urls share a domain, many are malformed, and one repeats very often; joined rules judge them like the trie."""
    urls = [f"http://h{i % 9}.example.com/{i}" for i in range(60)] + ["http://a.com/x"] * 40 + [None, "no url", ""] * 20
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("salt", F.lit("mine"))
    rules = [("allow", "com", "/"), ("block", "example.com", "/1"), ("block", "h2.example.com", "/"), ("allow", "h2.example.com", "/2")]
    got = [sorted(map(repr, map(tuple, url_filter.filter_urls(df, rules, max_broadcast_bytes=most).collect()))) for most in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == len(urls)


@pytest.mark.parametrize("name", ["language", "near", "counts", "prints"])
def test_very_long_texts(spark, name):
    """Two million characters in a row, beside a short one."""
    long = "the quick brown fox and " * 80_000 + "z" * 100_000
    df = spark.createDataFrame([(1, long, "en"), (2, long + " end", "en"), (3, "der schnelle braune fuchs und", "de")], "doc_id long, text string, lang string")
    if name == "language":
        assert [r.lang_pred for r in langid.identify(df, langid.train(df)).orderBy("doc_id").collect()] == ["en", "en", "de"]
    elif name == "near":
        assert [r.component_id for r in neardup.classes(df).orderBy("doc_id").collect()] == [1, 1, 3]
    elif name == "counts":
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json"), keep=("doc_id",)).collect()}
        assert got == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}
    else:
        one = fingerprint.edited(df).select("doc_id", fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near")).orderBy("doc_id").collect()
        assert one[0].near > 0.7 and one[1].near == 0.0
