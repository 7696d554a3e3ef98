"""The language kernel against plain sets of n-grams and the textbook form of ridge regression on landmarks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from corpuscope.llm import langid

WORDS = {"en": "the of and to in is that it was for on are with as at be this", "de": "der die und in den von zu das mit sich des auf für ist im dem", "fr": "le la de et les des un une du que est pour qui dans ce il au"}


def places(text):
    """Bits of a text's n-grams, one after another."""
    mask = (1 << 64) - 1
    kind = [48 if "0" <= c <= "9" else 32 if ord(c) <= 32 or ord(c) == 160 else ord(c) for c in text.lower()]
    out = set()
    for n in range(1, 5):
        for i in range(len(kind) - n + 1):
            h = 0
            for c in kind[i : i + n]:
                h = (h * 1000003 + c) & mask
            x = (h + n - 1) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            out.add((x ^ x >> 31) >> 50)
    return out


def kernel(a, b):
    return len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))


def cut(text):
    many = max(1, math.ceil(len(text) / 2048))
    at = [k * len(text) // many for k in range(many + 1)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("landmarks", [9, 60])
def test_kernel(landmarks):
    rng = np.random.default_rng(2)
    say = lambda lang, n: " ".join(f"{w}{rng.integers(9) if rng.random() < 0.2 else ''}" for w in rng.choice(WORDS[lang].split(), n))
    labels = [("en", "de", "fr")[i % 3] for i in range(60)] + ["en"] * 15
    train = [say(x, int(rng.integers(5, 60))) for x in labels]
    sets = [places(t) for t in train]
    bits = np.zeros((len(train), 1 << langid.BITS), np.uint8)
    for row, s in zip(bits, sets, strict=True):
        row[list(s)] = 1
    data = pa.array(train)
    raw = np.frombuffer("".join(train).encode(), np.uint8)
    cp, off = langid.codepoints(raw, np.cumsum([0, *(len(t.encode()) for t in train)]))
    assert (langid.presence(cp, off) == bits).all() and len(data) == len(train)

    model = langid.fitted(bits, labels, landmarks)
    names = sorted(set(labels))
    chosen = [i for x in names for i in [k for k, y in enumerate(labels) if y == x][: landmarks // 3]]
    z = [sets[i] for i in chosen]
    knm = np.array([[kernel(a, b) for b in z] for a in sets])
    kmm = np.array([[kernel(a, b) for b in z] for a in z])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in labels])
    w = np.array([len(labels) / (len(names) * labels.count(x)) for x in labels])
    beta = np.linalg.solve(knm.T @ (knm * w[:, None]) + langid.RIDGE * len(labels) / 100 * kmm, knm.T @ (y * w[:, None]))

    texts = [say("de", 20), say("en", 3000), say("fr", 1), say("fr", 900) + say("de", 700), "Ünd 12 ist", "...", "", None, "x" * 5000]
    langs, scores = langid.predicted(model, pa.array(texts))
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if not any(map(str.isalpha, t or "")):
            assert (lang, score) == ("und", 0.0)
            continue
        f = np.mean([[kernel(places(x), b) for b in z] @ beta for x in cut(t)], axis=0)
        best = np.sort(f)
        assert score == pytest.approx(min(1.0, max(0.0, (best[-1] + 1) / 2)), abs=2e-3)
        assert lang == names[int(f.argmax())] or best[-1] - best[-2] < 2e-3
