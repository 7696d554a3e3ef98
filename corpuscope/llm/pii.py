"""Personal data: patterns propose spans, checksum validators confirm them, context words adjust the score.

Base kinds are email, ip, card and phone; their patterns are matched leftmost and without overlap for each kind, and
a match that its validator refuses is dropped. Further proposals (`iban`, and cards and national phone numbers that
the base patterns miss) count only if validator and context lift their score to `threshold`; they never displace a
base span. Null text counts as empty. Repeated rows and ties are judged alike; an empty table gives an empty one. Whole
texts of any length are searched, in time that grows with their length and, but for a logarithm, the number of spans. A
column named like the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float
    base: bool


# The local part is the run of its characters before an @, so it is looked up backwards: no rescans of long runs.
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9-])")
_GROUP = re.compile(r"[0-9]+")
_ISSUER = re.compile(r"4|5[1-5]|3[47]|6011|65|2[2-7]")
#: Lengths of a card number's groups as they are printed.
_PRINTED = ([4, 4, 4, 4], [4, 6, 5], [16], [15])

CONTEXT = {
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
}
#: Characters before a span in which context words are looked for.
CONTEXT_CHARS = 40
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The ISO 7064 check of an IBAN without blanks."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(_GROUP.findall(text))


def context_score(text: str, start: int, kind: str) -> float:
    """0.25 if one of the kind's context words stands shortly before the span."""
    words = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start])}
    return 0.25 if words.intersection(CONTEXT[kind]) else 0.0


def base_spans(text: str) -> list[Span]:
    """What the base patterns find and their validators confirm."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and not _NOT_LOCAL.match(text, low - 1, low):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at)):
            out.append(Span(low, "email", m.end(), 0.7, True))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m.group().split("."))):
            out.append(Span(m.start(), "ip", m.end(), 0.7, True))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(Span(m.start(), "card", m.end(), 0.7, True))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append(Span(m.start(), "phone", m.end(), 0.7, True))
    return out


def further_spans(text: str) -> list[Span]:
    """Proposals beyond the base patterns, scored by validator and context."""
    out = []
    for m in _IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            out.append(Span(m.start(), "iban", m.end(), 0.6 + context_score(text, m.start(), "iban"), False))
    for m in _CARD.finditer(text):  # card numbers that run into other numbers: whole groups of digits of what the base rule refused
        if m.end() - m.start() < 15 or (12 <= len(d := digits_of(m.group())) <= 19 and luhn(d)):
            continue
        groups = list(_GROUP.finditer(text, m.start(), m.end()))
        for k in range(len(groups)):
            number, sizes = "", []
            for g in groups[k:]:
                number += g.group()
                sizes.append(len(g.group()))
                if len(number) > 19:
                    break
                if len(number) >= 15 and _ISSUER.match(number) and luhn(number):
                    # Printed like a card, with at most a date or a security code beside it: the layout confirms it too.
                    alone = sizes in _PRINTED and len(d) - len(number) <= 8
                    out.append(Span(groups[k].start(), "card", g.end(), (0.5 if alone else 0.3) + context_score(text, groups[k].start(), "card"), False))
    for m in _NATIONAL.finditer(text):
        out.append(Span(m.start(), "phone", m.end(), 0.3 + context_score(text, m.start(), "phone"), False))
    return out


class _Covered:
    """Places that spans cover, as sorted intervals that don't overlap."""

    def __init__(self, spans: Iterator[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def spans_of(text: str, threshold: float = 0.5) -> list[Span]:
    """All spans of a text by start, then kind: base ones, and further ones that score enough and overlap no other."""
    found = base_spans(text)
    taken = _Covered((s.start, s.end) for s in found)
    for s in sorted(further_spans(text), key=lambda s: (-s.score, s.start, -s.end)):
        if s.score >= threshold and taken.free(s.start, s.end):
            found.append(s)
            taken.add(s.start, s.end)
    found = [s._replace(score=min(1.0, s.score + context_score(text, s.start, s.kind))) if s.base else s for s in found]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.5, out: str = "spans") -> DataFrame:
    """The columns `keep` (all if None) and the spans of each text, offsets in code points, ends exclusive."""
    batches_of(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    src = df.select(*names, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "base": s.base} for s in spans_of(t or "", threshold)] for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _SPANS)], [*names, out])

    return src.mapInArrow(run, f"{schema}, `{out}` array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def masked(text: str, threshold: float = 0.5) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    spans = spans_of(text, threshold)
    k = 0
    while k < len(spans):
        start, end, kind = spans[k].start, spans[k].end, spans[k].kind
        while k + 1 < len(spans) and spans[k + 1].start < end:
            k += 1
            end = max(end, spans[k].end)
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
        k += 1
    return "".join([*out, text[at:]]) if out else text


def mask_pii(df: DataFrame, text: str = "text", length: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """df with personal data masked in its texts, and its column of lengths kept right; other columns stay."""
    batches_of(df.sparkSession)
    at = df.columns.index(text)
    long_at = df.columns.index(length) if length in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [t if t is None else masked(t, threshold) for t in old]
            columns[at] = pa.array(new, batch.schema.types[at])
            if long_at is not None:
                kind = batch.schema.types[long_at]
                columns[long_at] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[long_at].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
