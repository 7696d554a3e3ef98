"""Table functions: a row in, as many rows out as a text has chunks or symbols, none of them held together."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from corpuscope.functions.code import NAME_GROUPS, SYMBOLS

SIZE, OVERLAP = 1500, 150


@udtf(returnType="chunk bigint, start bigint, end bigint, text string")
class TextChunks:
    """Chunks of a text in code points: the same as `text.chunk_spans`, without a bound on their number; null has none."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        if text is None:
            return
        n, start, k = len(text), 0, 0
        while start < n or k == 0:
            end = min(start + SIZE, n)
            cut = end
            if n > SIZE:
                at = text.rfind("\n", start, end)
                cut = at if at > start + SIZE // 2 else end
            yield k, start, cut, text[start:cut]
            if n <= SIZE:
                return
            start, k = max(start + 1, cut - OVERLAP), k + 1


#: Languages whose scopes are indented; those of all others are in braces.
INDENTED = {"python"}
_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[{}]', re.DOTALL)


def _declared(text: str, language: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and name of what declares a symbol, by place."""
    found = []
    for kind, pattern in SYMBOLS.get(language, {}).items():
        groups = NAME_GROUPS.get((language, kind), (1,))
        for m in re.finditer(pattern, text):
            lead = len(m.group()) - len(m.group().lstrip())
            found.append((m.start() + lead, m.end(), kind, next(m.group(g) for g in groups if m.group(g))))
    return sorted(found)


def _indented(text: str, declared: list[tuple[int, int, str, str]]) -> list[int]:
    """For each symbol where its scope ends: before the first later line that isn't indented more, blank lines aside."""
    ends, open_ = [len(text)] * len(declared), []
    at, k, last = 0, 0, 0
    for line in text.splitlines(keepends=True):
        solid = line.lstrip()
        inside = k > 0 and at < declared[k - 1][1]  # a declaration may go over several lines
        if solid and not inside:
            indent = len(line) - len(solid)
            while open_ and open_[-1][0] >= indent:
                ends[open_.pop()[1]] = last
            if k < len(declared) and declared[k][0] < at + len(line):
                open_.append((indent, k))
                k += 1
        if solid:
            last = at + len(line.rstrip())
        at += len(line)
    for _, i in open_:
        ends[i] = last
    return ends


def _braced(text: str, declared: list[tuple[int, int, str, str]]) -> list[int]:
    """For each symbol the end of the braces that follow it, or of the declaration if a statement ends before any."""
    ends, waiting, open_, k = [d[1] for d in declared], [], [], 0
    for m in _TOKEN.finditer(text):
        if m.group() not in "{}":
            continue
        while k < len(declared) and declared[k][0] <= m.start():
            waiting.append(k)
            k += 1
        if m.group() == "{":
            mine = [i for i in waiting if ";" not in text[declared[i][1] : m.start()]][-1:]
            waiting = []
            open_.append(mine)
        elif open_:
            for i in open_.pop():
                ends[i] = m.end()
    for left in open_:
        for i in left:
            ends[i] = len(text)
    return ends


@udtf(returnType="kind string, name string, qualified string, line bigint, end_line bigint")
class ScopedSymbols:
    """Symbols of a source text with the scopes around them: `Outer.inner`, and their first and last lines.

    Scopes are intervals of the text that lie in each other; one pass over symbols by place keeps the open ones. Work grows
    with the text's length and the depth of scopes.
    """

    def eval(self, text: str, language: str) -> Iterator[tuple[str, str, str, int, int]]:
        if text is None:
            return
        declared = _declared(text, language)
        ends = (_indented if language in INDENTED else _braced)(text, declared)
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_right(breaks, at - 1) + 1
        scope: list[tuple[int, str]] = []
        for (start, _, kind, name), end in zip(declared, ends, strict=True):
            while scope and scope[-1][0] <= start:
                scope.pop()
            scope.append((end, name))
            yield kind, name, ".".join(n for _, n in scope), line(start), line(max(start, end - 1))
