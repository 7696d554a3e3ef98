"""Column functions over text: tokens, cleaning, buckets, hashes and splits. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9_]+)"), 1)


def retrieval_tokens(text: Column) -> Column:
    """Word tokens of more than one character."""
    return F.filter(word_tokens(text), lambda t: F.length(t) > 1)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(4.0)).cast("int"))


def size_bucket(chars: Column) -> Column:
    return F.when(chars < 1000, "0-1k").when(chars < 10000, "1k-10k").otherwise("10k+")


def split_of(key: Column) -> Column:
    """train, validation or test by the first 64 bits of sha256 of the key, as a fraction: below 0.9, 0.95, 1."""
    u = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))
    return F.when(u < 0.9, "train").when(u < 0.95, "validation").otherwise("test")


# Separators of lines, and what is stripped at their ends (fixed values of Unicode).
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK = r"\s\x1c-\x1f"

# What marks generated files in their first 2000 characters, and folders of foreign code.
GENERATED = r"(auto-generated|automatically generated|generated by|do not edit[!—]*|this file is generated|@generated|swagger codegen|protoc |eslint-disable.*generated|bundle\.js|\.min\.css)"
VENDOR = r"(^|/)(vendor|third_party|thirdparty|deps|external)/"


def cleaned(text: Column) -> Column:
    """Without byte order marks, with \\n line ends, lines right-stripped and the whole stripped."""
    lines = F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), LINE_BREAKS, "\n")
    # A run of blanks is looked at once: a match may not begin inside one.
    lines = F.regexp_replace(lines, rf"(?U)(?<![{BLANK}&&[^\n]])[{BLANK}&&[^\n]]++(?=\n|\z)", "")
    return F.regexp_replace(lines, rf"(?U)^[{BLANK}]+|(?<![{BLANK}])[{BLANK}]++\z", "")


def clean_flags(text: Column, done: Column) -> Column:
    """What cleaning `text` to `done` found: empty alone, or bom-removed, crlf-normalized, too-long-line, generated-marker, no-identifiers."""
    long = (F.length(done) > 100_000) & F.exists(F.split(done, "\n"), lambda line: F.length(line) > 100_000)
    flags = F.array(
        F.when(text.startswith("﻿"), "bom-removed"),
        F.when(F.contains(text, F.lit("\r\n")), "crlf-normalized"),
        F.when(long, "too-long-line"),
        F.when(F.substring(done, 1, 2000).rlike("(?i)" + GENERATED), "generated-marker"),
        F.when(~done.rlike("[A-Za-z_]{2,}"), "no-identifiers"),
    )
    return F.when(done == "", F.array(F.lit("empty"))).otherwise(F.filter(flags, lambda f: f.isNotNull()))


def drop_reason(flags: Column, path: Column) -> Column:
    """Why a cleaned file goes: empty, too-long-line, generated-marker or vendor; null if it stays."""
    out = F.when(path.rlike(VENDOR), "vendor")
    for flag in ("generated-marker", "too-long-line", "empty"):
        out = F.when(F.array_contains(flags, flag), flag).otherwise(out)
    return out


def word_shingles(tokens: Column, size: int = 5) -> Column:
    """Runs of `size` tokens, joined by blanks; fewer tokens have none."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
    # An array of one, so that the tokens are found once and not for each run.
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= size, runs(t)).otherwise(F.array().cast("array<string>"))), 1)


def chunk_id(path: Column, start: Column, text: Column) -> Column:
    """The first 16 digits of sha256 of path, start and text, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), text).cast("binary"), 256), 1, 16)


def fim(text: Column, share: float = 0.1 + 0.4 * 0.8444218515250481) -> Column:
    """Prefix and middle changed over for filling in the middle; null below 20 characters."""
    cut = F.floor(F.length(text) * F.lit(share)).cast("int")
    return F.when(F.length(text) >= 20, F.concat(F.lit("<fim_prefix>"), F.substring(text, F.lit(1), cut), F.lit("<fim_suffix><fim_middle>"), F.substring(text, cut + 1, F.length(text))))


# Patterns of unsafe code, matched without regard to case.
SECURITY = {
    "sql_injection": r"execute\(\s*[\"'][^\"']*%.*[\"']",
    "path_traversal": r"open\(\s*os\.path\.join\([^)]+\)",
    "xss": r"innerHTML\s*=|dangerouslySetInnerHTML|v-html\s*=",
    "weak_crypto": r"md5\(|sha1\(|DES|RC4",
    "hardcoded_secret": r"(password|secret|api_key)\s*=\s*[\"'][^\"']{6,}[\"']",
    "authz_omission": r"@app\.route\s*\([^)]*methods=\[[^]]*\"DELETE\"|\"POST\"\]\)",
}


def security_kinds(text: Column) -> Column:
    """Names of the patterns that occur in a text."""
    return F.filter(F.array(*(F.when(text.rlike("(?i)" + p), k) for k, p in SECURITY.items())), lambda k: k.isNotNull())


# Kinds of high severity (others are medium), weakness numbers of kinds (others have CWE-000).
HIGH = ("sql_injection", "path_traversal", "weak_crypto", "hardcoded_secret")
CWE = {"sql_injection": "CWE-89", "path_traversal": "CWE-22", "xss": "CWE-79", "weak_crypto": "CWE-327", "hardcoded_secret": "CWE-798"}


def security_findings(text: Column) -> Column:
    """category, severity, cwe, line and confidence of every match of the patterns.

    A match's line follows from the line breaks in what is before it: the pieces between the matches and the matches.
    """
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    count = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, t: a + breaks(t))

    def of(kind: str, pattern: str) -> Column:
        severity, cwe = F.lit("high" if kind in HIGH else "medium"), F.lit(CWE.get(kind, "CWE-000"))
        line = lambda x, i: (count(x["between"], i + 1) + count(x["matched"], i) + 1).alias("line")
        finding = lambda x, i: F.struct(F.lit(kind).alias("category"), severity.alias("severity"), cwe.alias("cwe"), line(x, i), F.lit(0.9).alias("confidence"))
        parts = F.struct(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0)).alias("matched"), F.split(text, "(?i)" + pattern, -1).alias("between"))
        return F.element_at(F.transform(F.array(parts), lambda x: F.transform(x["matched"], lambda _, i: finding(x, i))), 1)

    return F.concat(*(of(kind, pattern) for kind, pattern in SECURITY.items()))


def chunk_spans(text: Column, size: int = 1500, overlap: int = 150, most: int = 10_001, block: int = 4096) -> Column:
    """(start, end) of a text's chunks in code points; null has none.

    A text of at most `size` is one chunk. Else a chunk ends at the last newline of its second half, if there is one, and
    the next starts `overlap` before that. From the chunk that reaches the end on, every later start gives a chunk of its
    own up to the end. No more than `most` chunks are made. The text is cut into blocks (of at least `size`) once, so that a
    chunk doesn't count code points from the start of the text.
    """
    kind = "array<struct<start:bigint,end:bigint>>"
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    once = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  (f uses v more than once)
    begin = F.struct(F.lit(0).cast("long").alias("start"), F.array().cast(kind).alias("spans"), F.lit(False).alias("done"))

    def step(n: Column, blocks: Column, s: Column) -> Column:
        start = s["start"]
        at = F.floor(start / block).cast("int")
        near = F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit("")))
        end = F.least(start + size, n)
        back = F.instr(F.reverse(F.substring(near, (start - at * block + 1).cast("int"), (end - start).cast("int"))), "\n")
        cut = once(back, lambda r: F.when((r > 0) & (end - r > start + size // 2), end - r).otherwise(end))
        new = once(cut, lambda c: F.struct(F.greatest(start + 1, c - overlap).alias("start"), F.concat(s["spans"], F.array(span(start, c))).alias("spans"), (c == n).alias("done")))
        return F.when(s["done"], s).otherwise(new)

    def ended(n: Column, loop: Column) -> Column:
        tail = F.when(loop["start"] < n, F.transform(F.sequence(loop["start"], n - 1), lambda i: span(i, n))).otherwise(F.array().cast(kind))
        return F.slice(F.concat(loop["spans"], tail), 1, most)

    def cuts(v: Column) -> Column:
        n = v["n"]
        # A chunk advances by more than half its size less the overlap.
        rounds = F.sequence(F.lit(1), F.floor(n / (size // 2 - overlap)).cast("int") + 2)
        loop = once(F.aggregate(rounds, begin, lambda s, _: step(n, v["blocks"], s)), lambda loop: ended(n, loop))
        return F.when(n <= size, F.array(span(F.lit(0), n))).when(n > size, loop)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return once(F.struct(F.length(text).cast("long").alias("n"), blocks.alias("blocks")), cuts)


def test_counts(summary: Column) -> Column:
    """passed, failed, error, skipped and collected of a test summary; zeros if no tests ran."""
    none = summary.rlike("(?i)no tests ran")
    first = lambda word: F.when(none, 0).otherwise(F.coalesce(F.regexp_extract(summary, rf"(\d+)\s+{word}", 1).try_cast("int"), F.lit(0)))
    each = {"passed": first("passed"), "failed": first("failed"), "error": first("errors"), "skipped": first("skipped")}
    return F.struct(*(c.alias(k) for k, c in each.items()), (each["passed"] + each["failed"] + each["error"] + each["skipped"]).alias("collected"))


def node_id(path: Column) -> Column:
    """Other characters than letters, digits and _ . / - become -, which is stripped at both ends."""
    return F.btrim(id_characters(path), F.lit("-"))


def id_characters(path: Column) -> Column:
    """What a node's id is before it is stripped; that of joined texts is that of the texts, joined."""
    return F.regexp_replace(path, "[^A-Za-z0-9_./-]", "-")


# Weights of a verifier's findings.
REWARDS = {"hidden_tests_pass": 1.0, "compiles": 0.2, "patch_minimal": 0.1, "new_regression": -0.2, "linter_security_regression": -0.3, "timeout": -1.0, "sandbox_violation": -1.0}


def reward(found: dict[str, Column]) -> Column:
    """Sum of the weights of what was found; null counts as not found."""
    total = F.lit(0.0)
    for name, weight in REWARDS.items():
        if name in found:
            total = total + F.when(found[name], weight).otherwise(0.0)
    return total


def canonical(value: Column, kind: str) -> Column:
    """A value in the form that digests are taken of: strings bare, null and booleans as words, maps by sorted keys.

    kind: the value's type as Spark names it; arrays, maps and structs of scalars and of each other.
    """
    if kind.startswith("array<"):
        said = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind[6:-1])), ","), F.lit("]"))
    elif kind.startswith("map<string,"):
        entries = F.array_sort(F.map_entries(value))
        said = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), canonical(e["value"], kind[11:-1]))), ","), F.lit("}"))
    else:
        said = value.cast("string")
    return F.coalesce(said, F.lit("null"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n...[truncated]")))


# Advice for another attempt.
ADVICE = (
    "Checklist for next attempt:",
    "- Re-read the failing test/file before writing the patch.",
    "- Check indices, off-by-one, null handling, and the exact expected function/return type.",
    "- Prefer the smallest patch that targets the failure.",
    "- After patching, run the tests again before finishing.",
)


def reflection(summary: Column, kind: Column, log: Column, prior: Column) -> Column:
    """What a failed attempt teaches the next one; the log is cut at 1500 characters."""
    said = F.trim(F.coalesce(log, F.lit("")))
    lines = F.array(
        F.lit("The previous attempt failed."), F.concat(F.lit("Verifier: "), summary), F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("Failure kind: "), kind)),
        F.when(said != "", F.concat(F.lit("Log excerpt:\n"), truncated(F.replace(said, F.lit("\\n"), F.lit("\n")), 1500), F.lit("\n" + "\n".join(ADVICE)))),
        F.concat(F.lit("Attempt history: "), prior + 1, F.lit(" failed attempt(s).")),
    )
    return F.array_join(lines, "\n")  # nulls are left out


# What counts as a function (letters are ASCII ones, which Java's \b does not keep to) and as an identifier.
FUNCTIONS = r"(?<![A-Za-z0-9_])(?:def|function|func|fn|public\s+\w+\s+\w+|private\s+\w+\s+\w+)\s+\w+\s*\("
IDENTIFIERS = r"[A-Za-z_][A-Za-z0-9_]*(?:\([^)]*\))?"


# Languages of collected files by their endings.
FILE_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescriptreact", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".scala": "scala", ".kt": "kotlin", ".sql": "sql", ".vue": "vue",
    ".svelte": "svelte", ".html": "html", ".css": "css", ".scss": "scss", ".sh": "shell", ".bash": "shell",
}


def file_language(ending: Column) -> Column:
    """The language of a file's ending (in lower case), or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in FILE_LANGUAGES.items() for x in pair)), ending)
