"""Column functions over source files, patches and model outputs: symbols, imports, claims. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of imports by language, and the groups that may hold the name, the first one with a value counts.
IMPORTS = {
    "python": (r"(?m)^\s*(?:import|from)\s+([\w.]+)", (1,)),
    "javascript": (r"(?m)\(?import\s+(?:['\"])?([\w./]+)|from\s+(['\"])([\w./]+)(['\"])", (3, 2)),
    "go": (r"(?m)^\s*import\s+(\w+)|^\s*package\s+([\w.]+)", (1, 2)),
    "rust": (r"(?m)^\s*use\s+([\w:]+)", (1,)),
    "java": (r"(?m)^\s*import\s+[\w.*]+\s+([\w.]+);", (1,)),
}

# Languages of file extensions.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java"}

# Patterns of HTTP endpoints.
ENDPOINTS = [
    r"@(?:Get|Post|Put|Delete|Patch|RequestMapping|get|post|put|delete|patch)Mapping\(['\"]([^'\"]+)['\"]\)",
    r"(?:route|router)\.(?:get|post|put|delete|patch)\(['\"]([^'\"]+)['\"]",
]

#: The border of a word of ASCII letters, digits and underscore: Java's \b also counts other letters.
BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Pattern of tables that SQL text names; without regard to case, the long s and the Kelvin sign are letters too.
TABLES = r"(?=[FfIiJjTtUu])(?<![A-Za-z0-9_])(?i:FROM|JOIN|INTO|UPDATE|TABLE|INSERT INTO)[ \t\n\f\r]+([A-Za-z_\u017f\u212a][A-Za-z0-9_\u017f\u212a]*)"

# Patterns of symbols; group 1 is the name, but for those of NAME_GROUPS.
SYMBOLS = {
    "python": {
        "function": r"(?m)^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*[^:]+)?:",
        "class": r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\([^)]*\))?\s*:",
    },
    "java": {
        "method": r"(?m)^\s*(?:public|private|protected|static|final|abstract|synchronized|default|\s)*[\w<>.?\[\]]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+\w+)?\s*\{",
        "class": r"(?m)^\s*(?:public|private|protected|abstract|final|\s)*class\s+(\w+)",
        "interface": r"(?m)^\s*(?:public|private|protected|\s)*interface\s+(\w+)",
    },
    "javascript": {
        "function": r"(?m)^(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>|async\s+function\s+(\w+))",
        "class": r"(?m)^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)",
    },
    "go": {"function": r"(?m)^func\s+(?:\([^)]*\)\s+)?(?:\w+\.)?([A-Za-z_][A-Za-z0-9_]*)\s*\("},
    "rust": {"function": r"(?m)^(?:pub\s+)?fn\s+([a-z_][a-z0-9_]*)\s*\("},
    "sql": {"table_reference": r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([A-Za-z_][A-Za-z0-9_]*)"},
}
#: Patterns whose name is in the first of several groups that has a value.
NAME_GROUPS = {("javascript", "function"): (1, 2, 3)}

# Keywords of task types; the first type that has one counts.
TASK_TYPES = {
    "repair": ["repair", "fix", "bug", "failing", "fails", "broken", "exception", "error"],
    "security": ["security", "injection", "traversal", "xss", "ssrf", "vulnerability", "cwe"],
    "review": ["review", "findings", "code review", "pull request"],
    "sql": ["sql", "query", "schema", "join", "transaction", "index", "migration", "stored procedure"],
    "repo_qa": ["where is", "what calls", "what test", "which module", "does this", "defined", "invoked", "covered", "depends", "imports"],
    "infill": ["fill", "complete the function", "complete this", "implement body"],
    "explain": ["explain", "why", "what does", "how does"],
}

# Patterns of claims in outputs, and names that aren't symbols.
FILE_CLAIM = r"[`\"]?([\w./-]+\.(?:py|java|js|ts|tsx|go|rs|c|cc|cpp|h|cs|rb|php|sql|vue))[`\"]?"
SYMBOL_CLAIM = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\.|\band\b|\bof\b|\bin\b)"
NOT_SYMBOLS = ["def", "class", "import", "from", "return", "if", "for", "while", "with", "self", "and", "or", "not", "the", "this"]
TOOL_CLAIM = r"(?i)(?:I (?:ran|ran the|executed)|the (?:tests?|verifier))[^\n]*"
TOOLS = ["tests", "compile", "lint", "formatter", "verifier"]
RELATION = r"[\w./-]+\.(?:py|java|js|ts|go) (?:calls|imports|extends|implements|uses|depends on) [\w./-]+\.(?:py|java|js|ts|go)"

# What a generated patch must not hold.
SUSPICIOUS = [
    rf"{BORDER}(?iu:base64|decrypt|sudo|chmod[ \t\n\f\r]+4?777|pkexec){BORDER}",
    r"(?iu)(/etc/(passwd|shadow)|/root/|\.ssh/)",
    r"(?iu)(curl|wget)[ \t\n\f\r]",
]

# Hints of SQL dialects and words of forbidden writes.
DIALECTS = {
    "postgres": ["now()", "timestamptz", "bigserial"],
    "mysql": ["auto_increment", "engine=innodb", "`"],
    "sqlserver": ["nvarchar", "sysutcdatetime", "top"],
    "oracle": ["dual", "sysdate", "varchar2", "number"],
    "db2": ["from syscat.tables", "current timestamp", "values("],
}
FORBIDDEN_WRITES = ["DELETE", "DROP", "TRUNCATE", "GRANT", "REVOKE"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports(text: Column, extension: str) -> Column:
    """Imported names in order; an extension without a pattern has none."""
    if extension not in LANGUAGES:
        return F.array().cast("array<string>")
    pattern, groups = IMPORTS[LANGUAGES[extension]]
    names = found(text, pattern, groups[0])
    for g in groups[1:]:
        names = F.zip_with(names, found(text, pattern, g), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.filter(names, lambda n: n != "")


def endpoints(text: Column) -> Column:
    return F.concat(*(found(text, p) for p in ENDPOINTS))


def table_references(text: Column) -> Column:
    """Distinct tables in order of first mention."""
    return F.array_distinct(found(text, TABLES))


def _placed(kind: str, names: Column, matched: Column, between: Column) -> Column:
    """Line breaks before each match are summed up along the matches, so a file's work grows with its length."""
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matched)), matched, lambda b, m: F.struct(breaks(b).alias("before"), breaks(m).alias("within")))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("lines"))
    # The array of lines is copied as it grows, by whole blocks of numbers: small beside the patterns' work on the text.
    lines = F.aggregate(steps, start, lambda s, x: F.struct((s["sum"] + x["before"] + x["within"]).alias("sum"), F.concat(s["lines"], F.array(s["sum"] + x["before"] + 1)).alias("lines")), lambda s: s["lines"])
    return F.zip_with(F.arrays_zip(names.alias("name"), matched.alias("signature")), lines, lambda x, line: F.struct(
        F.lit(kind).alias("kind"), x["name"].alias("name"), line.alias("line"), F.regexp_replace(x["signature"], r"^\s+|\s+$", "").alias("signature")))


def _placing(kind: str, names: Column, between: Column) -> Callable[[Column], Column]:
    return lambda matched: _placed(kind, names, matched, between)


def symbols(text: Column, language: str) -> Column:
    """kind, name, line and signature of each symbol, by kind and place.

    A symbol's line follows from the line breaks in the matches before it and in what lies between them.
    """
    kinds = []
    for kind, pattern in SYMBOLS[language].items():
        names = found(text, pattern)
        for g in NAME_GROUPS.get((language, kind), (1,))[1:]:
            names = F.zip_with(names, found(text, pattern, g), lambda a, b: F.when(a != "", a).otherwise(b))
        # A variable of a lambda is made once; an expression that is named thrice is made thrice.
        kinds.append(F.element_at(F.transform(F.array(found(text, pattern, 0)), _placing(kind, names, F.split(text, pattern, -1))), 1))
    return F.concat(*kinds)


def is_test(path: Column, names: Column) -> Column:
    """The path speaks of test or spec, or one of the first 20 symbols does of test."""
    return F.lower(path).rlike("test|spec") | F.exists(F.slice(names, 1, 20), lambda n: F.contains(F.lower(n), F.lit("test")))


def task_type(prompt: Column) -> Column:
    low, out = F.lower(prompt), F.lit("general")
    for kind, words in reversed(TASK_TYPES.items()):
        has = F.lit(False)
        for word in words:
            has = has | F.contains(low, F.lit(word))
        out = F.when(has, kind).otherwise(out)
    return out


def file_claims(text: Column) -> Column:
    return F.array_distinct(found(text, FILE_CLAIM))


def symbol_claims(text: Column) -> Column:
    """Distinct names used like symbols: three characters or more, and ten where they are plain lower case."""
    names = F.array_distinct(found(text, SYMBOL_CLAIM))
    return F.filter(names, lambda n: (F.length(n) >= 3) & ~n.isin(NOT_SYMBOLS) & (n.rlike("[A-Z_]") | (F.length(n) >= 10)))


def tool_claims(text: Column) -> Column:
    """claim and supported (it names a known tool) of each claim to have run something."""
    named = lambda c: F.exists(F.array(*map(F.lit, TOOLS)), lambda t: F.contains(F.lower(c), t))
    return F.transform(found(text, TOOL_CLAIM, 0), lambda c: F.struct(F.substring(F.trim(c), 1, 120).alias("claim"), named(c).alias("supported")))


def relation_claims(text: Column, most: int = 50) -> Column:
    """source and target of the first distinct claims that one file depends on another."""
    ends = F.transform(found(text, RELATION, 0), lambda c: F.struct(F.split(c, " ")[0].alias("source"), F.element_at(F.split(c, " "), -1).alias("target")))
    return F.slice(F.array_distinct(ends), 1, most)


def suspicious(text: Column) -> Column:
    """Numbers, from 0, of the suspicious patterns that occur."""
    return F.filter(F.array(*(F.when(text.rlike(p), n) for n, p in enumerate(SUSPICIOUS))), lambda n: n.isNotNull())


def changed_lines(diff: Column) -> Column:
    """Added and removed lines of a diff, headers apart."""
    return F.size(F.filter(F.split(diff, "\n"), lambda line: line.rlike("^[+-]") & ~line.rlike(r"^(\+\+\+|---|@@)")))


def patch_size(diff: Column) -> Column:
    """Added lines; a billion for no patch."""
    added = F.size(F.filter(F.split(diff, r"\r\n|\n|\r"), lambda line: line.startswith("+") & ~line.startswith("+++")))
    return F.when(F.coalesce(diff, F.lit("")) == "", 1_000_000_000).otherwise(added)


def diff_paths(diff: Column) -> Column:
    """Distinct paths of a diff's headers."""
    return F.array_distinct(found(diff, r"(?m)^(?:---|\+\+\+) [ab]/(\S+)"))


def unsafe_path(path: Column) -> Column:
    """Absolute, on a drive, with a step upwards, or inside a folder of version control."""
    return path.rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(F.split(path, r"[/\\]"), lambda p: p.isin("..", ".git"))


# Tables that statements may name.
SCHEMA_TABLES = ("customer", "project", "task", "invoice", "audit_event")


def schema_tables(sql: Column) -> Column:
    """Known tables that a statement names, between blanks, at the start of a line or at its end."""
    low = F.lower(F.trim(sql))
    named = lambda t: F.contains(low, F.concat(F.lit("\n"), t)) | F.contains(low, F.concat(F.lit(" "), t, F.lit(" "))) | low.endswith(F.concat(F.lit(" "), t))
    return F.filter(F.array(*map(F.lit, SCHEMA_TABLES)), named)


def dialect_grade(sql: Column, dialect: Column) -> Column:
    """forbidden (a word of a write occurs) and hinted (a hint of the dialect occurs; 0 where forbidden)."""
    bad, hinted = F.lit(False), F.lit(False)
    for word in FORBIDDEN_WRITES:
        bad = bad | F.contains(F.upper(sql), F.lit(word))
    for name, hints in DIALECTS.items():
        for hint in hints:
            hinted = hinted | ((dialect == name) & F.contains(F.lower(sql), F.lit(hint)))
    return F.struct(bad.alias("forbidden"), F.when(~bad & hinted, 1.0).otherwise(0.0).alias("hinted"))
