"""Queries over texts: shingles, prompts, candidates, mutations, digests, splits and token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import candidates, code, gates, records, text
from corpuscope.operators import dedup, order, sketch
from corpuscope.operators.cut import cut
from corpuscope.registry import query, table


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    said = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[({key} % {len(values)} + 1)::INT]"


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(0, len(w) - 4)::BIGINT AS n, CASE WHEN len(w) > 4 THEN array_to_string(w[1:5], ' ') END AS first, CASE WHEN len(w) > 4 THEN array_to_string(w[len(w) - 4:len(w)], ' ') END AS last FROM t""")
def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: shingles of five words; fewer words have none."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.word_shingles(text.word_tokens(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


_ENDINGS = [".py", ".pyi", ".java", ".JS", ".jsx", ".ts", ".tsx", ".go", ".rs", ".rb", ".php", ".c", ".h", ".cc", ".cpp", ".cs", ".scala", ".kt", ".sql", ".vue", ".svelte", ".html", ".css", ".scss", ".sh", ".bash", ".txt", ""]
_LANGUAGES = ["python", "python", "java", "javascript", "javascript", "typescript", "typescriptreact", "go", "rust", "ruby", "php", "c", "c", "cpp", "cpp", "csharp", "scala", "kotlin", "sql", "vue", "svelte", "html", "css", "scss", "shell", "shell", "", ""]


@query(f"SELECT nullif({_pick_sql(_LANGUAGES, 'page_id')}, '') AS language, count(*) AS n FROM pages GROUP BY 1")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of paths by their endings."""
    path = F.concat(F.lit("a/f"), "page_id", _pick(_ENDINGS, "page_id"))
    return table(spark, sf_dir, "pages").groupBy(text.file_language(gates.suffix(path)).alias("language")).agg(F.count("*").alias("n"))


_OUTPUTS = [
    "Sure:\n```python\nprint(1)\n```\nand ```js\nx\n```", "```\nonly one\n```", "```js\n \n```\n```rs\nfn a() {}\n```", "plain words", "   ", "```go\n\n```\n```c\n \n```",
    "Here is it\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n same\nThat's all\n+no", "--- a/y.py\n+++ b/y.py\n@@ -0,0 +1 @@\n+new\n", "```python\n```",
]
_DIFF_LINE = r"regexp_matches(x, '^(\+|-| |@@|\\)') OR regexp_matches(x, '^\s*diff --git\s+a/') OR regexp_matches(x, '^\s*(new file mode|deleted file mode|index |similarity |rename |GIT binary)')"


@query(rf"""
WITH o AS (SELECT conv_id, turn, role, regexp_replace(coalesce(CASE WHEN (conv_id + turn) % 9 = 3 THEN text END, '') || {_pick_sql(_OUTPUTS, '(conv_id + turn)')}, '^\s+|\s+$', '', 'g') AS raw FROM conversations),
p AS (SELECT *, regexp_extract_all(raw, '(?s)```([A-Za-z0-9_+-]*)[ \t]*\n?(.*?)```', 1) AS tags, regexp_extract_all(raw, '(?s)```([A-Za-z0-9_+-]*)[ \t]*\n?(.*?)```', 2) AS codes,
  regexp_matches(raw, '(?m)^\s*diff --git\s+a/(.+?)\s+b/(.+?)\s*$') OR regexp_matches(raw, '(?m)^\s*(?:---|\+\+\+)\s+(?:a/)?(\S+)\s*$') AS diff, string_split(raw, chr(10)) AS lines FROM o),
q AS (SELECT *, lines[greatest(1, coalesce(list_position(list_transform(lines, lambda x: starts_with(trim(x), 'diff --git') OR regexp_matches(trim(x), '^---\s+(a/)?\S+')), true), 1)):] AS rest,
  CASE WHEN list_has_any(tags, ['python', 'py']) THEN codes[list_position(list_transform(tags, lambda x: x IN ('python', 'py')), true)] WHEN len(codes) = 1 THEN codes[1] ELSE list_filter(codes, lambda x: regexp_matches(x, '\S'))[1] END AS code FROM p),
k AS (SELECT *, list_position(list_transform(rest, lambda x: {_DIFF_LINE}), true) AS a FROM q),
b AS (SELECT *, CASE WHEN a > 0 THEN rest[a:] ELSE [] END AS kept FROM k),
c AS (SELECT *, list_position(list_transform(kept, lambda x: NOT ({_DIFF_LINE})), true) AS z FROM b),
d AS (SELECT *, CASE WHEN diff THEN regexp_replace(array_to_string(CASE WHEN z > 0 THEN kept[:z - 1] ELSE kept END, chr(10)), '^\n+|\n+$', '', 'g') WHEN len(codes) > 0 THEN regexp_replace(code, '^\s+|\s+$', '', 'g') ELSE raw END AS content FROM c),
f AS (SELECT *, CASE WHEN raw = '' THEN 'candidate output is empty' WHEN diff AND content = '' THEN 'candidate diff is empty' WHEN content IS NULL THEN 'no non-empty code fence found' WHEN content = '' THEN 'candidate source is empty' END AS fault FROM d)
SELECT conv_id, turn, role, CASE WHEN fault IS NULL THEN CASE WHEN diff THEN 'unified_diff' ELSE 'full_file' END END AS kind, CASE WHEN fault IS NULL THEN sha256(content) END AS sha256, CASE WHEN fault IS NULL THEN strlen(content) END::INT AS byte_count, fault FROM f""")
def candidate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in outputs of nine shapes, some with a turn's text before them."""
    number = F.col("conv_id") + F.col("turn")
    said = F.coalesce(F.when(number % 9 == 3, F.col("text")), F.lit(""))
    rows = table(spark, sf_dir, "conversations").withColumn("number", number).withColumn("said", F.concat(said, _pick(_OUTPUTS, "number")))
    return rows.select("conv_id", "turn", "role", candidates.candidate(F.col("said")).alias("c")).select("conv_id", "turn", "role", "c.kind", "c.sha256", "c.byte_count", "c.fault")


_DIFFS = [
    "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-x\n+y\n", "--- a/pkg/b{0}.py\n+++ b/pkg/b{0}.py\n@@\n+z\n", "diff --git a/q{0}.py b/q{0}.py\nnew file mode 100644\n", "--- /etc/passwd\n+++ /etc/passwd\n", "--- a/../x.py\n+++ a/../x.py\n",
    "--- tests/t.py\n+++ tests/t.py\n", "--- a/src/.git/config\n+++ a/src/.git/config\n", "--- C:/x\n+++ C:/x\n", "just words", "--- a/deep/a.py\n+++ a/deep/a.py\n", "--- src\\a.py\n+++ src\\a.py\n",
]

_UNSAFE = r"""CASE WHEN starts_with(x, '/') OR regexp_matches(x, '^[A-Za-z]:') THEN 'absolute path' WHEN list_contains(string_split(x, '/'), '..') THEN 'parent traversal'
  WHEN list_contains(string_split(x, '/'), '.git') OR regexp_matches(x, '^(tests|benches_hidden|hidden_tests|benchmarks/hidden_tests|\.git)') THEN 'protected path' END"""


@query(rf"""
WITH d AS (SELECT o_orderkey, replace({_pick_sql(_DIFFS, 'o_orderkey')}, '{{0}}', o_custkey::VARCHAR) AS diff, CASE WHEN o_custkey % 2 = 0 THEN ['src/a.py'] ELSE ['src/a.py', 'src/c.py'] END AS allowed FROM orders),
h AS (SELECT *, regexp_extract_all(diff, '(?m)^diff --git a/(\S+) b/(\S+)$', 1) || regexp_extract_all(diff, '(?m)^diff --git a/(\S+) b/(\S+)$', 2) AS git, regexp_extract_all(diff, '(?m)^(?:---|\+\+\+) (?:a/)?(\S+)$', 1) AS plain FROM d),
p AS (SELECT *, list_transform(CASE WHEN len(git) > 0 THEN git ELSE plain END, lambda x: replace(x, '\', '/')) AS paths FROM h),
n AS (SELECT *, len(list_distinct(paths)) AS n_paths, list_filter(list_transform(paths, lambda x: {_UNSAFE}), lambda x: x IS NOT NULL)[1] AS bad,
  len(list_filter(paths, lambda x: NOT (list_contains(allowed, x) OR (len(allowed) = 1 AND string_split(x, '/')[-1] = 'a.py')))) AS unlisted FROM p)
SELECT o_orderkey, CASE WHEN regexp_matches(diff, '(?m)^(new file mode|deleted file mode) ') THEN 'creation or deletion' WHEN bad IS NOT NULL THEN bad WHEN unlisted > 0 THEN 'unlisted path' WHEN n_paths = 0 THEN 'no changed files' END AS fault, n_paths,
  regexp_replace(regexp_replace(regexp_replace(diff, '(?m)^--- a/\S+', '--- a/src/m' || o_orderkey || '.py', 'g'), '(?m)^\+\+\+ b/\S+', '+++ b/src/m' || o_orderkey || '.py', 'g'), '(?m)^diff --git a/\S+ b/\S+', 'diff --git a/src/m' || o_orderkey || '.py b/src/m' || o_orderkey || '.py', 'g') AS retargeted FROM n""")
def patch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of eleven shapes against one or two allowed files, and the patches with another target in their headers."""
    diff = F.replace(_pick(_DIFFS, "o_orderkey"), F.lit("{0}"), F.col("o_custkey").cast("string"))
    allowed = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("src/a.py"))).otherwise(F.array(F.lit("src/a.py"), F.lit("src/c.py")))
    return table(spark, sf_dir, "orders").select("o_orderkey", candidates.target_fault(diff, allowed).alias("fault"), F.size(candidates.header_paths(diff)).cast("long").alias("n_paths"), candidates.retargeted(diff, F.concat(F.lit("src/m"), "o_orderkey", F.lit(".py"))).alias("retargeted"))


@query()  # difflib's matching isn't a function of SQL; a test compares with difflib itself
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines from each turn of a conversation to the next."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after")), ["conv_id", "turn"])
    broken = lambda c: F.replace(c, F.lit(" "), F.lit("\n"))
    return pairs.select("conv_id", "turn", candidates.line_changes(broken(F.col("text")), broken(F.col("after"))).alias("changed"))


# Programs that are written from an order's numbers: {0} is its customer, {1} its key.
_PROGRAMS = [
    "import os\ndef f(x):\n    if not x:\n        raise ValueError({0})\n    return int(x) + {1}\n",
    "def g(n):\n    total = 0\n    for i in range({0}):\n        total += i\n    return str(total)\n",
    "x = {0}\nfrom a import b\nimport sys\ny = float(x) == {1}\n",
    "def h(a):\n    if a is not None:\n        b = a - {0}\n    return [1][:{1}] and a >= range(2, {0})\n",
]
_CODE = f"replace(replace({_pick_sql(_PROGRAMS, 'o_orderkey')}, '{{0}}', o_custkey::VARCHAR), '{{1}}', o_orderkey::VARCHAR) AS code"


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.replace(F.replace(_pick(_PROGRAMS, "o_orderkey"), F.lit("{0}"), F.col("o_custkey").cast("string")), F.lit("{1}"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))


@query(rf"""
WITH p AS (SELECT o_orderkey, {_CODE} FROM orders)
SELECT o_orderkey, regexp_replace(code, '(?m)^import (\w)', 'import _missing_\1') AS broken_import, CASE WHEN contains(code, 'int(') THEN regexp_replace(code, 'int\(', 'float(') WHEN contains(code, 'float(') THEN regexp_replace(code, 'float\(', 'int(') WHEN contains(code, 'str(') THEN regexp_replace(code, 'str\(', 'int(') ELSE code END AS wrong_conversion,
  regexp_replace(regexp_replace(code, '\n$', ''), '(?m)^(\s*)return\b', '\1if True:' || chr(10) || '\1    pass  # unreachable' || chr(10) || '\1return') AS dead_code FROM p""")
def plain_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutations that draw no numbers, of a program for each order."""
    program = F.col("code")
    return _programs(spark, sf_dir).select("o_orderkey", candidates.broken_import(program).alias("broken_import"), candidates.wrong_conversion(program).alias("wrong_conversion"), candidates.dead_code(program).alias("dead_code"))


def _draw_sql(name: str, n: str) -> str:
    return f"(('0x' || substr(md5(o_orderkey || ':{name}'), 1, 8))::BIGINT % ({n}))"


def _respelled_sql(pattern: str, at: str, new: str) -> str:
    """SQL for code with its match number `at` (from 0, {m} is the number of matches) spelled as `new`, where {x} is the match."""
    found = f"regexp_extract_all(code, '{pattern}')"
    m = f"greatest(1, len({found}))"
    return f"array_to_string(list_transform(regexp_split_to_array(code, '{pattern}'), lambda b, i: b || CASE WHEN i - 1 = {at.format(m=m)} AND len({found}) > 0 THEN {new.format(x=f'{found}[i]')} ELSE coalesce({found}[i], '') END), '')"


_OPPOSITE_SQL = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in candidates.OPPOSITE.items()) + " END"
_OPERATORS_SQL = "[" + ", ".join(f"'{x}'" for x in candidates.OPERATORS) + "]"
_CONSTANT_SQL = _respelled_sql(candidates.NUMBERS, _draw_sql("constant:place", "{m}"), f"({{x}}::BIGINT + ([1, -1, 2, -2])[{_draw_sql('constant:shift', '4')} + 1])::VARCHAR")


@query(rf"""
WITH p AS (SELECT o_orderkey, {_CODE} FROM orders),
r AS (SELECT *, CASE WHEN regexp_matches(code, '\brange\(\d+\)') THEN regexp_replace(code, '\brange\(\d+\)', 'range(' || (regexp_extract(code, '\brange\((\d+)\)', 1)::BIGINT + 1) || ')')
  WHEN regexp_matches(code, '\brange\(\d+,\s*\d+\)') THEN regexp_replace(code, '\brange\(\d+,\s*\d+\)', regexp_extract(code, '\b(range\(\d+,\s*)\d+\)', 1) || (regexp_extract(code, '\brange\(\d+,\s*(\d+)\)', 1)::BIGINT + 1) || ')') ELSE code END AS bound,
  CASE WHEN regexp_matches(code, '\s*if\s+\w+\s+is\s+not\s+None:') THEN regexp_replace(code, '(?s)\s*if\s+\w+\s+is\s+not\s+None:\s*\n(.*?)\n\s*', repeat(chr(10), 3) || '    pass' || chr(10))
  WHEN regexp_matches(code, '\s*if\s+not\s+\w+:') THEN regexp_replace(code, '(?s)\s*if\s+not\s+\w+:\s*\n(.*?)\n\s*raise', repeat(chr(10), 2) || '    pass' || chr(10)) ELSE code END AS unguarded,
  {_CONSTANT_SQL} AS constant, {_respelled_sql(candidates.COMPARISONS, _draw_sql("comparison:place", "{m}"), _OPPOSITE_SQL)} AS opposite,
  {_respelled_sql(candidates.OPERANDS, _draw_sql("operand:place", "{m}"), f"({_OPERATORS_SQL})[(list_position({_OPERATORS_SQL}, {{x}}) + {_draw_sql('operand:step', '6')}) % 7 + 1]")} AS operand FROM p),
o AS (SELECT *, ([{", ".join(f"'{x}'" for x in candidates.DRAWN)}])[(o_orderkey % 5 + 1)::INT] AS operator, CASE o_orderkey % 5 WHEN 0 THEN bound WHEN 1 THEN opposite WHEN 2 THEN unguarded WHEN 3 THEN operand ELSE constant END AS bad FROM r)
SELECT o_orderkey, 'Repair the bug.' AS instruction, operator, CASE WHEN bad = code THEN constant ELSE bad END AS bad_code, code AS fixed_code FROM o""")
def repair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair tasks, one for each order, of five mutations that draw by hashes, seeded by the order."""
    names, n = list(candidates.DRAWN), F.col("o_orderkey") % len(candidates.DRAWN)
    bad = F.coalesce(*(F.when(n == k, candidates.mutated(F.col("code"), name, F.col("o_orderkey"))) for k, name in enumerate(names)))
    return _programs(spark, sf_dir).select("o_orderkey", F.lit("Repair the bug.").alias("instruction"), F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int")).alias("operator"), bad.alias("bad_code"), F.col("code").alias("fixed_code"))


@query("""
WITH d AS (SELECT source, '### d' || doc_id || '.txt' || chr(10) || substr(text, 1, 3000) AS block, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL)
SELECT source, sha256(string_agg(block, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'TASK:' || chr(10) || 'fix it') AS context_sha256 FROM d WHERE n <= 8 GROUP BY source""")
def context_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight documents of a source, cut at 3000 characters (both are the feature), and the task behind them."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("source", "doc_id", F.concat(F.lit("### d"), "doc_id", F.lit(".txt\n"), F.substring("text", 1, 3000)).alias("block"))
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 8")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda b: b["block"])
    said = F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\nTASK:\nfix it"))
    return first.groupBy("source").agg(F.sha2(said.cast("binary"), 256).alias("context_sha256"))


@query("""
WITH c AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS log, CASE WHEN turn % 2 = 0 THEN 'TEST_FAIL' END AS kind FROM conversations)
SELECT conv_id, turn, role, sha256('The previous attempt failed.' || chr(10) || 'Verifier: ' || role || CASE WHEN kind IS NOT NULL THEN chr(10) || 'Failure kind: ' || kind ELSE '' END || CASE WHEN log <> '' THEN chr(10) || 'Log excerpt:' || chr(10) || substr(log, 1, 1500) || CASE WHEN length(log) > 1500 THEN chr(10) || '...[truncated]' ELSE '' END
  || chr(10) || 'Checklist for next attempt:' || chr(10) || '- Re-read the failing test/file before writing the patch.' || chr(10) || '- Check indices, off-by-one, null handling, and the exact expected function/return type.' || chr(10) || '- Prefer the smallest patch that targets the failure.' || chr(10) || '- After patching, run the tests again before finishing.' ELSE '' END
  || chr(10) || 'Attempt history: ' || turn + 1 || ' failed attempt(s).') AS reflection_sha256, substr(log, 1, 120) AS summary FROM c""")
def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance after a failed attempt, and the first 120 characters of an event."""
    said = text.reflection(F.col("role"), F.when(F.col("turn") % 2 == 0, "TEST_FAIL"), F.col("text"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(said.cast("binary"), 256).alias("reflection_sha256"), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 120).alias("summary"))


@query("""
SELECT o_orderkey, sha256('{key:' || o_orderkey || ',nothing:null,status:' || o_orderstatus || ',tags:[' || o_orderpriority || ',x]}') AS hash, substr(sha256('{key:' || o_orderkey || ',nothing:null,status:' || o_orderstatus || ',tags:[' || o_orderpriority || ',x]}'), 1, 12) AS short FROM orders""")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of records in canonical form, keys sorted, strings bare."""
    tags = text.canonical(F.array(F.col("o_orderpriority"), F.lit("x")), "array<string>")
    record = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("tags"), tags, F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("nothing"), F.lit(None).cast("string"))
    hash_ = F.sha2(text.canonical(record, "map<string,string>").cast("binary"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", hash_.alias("hash"), F.substring(hash_, 1, 12).alias("short"))


@query()  # DuckDB has no crc32; a test compares with zlib
def text_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crc32 of each text."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("""
WITH d AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM d)
SELECT doc_id, CASE WHEN place < floor(n * 0.9::DOUBLE) THEN 'train' WHEN place < floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded permutation cut at whole counts. The permutation follows hashes of seed and id, not a generator's draws: these would have to be made one after another."""
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct()
    placed = order.numbered(ids.withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary"))), [F.col("h"), F.col("doc_id")])
    n = ids.agg(F.count("*").alias("n"))
    rows = placed.crossJoin(F.broadcast(n))  # one row
    train = F.floor(F.col("n") * 0.9)
    return rows.select("doc_id", F.when(F.col("place") < train, "train").when(F.col("place") < train + F.floor(F.col("n") * 0.05), "validation").otherwise("test").alias("split"))


_STREAM = """
d AS (SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) + 1 AS tokens FROM documents WHERE regexp_matches(text, '\\S')),
s AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't blank, their characters, tokens (an end mark behind each), and the characters before them."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", F.length("text").cast("long").alias("chars"), (F.size(text.word_tokens(F.col("text"))) + 1).cast("long").alias("tokens"))
    return order.running_total(docs, [F.col("doc_id")], F.col("chars"))


@query(f"WITH {_STREAM} SELECT doc_id, chars, tokens, before FROM s WHERE before < 200000")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a token stream that stops once 200,000 characters are reached (an early stop is the feature)."""
    return _stream(spark, sf_dir).where("before < 200000").select("doc_id", "chars", "tokens", "before")


@query(f"""
WITH {_STREAM}, t AS (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY doc_id) - tokens AS a, sum(tokens) OVER () AS n FROM d), c AS (SELECT *, floor(n * 0.9::DOUBLE) AS c1, floor(n * (0.9::DOUBLE + (1 - 0.9::DOUBLE) / 2)) AS c2 FROM t)
SELECT doc_id, greatest(0, least(a + tokens, c1) - a)::BIGINT AS train, greatest(0, least(a + tokens, c2) - greatest(a, c1))::BIGINT AS validation, greatest(0, a + tokens - greatest(a, c2))::BIGINT AS test FROM c""")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token stream cut at 90, 5 and 5 hundredths by position: how many tokens of each document fall to which part."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", (F.size(text.word_tokens(F.col("text"))) + 1).cast("long").alias("tokens"))
    rows = order.running_total(docs, [F.col("doc_id")], F.col("tokens"), "at")
    rows = rows.crossJoin(F.broadcast(docs.agg(F.sum("tokens").alias("n"))))  # one row
    c1, c2, at, end = F.floor(F.col("n") * 0.9), F.floor(F.col("n") * (0.9 + (1 - 0.9) / 2)), F.col("at"), F.col("at") + F.col("tokens")
    share = lambda lo, hi: F.greatest(F.lit(0), F.least(end, hi) - F.greatest(at, lo)).cast("long")
    return rows.select("doc_id", share(F.lit(0), c1).alias("train"), share(c1, c2).alias("validation"), share(c2, F.col("n")).alias("test"))


@query("""
WITH t AS (SELECT doc_id, greatest(1, len(regexp_extract_all(lower(text), '[a-z0-9_]+')))::BIGINT AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n // 64 AS windows, CASE WHEN n // 64 > 0 THEN floor((n // 64) * 0.95::DOUBLE)::BIGINT ELSE 0 END AS train, CASE WHEN n // 64 - floor((n // 64) * 0.95::DOUBLE) = 0 THEN n // 64 ELSE (n // 64 - floor((n // 64) * 0.95::DOUBLE))::BIGINT END AS eval FROM t""")
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 tokens of a document, cut at 95 hundredths; evaluation takes all where it would be empty."""
    n = F.floor(F.greatest(F.lit(1), F.size(text.word_tokens(F.col("text")))) / 64)
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", n.alias("windows"))
    train = F.floor(F.col("windows") * 0.95)
    return rows.select("doc_id", "windows", train.alias("train"), F.when(F.col("windows") == train, F.col("windows")).otherwise(F.col("windows") - train).alias("eval"))


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, length(text)::BIGINT AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE text IS NOT NULL
), p AS (
  SELECT conv_id, place, len AS used, 1 AS n, 0 AS win, 0::BIGINT AS boundary FROM c WHERE place = 1
  UNION ALL
  SELECT conv_id, place, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END + len, CASE WHEN opens THEN 1 ELSE n + 1 END, win + opens::INT, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END FROM (
    SELECT c.conv_id, c.place, c.len, used, n, win, used + 1 + c.len <= 400 AS behind, used > 0 AND used + 1 + c.len > 400 AS opens FROM p JOIN c ON c.conv_id = p.conv_id AND c.place = p.place + 1)
)
SELECT conv_id, win, max(used) AS used, least(400, max(used)) AS ones, greatest(0, 400 - max(used)) AS zeros, count(DISTINCT boundary) FILTER (boundary >= 1 AND boundary <= 400) AS ignored FROM p GROUP BY conv_id, win""")
def loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each packed window the characters that count, the padding, and the labels before a boundary that are ignored."""
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select("conv_id", F.struct("turn", "text", F.length("text").cast("long").alias("len")).alias("r"))
    packs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rs")).withColumn("at", records.next_fit(F.transform("rs", lambda r: r["len"]), 400))
    each = packs.select("conv_id", F.explode(F.arrays_zip("rs", "at")).alias("x")).groupBy("conv_id", F.col("x.at.window").alias("win")).agg(F.max(F.col("x.at.boundary") + F.col("x.rs.len")).alias("used"), F.collect_list("x.at.boundary").alias("boundaries"))
    labels = records.masked_labels(F.sequence(F.lit(1), F.lit(400)), F.transform("boundaries", lambda b: b.cast("int")))
    return each.select("conv_id", "win", "used", F.least(F.lit(400), "used").alias("ones"), F.greatest(F.lit(0), 400 - F.col("used")).alias("zeros"), F.size(F.filter(labels, lambda x: x == -100)).cast("long").alias("ignored"))


@query(r"""
WITH d AS (SELECT coalesce(lang, '?') AS lang, text, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM documents WHERE text IS NOT NULL)
SELECT lang, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE / greatest(1, sum(length(text))) AS tokens_per_char, sum(n)::DOUBLE / sum(length(text) - length(replace(text, chr(10), '')) + 1) AS tokens_per_line,
  sum(n)::DOUBLE / greatest(1, sum(len(regexp_extract_all(text, '\b(?:def|function|func|fn|public\s+\w+\s+\w+|private\s+\w+\s+\w+)\s+\w+\s*\(')))) AS tokens_per_function,
  sum(len(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\([^)]*\))?'), lambda x: len(regexp_extract_all(lower(x), '[a-z0-9_]+')) > 1)))::DOUBLE / greatest(1, sum(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\([^)]*\))?')))) AS identifier_fragmentation,
  sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]'))))::DOUBLE / greatest(1, sum(n)) AS indentation, avg(length(text) / greatest(1, n)::DOUBLE) AS compression FROM d GROUP BY lang""")
def tokenizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a tokenizer by language; word tokens stand for its tokens."""
    tokens = lambda c: F.size(text.word_tokens(c))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    names = F.regexp_extract_all("text", F.lit(text.IDENTIFIERS), F.lit(0))
    rows = docs.select(
        F.coalesce("lang", F.lit("?")).alias("lang"), tokens(F.col("text")).alias("n"), F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"), F.regexp_count("text", F.lit(text.FUNCTIONS)).alias("functions"), F.size(names).alias("names"),
        F.size(F.filter(names, lambda x: tokens(x) > 1)).alias("broken"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("^[ \t]"))).alias("indents"))
    per = lambda a, b: F.sum(a) / F.greatest(F.lit(1), F.sum(b))
    return rows.groupBy("lang").agg(F.sum("n").alias("tokens"), per("n", "chars").alias("tokens_per_char"), per("n", "lines").alias("tokens_per_line"), per("n", "functions").alias("tokens_per_function"), per("broken", "names").alias("identifier_fragmentation"), per("indents", "n").alias("indentation"), F.avg(F.col("chars") / F.greatest(F.lit(1), "n")).alias("compression"))


_SOURCES = {
    "python": "import a.b\nclass K{0}(B):\n    def m_{1}(self) -> int:\n        return 1\ndef run(x):\n    pass\n",
    "java": "public class A{0} {\n    private static int go{1}(int a) {\n        return a;\n    }\n}\ninterface I{0} {}\n",
    "javascript": "function f{0}(a) {}\nconst g{1} = async (x) => 1\nexport default class C{0} {}\n",
    "go": "package main\nfunc (r *R) Do{1}() {}\nfunc Plain{0}() {}\n",
    "rust": "use std::io\npub fn go_{1}() {}\nfn own_{0}() {}\n",
    "sql": "select * from t{0} join u{1} on true; update v{0} set x = 1",
}
#: How the lines of these files spell symbols, in words of SQL.
_LINES = [
    ("python", "class", r"^\s*class\s+(\w+)"), ("python", "function", r"^\s*def\s+(\w+)"), ("java", "class", r"\bclass\s+(\w+)"), ("java", "method", r"^\s+(?:private|public) .*\s(\w+)\("), ("java", "interface", r"\binterface\s+(\w+)"),
    ("javascript", "function", r"^function (\w+)"), ("javascript", "function", r"^const (\w+) = .*=>"), ("javascript", "class", r"\bclass (\w+)"), ("go", "function", r"^func (?:\(.*?\) )?(\w+)\("), ("rust", "function", r"^(?:pub )?fn (\w+)\("),
    ("sql", "table_reference", r"\b(?:from|join|update) (\w+)"),
]


def _written_sql(sources: list[str]) -> str:
    return f"replace(replace({_pick_sql(sources, 'o_orderkey')}, '{{0}}', o_custkey::VARCHAR), '{{1}}', (o_orderkey % 97)::VARCHAR)"


@query(f"""
WITH f AS (SELECT o_orderkey, {_pick_sql(list(_SOURCES), 'o_orderkey')} AS language, string_split({_written_sql(list(_SOURCES.values()))}, chr(10)) AS lines FROM orders),
l AS (SELECT o_orderkey, language, unnest(lines) AS text, generate_subscripts(lines, 1)::INT AS line FROM f)
""" + " UNION ALL ".join(f"SELECT o_orderkey, language, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 1)) AS name, line FROM l WHERE language = '{language}'" for language, kind, pattern in _LINES))
def symbols_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files in six languages, dealt by order."""
    out = None
    for n, (language, source) in enumerate(_SOURCES.items()):
        said = F.replace(F.replace(F.lit(source), F.lit("{0}"), F.col("o_custkey").cast("string")), F.lit("{1}"), (F.col("o_orderkey") % 97).cast("string"))
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 6 == n).select("o_orderkey", F.explode(code.symbols(said, language)).alias("s")).select("o_orderkey", F.lit(language).alias("language"), "s.kind", "s.name", "s.line")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line, l_partkey % 3 AS category, CASE WHEN l_suppkey % 2 = 0 THEN 'high' END AS severity, CASE WHEN l_suppkey % 5 > 0 THEN l_discount END AS confidence, l_suppkey, l_extendedprice FROM lineitem)
SELECT file, line, category, coalesce(severity, 'medium') AS severity, coalesce(confidence, 0.5::DOUBLE) AS confidence FROM l QUALIFY row_number() OVER (PARTITION BY file, line, category ORDER BY l_suppkey, l_extendedprice) = 1""")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings once for each file, line and category, the first one, with defaults."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 3).alias("category"),
        F.struct("l_suppkey", "l_extendedprice", F.when(F.col("l_suppkey") % 2 == 0, "high").alias("severity"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_discount")).alias("confidence")).alias("f"))
    first = rows.groupBy("file", "line", "category").agg(F.min("f").alias("f"))
    return first.select("file", "line", "category", F.coalesce("f.severity", F.lit("medium")).alias("severity"), F.coalesce("f.confidence", F.lit(0.5)).alias("confidence"))


@query(r"""
WITH o AS (SELECT doc_id, 'See src/a' || doc_id % 50 || '.py and `lib/b.tsx`, or x' || doc_id % 3 || '/src/a' || doc_id % 40 || '.py.' AS said FROM documents),
c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(said, '[`"]?([\w./-]+\.(?:py|java|js|ts|tsx|go|rs|c|cc|cpp|h|cs|rb|php|sql|vue))[`"]?', 1)) AS path FROM o),
f AS (SELECT 'src/a' || unnest(range(30)) || '.py' AS file), g AS (SELECT c.*, EXISTS (SELECT 1 FROM f WHERE ends_with(path, file)) AS known FROM c)
SELECT doc_id, count(*) AS claims, count(*) FILTER (NOT known) AS unsupported, count(*) FILTER (NOT known) / greatest(1, count(*))::DOUBLE AS rate FROM g GROUP BY doc_id""")
def file_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that outputs name, known if their path ends with that of a file; only files of the same name are compared."""
    key = F.col("doc_id")
    said = F.concat(F.lit("See src/a"), key % 50, F.lit(".py and `lib/b.tsx`, or x"), key % 3, F.lit("/src/a"), key % 40, F.lit(".py."))
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    claims = table(spark, sf_dir, "documents").select("doc_id", F.explode(code.file_claims(said)).alias("path")).withColumn("name", name(F.col("path")))
    known = spark.range(30).select(F.concat(F.lit("src/a"), "id", F.lit(".py")).alias("file")).withColumn("name", name(F.col("file")))
    met = claims.join(known, "name", "left").groupBy("doc_id", "path").agg(F.coalesce(F.bool_or(F.col("path").endswith(F.col("file"))), F.lit(False)).alias("known"))
    out = met.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("known")).alias("unsupported"))
    return out.withColumn("rate", F.col("unsupported") / F.greatest(F.lit(1), F.col("claims")))


@query("""
WITH f AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path FROM documents), p AS (SELECT path FROM f WHERE ends_with(path, '.py'))
SELECT path, (SELECT count(*) FROM p) AS total FROM (SELECT path FROM p ORDER BY path LIMIT 500)""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 files of an ending (a listing's length) and how many there are."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".md")).alias("path")).where(F.col("path").endswith(".py"))
    return files.orderBy("path").limit(500).crossJoin(F.broadcast(files.agg(F.count("*").alias("total"))))  # one row


def finder(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values; null finds nulls."""
    for column, value in wanted.items():
        df = df.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
    return df


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT -1, (SELECT count(*) > 0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3)::VARCHAR")
def finders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by equal columns, and whether any row exists; the filters reach the scan."""
    found = finder(table(spark, sf_dir, "supplier"), s_nationkey=7).select("s_suppkey", "s_name")
    exists = not finder(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3).isEmpty()
    return found.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("s_suppkey"), F.lit(str(exists).lower()).alias("s_name")))


@query()  # keep-first rounds; a test compares with a loop
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: exact copies go first, then those that share a band with an earlier text that stays."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    firsts = dedup.first_of(docs, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "doc_id").select(F.col("first").alias("doc_id"))
    once = docs.join(firsts, "doc_id", "left_semi")
    near = sketch.keep_first(cut(sketch.signatures(once, "doc_id", "text")), "doc_id")
    return docs.select("doc_id").distinct().join(near, "doc_id", "left").select("doc_id", F.when(F.col("kept").isNull(), "exact copy").when(~F.col("kept"), "near copy").otherwise("kept").alias("verdict"))


@query("""
WITH v AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i, vec_id FROM embeddings WHERE embedding IS NOT NULL)
SELECT count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS deviation, round(min(x), 9) AS least, round(max(x), 9) AS largest FROM v""")
def weight_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of all weights."""
    v = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("y")).select(F.col("y").cast("double").alias("x"))
    return v.agg(F.count("x").alias("n"), F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("deviation"), F.round(F.min("x"), 9).alias("least"), F.round(F.max("x"), 9).alias("largest"))


@query("""
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY x DESC, i) AS top5 FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 5) GROUP BY vec_id""")
def top_attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest places of each row, the smaller place first on ties."""
    cells = F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i")))
    first = F.slice(F.array_sort(cells), 1, 5)
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", F.array_join(F.transform(first, lambda c: c["i"].cast("string")), ",").alias("top5"))


_IMPORTED = {
    "py": "import a.b{0}\nfrom c{1} import d\nx = 1\n", "js": "import y from './m{0}'\nimport 'side'\nconst z = 1\nexport * from \"n{1}\"\n", "go": "package main{0}\nimport fmt\n", "rs": "use std::io{0}\nuse a::b{1}\n",
    "java": "import static a.B.m{0};\nimport java.util.List{1};\n", "txt": "import nothing\n",
}


_IMPORT_LINES = {"py": r"(?m)^(?:import|from) ([\w.]+)", "js": r"""from [''"]([^''"]+)[''"]""", "go": r"(?m)^(?:package|import) (\w+)", "rs": r"(?m)^use ([\w:]+)", "java": r"(?m)^import \w+ ([\w.]+);", "txt": "(never)"}


@query(f"""
WITH f AS (SELECT o_orderkey, {_pick_sql(list(_IMPORTED), 'o_orderkey')} AS extension, {_written_sql(list(_IMPORTED.values()))} AS text FROM orders)
""" + " UNION ALL ".join(f"SELECT o_orderkey, extension, array_to_string(regexp_extract_all(text, '{pattern}', 1), ',') AS imports FROM f WHERE extension = '{ext}'" for ext, pattern in _IMPORT_LINES.items()))
def imports_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of files in five languages and one without any, dealt by order."""
    out = None
    for n, (extension, source) in enumerate(_IMPORTED.items()):
        said = F.replace(F.replace(F.lit(source), F.lit("{0}"), F.col("o_custkey").cast("string")), F.lit("{1}"), (F.col("o_orderkey") % 97).cast("string"))
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 6 == n).select("o_orderkey", F.lit(extension).alias("extension"), F.array_join(code.imports(said, extension), ",").alias("imports"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT r_name AS suite, n_name AS task, count(DISTINCT o_orderkey) AS runs, count(*) AS metrics, round(sum(l_extendedprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def metric_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suites, tasks, runs and metrics joined along their keys; metrics are added up for each run before the joins."""
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(metrics, "o_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    tasks = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("suite"), F.col("n_name").alias("task"))
    return runs.join(tasks, "n_nationkey").groupBy("suite", "task").agg(F.count("*").alias("runs"), F.sum("n").alias("metrics"), F.round(F.sum("price"), 2).alias("total"))


@query("""
WITH l AS (SELECT vec_id, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(8)) AS expert FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT vec_id, expert, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, expert) AS place FROM l), n AS (SELECT count(DISTINCT vec_id) AS n, -sum(p * ln(greatest(p, 1e-9))) / count(DISTINCT vec_id) AS entropy FROM p),
e AS (SELECT expert, count(*) FILTER (place <= 2) AS usage, avg(p) AS mean_probability FROM p GROUP BY expert)
SELECT expert::INT AS expert, usage, round(usage / n::DOUBLE, 9) AS load, round(mean_probability, 9) AS mean_probability, round(entropy, 6) AS entropy, round((SELECT 0.01 * avg((usage / n::DOUBLE - mean_probability) * (usage / n::DOUBLE - mean_probability)) FROM e), 9) AS balance_loss FROM e, n""")
def expert_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight components of a vector as logits of experts: how often each is among the best two, entropy and balance of routing."""
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", logits.alias("x"))
    rows = rows.withColumn("total", F.aggregate("x", F.lit(0.0), lambda a, x: a + F.exp(x)))
    chosen = F.transform(F.slice(F.array_sort(F.transform("x", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 2), lambda c: c["i"])
    each = rows.select(F.posexplode(F.transform("x", lambda x: F.exp(x) / F.col("total"))).alias("expert", "p"), chosen.alias("chosen"))
    experts = each.groupBy("expert").agg(F.count_if(F.array_contains("chosen", F.col("expert"))).alias("usage"), F.avg("p").alias("mean"), F.count("*").alias("n"), F.sum(F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-9)))).alias("plogp"))
    experts = experts.withColumn("load", F.col("usage") / F.col("n"))
    whole = experts.agg((-F.sum("plogp") / F.max("n")).alias("entropy"), (0.01 * F.avg(F.pow(F.col("load") - F.col("mean"), F.lit(2.0)))).alias("loss"))
    out = experts.crossJoin(F.broadcast(whole))  # one row
    return out.select("expert", "usage", F.round("load", 9).alias("load"), F.round("mean", 9).alias("mean_probability"), F.round("entropy", 6).alias("entropy"), F.round("loss", 9).alias("balance_loss"))


_EVENTS = ["PLAN", "TOOL_REQUEST", "PATCH", "TEST", "REFLECT", "FINISH", "NOTE"]


@query(f"""
WITH e AS (SELECT event_id, {_pick_sql(_EVENTS, 'event_id')} AS type, json_extract_string(props, '$.k') AS k, event_type FROM events)
SELECT event_id, type, CASE type WHEN 'PLAN' THEN substr(event_type, 1, 120) WHEN 'TOOL_REQUEST' THEN 'attempt=' || k WHEN 'PATCH' THEN 'attempt=' || k WHEN 'TEST' THEN event_type WHEN 'REFLECT' THEN 'kind=' || event_type WHEN 'FINISH' THEN 'outcome=' || event_type ELSE substr(k, 1, 120) END AS summary FROM e""")
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each event of an agent, by its type; what is of no known type is cut at 120 characters."""
    rows = table(spark, sf_dir, "events").select("event_id", _pick(_EVENTS, "event_id").alias("type"), F.get_json_object("props", "$.k").alias("k"), "event_type")
    return rows.select("event_id", "type", records.event_summary(F.col("type"), F.col("k"), F.col("event_type")).alias("summary"))
