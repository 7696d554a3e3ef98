"""Queries over source files, patches and claims. Orders are source files and patches written from their keys; documents and conversations are model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import code
from corpuscope.plans import repository
from corpuscope.registry import query, table


def _diff() -> Column:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return F.concat(F.lit("--- a/src/f"), cust, F.lit(".py\n+++ b/src/f"), cust, F.lit(".py\n@@ -1 +1 @@\n-old\n"), F.repeat(F.lit("+new\n"), (key % 4).cast("int")), F.when(key % 5 == 0, "+++ b/../x\n").otherwise(""), F.lit(" same\n"))


@query(f"""
WITH {repository.GRAPH}
SELECT f.path, coalesce((SELECT string_agg(imp, ',' ORDER BY n) FROM (SELECT i.imp, l.n FROM i JOIN l ON l.path = i.path AND contains(l.line, i.imp) AND regexp_matches(l.line, '^(import|from) ') WHERE i.path = f.path)), '') AS imports,
  coalesce((SELECT string_agg(ep, ',') FROM e WHERE e.path = f.path), '') AS endpoints, array_to_string(list_distinct_kept, ',') AS tables
FROM (SELECT path, regexp_extract_all(text, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE|TABLE|INSERT INTO)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS named, list_filter(named, lambda x, k: NOT list_contains(named[1:k - 1], x)) AS list_distinct_kept FROM f) f""")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, endpoints and SQL tables of each file of a repository."""
    rows, text = repository.files(spark, sf_dir), F.col("text")
    return rows.select("path", F.array_join(code.imports(text, "py"), ",").alias("imports"), F.array_join(code.endpoints(text), ",").alias("endpoints"), F.array_join(code.table_references(text), ",").alias("tables"))


@query(f"WITH {repository.GRAPH} SELECT path, kind, name, n::INT AS line, trim(line_text) AS signature, path IN (SELECT path FROM tests) AS is_test FROM (SELECT s.*, l.line AS line_text FROM s JOIN l ON l.path = s.path AND l.n = s.n)")
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each file with their lines, and whether the file looks like a test by its path or symbols."""
    rows = repository.files(spark, sf_dir).select("path", code.symbols(F.col("text"), "python").alias("symbols"))
    rows = rows.select("path", code.is_test(F.col("path"), F.transform("symbols", lambda s: s["name"])).alias("is_test"), F.explode("symbols").alias("s"))
    return rows.select("path", "s.kind", "s.name", "s.line", "s.signature", "is_test")


@query("SELECT page_id, regexp_matches(lower(url), 'test|spec') AS is_test FROM pages")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls are paths; pages have no symbols."""
    return table(spark, sf_dir, "pages").select("page_id", code.is_test(F.col("url"), F.array().cast("array<string>")).alias("is_test"))


@query("""
SELECT doc_id, len(l) AS mentions, len(list_distinct(l)) AS n_tables, l[1] AS first_table FROM (
  SELECT doc_id, regexp_extract_all(text, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE|TABLE|INSERT INTO)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS l FROM documents WHERE text IS NOT NULL)""")
def table_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 on prose: tables that a document seems to name."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", code.found(F.col("text"), code.TABLES).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("mentions"), F.size(F.array_distinct("l")).cast("long").alias("n_tables"), F.get("l", F.lit(0)).alias("first_table"))


def _case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in code.TASK_TYPES.items()) + " ELSE 'general' END"


@query(f"SELECT role, {_case('text')} AS task_type, count(*) AS n FROM conversations GROUP BY ALL")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: turns are prompts."""
    return table(spark, sf_dir, "conversations").groupBy("role", code.task_type(F.col("text")).alias("task_type")).agg(F.count("*").alias("n"))


@query()  # DuckDB's word boundaries are ASCII ones; a test compares with Python's
def hallucination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are outputs, words of the benchmark the symbols that exist."""
    claims = table(spark, sf_dir, "documents").select("doc_id", F.explode(code.symbol_claims(F.col("text"))).alias("name"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(code.found(F.col("text"), "([A-Za-z0-9_]+)")).alias("name")).distinct().withColumn("known", F.lit(True))
    out = claims.join(known, "name", "left").groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("known").isNull()).alias("unsupported"))
    return out.withColumn("rate", F.col("unsupported") / F.col("claims"))


@query("""
SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (NOT (contains(lower(c), 'tests') OR contains(lower(c), 'compile') OR contains(lower(c), 'lint') OR contains(lower(c), 'formatter') OR contains(lower(c), 'verifier'))) AS unsupported
FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text || chr(10) || 'I ran the ' || CASE WHEN turn % 2 = 0 THEN 'linter' ELSE 'server' END, '(?i)(?:I (?:ran|ran the|executed)|the (?:tests?|verifier))[^\\n]*', 0)) AS c FROM conversations) GROUP BY ALL""")
def tool_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with one claim added to each."""
    said = F.concat("text", F.lit("\nI ran the "), F.when(F.col("turn") % 2 == 0, "linter").otherwise("server"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(code.tool_claims(said)).alias("c"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), F.count_if(~F.col("c.supported")).alias("unsupported"))


@query("""
WITH e AS (SELECT DISTINCT least(l_suppkey % 500, l_partkey % 500) AS a, greatest(l_suppkey % 500, l_partkey % 500) AS b FROM lineitem WHERE l_suppkey % 500 <> l_partkey % 500),
c AS (SELECT o_orderkey, o_custkey % 500 AS s, o_orderkey % 500 AS t FROM orders)
SELECT o_orderkey, 'm' || s || '.py' AS source, 'm' || t || '.py' AS target, e.a IS NOT NULL AS supported FROM c LEFT JOIN e ON least(s, t) = a AND greatest(s, t) = b""")
def relation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order claims that one module imports another; lines of orders are the edges, in both directions."""
    said = F.concat(F.lit("Here m"), F.col("o_custkey") % 500, F.lit(".py imports m"), F.col("o_orderkey") % 500, F.lit(".py, as said."))
    claims = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(code.relation_claims(said)).alias("c")).select("o_orderkey", "c.source", "c.target")
    name = lambda c: F.concat(F.lit("m"), F.col(c) % 500, F.lit(".py"))
    lines = table(spark, sf_dir, "lineitem").select(name("l_suppkey").alias("a"), name("l_partkey").alias("b")).where("a <> b")
    edges = lines.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("there", F.lit(True))
    pairs = claims.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    return pairs.join(edges, ["lo", "hi"], "left").select("o_orderkey", "source", "target", F.col("there").isNotNull().alias("supported"))


@query("""
WITH d AS (SELECT o_orderkey, string_split('--- a/src/f' || o_custkey || '.py' || chr(10) || '+++ b/src/f' || o_custkey || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-old' || chr(10) || repeat('+new' || chr(10), (o_orderkey % 4)::INT) || CASE WHEN o_orderkey % 5 = 0 THEN '+++ b/../x' || chr(10) ELSE '' END || ' same' || chr(10), chr(10)) AS lines FROM orders),
p AS (SELECT *, list_transform(list_filter(lines, lambda x: regexp_matches(x, '^(---|\\+\\+\\+) [ab]/')), lambda x: substr(x, 7)) AS paths FROM d)
SELECT o_orderkey, len(list_filter(lines, lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---|@@)')))::INT AS changed, len(list_filter(lines, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INT AS size,
  len(list_filter(paths, lambda x: regexp_matches(x, '^[/\\\\]|^[A-Za-z]:') OR list_contains(string_split(x, '/'), '..') OR list_contains(string_split(x, '/'), '.git'))) > 0 AS unsafe FROM p""")
def diff_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines, size and paths of patches."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _diff().alias("diff"))
    diff = F.col("diff")
    return rows.select("o_orderkey", code.changed_lines(diff).alias("changed"), code.patch_size(diff).alias("size"), F.exists(code.diff_paths(diff), code.unsafe_path).alias("unsafe"))


@query("""
SELECT doc_id, regexp_matches(text, '(?i)\\b(base64|decrypt|sudo|chmod\\s+4?777|pkexec)\\b')::INT + regexp_matches(text, '(?i)(/etc/(passwd|shadow)|/root/|\\.ssh/)')::INT
  + regexp_matches(text, '(?i)(curl|wget)\\s+(-o|-O)?\\s*\\S*(--url\\s*)?')::INT AS n FROM documents WHERE text IS NOT NULL""")
def suspicious_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the patterns occur in a document."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(code.suspicious(F.col("text"))).alias("n"))


_STATEMENTS = ["select now()", "select 1 from task where x", "select top 5 * from invoice", "select 1 from dual", "select current timestamp", "delete from task", "insert into t values(1)", "select `a` from project", "select x\\nfrom y join\\ncustomer c", "create table z (n number)", "  drop table q ", "select * from audit_event"]
_HINTS = {"postgres": ["now()", "timestamptz", "bigserial"], "mysql": ["auto_increment", "engine=innodb", "`"], "sqlserver": ["nvarchar", "sysutcdatetime", "top"], "oracle": ["dual", "sysdate", "varchar2", "number"], "db2": ["from syscat.tables", "current timestamp", "values("]}
_STATEMENT = "replace(([" + ", ".join("'" + x + "'" for x in _STATEMENTS) + "])[(o_orderkey % 12 + 1)::INT], chr(92) || 'n', chr(10))"
_DIALECT = "(['postgres', 'mysql', 'sqlserver', 'oracle', 'db2'])[(o_custkey % 5 + 1)::INT]"


@query(f"""
WITH o AS (SELECT o_orderkey, {_DIALECT} AS dialect, {_STATEMENT} AS statement FROM orders), l AS (SELECT *, lower(trim(statement)) AS low, regexp_matches(upper(statement), 'DELETE|DROP|TRUNCATE|GRANT|REVOKE') AS forbidden FROM o)
SELECT o_orderkey, dialect, statement, forbidden, CASE WHEN NOT forbidden AND ({" OR ".join(f"(dialect = '{d}' AND ({' OR '.join(f'contains(lower(statement), {chr(39)}{h}{chr(39)})' for h in hints)}))" for d, hints in _HINTS.items())}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hinted,
  array_to_string(list_filter(['customer', 'project', 'task', 'invoice', 'audit_event'], lambda t: contains(low, chr(10) || t) OR contains(low, ' ' || t || ' ') OR ends_with(low, ' ' || t)), ',') AS tables FROM l""")
def sql_dialect_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements dealt by order against hints of a dialect dealt by customer, forbidden words and known tables."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(list(_HINTS), "o_custkey").alias("dialect"), F.replace(pick(_STATEMENTS, "o_orderkey"), F.lit("\\n"), F.lit("\n")).alias("statement"))
    rows = rows.withColumn("g", code.dialect_grade(F.col("statement"), F.col("dialect")))
    return rows.select("o_orderkey", "dialect", "statement", "g.forbidden", "g.hinted", F.array_join(code.schema_tables(F.col("statement")), ",").alias("tables"))
