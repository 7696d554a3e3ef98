"""Queries over the corpus: documents are the files, `source` picks a license, page urls are paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import gates, text
from corpuscope.operators import digests
from corpuscope.operators.dedup import first_of
from corpuscope.registry import query, table


@query("""
SELECT 'language' AS dimension, coalesce(lang, 'unknown') AS value, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*), sum(n_chars)::BIGINT FROM documents GROUP BY ALL
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN '0-1k' WHEN n_chars < 10000 THEN '1k-10k' ELSE '10k+' END, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY ALL""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, source and size bucket from one scan (grouping sets)."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("unknown")).alias("l"), F.coalesce("source", F.lit("unknown")).alias("s"), text.size_bucket(F.col("n_chars")).alias("b"), "n_chars")
    docs.createOrReplaceTempView("profile_rows")
    return spark.sql("""
        SELECT CASE WHEN grouping(l) = 0 THEN 'language' WHEN grouping(s) = 0 THEN 'source' ELSE 'size' END AS dimension,
               coalesce(l, s, b) AS value, count(*) AS n, sum(n_chars) AS chars
        FROM profile_rows GROUP BY l, s, b GROUPING SETS ((l), (s), (b))""")


@query("""
SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents)
GROUP BY t ORDER BY n DESC, t LIMIT 50""")
def token_frequency_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent tokens (a top-k report)."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(text.word_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query("""
SELECT doc_id, greatest(1, CASE WHEN length(text) % 4 = 2 THEN CASE WHEN (length(text) // 4) % 2 = 0 THEN length(text) // 4 ELSE length(text) // 4 + 1 END
                                ELSE round(length(text) / 4.0)::BIGINT END)::INT AS tokens FROM documents""")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5."""
    return table(spark, sf_dir, "documents").select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@query("""
WITH u AS (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split FROM u""")
def content_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: content-addressed split."""
    return table(spark, sf_dir, "documents").select("doc_id", text.split_of(F.col("doc_id")).alias("split"))


@query("""
WITH s AS (SELECT doc_id::VARCHAR AS id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM documents)
SELECT CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM s GROUP BY ALL""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each split and the digest of its sorted ids, which are hashed as they come out of a sort."""
    docs = table(spark, sf_dir, "documents").select(text.split_of(F.col("doc_id")).alias("split"), F.col("doc_id").cast("string").alias("id"))
    return digests.joined_digests(docs, "split", "id")


@query("""
WITH h AS (SELECT sha256(text) AS h, coalesce(lang, 'unknown') AS lang FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS n, count(DISTINCT h) AS n_unique, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS digest FROM h GROUP BY lang""")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, distinct texts and an order-free digest of text hashes by language, aggregated where the rows are."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("unknown")).alias("lang"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    once = docs.groupBy("lang", "h").agg(F.count("*").alias("n"))
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    return once.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.bit_xor(F.when(F.col("n") % 2 == 1, number).otherwise(F.lit(0).cast("long"))).alias("digest"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts, and the group's size."""
    return first_of(table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")


_LICENSES = ["mit", "agpl-3.0", None, "cc-by-nc", " Apache-2.0 ", "", "CC0-1.0", "public-domain", "busl-1.1", "Zlib", "unlicense"]
_ALLOWED = "('mit', 'mit-0', 'apache-2.0', 'apache-2', 'bsd-3-clause', 'bsd-2-clause', 'isc', 'unlicense', 'cc0-1.0', 'mpl-2.0', 'lgpl-2.1', 'lgpl-2.1-only', 'lgpl-2.1-or-later', 'python-2.0', 'zlib', 'postgresql')"


def _dealt(values: list, key: str) -> Column:
    """One of the values for each row, by its key."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _dealt_sql(values: list, key: str) -> str:
    said = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[({key} % {len(values)} + 1)::INT]"


@query(f"""
WITH c AS (SELECT doc_id, {_dealt_sql(_LICENSES, 'doc_id')} AS l, doc_id % 7 = 0 AS verified, source FROM documents),
n AS (SELECT *, lower(trim(l)) AS norm, l IS NULL OR l = '' AS missing FROM c),
k AS (SELECT *, CASE WHEN missing THEN 'unknown' WHEN norm IN {_ALLOWED} THEN 'permissive' WHEN regexp_matches(norm, '^(agpl-3.0(-only|-or-later)?|sspl-1.0|business-source|busl-1.1|elastic-2.0)$') THEN 'restricted' ELSE 'unrecognized' END AS license_class FROM n)
SELECT doc_id, license_class, license_class = 'permissive' OR verified AS trainable, license_class = 'permissive' AND verified AS redistributable,
       coalesce(norm IN ('unlicense', 'cc0-1.0', 'public-domain'), false) AS public_domain,
       CASE WHEN license_class <> 'permissive' AND NOT verified THEN license_class WHEN source IN ('dataset', 'repository') THEN 'ok' WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'unsupported source_type' END AS gate FROM k""")
def license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses dealt by id, every seventh document verified, every third one a repository."""
    one, verified = _dealt(_LICENSES, "doc_id"), F.col("doc_id") % 7 == 0
    kind = F.when(F.col("doc_id") % 3 == 0, "repository").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", gates.license_class(one).alias("license_class"), gates.trainable(one, verified).alias("trainable"), gates.redistributable(one, verified).alias("redistributable"),
        gates.public_domain(one).alias("public_domain"), gates.source_gate(one, verified, kind).alias("gate"))


_FOLDERS = ["src", "./vendor", "benchmarks/baselines", "a/benchmarks/baselines", "benchmarks/hidden_tests/x", "a/.git", "venv", ".env", "lib//build", "repos/a", "..\\benchmarks\\baselines", "x/target", "benchmarks/baselines2"]
_NAMES = ["main.py", "logo.PNG", ".env", ".env.local", ".envrc", ".png", "a.tar.gz", "package-lock.json", "requirements-dev.lock", "x.yarn.lock", "poetry.lock.txt", "id.pem", "b.key", "c.woff2", "d.bmp", "README", "e.class/"]
_PATH = f"{_dealt_sql(_FOLDERS, 'page_id')} || '/' || {_dealt_sql(_NAMES, 'page_id')}"


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages UNION ALL SELECT -page_id, url FROM pages),
c AS (SELECT *, string_split(path, '/') AS parts, regexp_replace(replace(path, chr(92), '/'), '^[./]+', '') AS plain, lower(regexp_extract(path, '[^/](\\.[^./]+)/*$', 1)) AS suffix FROM p)
SELECT page_id, path, CASE
    WHEN plain = 'benchmarks/baselines' OR starts_with(plain, 'benchmarks/baselines/') THEN 'evaluation-baseline'
    WHEN plain = 'benchmarks/hidden_tests' OR starts_with(plain, 'benchmarks/hidden_tests/') THEN 'hidden-test'
    WHEN list_has_any(parts, ['.env', '.env.', 'node_modules', 'vendor', 'build', 'dist', 'target', '__pycache__', '.git', '.idea', '.gradle', '.cache', 'venv', '.venv']) THEN 'excluded-name'
    WHEN regexp_matches(path, '(^|/)\\.env(\\.|$)') THEN 'env-file'
    WHEN suffix IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.ico', '.pdf', '.zip', '.gz', '.tar', '.jar', '.class', '.so', '.dll', '.dylib', '.exe', '.bin', '.woff', '.woff2', '.ttf', '.eot', '.ipynb_checkpoints') THEN 'binary-like-suffix'
    WHEN regexp_matches(path, '(requirements.*\\.lock|package-lock\\.json|yarn\\.lock|Pipfile\\.lock|poetry\\.lock)$') THEN 'lockfile' END AS reason,
  NOT (list_has_any(parts, ['node_modules', 'vendor', 'build', 'dist', 'target', '__pycache__', '.git', '.idea', '.gradle', '.venv', 'venv', '.cache', 'repos'])
    OR suffix IN ('.png', '.jpg', '.jpeg', '.gif', '.pdf', '.zip', '.gz', '.tar', '.jar', '.class', '.so', '.dll', '.exe', '.woff', '.woff2', '.ico') OR starts_with(path, '.env') OR ends_with(path, '.pem') OR ends_with(path, '.key')) AS ingested FROM c""")
def path_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path rules over page urls and over paths made to hit each rule."""
    pages = table(spark, sf_dir, "pages")
    made = pages.select("page_id", F.concat(_dealt(_FOLDERS, "page_id"), F.lit("/"), _dealt(_NAMES, "page_id")).alias("path"))
    paths = made.unionByName(pages.select((-F.col("page_id")).alias("page_id"), F.col("url").alias("path")))
    return paths.select("page_id", "path", gates.skip_reason(F.col("path")).alias("reason"), gates.ingested(F.col("path")).alias("ingested"))


_SCAN = " || ".join(f"CASE WHEN regexp_matches(html, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{k},' ELSE '' END" for k, p in text.SECURITY.items())


@query(f"SELECT page_id, {_SCAN} AS kinds FROM pages")
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which unsafe patterns occur on a page."""
    kinds = F.transform(text.security_kinds(F.col("html")), lambda k: F.concat(k, F.lit(",")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(kinds, "").alias("kinds"))


@query(f"""
WITH f AS (SELECT page_id, unnest([{', '.join(f"len(regexp_extract_all(html, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in text.SECURITY.values())}]) AS n,
  unnest([{', '.join(f"'{k}'" for k in text.SECURITY)}]) AS category,
  unnest([{', '.join(f"length(regexp_extract(html, '(?is)^(.*?)(?:{p.replace(chr(39), chr(39) * 2)})', 1)) - length(replace(regexp_extract(html, '(?is)^(.*?)(?:{p.replace(chr(39), chr(39) * 2)})', 1), chr(10), '')) + 1" for p in text.SECURITY.values())}]) AS line FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN chr(10) || chr(10) || 'x.innerHTML = md5(s)' || chr(10) || 'secret = "abcdefgh"; v-html="y"' ELSE '' END AS html FROM pages))
SELECT page_id, category, n, line::INT AS first_line, CASE category WHEN 'sql_injection' THEN 'CWE-89' WHEN 'path_traversal' THEN 'CWE-22' WHEN 'xss' THEN 'CWE-79' WHEN 'weak_crypto' THEN 'CWE-327' WHEN 'hardcoded_secret' THEN 'CWE-798' ELSE 'CWE-000' END AS cwe,
       CASE WHEN category IN ('sql_injection', 'path_traversal', 'weak_crypto', 'hardcoded_secret') THEN 'high' ELSE 'medium' END AS severity FROM f WHERE n > 0""")
def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a page with their first lines; every third page has unsafe code added."""
    added = F.when(F.col("page_id") % 3 == 0, F.lit('\n\nx.innerHTML = md5(s)\nsecret = "abcdefgh"; v-html="y"')).otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(text.security_findings(F.concat("html", added))).alias("f")).select("page_id", "f.*")
    return rows.groupBy("page_id", "category", "cwe", "severity").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(f"SELECT count(*) AS pages, count(*) FILTER ({' OR '.join(f"regexp_matches(html, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in text.SECURITY.values())}) AS skipped FROM pages")
def secret_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one finding or more are left out."""
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"), F.count_if(F.size(text.security_kinds(F.col("html"))) > 0).alias("skipped"))


_W = "\\t\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ADDED = ["", "﻿", "", "", "/* DO NOT EDIT */ "]


@query(rf"""
WITH t AS (SELECT doc_id, {_dealt_sql(_ADDED, 'doc_id')} || CASE WHEN doc_id % 6 = 0 THEN replace(text, '. ', '.' || chr(13) || chr(10)) ELSE text END AS text, CASE WHEN doc_id % 9 = 0 THEN 'a/vendor/x.py' ELSE 'src/x.py' END AS path FROM documents),
b AS (SELECT *, regexp_replace(regexp_replace(text, '^\x{{feff}}+', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS l FROM t),
c AS (SELECT *, regexp_replace(regexp_replace(l, '[{_W}]+(\n|$)', '\1', 'g'), '^[\n{_W}]+|[\n{_W}]+$', '', 'g') AS done FROM b),
f AS (SELECT *, CASE WHEN done = '' THEN ['empty'] ELSE list_filter([CASE WHEN starts_with(text, chr(65279)) THEN 'bom-removed' END, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf-normalized' END,
    CASE WHEN len(list_filter(string_split(done, chr(10)), lambda x: length(x) > 100000)) > 0 THEN 'too-long-line' END,
    CASE WHEN regexp_matches(substr(done, 1, 2000), '(?i)(auto-generated|automatically generated|generated by|do not edit|this file is generated|@generated|swagger codegen|protoc |eslint-disable.*generated|bundle\.js|\.min\.css)') THEN 'generated-marker' END,
    CASE WHEN NOT regexp_matches(done, '[A-Za-z_]{{2,}}') THEN 'no-identifiers' END], lambda x: x IS NOT NULL) END AS flags FROM c)
SELECT doc_id, sha256(done) AS clean_sha256, array_to_string(flags, ',') AS flags, CASE WHEN list_contains(flags, 'empty') THEN 'empty' WHEN list_contains(flags, 'too-long-line') THEN 'too-long-line' WHEN list_contains(flags, 'generated-marker') THEN 'generated-marker'
    WHEN regexp_matches(path, '(^|/)(vendor|third_party|thirdparty|deps|external)/') THEN 'vendor' END AS dropped FROM f""")
def clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the cleaned text, its flags and why it is dropped; marks, line ends and paths are dealt by id."""
    path = F.when(F.col("doc_id") % 9 == 0, "a/vendor/x.py").otherwise("src/x.py")
    raw = F.concat(_dealt(_ADDED, "doc_id"), F.when(F.col("doc_id") % 6 == 0, F.replace("text", F.lit(". "), F.lit(".\r\n"))).otherwise(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), raw.alias("raw"))
    # An array of one, so that the cleaned text is made once and not wherever it is used.
    rows = rows.select("doc_id", "path", F.explode(F.array(F.struct("raw", text.cleaned(F.col("raw")).alias("done")))).alias("t"))
    rows = rows.select("doc_id", "path", F.sha2(F.col("t.done").cast("binary"), 256).alias("clean_sha256"), text.clean_flags(F.col("t.raw"), F.col("t.done")).alias("flags"))
    return rows.select("doc_id", "clean_sha256", F.array_join("flags", ",").alias("flags"), text.drop_reason(F.col("flags"), F.col("path")).alias("dropped"))


@query("""
SELECT doc_id, CASE WHEN length(text) >= 20 THEN sha256('<fim_prefix>' || substr(text, 1, c) || '<fim_suffix><fim_middle>' || substr(text, c + 1)) END AS fim_sha256
FROM (SELECT doc_id, text, floor(length(text) * (0.1::DOUBLE + 0.4::DOUBLE * 0.8444218515250481::DOUBLE))::INT AS c FROM documents)""")
def fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C25."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fim(F.col("text")).cast("binary"), 256).alias("fim_sha256"))


@query("""
SELECT lang, avg(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) / greatest(1, length(text))::DOUBLE) AS tokens_per_char,
       avg(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) / (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE) AS tokens_per_line FROM documents GROUP BY lang""")
def tokenizer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12."""
    n = F.size(text.word_tokens(F.col("text")))
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg(n / F.greatest(F.lit(1), F.length("text"))).alias("tokens_per_char"), F.avg(n / lines).alias("tokens_per_line"))


@query("""
SELECT doc_id, n AS line, substr(l, 1, 200) AS hit FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE regexp_matches(l, '(?i)license')""")
def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match a pattern, with their numbers."""
    return _hits(spark, sf_dir)


@query("""
WITH h AS (SELECT doc_id, n AS line, substr(l, 1, 200) AS hit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(l, '(?i)license'))
SELECT doc_id, line, hit, count(*) OVER () AS total FROM h ORDER BY doc_id, line LIMIT 200""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 lines that match (which is the feature), and how many there are in all."""
    hits = _hits(spark, sf_dir)
    return hits.orderBy("doc_id", "line").limit(200).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)license")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.where(F.col("l").rlike("(?i)license")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.substring("l", 1, 200).alias("hit"))


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset pagination; the limit is taken before rows are numbered."""
    page = table(spark, sf_dir, "orders").where("o_orderkey > 100").select("o_orderkey", "o_orderdate").orderBy("o_orderkey").limit(50)
    page.createOrReplaceTempView("keyset_page")
    return spark.sql("SELECT o_orderkey, o_orderdate, cast(row_number() OVER (ORDER BY o_orderkey) AS bigint) AS place FROM keyset_page")
