"""Queries over pieces of text: chunks, summaries of test runs, node names and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.registry import query, table

_CUT = """CASE WHEN length(substr(text, s + 1, least(1500, n - s))) - length(list_last(string_split(substr(text, s + 1, least(1500, n - s)), chr(10)))) - 1 > 750
               THEN s + length(substr(text, s + 1, least(1500, n - s))) - length(list_last(string_split(substr(text, s + 1, least(1500, n - s)), chr(10)))) - 1
               ELSE least(s + 1500, n) END"""


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, length(text)::BIGINT AS n FROM documents WHERE length(text) > 1500
), p AS (
  SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS k FROM d
), r AS (
  SELECT doc_id, s, ({_CUT})::BIGINT AS e, n, k FROM p JOIN d USING (doc_id)
  UNION ALL
  SELECT doc_id, s, ({_CUT})::BIGINT AS e, n, k FROM (SELECT r.doc_id, d.text, d.n, greatest(r.s + 1, r.e - 150) AS s, r.k + 1 AS k FROM r JOIN d USING (doc_id)) WHERE s < n AND k <= 10000
), every AS (
  SELECT doc_id, k, s, e FROM r UNION ALL SELECT doc_id, 0, 0, length(text) FROM documents WHERE length(text) <= 1500
)
SELECT doc_id, count(*) AS n_chunks, sha256(string_agg(s || ':' || e, ',' ORDER BY k)) AS spans_sha256 FROM every GROUP BY doc_id""")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of chunks of a document and a digest of where they start and end."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.chunk_spans(F.col("text")).alias("spans"))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return docs.select("doc_id", F.size("spans").cast("long").alias("n_chunks"), F.sha2(said.cast("binary"), 256).alias("spans_sha256"))


_SUMMARY = "(o_orderkey % 7) || ' failed, ' || (o_custkey % 5) || CASE WHEN o_custkey % 5 = 1 THEN ' error, ' ELSE ' errors, ' END || (o_orderkey % 11) || ' passed' || CASE WHEN o_orderkey % 3 = 0 THEN ', ' || o_custkey % 4 || ' skipped' ELSE '' END || CASE WHEN o_orderkey % 13 = 0 THEN '; No tests ran' ELSE ' in 1.10s' END"


@query(rf"""
WITH s AS (SELECT o_orderkey, {_SUMMARY} AS said FROM orders), n AS (SELECT *, NOT contains(lower(said), 'no tests ran') AS ran FROM s),
c AS (SELECT o_orderkey, coalesce(CASE WHEN ran THEN try_cast(nullif(regexp_extract(said, '(\d+)\s+passed', 1), '') AS INT) END, 0) AS passed, coalesce(CASE WHEN ran THEN try_cast(nullif(regexp_extract(said, '(\d+)\s+failed', 1), '') AS INT) END, 0) AS failed,
  coalesce(CASE WHEN ran THEN try_cast(nullif(regexp_extract(said, '(\d+)\s+errors', 1), '') AS INT) END, 0) AS error, coalesce(CASE WHEN ran THEN try_cast(nullif(regexp_extract(said, '(\d+)\s+skipped', 1), '') AS INT) END, 0) AS skipped FROM n)
SELECT o_orderkey, passed, failed, error, skipped, passed + failed + error + skipped AS collected FROM c""")
def test_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries written from keys of orders and read again; a single error isn't counted, as its word is another one."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("summary_orders")
    said = spark.sql(f"SELECT o_orderkey, {_SUMMARY} AS said FROM summary_orders")
    return said.select("o_orderkey", text.test_counts(F.col("said")).alias("c")).select("o_orderkey", "c.passed", "c.failed", "c.error", "c.skipped", "c.collected")


@query("SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_./-]', '-', 'g'), '-') AS node FROM pages")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16."""
    return table(spark, sf_dir, "pages").select("page_id", text.node_id(F.col("url")).alias("node"))


@query("""
SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN value < 10 THEN 0.1::DOUBLE ELSE 0 END
             + CASE WHEN value > 90 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN event_type = 'error' THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN -1.0::DOUBLE ELSE 0 END, 6) AS reward FROM events""")
def verifier_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings dealt by event id, value and type."""
    key, value = F.col("event_id"), F.col("value")
    found = {"hidden_tests_pass": key % 2 == 0, "compiles": key % 3 == 0, "patch_minimal": value < 10, "new_regression": value > 90, "linter_security_regression": F.col("event_type") == "error", "timeout": key % 5 == 0}
    return table(spark, sf_dir, "events").select("event_id", F.round(text.reward(found), 6).alias("reward"))
