"""Queries over what moves in bulk: resumable migrations, documents through a data source, table functions, paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import tables
from corpuscope.operators import migration, paths
from corpuscope.operators.cut import shared_folder
from corpuscope.plans.repository import GRAPH, files
from corpuscope.plans.retrieval import _EDGES, _edges
from corpuscope.plans.snippets import _CUT
from corpuscope.registry import query, table
from corpuscope.sources import documents


@query("""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN -1 END AS tokens, (row_number() OVER (ORDER BY doc_id) - 1) // 1500 AS go FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(tokens, greatest(1, round(length(text) / 4.0))::BIGINT) AS tokens, go::INT AS go FROM d""")
def resumed_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens filled in where they are missing, in goes of three batches of 500; the run stops after the first go and is taken up again."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(-1).cast("long")).alias("tokens"))
    fill = lambda df: df.select("doc_id", F.coalesce("tokens", F.greatest(F.lit(1), F.round(F.length("text") / 4.0)).cast("long")).alias("tokens"))
    folder = f"{shared_folder(spark)}/migration-{uuid.uuid4().hex}"
    migration.migrated(rows, "doc_id", fill, folder, batches=3, most=1)
    return migration.migrated(rows, "doc_id", fill, folder, batches=3)


@query("""
SELECT event_id, user_id, event_type, value FROM events WHERE event_id >= 1000 AND event_id < 7000 AND event_id % 11 <> 0""")
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents in the shared folder, in ranges of their ids; rows that can't be written are left out, a range is read again."""
    documents.register(spark)
    path, schema = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}", "event_id long, user_id long, event_type string, value double"
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))  # a number that JSON lacks
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", value.alias("value")).repartitionByRange("event_id")
    rows.write.format("documents").option("key", "event_id").option("failures", "swallow").mode("append").save(path)
    read = spark.read.format("documents").schema(schema).option("key", "event_id").load(path)
    return read.where("event_id >= 1000 and event_id < 7000")


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 1500),
p AS (SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS k FROM d),
r AS (
  SELECT doc_id, s, ({_CUT})::BIGINT AS e, n, k FROM p JOIN d USING (doc_id)
  UNION ALL
  SELECT doc_id, s, ({_CUT})::BIGINT AS e, n, k FROM (SELECT r.doc_id, d.text, d.n, greatest(r.s + 1, r.e - 150) AS s, r.k + 1 AS k FROM r JOIN d USING (doc_id)) WHERE s < n
), every AS (SELECT doc_id, k, s, e FROM r UNION ALL SELECT doc_id, 0, 0, length(text) FROM documents WHERE length(text) <= 1500)
SELECT doc_id, k AS chunk, s AS start, e AS "end", sha256(substr(text, s + 1, e - s)) AS sha256 FROM every JOIN documents USING (doc_id)""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, C9, 2.M: a row for each chunk of each document, by a table function."""
    spark.udtf.register("text_chunks", tables.TextChunks)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("chunked_documents")
    rows = spark.sql("SELECT d.doc_id, c.* FROM chunked_documents d, LATERAL text_chunks(d.text) c")
    return rows.select("doc_id", "chunk", "start", "end", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(f"""
WITH RECURSIVE {GRAPH}, b AS (SELECT path, n, length(line) - length(ltrim(line)) AS indent FROM l WHERE trim(line) <> ''),
y AS (SELECT s.path, s.n, s.kind, s.name, b.indent FROM s JOIN b USING (path, n)),
u AS (SELECT y.path, y.n, max(p.n) AS parent FROM y LEFT JOIN y AS p ON p.path = y.path AND p.n < y.n AND p.indent < y.indent AND NOT EXISTS (SELECT 1 FROM b WHERE b.path = y.path AND b.n > p.n AND b.n < y.n AND b.indent <= p.indent) GROUP BY ALL),
q AS (SELECT path, n, parent, name AS qualified FROM y JOIN u USING (path, n) UNION ALL SELECT q.path, q.n, u.parent, y.name || '.' || q.qualified FROM q JOIN y ON y.path = q.path AND y.n = q.parent JOIN u ON u.path = q.path AND u.n = q.parent),
z AS (SELECT y.path, y.n, min(b.n) AS stop FROM y LEFT JOIN b ON b.path = y.path AND b.n > y.n AND b.indent <= y.indent GROUP BY ALL),
x AS (SELECT z.path, z.n, max(b.n) AS end_line FROM z JOIN b ON b.path = z.path AND b.n >= z.n AND (stop IS NULL OR b.n < stop) GROUP BY ALL)
SELECT y.path, kind, name, qualified, y.n AS line, end_line FROM y JOIN q USING (path, n) JOIN x USING (path, n) WHERE q.parent IS NULL""")
def scoped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, C11, 2.M: symbols of files written from orders with the scopes around them, by a table function."""
    spark.udtf.register("scoped_symbols", tables.ScopedSymbols)
    files(spark, sf_dir).createOrReplaceTempView("scoped_files")
    return spark.sql("SELECT f.path, s.* FROM scoped_files f, LATERAL scoped_symbols(f.text, 'python') s")


def _levels(n: int) -> str:
    """Levels of searches from the sources of all pairs, with the smallest path to each node."""
    out = "w0 AS MATERIALIZED (SELECT pair, source AS node, [source] AS path, 0 AS steps FROM pairs)"
    for k in range(1, n + 1):
        out += f", w{k} AS MATERIALIZED (SELECT * FROM w{k - 1} UNION ALL SELECT pair, links.target, min(list_append(path, links.target)), {k} FROM w{k - 1} JOIN links ON links.source = node WHERE steps = {k - 1} AND NOT EXISTS (SELECT 1 FROM w{k - 1} AS o WHERE o.pair = w{k - 1}.pair AND o.node = links.target) GROUP BY pair, links.target)"
    return out


@query(f"""
WITH {_EDGES}, pairs AS (SELECT n_nationkey AS pair, 's' || min(s_suppkey) AS source, (SELECT 'c' || max(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS target FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey), {_levels(5)}
SELECT pairs.pair, source, target, array_to_string(coalesce(path, []), ' ') AS path FROM pairs LEFT JOIN w5 ON w5.pair = pairs.pair AND node = target""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: a shortest path over all orders from each nation's first supplier to its last customer, all pairs at once."""
    first = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("pair")).agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("source"))
    last = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("pair")).agg(F.concat(F.lit("c"), F.max("c_custkey")).alias("target"))
    found = paths.shortest_paths(_edges(spark, sf_dir), first.join(last, "pair", "left"))
    return found.select("pair", "source", "target", F.array_join("path", " ").alias("path"))
