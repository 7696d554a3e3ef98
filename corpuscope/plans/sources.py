"""Queries that write tables in other formats to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import order
from corpuscope.operators.cut import shared_folder
from corpuscope.registry import query, table
from corpuscope.sources import readers, sinks


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT NULL, NULL, NULL, NULL")
def jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers appended as JSON lines, then blank lines and a broken one; the broken one is a row of nulls."""
    path = _place(spark, "jsonl")
    sinks.append_jsonl(table(spark, sf_dir, "supplier"), path)
    spark.createDataFrame([("",), ("  ",), ("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return readers.read_jsonl(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT 'n' || n_nationkey AS task_id, n_name AS prompt, n_regionkey AS region FROM nation")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: nations as files with JSON arrays, one for each region."""
    path = _place(spark, "tasks")
    task = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("task_id"), F.col("n_name").alias("prompt"), F.col("n_regionkey").alias("region"))
    arrays = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(task)).alias("value"))
    arrays.repartition(5, "n_regionkey").select("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    return readers.read_tasks(spark, f"{path}/*", "task_id string, prompt string, region int", strict=True)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file with a header, read again with its types."""
    path = _place(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "nation"), path)
    return sinks.read_csv(spark, path)


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def parquet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: written twice; the second takes the place of the first."""
    path = _place(spark, "parquet")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    for _ in range(2):
        sinks.write_parquet(rows, path)
    return spark.read.parquet(path)


@query("SELECT n_regionkey::VARCHAR AS folder, count(*) AS lines, sum(length(n_name))::BIGINT AS chars FROM nation GROUP BY 1")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: names of nations in nested folders, read as whole files."""
    path = _place(spark, "files")
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    files = readers.read_files(spark, path).where("not is_binary and path like '%/n_regionkey=%'").select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("folder"), "text")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return files.groupBy("folder").agg(F.sum(F.size(lines)).alias("lines"), F.sum(F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))).alias("chars"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def select_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that begins with SELECT, at most 1000 rows of it (its limit is the feature)."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("passthrough_orders")
    return readers.select_only(spark, "select o_orderstatus, count(*) as n from passthrough_orders group by o_orderstatus")


_TABLES = ["customer", "documents", "embeddings", "events", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", true AS healthy, count(*) AS n FROM {t}" for t in _TABLES))
def health_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each table answers, and its rows; the latency is left out here, as it is another one each time."""
    rows = []
    for name in _TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(f"probed_{name}")
        found = readers.probe(spark, f"SELECT count(*) AS n FROM probed_{name}")
        rows.append((name, found["healthy"], found["rows"][0][0] if found["healthy"] else None))
    return spark.createDataFrame(rows, "table string, healthy boolean, n long")


@query(f"SELECT table_name AS \"table\", column_name AS \"column\", ordinal_position::INT AS position FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _TABLES)})")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the tables; types are left out here, as engines name them differently."""
    return readers.described(spark, {name: table(spark, sf_dir, name) for name in _TABLES}).drop("type")


@query("""
WITH m AS (SELECT l_linestatus AS suite, strftime(l_shipdate, '%Y-%m') AS generated_at, count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE AS score FROM lineitem GROUP BY ALL)
SELECT suite, max(generated_at) AS generated_at, arg_max(score, generated_at) AS score, (arg_max(score, generated_at, 2))[2] AS previous_score FROM m GROUP BY suite""")
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports appended in two writes; the latest of each suite and the score before it."""
    path = _place(spark, "reports")
    reports = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("suite"), F.date_format("l_shipdate", "yyyy-MM").alias("generated_at")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("score"))
    for half in ("generated_at < '1996-01'", "generated_at >= '1996-01'"):
        sinks.append_report(reports.where(half), path)
    return sinks.latest_reports(spark.read.parquet(path))


@query("""
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS batch, greatest(1, round(length(text) / 4.0))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL""")
def migration_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyset batches of 500 in which a migration takes documents, and the tokens it fills in."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.greatest(F.lit(1), F.round(F.length("text") / 4.0)).cast("long").alias("tokens"))
    return order.numbered(rows, [F.col("doc_id")]).select("doc_id", F.floor(F.col("place") / 500).alias("batch"), "tokens")


@query("""
WITH s AS (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM documents)
SELECT CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(*) AS said, min(doc_id) AS first FROM s GROUP BY 1""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each split as text files and a JSON document of their counts, both read again."""
    path = _place(spark, "splits")
    sinks.write_splits(table(spark, sf_dir, "documents"), text.split_of(F.col("doc_id")), "doc_id", path, "documents", "1")
    ids = spark.read.text(f"{path}/ids").groupBy("split").agg(F.count("*").alias("n"), F.min(F.col("value").cast("long")).alias("first"))
    said = spark.read.schema("datasetId string, version string, counts map<string,long>").option("multiLine", True).json(f"{path}/split").select(F.explode("counts").alias("split", "said"))
    return ids.join(said, "split")
