"""Queries over evaluation outcomes: labels are 0/1 outcomes, events are telemetry, suppliers are candidate models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.operators import order, quantiles
from corpuscope.registry import query, table

_PAIRS = "(SELECT l.doc_id, least(d.n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS p, l.quality AS a FROM labels l JOIN documents d USING (doc_id))"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p (a confidence made of the length) and a (the outcome)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("a"))


@query("""
SELECT event_type AS task_type, json_extract_string(props, '$.k')::INT % 5 AS failure_kind, count(*) AS n FROM events WHERE value IS NULL OR value < 50 GROUP BY ALL""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by kind, read from JSON."""
    kind = (F.get_json_object("props", "$.k").cast("int") % 5).alias("failure_kind")
    return table(spark, sf_dir, "events").where(F.col("value").isNull() | (F.col("value") < 50)).groupBy(F.col("event_type").alias("task_type"), kind).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, arg_min(value, event_id) AS first_value FROM events GROUP BY ALL""")
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles and the first value by event type; no task holds or sorts a type's values."""
    events = table(spark, sf_dir, "events")
    found = quantiles.percentiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("n")
    rest = events.groupBy("event_type").agg(F.count("*").alias("n"), F.min_by("value", "event_id").alias("first_value"))
    return rest.join(found, "event_type", "left").select("event_type", "n", F.round("p50", 2).alias("p50"), F.round("p95", 2).alias("p95"), "first_value")


def pass_at(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product; 0 if k > n, 1 if fewer than k fail."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1.0 - F.lit(float(k)) / i))
    return F.when(F.lit(k) > n, 0.0).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1.0 - product)


@query("""
SELECT source AS task_id, n, c, CASE WHEN c = 0 THEN 0.0 ELSE c::DOUBLE / n END AS pass_1,
       CASE WHEN 5 > n THEN 0.0 WHEN n - c < 5 THEN 1.0 ELSE 1.0 - ((n-c)::DOUBLE/n) * ((n-c-1)::DOUBLE/(n-1)) * ((n-c-2)::DOUBLE/(n-2)) * ((n-c-3)::DOUBLE/(n-3)) * ((n-c-4)::DOUBLE/(n-4)) END AS pass_5
FROM (SELECT source, count(*) AS n, sum(quality)::BIGINT AS c FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are tasks, labelled documents their samples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy(F.col("source").alias("task_id")).agg(F.count("*").alias("n"), F.sum("quality").alias("c"))
    return rows.select("task_id", "n", "c", pass_at(F.col("n"), F.col("c"), 1).alias("pass_1"), pass_at(F.col("n"), F.col("c"), 5).alias("pass_5"))


@query(f"""
SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(a::DOUBLE) AS accuracy, avg((p - a) * (p - a)) AS brier FROM {_PAIRS} GROUP BY ALL""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration by ten equal bins."""
    gap = F.col("p") - F.col("a")
    return outcomes(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("a").cast("double")).alias("accuracy"), F.avg(gap * gap).alias("brier"))


@query(f"SELECT count(*) AS n, count(*) FILTER (p >= 0.5) AS answered, avg(CASE WHEN p >= 0.5 THEN a::DOUBLE END) AS accuracy FROM {_PAIRS}")
def abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept at a confidence of 0.5."""
    sure = F.col("p") >= 0.5
    return outcomes(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(sure).alias("answered"), F.avg(F.when(sure, F.col("a").cast("double"))).alias("accuracy"))


@query("""
WITH c AS (SELECT s_suppkey, s_acctbal / 10000.0 AS quality, (s_suppkey * 37 % 900 + 100)::DOUBLE AS latency, (s_suppkey * 91 % 4000 + 256)::DOUBLE AS ram FROM supplier),
u AS (SELECT *, quality - 0.2 * latency / max(latency) OVER () - 0.1 * (ram / max(ram) OVER ()) / 2 - 0.5 * (1 - (0.7 * quality + 0.3 * 0.5)) AS utility FROM c)
SELECT s_suppkey, round(utility, 9) AS utility, row_number() OVER (ORDER BY round(utility, 9) DESC, s_suppkey) AS place FROM u""")
def router_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility of candidate models; the first place is selected. Maxima are joined as one row."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key, (F.col("s_acctbal") / 10000.0).alias("quality"), (key * 37 % 900 + 100).cast("double").alias("latency"), (key * 91 % 4000 + 256).cast("double").alias("ram"))
    most = rows.agg(F.max("latency").alias("most_latency"), F.max("ram").alias("most_ram"))
    utility = F.col("quality") - 0.2 * F.col("latency") / F.col("most_latency") - 0.1 * (F.col("ram") / F.col("most_ram")) / 2 - 0.5 * (1 - (0.7 * F.col("quality") + 0.3 * 0.5))
    rows = rows.crossJoin(F.broadcast(most)).select(key, F.round(utility, 9).alias("utility"))
    return order.numbered(rows, [F.desc("utility"), F.col("s_suppkey")]).withColumn("place", F.col("place") + 1)


@query("""
WITH m AS (SELECT l_linestatus AS suite, date_trunc('month', l_shipdate) AS generated_at, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS passed FROM lineitem GROUP BY ALL)
SELECT suite, strftime(generated_at, '%Y-%m') AS month, total, passed, passed::DOUBLE / total AS score,
       passed::DOUBLE / total - lag(passed::DOUBLE / total) OVER (PARTITION BY suite ORDER BY generated_at) AS delta FROM m""")
def regression_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reports of each suite, their score and the change since the report before."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("suite"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("passed"))
    rows = rows.withColumn("score", F.col("passed") / F.col("total"))
    return rows.withColumn("delta", F.col("score") - F.lag("score").over(Window.partitionBy("suite").orderBy("month")))


@query("""
SELECT user_id AS run_id, arg_max(value, event_id) FILTER (value <> 0) AS last_loss, max(event_id) AS last_step, count(*) AS steps FROM events GROUP BY user_id""")
def scaling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each run that isn't 0."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max_by(F.when(F.col("value") != 0, F.col("value")), F.when(F.col("value") != 0, F.col("event_id"))).alias("last_loss"), F.max("event_id").alias("last_step"), F.count("*").alias("steps"))


@query("""
SELECT event_id AS step, round(2.5e-4 * CASE WHEN event_id < 1000 THEN (event_id + 1) / 1000.0 ELSE 0.5 * (1 + cos(pi() * (event_id - 1000) / 100000.0)) END, 12) AS lr FROM events""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up, then cosine."""
    step = F.col("event_id")
    return table(spark, sf_dir, "events").select(step.alias("step"), F.round(2.5e-4 * F.when(step < 1000, (step + 1) / 1000.0).otherwise(0.5 * (1 + F.cos(F.pi() * (step - 1000) / 100000.0))), 12).alias("lr"))


@query("""
WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT least(floor((x - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM v, e GROUP BY ALL""")
def weight_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty equal bins, the last one closed."""
    v = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("y")).select(F.col("y").cast("double").alias("x"))
    edges = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)), F.lit(39)).cast("int")
    return v.crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, count(*) AS events, count(*) FILTER (role = 'assistant') AS attempts, count(*) FILTER (role = 'user') AS asks,
       arg_max(role, turn) AS last_role, string_agg(role, '>' ORDER BY turn) AS timeline FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text) GROUP BY conv_id""")
def agent_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in each conversation, in order; of rows with the same turn the smallest counts."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    steps = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("events"), F.count_if(F.col("role") == "assistant").alias("attempts"), F.count_if(F.col("role") == "user").alias("asks"), F.max_by("role", "turn").alias("last_role"), F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("timeline"))


@query(f"""
SELECT l_orderkey, {", ".join(f"max(l_quantity) FILTER (l_linenumber = {k}) AS line_{k}" for k in range(1, 8))}, max(l_quantity) FILTER (l_linenumber > 7) AS more FROM lineitem GROUP BY l_orderkey""")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric rows to columns, seven lines each and whatever is beyond."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(*(F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"line_{k}") for k in range(1, 8)), F.max(F.when(F.col("l_linenumber") > 7, F.col("l_quantity"))).alias("more"))


@query("""
SELECT p_brand AS model_variant_id, count(*) AS n, avg(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') GROUP BY ALL""")
def adapter_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four variants side by side; the filter reaches the scan of part."""
    part = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("model_variant_id")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("price"))
