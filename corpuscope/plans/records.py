"""Queries over records: lines of orders are model results, parts models, suppliers candidates, conversations training records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import records, text
from corpuscope.operators import graph, sketch
from corpuscope.operators.cut import cut, shared_folder
from corpuscope.registry import query, table
from corpuscope.streaming import telemetry


@query("""
WITH f AS (SELECT l_orderkey, min(l_linenumber) AS rejected FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber AS chosen, rejected FROM lineitem JOIN f USING (l_orderkey) WHERE l_returnflag = 'R'""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each result that passes against the first one of its order that fails."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    failing = rows.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("rejected"))
    return rows.where("l_returnflag = 'R'").join(failing, "l_orderkey").select("l_orderkey", F.col("l_linenumber").alias("chosen"), "rejected")


@query("""
SELECT l_orderkey, coalesce(min(l_linenumber - 1) FILTER (l_returnflag = 'A' AND l_linenumber <= 5), count(*))::BIGINT AS escalations, arg_min(l_linenumber, l_quantity * 100 + l_linenumber) FILTER (l_returnflag = 'R') AS selected FROM lineitem GROUP BY 1""")
def cascade_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an order escalates until a result is valid, and its smallest result that passes (the first on ties)."""
    valid, right = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") <= 5), F.col("l_returnflag") == "R"
    best = F.min(F.when(right, F.struct("l_quantity", "l_linenumber")))["l_linenumber"]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(valid, F.col("l_linenumber") - 1)), F.count("*")).cast("long").alias("escalations"), best.alias("selected"))


_TASKS = "VALUES (1, 'sql', 'small', false, 0.1, 100, 4000, 0), (2, 'interactive', 'large', true, 0.1, 100, 4000, 0), (3, 'explain', 'small', false, 0.9, 100, 4000, 0), (4, 'security', 'large', false, 0.1, 100, 900, 2000), (5, 'explain', 'large', false, 0.1, 100, 900, 0), (6, 'explain', 'large', false, 0.1, 5000, 3000, 3000), (7, 'explain', 'large', false, 0.1, 999999, 3000, 3000)"
_TASK_COLUMNS = "t(task, task_type, repo_size, tools, confidence, context, ram, vram)"
_MODELS = "SELECT s_suppkey AS id, s_acctbal AS quality, s_suppkey * 37 % 901 AS latency, s_suppkey * 91 % 4001 AS need, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey * 53 % 3001 END AS v, s_suppkey * 17 % 8001 AS len, s_suppkey % 4 = 0 AS has_tools, s_suppkey % 7 = 0 AS qwen_lora, s_suppkey % 5 > 0 AS loaded FROM supplier"


@query(f"""
WITH t AS (SELECT * FROM ({_TASKS}) AS {_TASK_COLUMNS}), m AS ({_MODELS})
SELECT task, coalesce(
  CASE WHEN task_type = 'sql' AND repo_size IN ('small', 'medium') THEN (SELECT id FROM m WHERE qwen_lora ORDER BY latency, id LIMIT 1) END,
  CASE WHEN task_type = 'interactive' OR tools THEN (SELECT id FROM m WHERE has_tools ORDER BY latency, id LIMIT 1) END,
  CASE WHEN confidence > 0.8 AND repo_size = 'small' THEN (SELECT id FROM m WHERE v = 0 ORDER BY latency, id LIMIT 1) END,
  CASE WHEN task_type IN ('security', 'review', 'sql') THEN coalesce((SELECT id FROM m WHERE v <= t.vram AND need <= t.ram ORDER BY quality DESC, id LIMIT 1), (SELECT id FROM m ORDER BY latency, id LIMIT 1)) END,
  CASE WHEN vram = 0 THEN coalesce((SELECT id FROM m WHERE v = 0 ORDER BY latency, id LIMIT 1), (SELECT id FROM m ORDER BY latency, id LIMIT 1)) END,
  (SELECT id FROM m WHERE loaded AND len >= t.context AND need <= t.ram AND v <= t.vram ORDER BY quality DESC, id LIMIT 1),
  (SELECT id FROM m WHERE loaded ORDER BY quality DESC, id LIMIT 1)) AS picked FROM t""")
def rule_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tasks, each dealt a model by rules; all models are seen once, whatever the rules."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("rule_suppliers")
    models = spark.sql(_MODELS.replace("FROM supplier", "FROM rule_suppliers"))
    tasks = spark.sql(f"SELECT * FROM ({_TASKS}) AS {_TASK_COLUMNS}")  # seven rows
    cheap = lambda p: F.min(F.when(F.expr(p), F.struct("latency", "id")))["id"]
    good = lambda p: F.min(F.when(F.expr(p), F.struct(-F.col("quality"), F.col("id").alias("id"))))["id"]
    found = models.crossJoin(F.broadcast(tasks)).groupBy("task", "task_type", "repo_size", "tools", "confidence", "vram").agg(
        cheap("true").alias("any"), cheap("qwen_lora").alias("lora"), cheap("has_tools").alias("tooled"), cheap("v = 0").alias("cpu"), good("v <= vram AND need <= ram").alias("fits"),
        good("loaded AND len >= context AND need <= ram AND v <= vram").alias("heavy"), good("loaded").alias("loaded"))
    rule = lambda p, c: F.when(F.expr(p), c)
    return found.select("task", F.coalesce(
        rule("task_type = 'sql' AND repo_size IN ('small', 'medium')", F.col("lora")), rule("task_type = 'interactive' OR tools", F.col("tooled")), rule("confidence > 0.8 AND repo_size = 'small'", F.col("cpu")),
        rule("task_type IN ('security', 'review', 'sql')", F.coalesce("fits", "any")), rule("vram = 0", F.coalesce("cpu", "any")), F.col("heavy"), F.col("loaded")).alias("picked"))


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, length(text)::BIGINT AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE text IS NOT NULL
), p AS (
  SELECT conv_id, place, turn, len AS used, 1 AS n, 0 AS win, 0::BIGINT AS boundary FROM c WHERE place = 1
  UNION ALL
  SELECT conv_id, place, turn, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END + len, CASE WHEN opens THEN 1 ELSE n + 1 END, win + opens::INT, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END FROM (
    SELECT c.conv_id, c.place, c.turn, c.len, used, n, win, used + 1 + c.len <= 400 AS behind, used > 0 AND used + 1 + c.len > 400 AS opens FROM p JOIN c ON c.conv_id = p.conv_id AND c.place = p.place + 1)
)
SELECT conv_id, place, turn, win::INT AS win, boundary FROM p""")
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into windows of 400 characters; a conversation is a shard."""
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select("conv_id", F.struct("turn", "text", F.length("text").cast("long").alias("len")).alias("r"))
    packs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    packs = packs.withColumn("at", records.next_fit(F.transform("rs", lambda r: r["len"]), 400))
    each = packs.select("conv_id", F.posexplode(F.arrays_zip("rs", "at")).alias("place", "x"))
    return each.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), "x.rs.turn", F.col("x.at.window").alias("win"), F.col("x.at.boundary").alias("boundary"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) // 64)) AS k FROM t)
SELECT doc_id, k::INT AS k, w[k * 64 + 1] AS first_input, w[k * 64 + 63] AS last_input, w[k * 64 + 64] AS last_label FROM i""")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words; labels are the inputs shifted by one."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(records.fixed_windows(text.word_tokens(F.col("text")), 64)).alias("k", "w"))
    return each.select("doc_id", "k", F.col("w.inputs")[0].alias("first_input"), F.element_at("w.inputs", -1).alias("last_input"), F.element_at("w.labels", -1).alias("last_label"))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
v AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 2))::INT AS idx, count(*) AS n FROM t WHERE length(t) > 1 GROUP BY ALL)
SELECT doc_id, idx, round(CASE WHEN idx % 2 = 1 THEN n ELSE -n END / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM v""")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: 256 buckets by the first byte of md5, odd ones positive, normalised. Tokens are counted before the shuffle."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.retrieval_tokens(F.col("text"))).alias("t"))
    counts = tokens.groupBy("doc_id", F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 2), 16, 10).cast("int").alias("idx")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))  # at most 256 rows each
    return counts.select("doc_id", "idx", F.round(F.when(F.col("idx") % 2 == 1, F.col("n")).otherwise(-F.col("n")) / norm, 9).alias("value"))


_SIGNED = """
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents),
v AS (SELECT word, slot, ('0x' || substr(sha256('7:' || 2 * slot + 1 || ':' || 2 * slot + 2 || ':' || word), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT word FROM w), (SELECT unnest(range(128)) AS slot)),
m AS (SELECT doc_id, slot, min(h) AS h FROM w JOIN v USING (word) GROUP BY ALL)"""


@query(f"""
WITH {_SIGNED}, s AS (SELECT doc_id, sha256(string_agg(h::VARCHAR, ',' ORDER BY slot)) AS signature_sha256, min(h) FILTER (slot = 0) AS first_slot FROM m GROUP BY doc_id)
SELECT d.doc_id, signature_sha256, first_slot FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id)""")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of 128 slots, shown as their digest and first slot."""
    sigs = sketch.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")
    said = F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")
    return sigs.select("doc_id", F.sha2(said.cast("binary"), 256).alias("signature_sha256"), F.get("signature", F.lit(0)).alias("first_slot"))


@query(f"""
WITH {_SIGNED}, n AS (SELECT DISTINCT doc_id FROM documents)
SELECT n.doc_id, count(*) FILTER (a.h = b.h) / 128.0::DOUBLE AS similarity FROM n LEFT JOIN m a ON a.doc_id = n.doc_id LEFT JOIN m b ON b.doc_id = n.doc_id + 1 AND b.slot = a.slot GROUP BY n.doc_id""")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal slots of each document and the one with the next number; 0 where either has none."""
    sigs = cut(sketch.signatures(table(spark, sf_dir, "documents"), "doc_id", "text"))
    after = sigs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("signature").alias("next"))
    return sigs.join(after, "doc_id", "left").select("doc_id", sketch.similarity(F.col("signature"), F.col("next")).alias("similarity"))


@query()
def band_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an earlier one that stays and shares a band."""
    return sketch.keep_first(cut(sketch.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")), "doc_id")


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS q FROM p)
SELECT vec_id, round(-list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x * ln(x + 1e-12) ELSE 0 END)), 6) AS entropy, round(list_sum(list_transform(q, lambda x, i: x * (i - 1))), 6) AS distance FROM q""")
def attention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of a vector, made to sum to one, as a row of attention."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", sizes.alias("e"))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).select("vec_id", F.transform("e", lambda x: x / F.col("total")).alias("q"))
    return rows.select("vec_id", F.round(records.entropy(F.col("q")), 6).alias("entropy"), F.round(records.mean_distance(F.col("q")), 6).alias("distance"))


@query("""
WITH s AS (SELECT o_custkey, o_orderstatus AS now, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderdate, o_orderkey FROM orders)
SELECT o_custkey, arg_max(now, (o_orderdate, o_orderkey)) AS status, count(before) AS moves, count(*) FILTER (before = 'F' AND now = 'P') AS invalid FROM s GROUP BY 1""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer are states in time; going from F to P isn't allowed."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("now"), F.lag("o_orderstatus").over(order).alias("before"))
    return rows.groupBy("o_custkey").agg(F.max_by("now", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count("before").alias("moves"), F.count_if((F.col("before") == "F") & (F.col("now") == "P")).alias("invalid"))


_STDERR = ["", "Error: x", "Timed out after 60 s", "BUILD FAILED", "fatal", "error", "x Timed out ERROR: y"]
_STDOUT = ["", "it has timed out", "1 failed", "ok"]


@query(f"""
WITH v AS (SELECT event_id, event_id % 2 = 0 AS passed, event_id % 5 = 0 AS policy, ([{', '.join(repr(x) for x in _STDERR)}])[(event_id % 7 + 1)::INT] AS e, ([{', '.join(repr(x) for x in _STDOUT)}])[(user_id % 4 + 1)::INT] AS o FROM events)
SELECT CASE WHEN passed THEN NULL WHEN contains(e, 'Timed out') OR contains(o || e, 'timed out') THEN 'SANDBOX_TIMEOUT' WHEN policy THEN 'SANDBOX_POLICY' WHEN contains(lower(e), 'error:') OR contains(lower(e), 'build failed') THEN 'COMPILE_FAIL' ELSE 'TEST_FAIL' END AS kind, count(*) AS n FROM v GROUP BY 1""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a verifier dealt by event and user, and why it failed."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    key = F.col("event_id")
    kind = records.failure_kind(key % 2 == 0, key % 5 == 0, pick(_STDOUT, "user_id"), pick(_STDERR, "event_id"))
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN coalesce(text, '') = '' THEN 'missing instruction' WHEN turn % 3 = 0 THEN 'missing response' ELSE 'ok' END AS reason, count(*) AS n FROM conversations GROUP BY 1""")
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are instructions; every third turn lacks its response."""
    reason = records.record_fault(("instruction", F.col("text")), ("response", F.when(F.col("turn") % 3 == 0, "").otherwise("r")))
    return table(spark, sf_dir, "conversations").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_KEYS = ["authorization", "password", "api_key", "apikey", "token", "private_key", "patch", "prompt", "secret", "Token", "step", "tokens"]


@query(f"""
WITH l AS (SELECT event_id, ['k', ([{', '.join(repr(x) for x in _KEYS)}])[(event_id % 12 + 1)::INT], 'kind_' || event_type] AS keys FROM events)
SELECT event_id, array_to_string(list_filter(keys, lambda x: NOT regexp_matches(x, '^(authorization|password|api_?key|token|private_key|patch|prompt|secret)$')), ',') AS keys FROM l""")
def log_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked keys leave a log line; each event logs one of twelve."""
    dealt = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % len(_KEYS) + 1).cast("int"))
    line = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), dealt, F.col("event_id").cast("string"), F.concat(F.lit("kind_"), "event_type"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(records.scrubbed(line)), ",").alias("keys"))


@query("SELECT doc_id, greatest(1, round(length(text) / 4.0))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def backfill_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the characters, rounded half up."""
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.greatest(F.lit(1), F.round(F.length("text") / 4.0)).cast("long").alias("tokens"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 rows after the first 20."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(20).limit(50)


@query("SELECT p_partkey::VARCHAR AS node, floor(log2(p_partkey))::INT AS steps FROM part WHERE p_partkey > 0")
def lineage_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part k is the parent of 2k and 2k + 1; all descendants of the first, by generation."""
    edges = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.expr("string(p_partkey div 2)").alias("source"), F.col("p_partkey").cast("string").alias("target"))
    return graph.reachable(edges, spark.createDataFrame([("1",)], "node string"))


@query("SELECT p_partkey // 2 AS parent, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part WHERE p_partkey > 1 GROUP BY 1")
def lineage_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the models made from each model, one step down."""
    rows = table(spark, sf_dir, "part").where("p_partkey > 1")
    return rows.groupBy(F.expr("p_partkey div 2").alias("parent")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest FROM events GROUP BY 1""")
def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, run until all is read; each batch replaces the written result."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    # A pattern, since a stream's plain path has to be a folder.
    stream = telemetry.running(telemetry.read_stream(spark, f"{sf_dir}/events.parque[t]", schema))
    # A batch that is repeated after a failure writes the same folder again.
    job = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/result"))
    job.start().awaitTermination()
    return spark.read.parquet(f"{base}/result").select("event_type", "n", F.round("total", 4).alias("total"), "least", "largest")
