"""Queries over graded runs: lines of orders are cases, parts tasks, suppliers registry entries, ship months report generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import grading
from corpuscope.registry import query, table


def _div(column: str, by: int) -> Column:
    return F.col(column) % by == 0


@query("""
SELECT l_linestatus AS suite, CASE WHEN l_suppkey % 11 = 0 THEN 'NOT_APPLICABLE' WHEN l_partkey % 13 = 0 THEN 'CANDIDATE_INVALID' WHEN l_orderkey % 31 = 0 THEN 'WORKSPACE_ERROR' WHEN l_orderkey % 37 = 0 THEN 'INTERNAL_ERROR'
  WHEN l_partkey % 17 = 0 THEN 'PATCH_APPLY_FAIL' WHEN l_quantity > 48 THEN 'SANDBOX_TIMEOUT' WHEN l_tax > 0.07 THEN 'SANDBOX_POLICY' WHEN l_discount < 0.01 THEN 'COMPILE_FAIL' WHEN l_quantity < 3 THEN 'SANDBOX_TIMEOUT'
  WHEN l_partkey % 19 = 0 THEN 'SANDBOX_POLICY' WHEN (l_linenumber - 1) % 6 = 0 THEN 'NO_TESTS' WHEN l_returnflag = 'R' THEN 'PASS' ELSE 'TEST_FAIL' END AS status, count(*) AS n FROM lineitem GROUP BY ALL""")
def grader_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each case, by the first stage that fails."""
    compile_ = {"timed_out": F.col("l_quantity") > 48, "policy": F.col("l_tax") > 0.07, "passed": F.col("l_discount") >= 0.01}
    test = {"timed_out": F.col("l_quantity") < 3, "policy": _div("l_partkey", 19), "passed": F.col("l_returnflag") == "R"}
    status = grading.status(~_div("l_suppkey", 11), _div("l_partkey", 13), _div("l_partkey", 17), compile_, test, (F.col("l_linenumber") - 1) % 6, _div("l_orderkey", 31), _div("l_orderkey", 37))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("suite"), status.alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'ws ' || o_custkey WHEN o_custkey % 10 = 0 THEN '' ELSE 'ws-' || o_custkey END AS ws, ['test', 'COMPILE', 'Lint', 'RUN', 'STATIC_ANALYSIS'][(o_orderkey % 5 + 1)::INT] AS cmd,
  ['python', 'Java', 'cobol', 'go', 'shell', 'javascript', 'rust'][(o_custkey % 7 + 1)::INT] AS lang, (o_orderkey * 7 % 400 - 20)::INT AS s FROM orders)
SELECT o_orderkey, CASE WHEN NOT regexp_matches(ws, '^[A-Za-z0-9_-]{1,128}$') THEN 'workspace' WHEN upper(cmd) NOT IN ('TEST', 'COMPILE', 'LINT', 'FORMAT', 'STATIC_ANALYSIS') THEN 'command'
  WHEN lower(lang) = 'cobol' THEN 'language' WHEN s < 0 THEN 'timeout too short' WHEN s > 300 THEN 'timeout too long' WHEN lower(lang) IN ('go', 'rust') THEN 'no command map' WHEN o_orderkey % 23 = 0 THEN 'extra fields' WHEN o_orderkey % 29 = 0 THEN 'free-form command' ELSE 'allowed' END AS decision FROM r""")
def sandbox_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of orders against the rules of a sandbox."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    cust = F.col("o_custkey")
    workspace = F.when(cust % 9 == 0, F.concat(F.lit("ws "), cust)).when(cust % 10 == 0, "").otherwise(F.concat(F.lit("ws-"), cust))
    decision = grading.sandbox_decision(
        workspace, pick(["test", "COMPILE", "Lint", "RUN", "STATIC_ANALYSIS"], "o_orderkey"), pick(["python", "Java", "cobol", "go", "shell", "javascript", "rust"], "o_custkey"),
        (F.col("o_orderkey") * 7 % 400 - 20).cast("int"), _div("o_orderkey", 23), _div("o_orderkey", 29))
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as tasks, with columns that only an evaluator may see."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("t"), item).alias("task_id"), F.when(item % 2 == 0, "repair").otherwise("sql").alias("task_type"), F.col("text").alias("prompt"), F.lit("python").alias("language"),
        (item % 90 + 10).cast("long").alias("timeout_seconds"), F.when(item % 3 == 0, "mysql").alias("dialect"), F.lit("patch").alias("gold_patch"), F.lit("test").alias("hidden_test"))


@query("""SELECT 't' || item_id AS task_id, CASE WHEN item_id % 2 = 0 THEN 'repair' ELSE 'sql' END AS task_type, text AS prompt, 'python' AS language, (item_id % 90 + 10)::BIGINT AS timeout_seconds, CASE WHEN item_id % 3 = 0 THEN 'mysql' END AS dialect FROM benchmark""")
def visible_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model sees of a task; the other columns aren't even read."""
    tasks = _tasks(spark, sf_dir)
    return tasks.select(*grading.visible(tasks.columns))


@query("""
SELECT 't' || item_id AS "taskId", CASE WHEN item_id % 2 = 0 THEN 'repair' ELSE 'sql' END AS "taskType", text AS prompt, 'python' AS language, (item_id % 90 + 10)::BIGINT AS "timeoutSeconds", CASE WHEN item_id % 3 = 0 THEN 'mysql' END AS dialect FROM benchmark""")
def task_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public fields of a task, renamed; optional ones only where the table has them."""
    tasks = _tasks(spark, sf_dir)
    names = {"task_id": "taskId", "task_type": "taskType", "repository_snapshot_id": "repositorySnapshotId", "prompt": "prompt", "language": "language", "timeout_seconds": "timeoutSeconds", "requiresTools": "requiresTools", "dialect": "dialect"}
    return tasks.select(*(F.col(a).alias(b) for a, b in names.items() if a in tasks.columns))


_REPORTS = """
c AS (SELECT l_linestatus AS suite, strftime(l_shipdate, '%Y-%m') AS generated, l_orderkey * 10 + l_linenumber AS case_id, ['repair', 'sql', 'review'][(l_partkey % 3 + 1)::INT] AS category, l_returnflag = 'R' AS matched FROM lineitem)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.element_at(F.array(F.lit("repair"), F.lit("sql"), F.lit("review")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("suite"), F.date_format("l_shipdate", "yyyy-MM").alias("generated"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"),
        category.alias("category"), (F.col("l_returnflag") == "R").alias("matched"))


@query(f"""
WITH {_REPORTS}
SELECT suite, category, count(*) FILTER (matched) AS passed, count(*) FILTER (NOT matched) AS failed, count(*) AS total, count(*) FILTER (matched) / count(*)::DOUBLE AS score, round(100 * (count(*) FILTER (matched) / count(*)::DOUBLE), 2) AS percent FROM c GROUP BY GROUPING SETS ((suite, category), (suite))""")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each suite and, within it, each category (null: all)."""
    passed, total = F.count_if("matched"), F.count("*")
    cases = _cases(spark, sf_dir)
    score = passed / total
    return cases.groupingSets([["suite", "category"], ["suite"]], "suite", "category").agg(passed.alias("passed"), (total - passed).alias("failed"), total.alias("total"), score.alias("score"), F.round(100 * score, 2).alias("percent"))


@query(f"""
WITH {_REPORTS}, r AS (SELECT suite, generated, count(*) FILTER (matched AND category = 'sql') AS sp, count(*) FILTER (category = 'sql') AS st, count(*) FILTER (matched AND category <> 'sql') AS dp, count(*) FILTER (category <> 'sql') AS dt,
  right(generated, 2)::INT % 3 > 0 AS want_s, right(generated, 2)::INT % 4 > 0 AS want_d FROM c GROUP BY ALL),
o AS (SELECT *, CASE WHEN want_s THEN sp ELSE 0 END + CASE WHEN want_d THEN dp ELSE 0 END AS passed, CASE WHEN want_s THEN st ELSE 0 END + CASE WHEN want_d THEN dt ELSE 0 END AS total FROM r)
SELECT suite, generated, passed::BIGINT AS passed, total::BIGINT AS total, CASE WHEN total > 0 THEN passed / total::DOUBLE ELSE 0.0::DOUBLE END AS score,
  (want_s OR want_d) AND (NOT want_s OR sp = st) AND (NOT want_d OR CASE WHEN dt > 0 THEN dp / dt::DOUBLE ELSE 0.0::DOUBLE END >= 0.25) AS passed_gate FROM o""")
def suite_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reports; software checks are the cases about SQL, each section counts only where it was asked for."""
    sql, month = F.col("category") == "sql", F.substring("generated", 6, 2).cast("int")
    rows = _cases(spark, sf_dir).groupBy("suite", "generated").agg(F.count_if(F.col("matched") & sql).alias("sp"), F.count_if(sql).alias("st"), F.count_if(F.col("matched") & ~sql).alias("dp"), F.count_if(~sql).alias("dt"))
    want_s, want_d = month % 3 > 0, month % 4 > 0
    part = lambda a, b: (F.when(want_s, F.col(a)).otherwise(0) + F.when(want_d, F.col(b)).otherwise(0)).cast("long")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    passed, total = part("sp", "dp"), part("st", "dt")
    gate = grading.gate([(want_s, F.col("sp") == F.col("st")), (want_d, share(F.col("dp"), F.col("dt")) >= 0.25)])
    return rows.select("suite", "generated", passed.alias("passed"), total.alias("total"), share(passed, total).alias("score"), gate.alias("passed_gate"))


@query(f"""
WITH {_REPORTS}, r AS (SELECT suite, generated, count(*) AS total, count(*) FILTER (matched) AS passed FROM c GROUP BY ALL)
SELECT suite, generated, total, passed, generated = max(generated) OVER (PARTITION BY suite) AS latest FROM r QUALIFY row_number() OVER (PARTITION BY suite ORDER BY generated DESC) <= 6""")
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six reports of each suite and which one is the latest; numbers out of 1 to 100 are brought into it."""
    most = max(1, min(6, 100))
    reports = _cases(spark, sf_dir).groupBy("suite", "generated").agg(F.count("*").alias("total"), F.count_if("matched").alias("passed"))
    place = F.row_number().over(Window.partitionBy("suite").orderBy(F.desc("generated")))
    return reports.withColumn("place", place).where(F.col("place") <= most).select("suite", "generated", "total", "passed", (F.col("place") == 1).alias("latest"))


@query("""
WITH c AS (SELECT l_linestatus AS suite, strftime(l_shipdate, '%Y-%m') AS generated, l_suppkey AS case_id, bool_or(l_returnflag = 'R') AS matched FROM lineitem GROUP BY ALL),
m AS (SELECT suite, generated, lag(generated) OVER (PARTITION BY suite ORDER BY generated) AS previous FROM (SELECT DISTINCT suite, generated FROM c))
SELECT c.suite, c.generated, c.case_id, p.matched AS previous_matched, c.matched AS current_matched FROM c JOIN m ON m.suite = c.suite AND m.generated = c.generated
JOIN c p ON p.suite = c.suite AND p.generated = m.previous AND p.case_id = c.case_id WHERE p.matched <> c.matched""")
def changed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases (one for each supplier) that came out otherwise than in the suite's report before."""
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("suite"), F.date_format("l_shipdate", "yyyy-MM").alias("generated"), F.col("l_suppkey").alias("case_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("matched"))
    months = cases.select("suite", "generated").distinct().withColumn("previous", F.lag("generated").over(Window.partitionBy("suite").orderBy("generated")))
    before = cases.select("suite", F.col("generated").alias("previous"), "case_id", F.col("matched").alias("previous_matched"))
    now = cases.withColumnRenamed("matched", "current_matched").join(months, ["suite", "generated"]).join(before, ["suite", "previous", "case_id"])
    return now.where("previous_matched <> current_matched").select("suite", "generated", "case_id", "previous_matched", "current_matched")


@query("""
SELECT l_linestatus AS suite, CASE WHEN p_partkey IS NULL THEN 'HARNESS_ERROR' WHEN s_suppkey IS NULL THEN 'NOT_APPLICABLE' WHEN l_returnflag = 'R' THEN 'PASS' ELSE 'TEST_FAIL' END AS status,
  count(*) AS n, count(*) FILTER (p_partkey IS NOT NULL AND s_suppkey IS NOT NULL AND l_returnflag = 'R') AS matched
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = l_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey GROUP BY ALL""")
def harness_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their tasks and registry entries; a missing task is an error of its row and never of the job."""
    tasks = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("task"))
    entries = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("entry"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag").join(tasks, "l_partkey", "left").join(entries, "l_suppkey", "left")
    status = F.when(F.col("task").isNull(), "HARNESS_ERROR").when(F.col("entry").isNull(), "NOT_APPLICABLE").when(F.col("l_returnflag") == "R", "PASS").otherwise("TEST_FAIL")
    return rows.groupBy(F.col("l_linestatus").alias("suite"), status.alias("status")).agg(F.count("*").alias("n"), F.count_if(status == "PASS").alias("matched"))


def baseline_faults(cases: DataFrame) -> DataFrame:
    """id and fault of the cases of a manifest that break a rule; rows without an id are about the manifest as a whole.

    cases: keys (array of a case's keys), id, candidate (a path) and expectedPassed. The first rule that is broken counts.
    """
    lacks = F.filter(F.array(*map(F.lit, grading.REQUIRED_CASE_KEYS)), lambda k: ~F.array_contains(F.col("keys"), k))
    bad = F.filter(F.array(*map(F.lit, grading.FORBIDDEN_CASE_KEYS)), lambda k: F.array_contains(F.col("keys"), k))
    depth = F.aggregate(F.filter(F.split("candidate", "/"), lambda p: ~p.isin("", ".")), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, p: F.struct(
        (s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    again = cases.groupBy("id").agg(F.count("*").alias("copies"))
    fault = (
        F.when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacks), ","))).when(F.size(bad) > 0, F.concat(F.lit("forbidden "), F.get(bad, F.lit(0))))
        .when(F.col("copies") > 1, "duplicate id").when(F.col("expectedPassed").isNull(), "expectedPassed must be boolean").when(F.col("candidate").startswith("/") | (depth["least"] < 0), "candidate escapes")
    )
    rows = cases.join(again, "id").select("id", fault.alias("fault")).where("fault is not null")
    whole = cases.agg(F.count_if("expectedPassed").alias("good"), F.count_if(~F.col("expectedPassed")).alias("bad"))
    said = F.array(F.when(F.col("good") == 0, "no known-good case"), F.when(F.col("bad") == 0, "no known-bad case"))
    return rows.unionByName(whole.select(F.lit(None).cast(cases.schema["id"].dataType).alias("id"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("fault")))


@query("""
WITH c AS (SELECT CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey AS k, CASE WHEN p_partkey % 8 = 5 THEN NULL ELSE p_size > 25 END AS good FROM part),
d AS (SELECT *, count(*) OVER (PARTITION BY id) AS copies FROM c)
SELECT id, CASE WHEN k % 7 = 1 AND k % 11 = 2 THEN 'missing candidate,taskId' WHEN k % 7 = 1 THEN 'missing taskId' WHEN k % 11 = 2 THEN 'missing candidate' WHEN k % 13 = 4 THEN 'forbidden argv' WHEN copies > 1 THEN 'duplicate id' WHEN good IS NULL THEN 'expectedPassed must be boolean'
  WHEN k % 6 IN (0, 1) THEN 'candidate escapes' END AS fault FROM d WHERE fault IS NOT NULL
UNION ALL SELECT NULL, 'no known-good case' FROM part HAVING count(*) FILTER (p_size > 25 AND p_partkey % 8 <> 5) = 0 UNION ALL SELECT NULL, 'no known-bad case' FROM part HAVING count(*) FILTER (p_size <= 25 AND p_partkey % 8 <> 5) = 0""")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases of a baseline, with keys left out, added or repeated by number."""
    key = F.col("p_partkey")
    keys = F.array(F.lit("id"), F.lit("category"), F.lit("expectedStatus"), F.lit("expectedPassed"), F.when(key % 7 != 1, "taskId"), F.when(key % 11 != 2, "candidate"), F.when(key % 13 == 4, "argv"))
    path = F.element_at(F.array(*map(F.lit, ["/etc/x", "a/../../x", "a/../b.py", "x.py", "./a/b.py", "a/b/../../c"])), (key % 6 + 1).cast("int"))
    cases = table(spark, sf_dir, "part").select(F.when(key % 10 == 3, key - 1).otherwise(key).alias("id"), F.filter(keys, lambda k: k.isNotNull()).alias("keys"), path.alias("candidate"), F.when(key % 8 != 5, F.col("p_size") > 25).alias("expectedPassed"))
    return baseline_faults(cases)


@query("""
WITH t AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS attempts, sum(length(coalesce(text, '')) // 100)::BIGINT AS calls, bool_or(contains(lower(text), 'thank')) AS good, max(turn) > 6 AS late FROM conversations GROUP BY conv_id)
SELECT conv_id, attempts, calls, CASE WHEN coalesce(good, false) THEN 'success' WHEN late THEN 'timeout' WHEN calls > 12 THEN 'tool-budget-exhausted' ELSE 'exhausted' END AS outcome FROM t""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each conversation, as a run of an agent, ended."""
    calls = F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 100)).cast("long")
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("attempts"), calls.alias("calls"), F.bool_or(F.contains(F.lower("text"), F.lit("thank"))).alias("good"), (F.max("turn") > 6).alias("late"))
    return runs.select("conv_id", "attempts", "calls", grading.run_outcome(F.coalesce("good", F.lit(False)), F.col("late"), F.col("calls"), 12).alias("outcome"))


@query("""
SELECT suite, case_id, category, matched, message FROM (SELECT l_linestatus AS suite, l_orderkey * 10 + l_linenumber AS case_id, ['repair', 'sql', 'review'][(l_partkey % 3 + 1)::INT] AS category, l_returnflag = 'R' AS matched, CASE WHEN l_partkey % 4 = 0 THEN 'late' ELSE '' END AS message FROM lineitem)""")
def public_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a report without outputs, commands and environment; a case is one nested value."""
    raw = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.element_at(F.array(F.lit("repair"), F.lit("sql"), F.lit("review")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("category"),
        (F.col("l_returnflag") == "R").alias("matched"), F.when(F.col("l_partkey") % 4 == 0, "late").alias("message"), F.lit("out").alias("stdout"), F.lit("err").alias("stderr"), F.lit("run").alias("command"), F.lit("env").alias("environment"))
    case = F.col("case").dropFields("stdout", "stderr", "command", "environment").withField("message", F.coalesce("case.message", F.lit("")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("suite"), raw.alias("case")).select("suite", case.alias("case")).select("suite", "case.*")


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_custkey END, 42)::BIGINT AS seed, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, 'CREATED') AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'models required' WHEN o_orderkey % 7 = 0 THEN 'tasks required' ELSE 'ok' END AS verdict FROM orders""")
def experiment_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of new experiments, and which required list is empty."""
    key = F.col("o_orderkey")
    models = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m")))
    tasks = F.when(key % 7 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("t")))
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.coalesce(F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")), F.lit(42)).cast("long").alias("seed"), F.coalesce(F.when(key % 3 > 0, F.col("o_orderstatus")), F.lit("CREATED")).alias("status"),
        F.when(empty(models), "models required").when(empty(tasks), "tasks required").otherwise("ok").alias("verdict"))


@query("""
SELECT o_orderkey AS run_id, 'RUNNING' AS event, NULL::VARCHAR AS metric, NULL::DOUBLE AS value FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'FINISHED' END, NULL, NULL FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT l_orderkey, 'METRIC', m, v FROM (SELECT l_orderkey, unnest(['quantity', 'price']) AS m, unnest([l_quantity, l_extendedprice]) AS v FROM lineitem)""")
def run_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, finish and metric rows of runs as one frame, so that one write holds them all."""
    orders, none = table(spark, sf_dir, "orders"), F.lit(None)
    row = lambda df, event: df.select(F.col("o_orderkey").alias("run_id"), event.alias("event"), none.cast("string").alias("metric"), none.cast("double").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.map_from_arrays(F.array(F.lit("quantity"), F.lit("price")), F.array("l_quantity", "l_extendedprice"))).alias("metric", "value"))
    metrics = lines.select(F.col("l_orderkey").alias("run_id"), F.lit("METRIC").alias("event"), "metric", "value")
    return row(orders, F.lit("RUNNING")).unionByName(row(orders.where("o_orderstatus <> 'P'"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("FINISHED"))).unionByName(metrics)
