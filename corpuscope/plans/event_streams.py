"""Queries over the events as a stream that arrives in four goes: a third of the time at once, and what comes too late with the last.

A go is a run of the stream that goes on from the state of the one before. Every fiftieth event of the first third
arrives behind the watermark; the last go also holds a mark of a far later time, which closes what is still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.cut import cut
from corpuscope.registry import query, table
from corpuscope.streaming import machine, telemetry
from corpuscope.streaming.runs import in_goes

LATE = "1 hour"
MARK = "mark"

_ARRIVED = """
e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL), r AS (SELECT min(us) AS lo, max(us) - min(us) + 1 AS width FROM e),
a AS (SELECT e.*, (us - lo) * 3 // width AS third FROM e, r), t AS (SELECT *, event_id % 50 = 0 AND third = 0 AS late FROM a)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """Four frames of event_id, ts (a timestamp), user_id, event_type and value, and all of them with their go."""
    rows = table(spark, sf_dir, "events").where(F.col("ts").isNotNull()).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    at = F.unix_micros("ts")
    bounds = rows.agg(F.min(at).alias("lo"), (F.max(at) - F.min(at) + 1).alias("width"), F.max("ts").alias("end"))  # one row
    third = F.expr("(unix_micros(ts) - lo) * 3 div width")
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("third", third)
    dealt = dealt.withColumn("go", F.when((F.col("event_id") % 50 == 0) & (F.col("third") == 0), 3).otherwise(F.col("third")).cast("int")).drop("third", "lo", "width")
    dealt = cut(dealt.drop("end"), "arrivals")
    mark = bounds.where("end is not null").select(F.lit(None).cast("long").alias("event_id"), (F.col("end") + F.expr("interval 30 days")).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit(MARK).alias("event_type"), F.lit(None).cast("double").alias("value"))
    goes = [dealt.where(F.col("go") == k).drop("go") for k in range(4)]
    return [*goes[:3], goes[3].unionByName(mark)], dealt


def _naive(ts: str) -> Column:
    return F.col(ts).cast("timestamp_ntz")


@query(f"""
WITH {_ARRIVED}
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS win, event_type, count(*) AS n, round(sum(value), 4) AS total FROM t WHERE NOT late GROUP BY ALL
UNION ALL SELECT NULL, event_type, count(*), NULL FROM t WHERE late GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.L: events of each type in windows of six hours; rows without a window count what came too late."""
    arrivals, every = _arrivals(spark, sf_dir)
    of = lambda s: s.withWatermark("ts", LATE).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    found = cut(in_goes(spark, arrivals, arrivals[0].schema, of, "tumbling").where(F.col("event_type") != MARK), "windows")
    counted = found.groupBy("event_type").agg(F.sum("n").alias("counted"))
    late = every.groupBy("event_type").agg(F.count("*").alias("arrived")).join(counted, "event_type", "left").select("event_type", (F.col("arrived") - F.coalesce("counted", F.lit(0))).alias("n")).where("n > 0")
    windows = found.select(_naive("window.start").alias("win"), "event_type", "n", F.round("total", 4).alias("total"))
    return windows.unionByName(late.select(F.lit(None).cast("timestamp_ntz").alias("win"), "event_type", "n", F.lit(None).cast("double").alias("total")))


@query(f"""
WITH {_ARRIVED}, w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS win FROM t WHERE NOT late)
SELECT win, win + INTERVAL 1 DAY AS until, count(*) AS n, min(value) AS least, max(value) AS largest FROM w GROUP BY win""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.L: windows of a day every twelve hours."""
    arrivals, _ = _arrivals(spark, sf_dir)
    of = lambda s: s.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"), F.max("event_type").alias("kind"))
    found = in_goes(spark, arrivals, arrivals[0].schema, of, "sliding")
    return found.where(~((F.col("n") == 1) & (F.col("kind") == MARK))).select(_naive("window.start").alias("win"), _naive("window.end").alias("until"), "n", "least", "largest")


@query(f"""
WITH {_ARRIVED}, s AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 7200000000, true)::INT AS fresh FROM t WHERE NOT late),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM s)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM n GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.L: a user's events with less than two hours between them are a session."""
    arrivals, _ = _arrivals(spark, sf_dir)
    of = lambda s: s.withWatermark("ts", LATE).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("event_type").alias("kind"))
    found = in_goes(spark, arrivals, arrivals[0].schema, of, "sessions").where(F.col("kind") != MARK)
    return found.select("user_id", _naive("session_window.start").alias("began"), _naive("session_window.end").alias("until"), "n", "errors")


@query(f"""
WITH {_ARRIVED}, s AS (SELECT DISTINCT event_id // 3 AS id, user_id, event_type FROM t WHERE NOT late)
SELECT user_id, event_type, count(*) AS n FROM s GROUP BY ALL""")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.L: each event is sent three times within the watermark and counted once; the ids of three events are one, by user and type."""
    arrivals, _ = _arrivals(spark, sf_dir)
    again = [a.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy").withColumn("event_id", F.expr("event_id div 3")) for a in arrivals]
    of = lambda s: s.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id", "user_id", "event_type"])
    found = in_goes(spark, again[:3], again[0].schema, of, "unique")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


#: Commands that events of each type stand for.
COMMANDS = {"signup": "start", "view": "start", "click": "done", "purchase": "done", "error": "fail"}
_SQL_COMMAND = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in COMMANDS.items()) + " ELSE 'none' END"
_SQL_MOVE = "CASE " + " ".join(f"WHEN split_part(s, '|', 1) = '{a}' AND c = '{c}' THEN '{b}|' || (split_part(s, '|', 2)::INT + 1)" for (a, c), b in machine.MOVES.items()) + " ELSE s END"


@query(f"""
WITH {_ARRIVED}, c AS (SELECT user_id, list({_SQL_COMMAND} ORDER BY us, event_id) FILTER (NOT late) AS cs, count(*) FILTER (late) AS late FROM t WHERE user_id IS NOT NULL GROUP BY user_id),
f AS (SELECT *, coalesce(len(cs), 0) AS applied, list_reduce(list_prepend('{machine.FIRST}|0', coalesce(cs, [])), lambda s, c: {_SQL_MOVE}) AS s FROM c)
SELECT user_id AS run, split_part(s, '|', 1) AS status, split_part(s, '|', 2)::BIGINT AS moves, applied - split_part(s, '|', 2)::BIGINT AS invalid, late, applied FROM f""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are commands to a run; its status, valid and invalid commands, and late ones without effect."""
    arrivals, every = _arrivals(spark, sf_dir)
    command = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in COMMANDS.items()), F.lit("none"))
    rows = [a.where(F.col("user_id").isNotNull() | (F.col("event_type") == MARK)).select("ts", F.coalesce("user_id", F.lit(-1)).alias("run"), F.coalesce("event_id", F.lit(-1)).alias("number"), command.alias("command")) for a in arrivals]
    key, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, ours)  # state with timers needs it
    try:
        states = in_goes(spark, rows, rows[0].schema, lambda s: machine.followed(s, LATE), "machine")
    finally:
        spark.conf.set(key, before)
    sent = every.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("sent"))
    found = sent.join(machine.latest(states.where("run <> -1")), "run", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("run", F.coalesce("status", F.lit(machine.FIRST)).alias("status"), count("moves").alias("moves"), count("invalid").alias("invalid"), (F.col("sent") - count("applied")).alias("late"), count("applied").alias("applied"))


@query("""
WITH l AS (SELECT event_id, event_type, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events)
SELECT CASE WHEN event_id % 17 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS event_type, event_id % 17 = 0 AS bad, CASE WHEN event_id % 17 = 0 THEN 'bad line: ' || left(line, length(line) - 5) END AS error FROM l WHERE event_id % 23 <> 1""")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: lines of JSON as a stream; some are cut off and some blank: bad lines are rows with an error, blank ones go."""
    line = F.to_json(F.struct("event_id", "event_type"))
    value = F.when(F.col("event_id") % 23 == 1, "  ").when(F.col("event_id") % 17 == 0, F.expr("substr(l, 1, length(l) - 5)")).otherwise(F.col("l"))
    lines = table(spark, sf_dir, "events").withColumn("l", line).select(value.alias("value"))
    found = in_goes(spark, [lines], lines.schema, lambda s: telemetry.parsed_lines(s, "event_id long, event_type string"), "lines")
    good = F.col("error").isNull()
    return found.select(F.when(good, F.col("event_id")).alias("event_id"), F.when(good, F.col("event_type")).alias("event_type"), (~good).alias("bad"), "error")
