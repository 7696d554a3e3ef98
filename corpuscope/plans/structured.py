"""Queries over JSON in generated text: turns of conversations are generations, with blocks of JSON added by turn and conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import structured
from corpuscope.registry import query, table

_BLOCKS = [
    'Plan: ```json\n{"tool": "grep", "arguments": {"q": 1}}\n``` done',
    'First ```{"tool": "grep"}``` then ```json {"tool": "ls", "arguments": null} ```',
    '```json\n{"tool": broken}\n``` ```{"findings": [{"file": "a", "line": 1}]}```',
    '```json\n{"findings": [{"file": "a", "line": 1, "severity": "low", "category": "x", "message": "m", "confidence": 0.5}]}\n```',
    '```python\nprint({})\n``` ```{"arguments": {}}``` ```{"a": {"tool": 1}}``` ```json\n{"arguments": [], "tool": ""}```',
    '```{"answer": "42", "citations": []}``` no more',
]
_SAID = "coalesce(text, '') || chr(10) || ([" + ", ".join("'" + b.replace("'", "''") + "'" for b in _BLOCKS) + f"])[((conv_id + turn) % {len(_BLOCKS)} + 1)::INT]"


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.element_at(F.array(*map(F.lit, _BLOCKS)), ((F.col("conv_id") + F.col("turn")) % len(_BLOCKS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block).alias("said"))


_FENCED = rf"""
g AS (SELECT conv_id, turn, role, {_SAID} AS said FROM conversations),
b AS (SELECT *, regexp_extract_all(said, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1) AS blocks FROM g),
v AS (SELECT *, list_filter(blocks, lambda x: json_valid(x)) AS vals FROM b),
p AS (SELECT *, list_position(list_transform(vals, lambda x: list_has_all(json_keys(x::JSON), ['tool', 'arguments'])), true) AS place FROM v)"""


@query(rf"""
WITH {_FENCED}
SELECT conv_id, turn, role, len(blocks) AS n_blocks, len(vals) AS n_values, vals[1] AS first_value FROM p""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced objects and which of them can be parsed; texts without any are scanned (a test compares that with Python)."""
    rows = _generations(spark, sf_dir).select("conv_id", "turn", "role", F.size(structured.fenced(F.col("said"))).cast("long").alias("n_blocks"), structured.embedded_json(F.col("said")).alias("v"))
    return rows.select("conv_id", "turn", "role", "n_blocks", F.size("v").cast("long").alias("n_values"), F.get("v", F.lit(0)).alias("first_value"))


@query(rf"""
WITH {_FENCED}, f AS (SELECT conv_id, turn, role, vals[1] AS x FROM v WHERE len(vals) > 0),
i AS (SELECT *, unnest(generate_series(0, len(json_extract(x, '$.findings[*]')) - 1)) AS i, unnest(json_extract(x, '$.findings[*]')) AS item FROM f)
SELECT conv_id, turn, role, CASE WHEN list_contains(json_keys(x::JSON), 'findings') THEN NULL ELSE '$.findings: required field missing' END AS fault FROM f WHERE NOT list_contains(json_keys(x::JSON), 'findings')
UNION ALL SELECT conv_id, turn, role, '$.findings[' || i || '].' || k || ': required field missing' FROM i, (SELECT unnest(['file', 'line', 'severity', 'category', 'message', 'confidence']) AS k) WHERE NOT list_contains(json_keys(item), k)""")
def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required keys that the first object of a generation lacks as a review, with their paths."""
    rows = _generations(spark, sf_dir).select("conv_id", "turn", "role", F.get(F.filter(structured.fenced(F.col("said")), structured.valid_json), F.lit(0)).alias("x")).where("x is not null")
    return rows.select("conv_id", "turn", "role", F.explode(structured.missing_keys(F.col("x"), "ReviewResult")).alias("fault"))


@query(rf"""
WITH {_FENCED}
SELECT conv_id, turn, role, vals[place] AS value, CASE WHEN place > 0 THEN place - 1 ELSE greatest(0, len(vals) - 1) END::INT AS retries, NOT coalesce(place > 0, false) AS failed FROM p""")
def structured_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object of a generation that is a tool call, and how many were tried before."""
    rows = _generations(spark, sf_dir).select("conv_id", "turn", "role", structured.parsed(F.filter(structured.fenced(F.col("said")), structured.valid_json), "ToolCall").alias("p"))
    return rows.select("conv_id", "turn", "role", "p.value", "p.retries", (F.size("p.errors") > 0).alias("failed"))


@query(rf"""
WITH {_FENCED}, r AS (SELECT role, coalesce(place > 0, false) AS ok, CASE WHEN place > 0 THEN place - 1 ELSE greatest(0, len(vals) - 1) END AS retries FROM p)
SELECT role, count(*) AS n, count(*) FILTER (ok AND retries = 0) / count(*)::DOUBLE AS first_try, count(*) FILTER (ok) / count(*)::DOUBLE AS eventual, sum(retries)::DOUBLE / count(*) AS mean_retries FROM r GROUP BY role""")
def structured_output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tool calls at the first try and at last, and mean number of retries, by role."""
    rows = _generations(spark, sf_dir).select("role", structured.parsed(F.filter(structured.fenced(F.col("said")), structured.valid_json), "ToolCall").alias("p"))
    ok, n = F.size("p.errors") == 0, F.count("*")
    return rows.groupBy("role").agg(n.alias("n"), (F.count_if(ok & (F.col("p.retries") == 0)) / n).alias("first_try"), (F.count_if(ok) / n).alias("eventual"), (F.sum("p.retries") / n).alias("mean_retries"))
