"""Column functions over evaluation and training records: packing, routing, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that never reach a log.
BLOCKED_KEYS = ["authorization", "password", "api_key", "apikey", "token", "private_key", "patch", "prompt", "secret"]


def scrubbed(entries: Column) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(BLOCKED_KEYS))


def next_fit(sizes: Column, most: int) -> Column:
    """window (from 0) and boundary of each size, in order: a document joins the open window if it fits behind one separator.

    Otherwise it opens a window, in which it may be larger than `most`; a window that holds only empty documents stays open.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("window"), F.array().cast("array<struct<window:int,boundary:bigint>>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        behind = (s["n"] > 0) & (s["used"] + 1 + size <= most)
        opens = (s["used"] > 0) & ~behind
        window = s["window"] + opens.cast("int")
        boundary = F.when(opens, F.lit(0).cast("long")).otherwise(s["used"] + behind.cast("long"))
        return F.struct((boundary + size).cast("long").alias("used"), F.when(opens, 1).otherwise(s["n"] + 1).alias("n"), window.alias("window"), F.concat(s["out"], F.array(F.struct(window.alias("window"), boundary.alias("boundary")))).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def masked_labels(labels: Column, boundaries: Column, ignored: int = -100) -> Column:
    """Labels, those before a boundary from 1 on ignored."""
    return F.transform(labels, lambda x, i: F.when(F.array_contains(boundaries, i + 1), ignored).otherwise(x))


def fixed_windows(tokens: Column, size: int) -> Column:
    """inputs and labels of the whole windows of so many tokens; the rest at the end is left out."""

    def windows(tokens: Column) -> Column:
        whole = F.floor(F.size(tokens) / size).cast("int")
        part = lambda i, first: F.slice(tokens, i * size + first, F.lit(size - 1))
        return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(part(i, 1).alias("inputs"), part(i, 2).alias("labels"))))

    # A variable of a lambda is made once; an expression inside one is made anew for each window.
    return F.element_at(F.transform(F.array(tokens), windows), 1)


def record_fault(*fields: tuple[str, Column]) -> Column:
    """The first field that is null or empty, as `missing name`; else `ok`."""
    out = F.lit("ok")
    for name, value in reversed(fields):
        out = F.when(F.coalesce(value, F.lit("")) == "", f"missing {name}").otherwise(out)
    return out


def failure_kind(passed: Column, policy: Column, stdout: Column, stderr: Column) -> Column:
    """Why a verification failed; null if it passed."""
    return (F.when(passed, None).when(stderr.contains("Timed out") | F.concat(stdout, stderr).contains("timed out"), "SANDBOX_TIMEOUT").when(policy, "SANDBOX_POLICY")
            .when(F.lower(stderr).contains("error:") | F.lower(stderr).contains("build failed"), "COMPILE_FAIL").otherwise("TEST_FAIL"))


def entropy(weights: Column) -> Column:
    """Entropy of positive weights."""
    return -F.aggregate(F.filter(weights, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log(p + 1e-12))


def mean_distance(weights: Column) -> Column:
    """Weighted mean of the places, from 0."""
    return F.aggregate(F.zip_with(weights, F.sequence(F.lit(0), F.size(weights) - 1), lambda p, j: p * j), F.lit(0.0), lambda a, x: a + x)


# Stages of a data set, and bytes of a parameter by precision.
STAGES = ("source", "license gate", "filtering", "dedup", "synthetic augmentation", "split", "tokenization", "dataset version")
BYTES = {"fp32": 4.0, "fp16": 2.0, "bf16": 2.0, "int8": 1.0, "int4": 0.5}


def quantized_bytes(params: Column, precision: Column) -> Column:
    """Bytes of so many parameters; an unknown precision takes two for each."""
    each = F.coalesce(*(F.when(precision == k, v) for k, v in BYTES.items()), F.lit(2.0))
    return params * each


def preference_prompt(prompt: Column) -> Column:
    return F.concat(F.lit("### Prompt\n"), F.coalesce(prompt, F.lit("")), F.lit("\n\n### Prompt\n"), F.coalesce(prompt, F.lit("")))


def instruction_text(system: Column, context: Column, instruction: Column, response: Column) -> Column:
    """The text of an instruction record, without white space at its ends."""
    said = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat(said(system), F.lit("\n\n"), said(context), F.lit("\n\n### Instruction\n"), said(instruction), F.lit("\n\n### Response\n"), said(response))
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def event_summary(kind: Column, attempt: Column, said: Column) -> Column:
    """What an agent's event says in a line: plans and results in their words, others by attempt, kind or outcome."""
    return (
        F.when(kind == "PLAN", F.substring(said, 1, 120)).when(kind.isin("TOOL_REQUEST", "TOOL_RESULT", "PATCH"), F.concat(F.lit("attempt="), attempt)).when(kind.isin("COMPILE", "TEST"), said)
        .when(kind == "REFLECT", F.concat(F.lit("kind="), said)).when(kind == "FINISH", F.concat(F.lit("outcome="), said)).otherwise(F.substring(attempt, 1, 120))
    )
