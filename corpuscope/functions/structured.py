"""Column functions over JSON in generated text: extraction, required keys, parsing against schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Required keys of each kind of output, and of the items of its array, if it has one.
SCHEMAS = {
    "PatchPlan": (("summary", "steps", "files"), None, ()),
    "PatchResult": (("patch", "files_changed"), None, ()),
    "ReviewResult": (("findings",), "findings", ("file", "line", "severity", "category", "message", "confidence")),
    "SecurityResult": (("findings",), "findings", ("file", "line", "severity", "category", "cwe", "expected_fix")),
    "RepositoryAnswer": (("answer", "citations"), None, ()),
    "ToolCall": (("tool", "arguments"), None, ()),
    "RouterDecision": (("selected_model", "scores"), None, ()),
}
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def fenced(text: Column) -> Column:
    """Bodies of fenced blocks that look like objects, whether or not they can be parsed."""
    return F.regexp_extract_all(text, F.lit(FENCED), F.lit(1))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


@pandas_udf(ArrayType(StringType()))
def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON values of a text, looked for from each place behind the last one found; null for null.

    Decoders have to be tried at every place, which no built-in function does; only texts without a fenced block get here.
    """
    decoder = json.JSONDecoder()

    def values(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out, at = [], 0
        while at < len(text):
            try:
                value, at = decoder.raw_decode(text, at)
                out.append(json.dumps(value, ensure_ascii=False))
            except (json.JSONDecodeError, RecursionError):
                at += 1
        return out

    for series in texts:
        yield series.map(values)


def embedded_json(text: Column) -> Column:
    """The JSON values of a generated text: of its fenced objects those that parse, or what a scan finds if it has none."""
    blocks = fenced(text)
    return F.when(F.size(blocks) > 0, F.filter(blocks, valid_json)).otherwise(scanned(F.when(F.size(blocks) == 0, text)))


def missing_keys(value: Column, schema: str) -> Column:
    """Paths of required keys that a JSON value lacks, those of the root first, then those of its items; a null value counts as there."""
    keys, items, item_keys = SCHEMAS[schema]
    fault = lambda path: F.concat(path, F.lit(": required field missing"))
    has = F.json_object_keys(value)
    out = F.filter(F.array(*(F.when(~F.array_contains(has, k), fault(F.lit(f"$.{k}"))) for k in keys)), lambda e: e.isNotNull())
    if items:
        rows = F.from_json(F.get_json_object(value, f"$.{items}"), "array<string>")
        lacks = lambda row, i: F.array(*(F.when(~F.array_contains(F.json_object_keys(row), k), fault(F.concat(F.lit(f"$.{items}["), i.cast("string"), F.lit(f"].{k}")))) for k in item_keys))
        found = F.flatten(F.transform(rows, lacks))
        out = F.concat(out, F.coalesce(F.filter(found, lambda e: e.isNotNull()), F.array().cast("array<string>")))
    return F.when(has.isNull(), F.array(F.lit("root must be an object"))).otherwise(out)


def parsed(values: Column, schema: str) -> Column:
    """value (the first one without a fault, else null), errors and retries (values tried before it, or all but one)."""
    place = F.array_position(F.transform(values, lambda v: F.size(missing_keys(v, schema)) == 0), True)
    none = F.array(F.lit("no valid JSON object matched schema"))
    return F.struct(
        F.when(place > 0, F.try_element_at(values, place.cast("int"))).alias("value"),
        F.when(place > 0, F.array().cast("array<string>")).otherwise(none).alias("errors"),
        F.when(place > 0, place - 1).otherwise(F.greatest(F.lit(0), F.size(values) - 1)).cast("int").alias("retries"),
    )
