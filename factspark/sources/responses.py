"""Turning stored research responses into claim, event, fragment and relation rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = ["claims", "events", "fragments", "relations"]


#: The keys that mark an object as a record of a section, the first fit counting.
SIGNATURES = [
    ("claims", {"attribute_key"}),
    ("events", {"event_type"}),
    ("fragments", {"category", "text"}),
    ("relations", {"predicate", "object_mention"}),
]
_STRING_OR_OPENING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|\{', re.DOTALL)


def recover_objects(text: str | None) -> list[dict] | None:
    """Complete records of a truncated response, each with its section.

    An object is tried wherever a brace opens outside a string; those that decode come in
    the order in which they end, so inner records precede the object around them.
    """
    if text is None:
        return None
    decode = json.JSONDecoder().raw_decode
    complete = []
    for token in _STRING_OR_OPENING.finditer(text):
        if token[0] == "{":
            try:
                item, end = decode(text, token.start())
            except ValueError:
                continue
            complete.append((end, token.start(), item))
    out = []
    for end, start, item in sorted(complete, key=lambda c: c[0]):
        section = next((name for name, keys in SIGNATURES if keys <= item.keys()), None)
        if section:
            out.append({"section": section, "obj": text[start:end]})
    return out


_RECORDS = T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("obj", T.StringType())]))


@F.pandas_udf(_RECORDS)
def _recover(texts: pd.Series) -> pd.Series:
    return texts.map(recover_objects)


def salvage_responses(responses: DataFrame) -> DataFrame:
    """(response_id, section, position, obj) for every record of every response.

    Well-formed JSON is split by generated code; only responses that fail to parse go
    through the recovery function.  A response without any record yields one ``error`` row.
    """
    fenced = F.regexp_extract("response", r"```(?:json)?\s*([\s\S]+?)\s*```", 1)
    text = F.when(F.length(fenced) > 0, fenced).otherwise(F.trim(F.col("response")))
    parsed = responses.select("response_id", text.alias("body")).withColumn(
        "doc", F.try_parse_json("body")
    )
    def section(name):
        items = F.try_variant_get("doc", f"$.{name}", "array<variant>")
        rows = F.transform(items, lambda v: F.struct(F.lit(name).alias("section"), F.to_json(v).alias("obj")))
        return F.coalesce(rows, F.array().cast(_RECORDS))

    section_rows = [section(name) for name in SECTIONS]
    broken = F.col("doc").isNull()
    both = parsed.withColumn("recovered", _recover(F.when(broken, F.col("body"))))
    records = F.when(broken, F.col("recovered")).otherwise(F.concat(*section_rows))
    failed = F.array(F.struct(F.lit("error").alias("section"), F.lit(None).cast("string").alias("obj")))
    filled = F.when(broken & (F.size(records) == 0), failed).otherwise(records)
    return both.select("response_id", F.posexplode(filled).alias("position", "r")).select(
        "response_id", "r.section", "position", "r.obj"
    )
