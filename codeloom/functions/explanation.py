"""Explanations of a model as rows: what is usable of a reply, or why it isn't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v

# fixed values: why a reply is refused, in the order of the checks
NO_OBJECT, NOT_JSON, NOT_OBJECT = "reply contained no JSON object", "reply was not valid JSON", "reply JSON was not an object"
NO_SUMMARY, NO_LIST, NO_INDICES = "reply had no summary", "evidence_indices was not a list", "evidence_indices was empty or invalid"


def _text(value: Column) -> Column:
    """A value as text: strings as they are, null as nothing, true and false as Python writes them, all else as JSON."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(value.isNull() | (kind == "VOID"), "").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(F.coalesce(plain, F.to_json(value)))


def _clean(value: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(_text(value), r"\s+", " ")), 1, most)


def parsed(reply: Column) -> Column:
    """struct(error, summary, evidence_indices, uncertainty, suggested_checks). ``error`` is null if the reply is usable, and all else
    null if not. Fences go; the object is what lies between the first { and the last }. Of the indices whole numbers count, 6 at
    most; of the checks those that are not empty, 4 at most; texts are cut to their lengths."""
    most = v.EXPLANATION_LIMITS
    body = F.regexp_replace(reply, r"^\s+|\s+$", "")
    body = F.when(body.startswith("```"), F.regexp_replace(F.regexp_replace(body, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")).otherwise(body)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    value = F.try_parse_json(inner)
    field = lambda name, kind="variant": F.try_variant_get(value, f"$.{name}", kind)
    summary = _clean(field("summary"), most["summary"])
    listed = F.when(F.schema_of_variant(field("evidence_indices")).startswith("ARRAY"), field("evidence_indices", "array<variant>"))
    whole = F.filter(F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))), lambda x: x.isNotNull())
    checks = F.when(F.schema_of_variant(field("suggested_checks")).startswith("ARRAY"), field("suggested_checks", "array<variant>"))
    checks = F.filter(F.transform(F.coalesce(checks, F.array().cast("array<variant>")), lambda x: _clean(x, most["check"])), lambda x: x != "")
    error = F.when(F.coalesce(inner, F.lit("")) == "", NO_OBJECT).when(value.isNull(), NOT_JSON).when(~F.schema_of_variant(value).startswith("OBJECT"), NOT_OBJECT)
    error = error.when(summary == "", NO_SUMMARY).when(listed.isNull(), NO_LIST).when(F.size(whole) == 0, NO_INDICES)
    usable = lambda x: F.when(error.isNull(), x)
    return F.struct(
        error.alias("error"), usable(summary).alias("summary"), usable(F.slice(whole, 1, most["indices"])).alias("evidence_indices"),
        usable(F.nullif(_clean(field("uncertainty"), most["uncertainty"]), F.lit(""))).alias("uncertainty"), usable(F.slice(checks, 1, most["checks"])).alias("suggested_checks"),
    )
