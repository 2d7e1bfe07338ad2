"""JSON Schema as column expressions over VARIANT: each broken rule of a reply is a row with its path.

A schema is compiled once on the driver; a reply is parsed once and walked by built-in functions, arrays by lambdas. The
keywords are type, enum, const, properties, required, additionalProperties (false), items, minItems, maxItems, uniqueItems,
minLength, maxLength, pattern, minimum, maximum, anyOf, and $ref to ``#/$defs/..``; others are refused, not ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<path:string,problem:string>>"
KNOWN = {"type", "enum", "const", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength",
         "pattern", "minimum", "maximum", "anyOf", "$ref", "$defs", "$id", "$schema", "title", "description"}
#: How VARIANT names the types of JSON values.
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$",
         "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))"}
#: References that may be followed below one another.
DEPTH = 16


def _problem(path: Column, name: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(name).alias("problem")))


def _if(cond: Column, path: Column, name: str) -> Column:
    return F.when(cond, _problem(path, name)).otherwise(F.array().cast(PROBLEMS))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is evaluated once."""
    return F.flatten(F.transform(F.array(value), f))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(PROBLEMS)


def _member(value: Column, name: str) -> Column:
    if "'" in name or "\\" in name:  # a path cannot quote it
        return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(value, f"$['{name}']", "variant")


def resolved(schema: Mapping, defs: Mapping, depth: int = 0) -> tuple[Mapping, int]:
    """A schema without a reference at its top, and how many references were followed to it."""
    while "$ref" in schema:
        depth += 1
        if depth > DEPTH:
            raise ValueError("references are too deep")
        schema = defs[schema["$ref"].removeprefix("#/$defs/")]
    return schema, depth


def problems(value: Column, schema: Mapping, path: Column | None = None, defs: Mapping | None = None, depth: int = 0) -> Column:
    """The broken rules of a VARIANT value as structs of path and problem."""
    path = F.lit("$") if path is None else path
    defs = schema.get("$defs", {}) if defs is None else defs
    schema, depth = resolved(schema, defs, depth)
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"unknown keywords {sorted(unknown)}")
    return _bound(value, lambda v: _bound(F.schema_of_variant(v), lambda kind: _checked(v, kind, schema, path, defs, depth)))


def _checked(v: Column, kind: Column, schema: Mapping, path: Column, defs: Mapping, depth: int) -> Column:
    is_a = lambda name: kind.rlike(KINDS[name])
    parts = []
    if types := schema.get("type"):
        fits = F.lit(False)
        for name in [types] if isinstance(types, str) else types:
            fits |= is_a(name)
        parts.append(_if(~fits, path, "type"))
    if (allowed := schema.get("enum", [schema["const"]] if "const" in schema else None)) is not None:
        parts.append(_if(~F.to_json(v).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed]), path, "enum" if "enum" in schema else "const"))
    text = F.when(is_a("string"), F.try_variant_get(v, "$", "string"))
    for key, broken in (("pattern", lambda x: ~text.rlike(x)), ("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x)):
        if key in schema:
            parts.append(_if(F.coalesce(broken(schema[key]), F.lit(False)), path, key))
    number = F.when(is_a("number"), F.try_variant_get(v, "$", "double"))
    for key, broken in (("minimum", lambda x: number < float(x)), ("maximum", lambda x: number > float(x))):
        if key in schema:
            parts.append(_if(F.coalesce(broken(schema[key]), F.lit(False)), path, key))
    if {"items", "minItems", "maxItems", "uniqueItems"} & set(schema):
        parts.append(F.when(is_a("array"), _bound(F.try_variant_get(v, "$", "array<variant>"), lambda a: _listed(a, schema, path, defs, depth)))
                     .otherwise(F.array().cast(PROBLEMS)))
    if {"properties", "required", "additionalProperties"} & set(schema):
        parts.append(F.when(is_a("object"), _named(v, schema, path, defs, depth)).otherwise(F.array().cast(PROBLEMS)))
    if "anyOf" in schema:
        none_fits = F.lit(True)
        for choice in schema["anyOf"]:
            none_fits &= F.size(problems(v, choice, path, defs, depth)) > 0
        parts.append(_if(none_fits, path, "anyOf"))
    return _all(parts)


def _listed(a: Column, schema: Mapping, path: Column, defs: Mapping, depth: int) -> Column:
    parts = []
    if "minItems" in schema:
        parts.append(_if(F.size(a) < schema["minItems"], path, "minItems"))
    if "maxItems" in schema:
        parts.append(_if(F.size(a) > schema["maxItems"], path, "maxItems"))
    if schema.get("uniqueItems"):
        parts.append(_if(F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) < F.size(a), path, "uniqueItems"))
    if "items" in schema:
        parts.append(F.flatten(F.transform(a, lambda x, i: problems(x, schema["items"], F.concat(path, F.lit("["), i, F.lit("]")), defs, depth))))
    return _all(parts)


def _named(v: Column, schema: Mapping, path: Column, defs: Mapping, depth: int) -> Column:
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    parts = [_if(_member(v, name).isNull(), below(name), "required") for name in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        more = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), known))
        parts.append(F.transform(more, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("problem"))))
    for name, part in schema.get("properties", {}).items():
        held = _member(v, name)
        parts.append(F.when(held.isNotNull(), problems(held, part, below(name), defs, depth)).otherwise(F.array().cast(PROBLEMS)))
    return _all(parts)


def schema_problems(rows: DataFrame, key: str, text: str, schema: Mapping) -> DataFrame:
    """``(key, path, problem)`` of JSON texts against a schema; a text that is null or no JSON is ``unreadable``."""
    parsed = rows.select(key, F.try_parse_json(text).alias("_v"))
    found = F.when(F.col("_v").isNull(), _problem(F.lit("$"), "unreadable")).otherwise(problems(F.col("_v"), schema))
    return parsed.select(key, F.inline(found))
