"""Validators. Each returns violations: check_id, entity_key, severity, message; they are unioned, never raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, check: str, key: Column | str, bad: Column, message: Column | str, severity: str = "error") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    message = F.lit(message) if isinstance(message, str) else message
    return df.where(bad).select(F.lit(check).alias("check_id"), key.cast("string").alias("entity_key"), F.lit(severity).alias("severity"), message.alias("message"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def in_domain(df: DataFrame, check: str, key: str, column: str, domain: list) -> DataFrame:
    c = F.col(column)
    return violations(df, check, key, c.isNull() | ~c.isin(*domain), F.concat(F.lit(f"{column}="), F.coalesce(c.cast("string"), F.lit("null"))))


def required(df: DataFrame, check: str, key: str, columns: list[str]) -> DataFrame:
    """One violation for each null column of a row, in one scan."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in columns]), lambda x: x.isNotNull())
    got = df.withColumn("_missing", F.explode(missing))
    return violations(got, check, key, F.lit(True), F.concat(F.lit("missing "), "_missing"))


def unique(df: DataFrame, check: str, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return violations(n, check, key, F.col("n") > 1, F.concat(F.lit("occurs "), F.col("n").cast("string")))


def refers(df: DataFrame, check: str, key: str, column: str, to: DataFrame, to_column: str) -> DataFrame:
    """Anti join: values that the other table lacks."""
    got = df.where(F.col(column).isNotNull()).join(to.select(F.col(to_column).alias(column)).distinct(), column, "left_anti")
    return violations(got, check, key, F.lit(True), F.concat(F.lit(f"unknown {column} "), F.col(column).cast("string")))


def agrees(df: DataFrame, check: str, key: str, own: str, want: str, message: Column) -> DataFrame:
    """Two columns must be equal where the first is given."""
    return violations(df, check, key, F.col(own).isNotNull() & ~F.col(own).eqNullSafe(F.col(want)), message)


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of distinct keys: key and side (left_only, right_only) of those without a partner."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    got = a.join(b, key, "full_outer").where("l is null or r is null")
    return got.select(key, F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"))


def json_violations(value: Column, kind: str, minimum: int | None = None, maximum: int | None = None, enum: list | None = None, pattern: str | None = None) -> Column:
    """Problem of one member of a JSON object (given as text or null), or null: type, enum, pattern and bounds."""
    checks = F.when(value.isNull(), "required")
    if kind == "integer":
        checks = checks.when(~value.rlike(r"^-?[0-9]+$"), "type")
        if minimum is not None:
            checks = checks.when(value.try_cast("long") < minimum, "minimum")
        if maximum is not None:
            checks = checks.when(value.try_cast("long") > maximum, "maximum")
    if enum is not None:
        checks = checks.when(~value.isin(*enum), "enum")
    if pattern is not None:
        checks = checks.when(~value.rlike(pattern), "pattern")
    return checks


_KINDS = {"integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def _checks(schema: dict, node: dict, path: str) -> list:
    """(message, predicate of a variant that is true where the node fails), children included."""
    while "$ref" in node:
        node = reduce(lambda at, part: at[part], node["$ref"].lstrip("#/").split("/"), schema)
    text = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    member = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    out = []
    if "type" in node:
        out.append((f"{path}: type", lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike(_KINDS[node["type"]])))
    if "enum" in node:
        out.append((f"{path}: enum", lambda v: ~text(v).isin(*map(str, node["enum"]))))
    if "const" in node:
        out.append((f"{path}: const", lambda v: text(v) != str(node["const"])))
    if "pattern" in node:
        out.append((f"{path}: pattern", lambda v: ~text(v).rlike(node["pattern"])))
    out += [(f"{path}: required {name}", lambda v, name=name: member(v, name).isNull()) for name in node.get("required", [])]
    for name, child in node.get("properties", {}).items():
        out += [(message, lambda v, name=name, bad=bad: member(v, name).isNotNull() & bad(member(v, name))) for message, bad in _checks(schema, child, f"{path}.{name}")]
    if "items" in node:
        items = lambda v: F.try_variant_get(v, "$", "array<variant>")
        out += [(message, lambda v, bad=bad: F.coalesce(F.exists(items(v), lambda x: bad(x)), F.lit(False))) for message, bad in _checks(schema, node["items"], f"{path}[]")]
    return out


def schema_violations(df: DataFrame, key: str, root: str, schema: dict) -> DataFrame:
    """A JSON Schema subset ($ref, type, enum, const, pattern, required, properties, items) over a JSON text column.

    The schema is resolved when the plan is built; each rule becomes one predicate over a variant path, those of items
    one over all items. An absent member breaks no rule but ``required``.
    """
    value = F.try_parse_json(F.col(root))
    failed = [F.when(value.isNull(), F.lit("$: no JSON"))] + [F.when(value.isNotNull() & bad(value), F.lit(message)) for message, bad in _checks(schema, schema, "$")]
    found = df.select(F.col(key).cast("string").alias("entity_key"), F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("message"))
    return found.select(F.lit("schema").alias("check_id"), "entity_key", F.lit("error").alias("severity"), "message")
