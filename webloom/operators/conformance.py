"""JSON held against a JSON Schema of the tool: which properties it has, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds by the first word of a variant's type.
KINDS = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "DECIMAL": "number", "ARRAY": "array", "OBJECT": "object"}


def kind_of(value: Column) -> Column:
    """Kind of a variant, as JSON Schema names it."""
    words = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(words, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def check_schema(rows: DataFrame, schema: dict, column: str = "json") -> DataFrame:
    """A row for each property of each object, and for each that is missing, with its kind and fault beside the other columns.

    fault: unknown (the schema has no such property), kind (of another type), value (not among those allowed), missing
    (required, but not there: kind is null); null where nothing is wrong. What is no JSON object gives the missing ones only.
    """
    known, required = schema["properties"], set(schema.get("required", []))
    listed = lambda x: x if isinstance(x, list) else [x]
    kinds = {n: [k for k in listed(p["type"])] if "type" in p else ["string", *(["null"] if None in p["enum"] else [])] for n, p in known.items()}
    values = {n: [v for v in p["enum"] if v is not None] for n, p in known.items() if "enum" in p}
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    told = rows.withColumn("_missing", F.array_except(F.array(*map(F.lit, sorted(required))), names))
    told = told.withColumn("property", F.explode(F.concat(names, "_missing")))
    raw = F.to_json(F.element_at(F.from_json(column, "map<string,variant>"), F.col("property")))
    there = ~F.array_contains("_missing", F.col("property"))
    told = told.withColumn("kind", F.when(there, F.coalesce(kind_of(F.try_parse_json(raw)), F.lit("null"))))
    allowed = F.try_element_at(table(values), F.col("property")) if values else F.lit(None).cast("array<string>")
    text = F.regexp_extract(raw, '(?s)^"(.*)"$', 1)
    fault = (
        F.when(F.col("kind").isNull(), "missing")
        .when(~F.col("property").isin(*known), "unknown")
        .when(~F.array_contains(F.try_element_at(table(kinds), F.col("property")), F.col("kind")), "kind")
        .when(allowed.isNotNull() & (F.col("kind") == "string") & ~F.array_contains(allowed, text), "value")
    )
    return told.withColumn("fault", fault).drop("_missing")
