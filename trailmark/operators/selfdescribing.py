"""Validation of self-describing events and entities by schema key.

An event's own data and each element of its entity arrays name the schema that
they must satisfy.  ``entities`` lists them, one row each; ``violations`` checks
every row against the schema of its key.  The rows are stored once, partitioned
by schema key, and each key's compiled checks read only its own partition: the
data are read once in all, however many schemas there are, and a key that holds
most rows is still many files and tasks.

Schemas come from a catalog (key, body).  Only the bodies of keys that occur in
the data, and of those they refer to, are read on the driver, as a compiler
reads its sources.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.operators.validate import FAILURE_SCHEMA, validate_variant
from trailmark.session import checkpoint_dir

ARRAYS = ("contexts", "derived_contexts")
# FIXED VALUE: envelope of an entity array.
CONTEXTS_SCHEMA = "iglu:com.snowplowanalytics.snowplow/contexts/jsonschema/1-0-1"
ENTITY = "array<struct<place: string, position: int, schema: string, data: variant>>"
VIOLATION = ("place", "position", "schema", "path", "keyword")


# --- references ------------------------------------------------------------------

def pointer(document, fragment: str):
    """The part of a schema that a JSON pointer names."""
    for step in [s for s in fragment.split("/") if s]:
        step = step.replace("~1", "/").replace("~0", "~")
        try:
            document = document[int(step)] if isinstance(document, list) else document[step]
        except (KeyError, IndexError, ValueError):
            raise ValueError(f"$ref to a part that does not exist: #{fragment}") from None
    return document


def referred(schema) -> set[str]:
    """Keys of other schemas that a schema refers to."""
    if isinstance(schema, list):
        return set().union(*map(referred, schema))
    if not isinstance(schema, dict):
        return set()
    own = {schema["$ref"].split("#")[0]} - {""} if isinstance(schema.get("$ref"), str) else set()
    return own.union(*map(referred, schema.values()))


def resolve_refs(schema: dict, catalog: Mapping[str, dict]) -> dict:
    """The schema with every ``$ref`` replaced by what it names, in itself (``#/...``) or in the catalog (key, ``key#/...``).

    Keywords beside a ``$ref`` are ignored.  A schema that refers back to itself has no finite form and raises.
    """

    def walk(node, root, chain):
        if isinstance(node, list):
            return [walk(x, root, chain) for x in node]
        if not isinstance(node, dict):
            return node
        if not isinstance(node.get("$ref"), str):
            return {k: walk(v, root, chain) for k, v in node.items() if k != "definitions"}
        key, _, fragment = node["$ref"].partition("#")
        if key and key not in catalog:
            raise ValueError(f"$ref to a schema that is not in the catalog: {key}")
        home = catalog[key] if key else root
        at = (id(home), fragment)
        if at in chain:
            raise ValueError(f"schema refers back to itself: {node['$ref']}")
        return walk(pointer(home, fragment), home, (*chain, at))

    return walk(schema, schema, ((id(schema), ""),))


def bodies(catalog: DataFrame, keys: set[str]) -> dict[str, dict]:
    """Parsed schemas of ``keys`` and of all that they refer to."""
    out: dict[str, dict] = {}
    wanted = set(keys)
    while wanted:
        rows = catalog.filter(F.col("schema_key").isin(*sorted(wanted))).groupBy("schema_key").agg(
            F.max("body").alias("body")).collect()
        out.update({r["schema_key"]: json.loads(r["body"]) for r in rows})
        wanted = set().union(*(referred(out[r["schema_key"]]) for r in rows)) - set(out)
    return out


# --- entities --------------------------------------------------------------------

def entities(events: DataFrame, keys: Sequence[str], event_col: str | None = "unstruct_event",
             arrays: Sequence[str] = ARRAYS) -> DataFrame:
    """``keys``, place, position, schema, data: one row for an event's own data and each entity of its arrays.

    A column that is no JSON, or no envelope, gives one row without schema; a null column gives none.
    """
    found = []
    for col in [c for c in ([event_col] if event_col else []) if c in events.columns]:
        body = F.try_variant_get(F.try_parse_json(F.col(col)), "$.data", "variant")
        found.append(F.when(F.col(col).isNotNull(), F.array(_entity(col, F.lit(0), body))).otherwise(F.array().cast(ENTITY)))
    for col in [c for c in arrays if c in events.columns]:
        items = F.try_variant_get(F.try_parse_json(F.col(col)), "$.data", "array<variant>")
        listed = F.transform(items, lambda x, i: _entity(col, i, x))
        broken = F.array(_entity(col, F.lit(-1), F.lit(None).cast("variant")))
        found.append(F.when(F.col(col).isNull(), F.array().cast(ENTITY)).otherwise(F.coalesce(listed, broken)))
    return events.select(*keys, F.explode(F.concat(*found)).alias("__e")).select(*keys, "__e.*")


def _entity(place: str, position: Column, value: Column) -> Column:
    return F.struct(F.lit(place).alias("place"), position.cast("int").alias("position"),
                    F.try_variant_get(value, "$.schema", "string").alias("schema"),
                    F.try_variant_get(value, "$.data", "variant").alias("data"))


def violations(rows: DataFrame, catalog: DataFrame, keys: Sequence[str], exit_on_missing: bool = False) -> DataFrame:
    """``keys`` and ``VIOLATION``: what each row of ``entities`` breaks of its schema.

    keyword ``json``: no self-describing data there; ``schema``: the key is not in the catalog, which ends the job
    instead with ``exit_on_missing``.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/entities-{uuid.uuid4().hex}"
    missing = "__none"
    rows.withColumn("__key", F.coalesce("schema", F.lit(missing))).write.partitionBy("__key").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("__key", T.StringType())])
    stored = spark.read.schema(schema).parquet(path)
    held = {r["__key"] for r in stored.select("__key").distinct().collect()} - {missing}
    known = bodies(catalog, held) if held else {}

    def plain(keyword, condition):
        return stored.filter(condition).select(*keys, "place", "position", "schema", F.lit("$").alias("path"),
                                               F.lit(keyword).alias("keyword"))

    out = plain("json", F.col("__key") == missing)
    lost = sorted(held - set(known))
    if lost and exit_on_missing:
        raise ValueError(f"schemas that are not in the catalog: {', '.join(lost)}")
    if lost:
        out = out.unionByName(plain("schema", F.col("__key").isin(*lost)))
    for key in sorted(held & set(known)):
        checked = validate_variant(stored.filter(F.col("__key") == key), "data", resolve_refs(known[key], known), "__errors",
                                   absent="json")
        out = out.unionByName(checked.filter(F.size("__errors") > 0).select(
            *keys, "place", "position", "schema", F.explode("__errors").alias("__v")).select(
            *keys, "place", "position", "schema", "__v.path", "__v.keyword"))
    return out


def with_errors(events: DataFrame, found: DataFrame, keys: Sequence[str], out: str = "errors") -> DataFrame:
    """``events`` with all violations of each as an array (empty: valid), in order of place, position and path."""
    gathered = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*VIOLATION))).alias(out))
    kind = found.select(F.struct(*VIOLATION)).schema[0].dataType
    return events.join(gathered, list(keys), "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(T.ArrayType(kind))))


# --- failures --------------------------------------------------------------------

def add_failure(df: DataFrame, errors_col: str = "errors", contexts_col: str = "derived_contexts") -> DataFrame:
    """A failure entity as one more element of the events' own entity array, whatever schemas it holds.

    Elements are VARIANT values, so entities of different shapes stand in one array.  Events without errors keep
    their text as it is; a null or broken array counts as empty.
    """
    failure = F.to_variant_object(F.struct(
        F.lit(FAILURE_SCHEMA).alias("schema"),
        F.struct(F.lit("ValidationError").alias("failureType"), F.col(errors_col).alias("errors")).alias("data")))
    held = (F.try_variant_get(F.try_parse_json(F.col(contexts_col)), "$.data", "array<variant>")
            if contexts_col in df.columns else F.lit(None).cast("array<variant>"))
    whole = F.to_json(F.struct(F.lit(CONTEXTS_SCHEMA).alias("schema"), F.concat(
        F.coalesce(held, F.array().cast("array<variant>")), F.array(failure)).alias("data")))
    own = F.col(contexts_col) if contexts_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(contexts_col, F.when(F.size(errors_col) > 0, whole).otherwise(own))


def routed(df: DataFrame, errors_col: str = "errors", contexts_col: str = "derived_contexts") -> DataFrame:
    """V07 in one pass: ``output`` is good, or bad and incomplete (with the failure entity in place) for a failing event.

    One read of the input and no union: written with ``partitionBy("output")`` it fills all three sinks.
    """
    outputs = F.when(F.size(errors_col) > 0, F.array(F.lit("bad"), F.lit("incomplete"))).otherwise(F.array(F.lit("good")))
    own = F.col(contexts_col) if contexts_col in df.columns else F.lit(None).cast("string")
    both = add_failure(df.withColumn("__own", own), errors_col, contexts_col)
    return both.withColumn("output", F.explode(outputs)).withColumn(
        contexts_col, F.when(F.col("output") == "incomplete", F.col(contexts_col)).otherwise(F.col("__own"))).drop("__own")
