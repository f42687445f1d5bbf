"""Enriched-event TSV parsing, stream tagging/routing and JSON rendering.

The same functions run on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.contracts import ATOMIC_FIELDS, BOOL_FIELDS, JSON_FIELDS, NUMBER_FIELDS

# FIXED VALUES: schema tags given to parsed records by origin stream.
STREAM_SCHEMAS = {
    "enriched-good": "iglu:io.snowplow/good/jsonschema/1-0-0",
    "enriched-incomplete": "iglu:io.snowplow/incomplete/jsonschema/1-0-0",
}
PARSED_STREAMS = ("enriched-good", "enriched-incomplete")
BAD_STREAM = "enriched-bad"


def parse_field(raw: Column, name: str) -> Column:
    """Typed value of one positional field: bad number / bool / JSON -> NULL; text kept ('' stays '')."""
    if name in NUMBER_FIELDS:
        return raw.try_cast("double")
    if name in BOOL_FIELDS:
        return raw.try_cast("boolean")
    if name in JSON_FIELDS:
        return F.when(F.try_parse_json(raw).isNotNull(), raw)
    return raw


def tsv_parts(value: Column) -> Column:
    return F.split(value, "\t", -1)


def tsv_fields(parts: Column) -> list[Column]:
    return [parse_field(F.get(parts, i), name).alias(name) for i, name in enumerate(ATOMIC_FIELDS)]


def read_enriched_tsv(lines: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One TSV line -> 131 typed columns; a short (ragged) line gives trailing NULLs."""
    split = lines.select(*keep, tsv_parts(F.col(value_col)).alias("__parts"))
    return split.select(*keep, *tsv_fields(F.col("__parts")))


def union_tagged_streams(streams: dict[str, DataFrame], value_col: str = "value") -> DataFrame:
    """Read several record streams as one, keeping the origin in ``stream``."""
    out = None
    for name, df in streams.items():
        d = df.select(F.col(value_col).alias("value"), F.lit(name).alias("stream"))
        out = d if out is None else out.unionByName(d)
    return out


def tag_schema(stream: Column) -> Column:
    """Origin stream -> schema URI (NULL for unknown streams)."""
    expr = None
    for k, v in STREAM_SCHEMAS.items():
        expr = F.when(stream == k, v) if expr is None else expr.when(stream == k, v)
    return expr


def event_to_json(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Typed fields squashed to one JSON document (NULL fields kept as null)."""
    cols = cols or list(ATOMIC_FIELDS)
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})


def route_by_stream(records: DataFrame) -> DataFrame:
    """good/incomplete lines are parsed and rendered as (schema, data); bad rows pass through.

    Bad rows already are ``{"schema": …, "data": …}`` documents; their two
    fields are lifted out unchanged.  One pass: each record takes its branch.
    """
    bad = F.col("stream") == BAD_STREAM
    split = records.filter(F.col("stream").isin(*PARSED_STREAMS, BAD_STREAM)).select(
        "stream", "value", F.when(~bad, tsv_parts(F.col("value"))).alias("__parts"))
    rendered = F.to_json(F.struct(*tsv_fields(F.col("__parts"))), {"ignoreNullFields": "false"})
    return split.select(
        "stream",
        F.when(bad, F.get_json_object("value", "$.schema")).otherwise(tag_schema(F.col("stream"))).alias("schema"),
        F.when(bad, F.get_json_object("value", "$.data")).otherwise(rendered).alias("data"),
        parse_field(F.get("__parts", ATOMIC_FIELDS.index("event_id")), "event_id").alias("event_id"))
