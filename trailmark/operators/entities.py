"""Entity (context) extraction: feature toggles, first-element field reads, v1/v2 coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.config import ModelConfig
from trailmark.functions.contracts import ENTITY_CATALOG, ENTITY_FIELD_TYPES, ENTITY_FLAGS

BROWSER_V2 = "contexts_com_snowplowanalytics_snowplow_browser_context_2"


def _struct_field(df: DataFrame, source: str, field: str) -> Column | None:
    """Field of the entity column: first array element for contexts, the struct for events.

    ``None`` when the column or the (case-sensitive) field does not exist.
    """
    if source not in df.columns:
        return None
    dtype = df.schema[source].dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        if field in dtype.elementType.fieldNames():
            return F.get(F.col(source), 0).getField(field)
    elif isinstance(dtype, T.StructType) and field in dtype.fieldNames():
        return F.col(source).getField(field)
    return None


def _typed(c: Column, name: str) -> Column:
    t = ENTITY_FIELD_TYPES.get(name, "string")
    return c.cast("string") if t == "string" else c.cast("string").try_cast(t)


def entity_exprs(df: DataFrame, cfg: ModelConfig) -> dict[str, Column]:
    """``prefix__field`` -> expression, for every catalog field.

    Flag off -> NULL.  Flag on: a column already named ``prefix__field`` is
    used as is (flattened input); otherwise the field is read from the entity
    column(s), coalescing browser v1 before v2; absent column -> NULL.
    """
    out = {}
    for prefix, (sources, fields) in ENTITY_CATALOG.items():
        on = cfg.enabled(ENTITY_FLAGS[prefix])
        for f in fields:
            name = f"{prefix}__{f}"
            if not on:
                value = F.lit(None)
            elif name in df.columns:
                value = F.col(name)
            else:
                parts = [_struct_field(df, s, f) for s in sources
                         if s != BROWSER_V2 or cfg.enabled("enable_browser_context_2")]
                parts = [p for p in parts if p is not None]
                value = F.coalesce(*parts) if len(parts) > 1 else (parts[0] if parts else F.lit(None))
            out[name] = _typed(value, name)
    return out


def extract_entities(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    return df.withColumns(entity_exprs(df, cfg))


def session_identifier(df: DataFrame, cfg: ModelConfig) -> Column:
    """Client-session field (if enabled and present) else domain_sessionid."""
    src = ENTITY_CATALOG["session"][0][0]
    sid = _struct_field(df, src, cfg.session_field) if cfg.enabled("enable_client_session_context") else None
    return F.coalesce(sid.cast("string"), F.col("domain_sessionid")) if sid is not None else F.col("domain_sessionid")
