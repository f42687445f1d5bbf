"""M01 unified_events: filtered, de-duplicated, entity-extracted events with device fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ModelConfig
from trailmark.functions import rules
from trailmark.functions.contracts import ATOMIC_FIELDS, TIMESTAMP_FIELDS, atomic_type, entity_columns
from trailmark.operators.entities import extract_entities, session_identifier
from trailmark.operators.ranking import dedupe_events

DERIVED_COLUMNS = (
    "session_identifier", "user_identifier", "view_id", "device_session_index", "referrer", "url",
    "screen_resolution", "os_type", "os_version", "device_identifier", "platform_name",
    "device_category",
)


PRE_DEDUPE_FIELDS = ("event_id", "app_id", "collector_tstamp", "dvce_created_tstamp", "domain_sessionid",
                     "domain_userid")


def conform_atomic(df: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add every atomic field missing from ``df`` (or from ``only``) as a typed NULL column."""
    missing = {}
    for name in (only or ATOMIC_FIELDS):
        if name not in df.columns:
            t = "timestamp_ntz" if name in TIMESTAMP_FIELDS else atomic_type(name)
            missing[name] = F.lit(None).cast(t)
    return df.withColumns(missing) if missing else df


def filter_app_id(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Keep the configured apps; an empty list keeps all (pushed into the scan)."""
    return df.filter(F.col("app_id").isin(*cfg.app_ids)) if cfg.app_ids else df


def add_device_fields(df: DataFrame) -> DataFrame:
    """View id, session index, OS/device coalesce chains, platform and device category."""
    c = F.col
    df = df.withColumns({
        "view_id": F.coalesce(c("page_view__id"), c("screen_view__id"), c("screen__id")).cast("string"),
        "device_session_index": F.coalesce(c("session__session_index").try_cast("int"),
                                           c("domain_sessionidx").try_cast("int")),
        "referrer": c("deep_link__referrer").cast("string"),
        "url": c("deep_link__url").cast("string"),
        "screen_resolution": c("mobile__resolution").cast("string"),
        "os_type": F.coalesce(c("mobile__os_type"), c("yauaa__operating_system_name"),
                              c("ua__os_family")).cast("string"),
        "os_version": F.coalesce(c("yauaa__operating_system_version"), c("mobile__os_version"),
                                 c("ua__os_version")).cast("string"),
        "device_identifier": F.coalesce(c("domain_userid"), c("session__user_id")).cast("string"),
        "platform_name": rules.platform_name(c("platform")),
    })
    return df.withColumn("device_category",
                         rules.device_category(c("platform"), c("yauaa__device_class"), c("platform_name")))


def bot_filter(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Drop user agents with bot words (and NULL ones) when enabled."""
    return df.filter(rules.is_not_bot(F.col("useragent"))) if cfg.ua_bot_filter else df


def output_columns(df: DataFrame) -> list[str]:
    base = list(ATOMIC_FIELDS) + entity_columns() + list(DERIVED_COLUMNS)
    return base + [c for c in df.columns if c not in set(base)]


def unified_events(atomic: DataFrame, cfg: ModelConfig) -> DataFrame:
    """M01.  Order matters: app filter before the de-duplication, bot filter after it.

    Only the columns the input really has cross the de-duplication shuffle;
    absent fields and entity columns (typed NULLs, row-wise derivations) are
    added after it, so they never widen the shuffled rows.
    """
    df = filter_app_id(conform_atomic(atomic, PRE_DEDUPE_FIELDS), cfg)
    df = df.withColumn("session_identifier", session_identifier(df, cfg))
    df = df.withColumn("user_identifier", F.col("domain_userid"))
    df = conform_atomic(dedupe_events(df))
    df = add_device_fields(extract_entities(df, cfg))
    df = bot_filter(df, cfg)
    return df.select(*output_columns(df))
