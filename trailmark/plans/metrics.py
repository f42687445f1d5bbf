"""Per-view screen-summary, engaged-time and scroll-depth metrics.

All three are plain ``groupBy(view_id, session_identifier)`` aggregations, so
Spark combines map-side before the shuffle; a hot view or session never
reaches a single task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ModelConfig
from trailmark.functions.timeutil import heartbeat_bucket

KEYS = ("view_id", "session_identifier")
MOBILE_END_EVENTS = ("screen_end", "application_background", "application_foreground")


def _pct(num: Column, den: Column) -> Column:
    """round(100 * num / den) as DOUBLE; NULL unless both set and den > 0."""
    return F.when(num.isNotNull() & den.isNotNull() & (den > 0),
                  F.round(F.lit(100.0) * num.cast("double") / den.cast("double")))


def screen_summary_metrics(events: DataFrame) -> DataFrame:
    """M02 / A02.  Text fields are cast to numbers *before* max/min (numeric, not lexicographic)."""
    c = lambda f: F.col(f"screen_summary__{f}")
    prep = (events
            .filter(F.col("view_id").isNotNull() & (F.col("platform") != "web")
                    & F.col("event_name").isin(*MOBILE_END_EVENTS))
            .groupBy(*KEYS)
            .agg(F.round(F.max(c("foreground_sec").try_cast("double")), 2).alias("foreground_sec"),
                 F.round(F.max(c("background_sec").try_cast("double")), 2).alias("background_sec"),
                 F.max(c("last_item_index").try_cast("int")).alias("last_item_index"),
                 F.max(c("items_count").try_cast("int")).alias("items_count"),
                 F.min(c("min_x_offset").try_cast("int")).alias("min_x_offset"),
                 F.min(c("min_y_offset").try_cast("int")).alias("min_y_offset"),
                 F.max(c("max_x_offset").try_cast("int")).alias("max_x_offset"),
                 F.max(c("max_y_offset").try_cast("int")).alias("max_y_offset"),
                 F.max(c("content_width").try_cast("int")).alias("content_width"),
                 F.max(c("content_height").try_cast("int")).alias("content_height")))
    return prep.select(
        "*",
        _pct(F.col("max_x_offset"), F.col("content_width")).alias("horizontal_percentage_scrolled"),
        _pct(F.col("max_y_offset"), F.col("content_height")).alias("vertical_percentage_scrolled"),
        _pct(F.col("last_item_index") + 1, F.col("items_count")).alias("list_items_percentage_scrolled"),
    )


def pv_engaged_time(events: DataFrame, cfg: ModelConfig, screen_summary: DataFrame | None = None) -> DataFrame:
    """Heartbeat buckets of page pings per view, plus mobile foreground time."""
    hb = cfg.heartbeat
    web = (events
           .filter((F.col("event_name") == "page_ping") & F.col("view_id").isNotNull())
           .groupBy(*KEYS)
           .agg(F.max("derived_tstamp").alias("end_tstamp"),
                (F.lit(hb) * (F.countDistinct(heartbeat_bucket(F.col("dvce_created_tstamp"), hb)) - 1)
                 + F.lit(cfg.min_visit_length)).cast("double").alias("engaged_time_in_s"))
           .withColumn("absolute_time_in_s", F.lit(None).cast("double")))
    ss = screen_summary if screen_summary is not None else screen_summary_metrics(events)
    mobile = ss.select(*KEYS, F.lit(None).cast(web.schema["end_tstamp"].dataType).alias("end_tstamp"),
                       F.col("foreground_sec").alias("engaged_time_in_s"),
                       (F.col("foreground_sec") + F.coalesce(F.col("background_sec"), F.lit(0.0)))
                       .alias("absolute_time_in_s"))
    return web.unionByName(mobile)


def pv_scroll_depth(events: DataFrame, screen_summary: DataFrame | None = None) -> DataFrame:
    """Clamped scroll offsets and their percentages, plus mobile rows."""
    c = F.col
    prep = (events
            .filter(c("event_name").isin("page_view", "page_ping") & c("view_id").isNotNull()
                    & (c("doc_height") > 0) & (c("doc_width") > 0))
            .groupBy(*KEYS)
            .agg(F.max("doc_width").alias("doc_width"), F.max("doc_height").alias("doc_height"),
                 F.max("br_viewwidth").alias("br_viewwidth"), F.max("br_viewheight").alias("br_viewheight"),
                 F.min(F.coalesce(c("pp_xoffset_min"), F.lit(0))).alias("_xmin"),
                 F.max(F.coalesce(c("pp_xoffset_max"), F.lit(0))).alias("_xmax"),
                 F.min(F.coalesce(c("pp_yoffset_min"), F.lit(0))).alias("_ymin"),
                 F.max(F.coalesce(c("pp_yoffset_max"), F.lit(0))).alias("_ymax")))

    def clamp(v, hi):
        return F.least(F.greatest(c(v), F.lit(0)), c(hi))

    def rel(v, extent):
        return F.round(F.lit(100) * (v / c(extent).cast("double")))

    web = prep.select(
        *KEYS, "doc_width", "doc_height", "br_viewwidth", "br_viewheight",
        clamp("_xmin", "doc_width").alias("hmin"), clamp("_xmax", "doc_width").alias("hmax"),
        clamp("_ymin", "doc_height").alias("vmin"), clamp("_ymax", "doc_height").alias("vmax"),
    ).select(
        "*",
        rel(F.greatest(c("hmin"), F.lit(0)), "doc_width").alias("relative_hmin"),
        rel(F.least(c("hmax") + c("br_viewwidth"), c("doc_width")), "doc_width").alias("relative_hmax"),
        rel(F.greatest(c("vmin"), F.lit(0)), "doc_height").alias("relative_vmin"),
        rel(F.least(c("vmax") + c("br_viewheight"), c("doc_height")), "doc_height").alias("relative_vmax"),
        F.lit(None).cast("int").alias("last_list_item_index"),
        F.lit(None).cast("int").alias("list_items_count"),
        F.lit(None).cast("double").alias("list_items_percentage_scrolled"),
    )
    ss = screen_summary if screen_summary is not None else screen_summary_metrics(events)
    dtypes = dict(web.dtypes)
    mobile = ss.select(
        *KEYS,
        c("content_width").cast(dtypes["doc_width"]).alias("doc_width"),
        c("content_height").cast(dtypes["doc_height"]).alias("doc_height"),
        F.lit(None).cast(dtypes["br_viewwidth"]).alias("br_viewwidth"),
        F.lit(None).cast(dtypes["br_viewheight"]).alias("br_viewheight"),
        c("min_x_offset").cast(dtypes["hmin"]).alias("hmin"), c("max_x_offset").cast(dtypes["hmax"]).alias("hmax"),
        c("min_y_offset").cast(dtypes["vmin"]).alias("vmin"), c("max_y_offset").cast(dtypes["vmax"]).alias("vmax"),
        F.lit(None).cast("double").alias("relative_hmin"),
        c("horizontal_percentage_scrolled").alias("relative_hmax"),
        F.lit(None).cast("double").alias("relative_vmin"),
        c("vertical_percentage_scrolled").alias("relative_vmax"),
        c("last_item_index").alias("last_list_item_index"),
        c("items_count").alias("list_items_count"),
        c("list_items_percentage_scrolled"),
    )
    return web.unionByName(mobile)
