"""M05 unified_views: one row per page/screen view with engagement and scroll metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ModelConfig
from trailmark.functions import rules
from trailmark.functions.contracts import VIEWS_COLUMNS
from trailmark.functions.timeutil import seconds_between
from trailmark.operators.ranking import asc, rank_in_group, top1_per_group
from trailmark.plans.metrics import KEYS, pv_engaged_time, pv_scroll_depth, screen_summary_metrics


def not_robot(df: DataFrame) -> DataFrame:
    """Keep rows not flagged by the IAB enrichment (NULL counts as not a robot)."""
    return df.filter(~F.coalesce(F.col("iab__spider_or_robot"), F.lit(False)))


def dedupe_views(events: DataFrame) -> DataFrame:
    """page/screen views with a view id, one row per view_id (earliest; ties: least event_id)."""
    v = not_robot(events.filter(F.col("event_name").isin("page_view", "screen_view")
                                & F.col("view_id").isNotNull()))
    return top1_per_group(v, ["view_id"], [asc("derived_tstamp"), asc("dvce_created_tstamp"), asc("event_id")])


def view_aggs(events: DataFrame) -> DataFrame:
    """Distinct (view_id, session) pairs of non-robot events."""
    return not_robot(events).select(*KEYS).distinct()


def unified_views(events: DataFrame, cfg: ModelConfig, engaged: DataFrame | None = None,
                  scroll: DataFrame | None = None, with_model_tstamp: bool = True) -> DataFrame:
    c = F.col
    if engaged is None or scroll is None:
        ss = screen_summary_metrics(events)
        engaged = engaged if engaged is not None else pv_engaged_time(events, cfg, ss)
        scroll = scroll if scroll is not None else pv_scroll_depth(events, ss)
    prep = dedupe_views(events).withColumns({
        "start_tstamp": c("derived_tstamp"),
        "default_channel_group": rules.default_channel_group(c("mkt_source"), c("mkt_medium"), c("mkt_campaign")),
        "content_group": F.lit("other"),
        "br_colordepth": c("browser__color_depth").cast("string"),
        "stitched_user_id": c("user_identifier").cast("string"),
    })
    t = engaged.select(*KEYS, c("end_tstamp").alias("_t_end"), c("engaged_time_in_s").alias("_t_eng"),
                       c("absolute_time_in_s").alias("_t_abs"))
    sd = scroll.select(*KEYS, c("hmax").alias("horizontal_pixels_scrolled"),
                       c("vmax").alias("vertical_pixels_scrolled"),
                       c("relative_hmax").alias("horizontal_percentage_scrolled"),
                       c("relative_vmax").alias("vertical_percentage_scrolled"))
    # NULL keys never match; J03 (view_aggs) adds no column and is omitted.
    j = prep.join(t, list(KEYS), "left").join(sd, list(KEYS), "left")
    # The original orders by (derived, created, event_id); when a view has
    # both web and mobile metric rows the joined copies tie, so the metric
    # columns break the tie deterministically.
    order = [asc("derived_tstamp"), asc("dvce_created_tstamp"), asc("event_id"), asc("_t_eng"),
             asc("_t_abs"), asc("_t_end"), asc("horizontal_pixels_scrolled"),
             asc("vertical_pixels_scrolled"), asc("horizontal_percentage_scrolled"),
             asc("vertical_percentage_scrolled")]
    end = F.coalesce(c("_t_end"), c("derived_tstamp"))
    # W03 + W04: skew-safe rank (range-split by time, see rank_in_group) and session size.
    j = rank_in_group(j, "session_identifier", "derived_tstamp", order, "view_in_session_index",
                      count_out="views_in_session", then_col="dvce_created_tstamp")
    j = j.withColumns({
        "end_tstamp": end,
        "engaged_time_in_s": F.coalesce(c("_t_eng"), F.lit(0.0)),
        "absolute_time_in_s": F.coalesce(c("_t_abs"), seconds_between(c("derived_tstamp"), end).cast("double")),
        "model_tstamp": F.current_timestamp(),
    })
    cols = [x for x in VIEWS_COLUMNS if with_model_tstamp or x != "model_tstamp"]
    return j.select(*cols)
