"""M06 unified_sessions: one row per session.

The events are read twice:

* once for the numbers: one aggregate per (session, view, heartbeat bucket,
  event name) with map-side combine, written once; counts, start/end, conversions,
  engaged time and the event histogram are sums over that table, level by level,
  so no distinct count needs an ``Expand`` and a session that holds a third of
  all events is spread over its views and buckets first;
* once for the first and the last row: one aggregate of least and greatest rows
  per session, which a map task reduces to one row each before the exchange.

The two meet in one join on the session.  The single steps (``session_firsts``,
``session_aggs`` ...) are kept as operators of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ModelConfig
from trailmark.functions import rules
from trailmark.functions.contracts import SESSIONS_COLUMNS
from trailmark.functions.timeutil import heartbeat_bucket, minus_seconds, seconds_between
from trailmark.operators.joins import dim_lookup
from trailmark.operators.ranking import asc, desc, top1_per_group
from trailmark.plans.views import not_robot

SID = "session_identifier"


def session_firsts(events: DataFrame) -> DataFrame:
    """First page ping / page view / screen view of each session (event_id breaks ties)."""
    f = not_robot(events.filter(F.col("event_name").isin("page_ping", "page_view", "screen_view")
                                & F.col("view_id").isNotNull()))
    return top1_per_group(f, [SID], [asc("derived_tstamp"), asc("event_id")])


def session_lasts(events: DataFrame) -> DataFrame:
    """Last page view / screen view of each session."""
    lv = not_robot(events.filter(F.col("event_name").isin("page_view", "screen_view")
                                 & F.col("view_id").isNotNull()))
    return top1_per_group(lv, [SID], [desc("derived_tstamp"), desc("event_id")])


def session_aggs(events: DataFrame) -> DataFrame:
    """A04 + A07: counts, start/end, absolute time and the page-view conversion."""
    c = F.col
    pv = c("event_name") == "page_view"
    return (not_robot(events).groupBy(SID).agg(
        F.min("derived_tstamp").alias("start_tstamp"),
        F.max("derived_tstamp").alias("end_tstamp"),
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("view_id").alias("views"),
        F.count(F.when(pv, F.lit(1))).alias("cv_view_page_volume"),
        F.sum(F.when(pv, F.coalesce(c("tr_total_base").cast("double"), F.lit(0.5))).otherwise(F.lit(0.0)))
        .alias("cv_view_page_total"),
        F.min(F.when(pv, c("derived_tstamp"))).alias("cv_view_page_first_conversion"),
        F.max(F.when(pv, F.lit(1)).otherwise(F.lit(0))).cast("boolean").alias("cv_view_page_converted"),
    ).withColumn("absolute_time_in_s", seconds_between(c("start_tstamp"), c("end_tstamp"))))


def session_engaged_time(events: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Engaged seconds of every session, 0 for those without pings."""
    every = not_robot(events).filter(F.col(SID).isNotNull()).select(SID).distinct()
    return every.join(pinged_time(events, cfg), SID, "left").select(
        SID, F.coalesce("engaged_time_in_s", F.lit(0).cast("bigint")).alias("engaged_time_in_s"))


def pinged_time(events: DataFrame, cfg: ModelConfig) -> DataFrame:
    """hb * (distinct (view, bucket) - pinged views) + pinged views * min_visit_length, of sessions with pings."""
    pings = not_robot(events.filter((F.col("event_name") == "page_ping") & F.col("view_id").isNotNull()))
    per_view = (pings.groupBy(SID, "view_id")
                .agg(F.countDistinct(heartbeat_bucket(F.col("dvce_created_tstamp"), cfg.heartbeat)).alias("nb")))
    per_session = per_view.groupBy(SID).agg(F.sum("nb").alias("d"), F.count(F.lit(1)).alias("v"))
    return per_session.select(
        SID, (F.lit(cfg.heartbeat) * (F.col("d") - F.col("v")) + F.col("v") * F.lit(cfg.min_visit_length))
        .cast("bigint").alias("engaged_time_in_s"))


def event_counts(events: DataFrame) -> DataFrame:
    """Histogram of event names as a key-sorted map and its JSON text."""
    per_event = (not_robot(events).filter(F.col("event_name").isNotNull())
                 .groupBy(SID, "event_name").agg(F.count(F.lit(1)).alias("n")))
    return (per_event.groupBy(SID)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_name", "n"))))
                 .alias("event_counts"))
            .withColumn("event_counts_string", F.to_json("event_counts")))


# --- the whole in two passes ------------------------------------------------------

#: columns of a session's first and last row that its output is made of, beside those of the same name
FIRST_FIELDS = ("event_name", "user_identifier", "geo_country", "geo_region_name", "geo_city", "page_url", "page_urlquery",
                "br_lang", "mobile__language")
LAST_FIELDS = ("event_name", "geo_country", "geo_city", "geo_region_name", "page_url", "br_lang",
               "screen_view__name", "screen_view__transition_type", "screen_view__type")
GEO_FIELDS = ("latitude", "longitude", "latitude_longitude_accuracy", "altitude", "altitude_accuracy", "bearing", "speed")


def session_parts(events: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Counts and times per (session, view, heartbeat bucket, event name); the bucket is that of a view's pings."""
    c = F.col
    ping = (c("event_name") == "page_ping") & c("view_id").isNotNull()
    amount = F.coalesce(c("tr_total_base").cast("double"), F.lit(0.5))
    return (not_robot(events)
            .withColumn("bucket", F.when(ping, heartbeat_bucket(c("dvce_created_tstamp"), cfg.heartbeat)))
            .groupBy(SID, "view_id", "bucket", "event_name").agg(
                F.count(F.lit(1)).alias("n"), F.min("derived_tstamp").alias("first_at"), F.max("derived_tstamp").alias("last_at"),
                F.sum(F.when(c("event_name") == "page_view", amount)).alias("amount")))


def session_numbers(parts: DataFrame, cfg: ModelConfig) -> DataFrame:
    """One row per session: what ``session_aggs``, ``pinged_time`` and ``event_counts`` give, from ``session_parts``."""
    c = F.col
    pv = c("event_name") == "page_view"
    ping = (c("event_name") == "page_ping") & c("view_id").isNotNull()
    per_view = parts.groupBy(SID, "view_id").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"),
        F.sum(F.when(pv, c("n"))).alias("pv"), F.sum("amount").alias("amount"),
        F.min(F.when(pv, c("first_at"))).alias("pv_at"), F.count("bucket").alias("buckets"),
        F.max(ping).alias("pinged"))
    per_session = per_view.groupBy(SID).agg(
        F.min("first_at").alias("a_start"), F.max("last_at").alias("a_end"), F.sum("n").alias("total_events"),
        F.count("view_id").alias("views"), F.coalesce(F.sum("pv"), F.lit(0).cast("long")).alias("cv_view_page_volume"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("cv_view_page_total"),
        F.min("pv_at").alias("cv_view_page_first_conversion"),
        (F.coalesce(F.sum("pv"), F.lit(0)) > 0).alias("cv_view_page_converted"),
        F.sum("buckets").alias("buckets"), F.count(F.when(c("pinged"), 1)).alias("pinged"))
    engaged = F.lit(cfg.heartbeat) * (c("buckets") - c("pinged")) + c("pinged") * F.lit(cfg.min_visit_length)
    per_event = parts.filter(c("event_name").isNotNull()).groupBy(SID, "event_name").agg(F.sum("n").alias("n"))
    counts = per_event.groupBy(SID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_name", "n"))))
                                        .alias("event_counts"))
    return (per_session.withColumn("engaged_time_in_s", F.when(c("pinged") > 0, engaged).cast("bigint"))
            .withColumn("a_abs", seconds_between(c("a_start"), c("a_end"))).drop("buckets", "pinged")
            .join(counts, SID, "left").withColumn("event_counts_string", F.to_json("event_counts")))


def first_and_last(events: DataFrame, first_cols: list[str], last_cols: list[str]) -> DataFrame:
    """``first`` and ``last`` row of each session, as ``session_firsts`` and ``session_lasts`` pick them, in one pass.

    A session without a page or screen view has no ``last``.
    """
    c = F.col
    seen = not_robot(events.filter(c("event_name").isin("page_ping", "page_view", "screen_view") & c("view_id").isNotNull()))

    def missing(flag):  # times and ids that lack come last in either direction
        return [x for k in ("derived_tstamp", "event_id") for x in ((c(k).isNull() if flag else c(k).isNotNull()).alias(f"_{k}"), c(k))]

    viewed = c("event_name") != "page_ping"
    return seen.groupBy(SID).agg(
        F.min_by(F.struct(*first_cols), F.struct(*missing(True))).alias("first"),
        F.max_by(F.struct(*last_cols), F.when(viewed, F.struct(*missing(False)))).alias("last"))


def _last_or_first(witness: str, last: str, first: str) -> Column:
    """The last value, or the first when the whole last row is missing (witness NULL)."""
    return F.when(F.col(witness).isNull(), F.coalesce(F.col(last), F.col(first))).otherwise(F.col(last))


def with_language_names(f: DataFrame, dims: dict[str, DataFrame], prefix: str, source: str = "") -> DataFrame:
    """Country name/continent and browser-language name by case-insensitive key; ``source``: prefix of the keys."""
    f = dim_lookup(f, dims["language"], f"{source}br_lang", "lang_tag", {"name": f"{prefix}br_lang_name"},
                   order="name", prefix="__lang")
    return dim_lookup(f, dims["country"], f"{source}geo_country", "alpha_2",
                      {"name": f"{prefix}geo_country_name", "region": f"{prefix}geo_continent"},
                      order="name", prefix="__ctry")


def with_mobile_language(f: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """ISO 639-1 code, then 639-2T code, then de-duplicated 639-3 code, then the raw value."""
    f = dim_lookup(f, dims["iso_639_2t"], "mobile__language", "iso_639_1_code", {"name": "__ml1"},
                   order="name", prefix="__ml1k")
    f = dim_lookup(f, dims["iso_639_2t"], "mobile__language", "iso_639_2t_code", {"name": "__ml2"},
                   order="name", prefix="__ml2k")
    f = dim_lookup(f, dims["iso_639_3"], "mobile__language", "iso_639_3_code", {"name": "__ml3"},
                   order="name", prefix="__ml3k")
    return (f.withColumn("mobile_language_name",
                         F.coalesce("__ml1", "__ml2", "__ml3", "mobile__language"))
            .drop("__ml1", "__ml2", "__ml3"))


LAST_PAGE_FIELDS = ("title", "urlscheme", "urlhost", "urlpath", "urlquery", "urlfragment")


def unified_sessions(events: DataFrame, cfg: ModelConfig, dims: dict[str, DataFrame],
                     with_model_tstamp: bool = True) -> DataFrame:
    from trailmark.session import materialize

    c = F.col
    last_cols = [*LAST_FIELDS, *(f"page_{x}" for x in LAST_PAGE_FIELDS)]
    wanted = {*SESSIONS_COLUMNS, *FIRST_FIELDS, *last_cols, *(f"geo__{x}" for x in GEO_FIELDS)}
    first_cols = [x for x in events.columns if x in wanted and x != SID]
    rows = first_and_last(events, first_cols, last_cols)
    f = rows.select(SID, "first.*", *[c(f"last.{x}").alias(f"l_{x}") for x in last_cols])
    f = with_mobile_language(with_language_names(f, dims, ""), dims)
    f = with_language_names(f, dims, "l_", "l_")
    numbers = session_numbers(materialize(session_parts(events, cfg), "session_parts"), cfg)
    j = f.join(numbers, SID, "left")
    starts_with_ping = c("event_name") == "page_ping"
    out = {
        "first_event_name": c("event_name"),
        "last_event_name": c("l_event_name"),
        "stitched_user_id": c("user_identifier").cast("string"),
        "start_tstamp": F.when(starts_with_ping, minus_seconds(c("a_start"), cfg.min_visit_length))
        .otherwise(c("a_start")),
        "end_tstamp": c("a_end"),
        "model_tstamp": F.current_timestamp(),
        "first_geo_country": c("geo_country"),
        "first_geo_region_name": c("geo_region_name"),
        "first_geo_city": c("geo_city"),
        "first_geo_country_name": c("geo_country_name"),
        "first_geo_continent": c("geo_continent"),
        "engaged_time_in_s": F.coalesce(c("engaged_time_in_s"), F.when(c("a_start").isNotNull(), F.lit(0))
                                        ).cast("bigint"),
        "absolute_time_in_s": c("a_abs") + F.when(starts_with_ping, F.lit(cfg.min_visit_length)).otherwise(F.lit(0)),
        "default_channel_group": F.lit(None).cast("string"),
        "mkt_source_platform": rules.mkt_source_platform(c("page_urlquery")),
        "first_page_url": c("page_url"),
        "last_page_url": _last_or_first("l_page_url", "l_page_url", "page_url"),
        "first_br_lang": c("br_lang"),
        "first_br_lang_name": c("br_lang_name"),
        "last_br_lang": _last_or_first("l_br_lang", "l_br_lang", "br_lang"),
        "last_br_lang_name": _last_or_first("l_br_lang", "l_br_lang_name", "br_lang_name"),
        "first_screen_view__name": c("screen_view__name"),
        "first_screen_view__type": c("screen_view__type"),
    }
    for x in ("geo_country", "geo_region_name", "geo_city", "geo_country_name", "geo_continent"):
        out[f"last_{x}"] = _last_or_first("l_geo_country", f"l_{x}", x)
    for x in LAST_PAGE_FIELDS:
        out[f"first_page_{x}"] = c(f"page_{x}")
        out[f"last_page_{x}"] = _last_or_first("l_page_url", f"l_page_{x}", f"page_{x}")
    for x in ("name", "transition_type", "type"):
        out[f"last_screen_view__{x}"] = _last_or_first(f"l_screen_view__{x}", f"l_screen_view__{x}",
                                                       f"screen_view__{x}")
    for x in GEO_FIELDS:
        out[f"first_geo__{x}"] = c(f"geo__{x}")
    # the first-event columns are replaced by their session meaning
    j = j.withColumns(out)
    j = j.withColumn("is_engaged", F.coalesce(
        F.when((c("views") >= 2) | (c("engaged_time_in_s") / 10 >= 2) | c("cv_view_page_converted"), F.lit(True)),
        F.lit(False)))
    cols = [x for x in SESSIONS_COLUMNS if with_model_tstamp or x != "model_tstamp"]
    return j.select(*cols)
