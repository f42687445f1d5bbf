"""Registered sub-operators of the model (P, A, W, J, O families) and their oracles.

Each query runs the library operator over the whole fixture and projects the
columns that operator is responsible for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ModelConfig, fixture_config
from trailmark.functions import rules
from trailmark.functions.contracts import ENTITY_CATALOG, ENTITY_FIELD_TYPES, ENTITY_FLAGS, entity_columns
from trailmark.operators.entities import extract_entities, session_identifier
from trailmark.operators.ranking import asc, dedupe_dimension, dedupe_events, desc, top1_per_group
from trailmark.plans.events import bot_filter, filter_app_id
from trailmark.plans.sessions import (event_counts, session_aggs, session_engaged_time, session_firsts,
                                      session_lasts)
from trailmark.plans.views import dedupe_views, not_robot, unified_views, view_aggs
from trailmark.registry import oracle_models as om
from trailmark.registry.models import CFG, events, model, model_input, sessions, users_parts
from trailmark.registry.oracle_base import base_ctes, full_match, with_ctes
from trailmark.sources.tables import atomic, read_table

BASE = base_ctes()
METRICS = om.metric_ctes()
VIEWS = BASE + METRICS + om.views_ctes()
SESS = BASE + om.sessions_ctes() + [om.sessions_select_cte()]
USERS = SESS + om.users_ctes()


def _views(s, sf):
    return model(s, sf).views


def _mev(s, sf):
    """Materialised unified_events of a fresh model build."""
    return model(s, sf).events


def _eid_num(col="event_id"):
    return F.substring(F.col(col), 2, 20).cast("bigint")


# --- P: projections, filters, derivations -------------------------------------

def q_filter_app_id(s, sf):
    return filter_app_id(atomic(s, sf), CFG).select("event_id", "app_id")


def q_entity_toggles(s, sf):
    cfg = ModelConfig(flags={"enable_iab": False, "enable_yauaa": True, "enable_mobile_context": True,
                             "enable_web_page": False})
    ex = extract_entities(atomic(s, sf), cfg)
    return ex.select("event_id", "iab__spider_or_robot", "yauaa__device_class", "mobile__os_type",
                     "page_view__id", "ua__os_family")


def _wrapped_entities(s, sf) -> DataFrame:
    """The fixture with its flat entity fields moved into context arrays / an event struct."""
    a = atomic(s, sf)
    n = _eid_num()
    return a.select(
        "event_id",
        F.when(F.col("page_view__id").isNull(), F.array().cast("array<struct<id:string>>"))
         .otherwise(F.array(F.struct(F.col("page_view__id").alias("id"))))
         .alias("contexts_com_snowplowanalytics_snowplow_web_page_1"),
        F.array(F.struct(F.col("yauaa__device_class").alias("deviceClassX"),
                         F.col("yauaa__device_class").alias("device_class")))
         .alias("contexts_nl_basjes_yauaa_context_1"),
        F.when(n % 2 == 0, F.array(F.struct(F.col("br_lang").alias("viewport"), F.lit(24).alias("color_depth"))))
         .otherwise(F.array().cast("array<struct<viewport:string,color_depth:int>>"))
         .alias("contexts_com_snowplowanalytics_snowplow_browser_context_1"),
        F.array(F.struct(F.col("geo_country").alias("viewport"), F.lit(32).alias("color_depth")))
         .alias("contexts_com_snowplowanalytics_snowplow_browser_context_2"),
        F.struct(F.col("mobile__os_type").alias("name"), F.col("platform").alias("type"))
         .alias("unstruct_event_com_snowplowanalytics_mobile_screen_view_1"),
        F.when(n % 3 == 0, F.array(F.struct(F.concat(F.lit("cs-"), F.col("event_id")).alias("sessionId"))))
         .otherwise(F.array().cast("array<struct<sessionId:string>>"))
         .alias("contexts_com_snowplowanalytics_snowplow_client_session_1"),
        "domain_sessionid",
    )


def q_extract_entities(s, sf):
    ex = extract_entities(_wrapped_entities(s, sf), fixture_config())
    return ex.select("event_id", "page_view__id", "yauaa__device_class", "yauaa__agent_class",
                     "screen_view__name", "screen_view__type", "screen_view__id")


#: every entity switched on, the second browser schema too
ALL_ON = ModelConfig(flags={f: True for f in (*ENTITY_FLAGS.values(), "enable_browser_context_2")})


def _entity_value(prefix: str, field: str):
    """Text of an entity field by a fixed rule; numbers and booleans where the catalog has such."""
    name, n = f"{prefix}__{field}", _eid_num()
    if ENTITY_FIELD_TYPES.get(name) == "boolean":
        return F.when(n % 3 == 0, "true").when(n % 3 == 1, "false").otherwise("maybe")
    if ENTITY_FIELD_TYPES.get(name) == "int":
        return F.when(n % 4 == 0, "deep").otherwise((n % 32).cast("string"))
    return F.when(n % 7 != 0, F.concat(F.lit(f"{name}."), n.cast("string")))


def _full_entities(s, sf) -> DataFrame:
    """Every source column of the catalog with every field: arrays of two elements, or a struct; some arrays are
    empty or missing, and the browser's first schema is there for odd events only."""
    n = _eid_num()
    cols = []
    for k, (prefix, (sources, fields)) in enumerate(ENTITY_CATALOG.items()):
        for v, source in enumerate(sources):
            whole = F.struct(*[_entity_value(prefix, f).alias(f) for f in fields])
            if source.startswith("contexts_"):
                other = F.struct(*[F.lit("second").alias(f) for f in fields])
                whole = F.when(n % 11 == k % 11, F.array().cast(whole_type(fields))).otherwise(F.array(whole, other))
            if len(sources) > 1 and v == 0:
                whole = F.when(n % 2 == 1, whole)
            cols.append(whole.alias(source))
    return atomic(s, sf).select("event_id", *cols)


def whole_type(fields) -> str:
    return "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"


def q_extract_entities_all(s, sf):
    return extract_entities(_full_entities(s, sf), ALL_ON).select("event_id", *entity_columns())


def _entities_all_sql() -> str:
    out = []
    for k, (prefix, (sources, fields)) in enumerate(ENTITY_CATALOG.items()):
        there = f"{_N} % 11 <> {k % 11}" if sources[0].startswith("contexts_") else "true"
        for f in fields:
            name = f"{prefix}__{f}"
            kind = ENTITY_FIELD_TYPES.get(name)
            value = (f"CASE {_N} % 3 WHEN 0 THEN true WHEN 1 THEN false END" if kind == "boolean" else
                     f"CAST(CASE WHEN {_N} % 4 <> 0 THEN {_N} % 32 END AS INTEGER)" if kind == "int" else
                     f"CASE WHEN {_N} % 7 <> 0 THEN '{name}.' || {_N} END")
            out.append(f"CASE WHEN {there} THEN {value} END AS {name}")
    return "SELECT event_id, " + ", ".join(out) + " FROM atomic"


def q_coalesce_entity_versions(s, sf):
    cfg = fixture_config()
    ex = extract_entities(_wrapped_entities(s, sf), cfg)
    return ex.select("event_id", "browser__viewport", "browser__color_depth")


def q_session_identifier(s, sf):
    w = _wrapped_entities(s, sf)
    return w.select("event_id", session_identifier(w, fixture_config()).alias("session_identifier"))


def _ev_cols(*cols):
    return lambda s, sf: events(s, sf).selectExpr("event_id", *cols)


def q_ua_bot_filter(s, sf):
    return bot_filter(atomic(s, sf), CFG).select("event_id", "useragent")


def q_iab_robot_filter(s, sf):
    return not_robot(events(s, sf)).select("event_id", "iab__spider_or_robot")


def q_default_channel_group(s, sf):
    e = events(s, sf)
    return e.select("event_id", "mkt_source", "mkt_medium", "mkt_campaign",
                    rules.default_channel_group(F.col("mkt_source"), F.col("mkt_medium"), F.col("mkt_campaign"))
                    .alias("default_channel_group"))


def q_mkt_source_platform(s, sf):
    return atomic(s, sf).select("event_id", "page_urlquery",
                                rules.mkt_source_platform(F.col("page_urlquery")).alias("mkt_source_platform"))


def _sess_cols(*cols):
    return lambda s, sf: sessions(s, sf).select("session_identifier", *cols)


def q_json_path_extract(s, sf):
    ev = read_table(s, sf, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def q_regex_field_filter(s, sf):
    from trailmark.operators.routing import regex_field_filter
    return regex_field_filter(atomic(s, sf), "app_id", "^demo-app$").select("event_id", "app_id")


def q_view_time_fallback(s, sf):
    return _views(s, sf).select("view_id", "session_identifier", "end_tstamp", "engaged_time_in_s",
                                "absolute_time_in_s")


# --- J: joins -------------------------------------------------------------------

def q_views_left_viewaggs(s, sf):
    v = _views(s, sf).select("view_id", "session_identifier")
    a = view_aggs(_mev(s, sf)).withColumn("has_aggs", F.lit(True))
    return v.join(a, ["view_id", "session_identifier"], "left").select(
        "view_id", "session_identifier", F.coalesce("has_aggs", F.lit(False)).alias("has_aggs"))


# --- W / O: windows and top-k ---------------------------------------------------

def q_dedupe_events(s, sf):
    return dedupe_events(atomic(s, sf)).select("event_id", "collector_tstamp")


def q_dedupe_dimension(s, sf):
    return dedupe_dimension(read_table(s, sf, "nation").withColumnRenamed("n_name", "name"),
                            "n_regionkey").select("n_regionkey", "name")


def q_top1_per_group(s, sf):
    ev = read_table(s, sf, "events")
    return top1_per_group(ev, ["user_id"], [desc("value"), asc("event_id")]).select("user_id", "event_id", "value")


def q_limit_lookup(s, sf):
    c = read_table(s, sf, "customer")
    return top1_per_group(c, ["c_nationkey"], [desc("c_acctbal"), asc("c_custkey")]) \
        .select("c_nationkey", "c_custkey", "c_acctbal")


def q_count_by_app(s, sf):
    """All raw events, no app filter, so that several applications are counted and sorted."""
    return atomic(s, sf).groupBy("app_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("app_id"))


def q_count_events(s, sf):
    return atomic(s, sf).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "filter_app_id": q_filter_app_id,
    "entity_toggles": q_entity_toggles,
    "extract_entities": q_extract_entities,
    "extract_entities_all": q_extract_entities_all,
    "coalesce_entity_versions": q_coalesce_entity_versions,
    "session_identifier": q_session_identifier,
    "user_identifier": _ev_cols("user_identifier", "CAST(user_identifier AS STRING) AS stitched_user_id"),
    "stitched_user_id": _ev_cols("CAST(user_identifier AS STRING) AS stitched_user_id"),
    "select_view": lambda s, sf: _views(s, sf),
    "view_id": _ev_cols("view_id"),
    "device_session_index": _ev_cols("device_session_index"),
    "device_attrs": _ev_cols("os_type", "os_version", "device_identifier", "referrer", "url", "screen_resolution"),
    "platform_name": _ev_cols("platform", "platform_name"),
    "device_category": _ev_cols("platform", "yauaa__device_class", "device_category"),
    "ua_bot_filter": q_ua_bot_filter,
    "iab_robot_filter": q_iab_robot_filter,
    "default_channel_group": q_default_channel_group,
    "mkt_source_platform": q_mkt_source_platform,
    "last_or_first": _sess_cols("last_page_url", "last_page_title", "last_geo_country", "last_geo_country_name",
                                "last_br_lang", "last_br_lang_name", "last_screen_view__name"),
    "is_engaged": _sess_cols("views", "engaged_time_in_s", "is_engaged"),
    "session_start_adjust": _sess_cols("first_event_name", "start_tstamp", "absolute_time_in_s"),
    "constant_columns": lambda s, sf: _views(s, sf).select("view_id", "content_group").unionByName(
        sessions(s, sf).select(F.col("session_identifier").alias("view_id"),
                               F.col("default_channel_group").alias("content_group"))),
    "json_path_extract": q_json_path_extract,
    "regex_field_filter": q_regex_field_filter,
    "view_time_fallback": q_view_time_fallback,
    "views_left_engagement": lambda s, sf: _views(s, sf).select(
        "view_id", "session_identifier", "end_tstamp", "engaged_time_in_s", "absolute_time_in_s"),
    "views_left_scroll": lambda s, sf: _views(s, sf).select(
        "view_id", "session_identifier", "horizontal_pixels_scrolled", "vertical_pixels_scrolled",
        "horizontal_percentage_scrolled", "vertical_percentage_scrolled"),
    "views_left_viewaggs": q_views_left_viewaggs,
    "sessions_left_language": _sess_cols("first_br_lang", "first_br_lang_name", "last_br_lang", "last_br_lang_name"),
    "sessions_left_country": _sess_cols("first_geo_country", "first_geo_country_name", "first_geo_continent",
                                        "last_geo_country", "last_geo_country_name", "last_geo_continent"),
    "sessions_assemble": _sess_cols("first_event_name", "last_event_name", "total_events", "views",
                                    "engaged_time_in_s", "event_counts_string"),
    "mobile_language_name": _sess_cols("mobile__language", "mobile_language_name"),
    "users_first_session": lambda s, sf: users_parts(s, sf)[1].select(
        "user_identifier", "first_session_identifier", "start_tstamp"),
    "users_last_session": lambda s, sf: users_parts(s, sf)[2].select(
        "user_identifier", "last_platform", "last_page_url", "last_event_id"),
    "pv_engaged_time": lambda s, sf: model(s, sf).pv_engaged_time,
    "screen_summary_metrics": lambda s, sf: model(s, sf).screen_summary_metrics,
    "pv_scroll_depth": lambda s, sf: model(s, sf).pv_scroll_depth,
    "session_aggs": lambda s, sf: session_aggs(_mev(s, sf)).select(
        "session_identifier", "start_tstamp", "end_tstamp", "total_events", "views", "absolute_time_in_s"),
    "event_counts": lambda s, sf: event_counts(_mev(s, sf)).select("session_identifier", "event_counts_string"),
    "session_engaged_time": lambda s, sf: session_engaged_time(_mev(s, sf), CFG),
    "session_conversions": lambda s, sf: session_aggs(_mev(s, sf)).select(
        "session_identifier", "cv_view_page_volume",
        F.round("cv_view_page_total", 2).alias("cv_view_page_total"),
        "cv_view_page_first_conversion", "cv_view_page_converted"),
    "users_aggs": lambda s, sf: users_parts(s, sf)[1],
    "first_last_session_pick": lambda s, sf: users_parts(s, sf)[1].select(
        "user_identifier", "first_session_identifier", "last_session_identifier"),
    "count_by_app": q_count_by_app,
    "count_events": q_count_events,
    "view_aggs": lambda s, sf: view_aggs(_mev(s, sf)),
    "dedupe_events": q_dedupe_events,
    "dedupe_views": lambda s, sf: dedupe_views(_mev(s, sf)).select("view_id", "event_id", "session_identifier"),
    "view_in_session_index": lambda s, sf: _views(s, sf).select("view_id", "session_identifier", "event_id",
                                                                  "view_in_session_index"),
    "views_in_session": lambda s, sf: _views(s, sf).select("view_id", "session_identifier", "views_in_session"),
    "session_firsts": lambda s, sf: session_firsts(_mev(s, sf)).select("session_identifier", "event_id", "event_name"),
    "session_lasts": lambda s, sf: session_lasts(_mev(s, sf)).select("session_identifier", "event_id", "event_name"),
    "users_sessions": lambda s, sf: users_parts(s, sf)[0].select(
        "session_identifier", "user_identifier", "user_start_tstamp", "user_end_tstamp", "on_web", "on_mobile"),
    "dedupe_dimension": q_dedupe_dimension,
    "order_by_desc": q_count_by_app,
    "limit_lookup": q_limit_lookup,
    "top1_per_group": q_top1_per_group,
    "union_all_metrics": lambda s, sf: model(s, sf).pv_scroll_depth,
}


def _ev_sql(*cols):
    return with_ctes(BASE, "SELECT event_id, " + ", ".join(cols) + " FROM events_m")


def _sess_sql(*cols):
    return with_ctes(SESS, "SELECT session_identifier, " + ", ".join(cols) + " FROM sess")


ATOMIC_ONLY = BASE[:2]
_N = "CAST(substr(event_id, 2) AS BIGINT)"

ORACLE = {
    "filter_app_id": with_ctes(ATOMIC_ONLY, "SELECT event_id, app_id FROM atomic WHERE app_id IN ('demo-app')"),
    "entity_toggles": with_ctes(ATOMIC_ONLY, "SELECT event_id, CAST(NULL AS BOOLEAN) AS iab__spider_or_robot, "
                                "yauaa__device_class, mobile__os_type, CAST(NULL AS VARCHAR) AS page_view__id, "
                                "CAST(NULL AS VARCHAR) AS ua__os_family FROM atomic"),
    "extract_entities": with_ctes(ATOMIC_ONLY, "SELECT event_id, page_view__id, yauaa__device_class, "
                                  "CAST(NULL AS VARCHAR) AS yauaa__agent_class, mobile__os_type AS screen_view__name, "
                                  "platform AS screen_view__type, CAST(NULL AS VARCHAR) AS screen_view__id FROM atomic"),
    "extract_entities_all": with_ctes(ATOMIC_ONLY, _entities_all_sql()),
    "coalesce_entity_versions": with_ctes(ATOMIC_ONLY, f"SELECT event_id, CASE WHEN {_N} % 2 = 0 THEN coalesce(br_lang, geo_country) "
                                          f"ELSE geo_country END AS browser__viewport, CASE WHEN {_N} % 2 = 0 THEN 24 ELSE 32 END "
                                          "AS browser__color_depth FROM atomic"),
    "session_identifier": with_ctes(ATOMIC_ONLY, f"SELECT event_id, CASE WHEN {_N} % 3 = 0 THEN 'cs-' || event_id "
                                    "ELSE domain_sessionid END AS session_identifier FROM atomic"),
    "user_identifier": _ev_sql("user_identifier", "CAST(user_identifier AS VARCHAR) AS stitched_user_id"),
    "stitched_user_id": _ev_sql("CAST(user_identifier AS VARCHAR) AS stitched_user_id"),
    "view_id": _ev_sql("view_id"),
    "device_session_index": _ev_sql("device_session_index"),
    "device_attrs": _ev_sql("os_type", "os_version", "device_identifier", "referrer", "url", "screen_resolution"),
    "platform_name": _ev_sql("platform", "platform_name"),
    "device_category": _ev_sql("platform", "yauaa__device_class", "device_category"),
    "ua_bot_filter": with_ctes(ATOMIC_ONLY, "SELECT event_id, useragent FROM atomic WHERE NOT "
                               + full_match("useragent", rules.BOT_PATTERN)),
    "iab_robot_filter": _ev_sql("iab__spider_or_robot") + " WHERE NOT coalesce(iab__spider_or_robot, false)",
    "default_channel_group": _ev_sql("mkt_source", "mkt_medium", "mkt_campaign",
                                     om.channel_group_sql() + " AS default_channel_group"),
    "mkt_source_platform": with_ctes(ATOMIC_ONLY, "SELECT event_id, page_urlquery, regexp_extract(page_urlquery, "
                                     "'utm_source_platform=([^?&#]*)', 1) AS mkt_source_platform FROM atomic"),
    "last_or_first": _sess_sql("last_page_url", "last_page_title", "last_geo_country", "last_geo_country_name",
                               "last_br_lang", "last_br_lang_name", "last_screen_view__name"),
    "is_engaged": _sess_sql("views", "engaged_time_in_s", "is_engaged"),
    "session_start_adjust": _sess_sql("first_event_name", "start_tstamp", "absolute_time_in_s"),
    "constant_columns": with_ctes(VIEWS + SESS[len(BASE):], "SELECT view_id, 'other' AS content_group FROM v_idx "
                                  "UNION ALL SELECT session_identifier, default_channel_group FROM sess"),
    "json_path_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "regex_field_filter": with_ctes(ATOMIC_ONLY, "SELECT event_id, app_id FROM atomic WHERE coalesce("
                                    "regexp_matches(app_id, '^demo-app$'), false)"),
    "view_time_fallback": with_ctes(VIEWS, "SELECT view_id, session_identifier, coalesce(_t_end, derived_tstamp) AS end_tstamp, "
                                    "coalesce(_t_eng, 0) AS engaged_time_in_s, " + om.VIEW_SPECIAL["absolute_time_in_s"]
                                    + " AS absolute_time_in_s FROM v_idx"),
    "views_left_engagement": with_ctes(VIEWS, "SELECT view_id, session_identifier, coalesce(_t_end, derived_tstamp) AS end_tstamp, "
                                       "coalesce(_t_eng, 0) AS engaged_time_in_s, " + om.VIEW_SPECIAL["absolute_time_in_s"]
                                       + " AS absolute_time_in_s FROM v_idx"),
    "views_left_scroll": with_ctes(VIEWS, "SELECT view_id, session_identifier, horizontal_pixels_scrolled, vertical_pixels_scrolled, "
                                   "horizontal_percentage_scrolled, vertical_percentage_scrolled FROM v_idx"),
    "views_left_viewaggs": with_ctes(VIEWS + ["va AS (SELECT DISTINCT view_id, session_identifier FROM events_m "
                                              "WHERE NOT coalesce(iab__spider_or_robot, false))"],
                                     "SELECT v.view_id, v.session_identifier, (a.view_id IS NOT NULL OR a.session_identifier IS NOT NULL) "
                                     "AND v.session_identifier IS NOT NULL AS has_aggs FROM v_idx v LEFT JOIN va a "
                                     "ON v.view_id = a.view_id AND v.session_identifier = a.session_identifier"),
    "sessions_left_language": _sess_sql("first_br_lang", "first_br_lang_name", "last_br_lang", "last_br_lang_name"),
    "sessions_left_country": _sess_sql("first_geo_country", "first_geo_country_name", "first_geo_continent",
                                       "last_geo_country", "last_geo_country_name", "last_geo_continent"),
    "sessions_assemble": _sess_sql("first_event_name", "last_event_name", "total_events", "views",
                                   "engaged_time_in_s", "event_counts_string"),
    "mobile_language_name": _sess_sql("mobile__language", "mobile_language_name"),
    "users_first_session": with_ctes(USERS, "SELECT user_identifier, first_session_identifier, start_tstamp FROM ua"),
    "users_last_session": with_ctes(USERS, "SELECT user_identifier, last_platform, last_page_url, last_event_id FROM ul"),
    "session_aggs": with_ctes(SESS, "SELECT session_identifier, a_start AS start_tstamp, a_end AS end_tstamp, "
                              "total_events, views, a_abs AS absolute_time_in_s FROM s_a"),
    "event_counts": with_ctes(SESS, "SELECT session_identifier, event_counts_string FROM s_a"),
    "session_engaged_time": with_ctes(SESS, "SELECT session_identifier, coalesce(a_eng, 0) AS engaged_time_in_s FROM s_a"),
    "session_conversions": with_ctes(BASE, "SELECT session_identifier, "
                                     "count(CASE WHEN event_name = 'page_view' THEN 1 END) AS cv_view_page_volume, "
                                     "round(sum(CASE WHEN event_name = 'page_view' THEN coalesce(tr_total_base, 0.5) ELSE 0 END), 2) "
                                     "AS cv_view_page_total, "
                                     "min(CASE WHEN event_name = 'page_view' THEN derived_tstamp END) AS cv_view_page_first_conversion, "
                                     "CAST(max(CASE WHEN event_name = 'page_view' THEN 1 ELSE 0 END) AS BOOLEAN) AS cv_view_page_converted "
                                     "FROM events_m WHERE NOT coalesce(iab__spider_or_robot, false) GROUP BY session_identifier"),
    "users_aggs": with_ctes(USERS, om.users_aggs_select()),
    "first_last_session_pick": with_ctes(USERS, "SELECT user_identifier, first_session_identifier, last_session_identifier FROM ua"),
    "count_by_app": with_ctes(base_ctes()[:2], "SELECT app_id, count(*) AS n FROM atomic GROUP BY app_id ORDER BY app_id DESC"),
    "count_events": with_ctes(base_ctes()[:2], "SELECT count(*) AS n FROM atomic"),
    "view_aggs": with_ctes(BASE, "SELECT DISTINCT view_id, session_identifier FROM events_m "
                           "WHERE NOT coalesce(iab__spider_or_robot, false)"),
    "dedupe_events": with_ctes(ATOMIC_ONLY, "SELECT event_id, collector_tstamp FROM atomic QUALIFY row_number() OVER "
                               "(PARTITION BY event_id ORDER BY collector_tstamp, dvce_created_tstamp) = 1"),
    "dedupe_views": with_ctes(VIEWS, "SELECT view_id, event_id, session_identifier FROM v_prep"),
    "view_in_session_index": with_ctes(VIEWS, "SELECT view_id, session_identifier, event_id, view_in_session_index FROM v_idx"),
    "views_in_session": with_ctes(VIEWS, "SELECT view_id, session_identifier, count(*) OVER (PARTITION BY session_identifier) "
                                  "AS views_in_session FROM v_idx"),
    "session_firsts": with_ctes(SESS, "SELECT session_identifier, event_id, event_name FROM s_f0"),
    "session_lasts": with_ctes(SESS, "SELECT session_identifier, event_id, event_name FROM s_l0"),
    "users_sessions": with_ctes(USERS, "SELECT session_identifier, user_identifier, user_start_tstamp, user_end_tstamp, "
                                "on_web, on_mobile FROM us"),
    "dedupe_dimension": "SELECT n_regionkey, n_name AS name FROM nation QUALIFY row_number() OVER "
                        "(PARTITION BY lower(CAST(n_regionkey AS VARCHAR)) ORDER BY n_name) = 1",
    "limit_lookup": "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER "
                    "(PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) = 1",
    "top1_per_group": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER "
                      "(PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1",
}
ORACLE["order_by_desc"] = ORACLE["count_by_app"]
from trailmark.registry.models import ORACLE as _MODEL_ORACLE  # noqa: E402
ORACLE["select_view"] = _MODEL_ORACLE["unified_views"]
for _k, _src in (("pv_engaged_time", "unified_pv_engaged_time"), ("screen_summary_metrics", "unified_screen_summary_metrics"),
                 ("pv_scroll_depth", "unified_pv_scroll_depth"), ("union_all_metrics", "unified_pv_scroll_depth")):
    from trailmark.registry.models import ORACLE as _MO
    ORACLE[_k] = _MO[_src]
