"""DuckDB oracle CTEs for the modelled views."""

from __future__ import annotations

from trailmark.functions.contracts import (SESSIONS_COLUMNS, USERS_AGGS_COLUMNS, USERS_COLUMNS,
                                           USERS_LASTS_COLUMNS, VIEWS_COLUMNS)
from trailmark.registry.oracle_base import channel_group_sql

NOT_ROBOT = "NOT coalesce(iab__spider_or_robot, false)"


def _pct(num: str, den: str) -> str:
    return (f"CASE WHEN {num} IS NOT NULL AND {den} IS NOT NULL AND {den} > 0 "
            f"THEN round(CAST(100 AS DOUBLE) * CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)) END")


def metric_ctes(hb=10, mvl=5) -> list[str]:
    s = "screen_summary__"
    return [
        f"""ss_prep AS (SELECT view_id, session_identifier,
      round(max(TRY_CAST({s}foreground_sec AS DOUBLE)), 2) AS foreground_sec,
      round(max(TRY_CAST({s}background_sec AS DOUBLE)), 2) AS background_sec,
      max(TRY_CAST({s}last_item_index AS INTEGER)) AS last_item_index,
      max(TRY_CAST({s}items_count AS INTEGER)) AS items_count,
      min(TRY_CAST({s}min_x_offset AS INTEGER)) AS min_x_offset,
      min(TRY_CAST({s}min_y_offset AS INTEGER)) AS min_y_offset,
      max(TRY_CAST({s}max_x_offset AS INTEGER)) AS max_x_offset,
      max(TRY_CAST({s}max_y_offset AS INTEGER)) AS max_y_offset,
      max(TRY_CAST({s}content_width AS INTEGER)) AS content_width,
      max(TRY_CAST({s}content_height AS INTEGER)) AS content_height
    FROM events_m
    WHERE view_id IS NOT NULL AND platform <> 'web'
      AND event_name IN ('screen_end', 'application_background', 'application_foreground')
    GROUP BY view_id, session_identifier)""",
        f"""ssm AS (SELECT *,
      {_pct('max_x_offset', 'content_width')} AS horizontal_percentage_scrolled,
      {_pct('max_y_offset', 'content_height')} AS vertical_percentage_scrolled,
      {_pct('(last_item_index + 1)', 'items_count')} AS list_items_percentage_scrolled
    FROM ss_prep)""",
        f"""eng AS (
    SELECT view_id, session_identifier, max(derived_tstamp) AS end_tstamp,
      CAST({hb} * (count(DISTINCT epoch_us(dvce_created_tstamp) // {hb * 1000000}) - 1) + {mvl} AS DOUBLE) AS engaged_time_in_s,
      CAST(NULL AS DOUBLE) AS absolute_time_in_s
    FROM events_m WHERE event_name = 'page_ping' AND view_id IS NOT NULL
    GROUP BY view_id, session_identifier
    UNION ALL
    SELECT view_id, session_identifier, CAST(NULL AS TIMESTAMP), foreground_sec,
      foreground_sec + coalesce(background_sec, 0) FROM ssm)""",
        """sd_prep AS (SELECT view_id, session_identifier,
      max(doc_width) AS doc_width, max(doc_height) AS doc_height,
      max(br_viewwidth) AS br_viewwidth, max(br_viewheight) AS br_viewheight,
      least(greatest(min(coalesce(pp_xoffset_min, 0)), 0), max(doc_width)) AS hmin,
      least(greatest(max(coalesce(pp_xoffset_max, 0)), 0), max(doc_width)) AS hmax,
      least(greatest(min(coalesce(pp_yoffset_min, 0)), 0), max(doc_height)) AS vmin,
      least(greatest(max(coalesce(pp_yoffset_max, 0)), 0), max(doc_height)) AS vmax
    FROM events_m
    WHERE event_name IN ('page_view', 'page_ping') AND view_id IS NOT NULL AND doc_height > 0 AND doc_width > 0
    GROUP BY view_id, session_identifier)""",
        """scroll AS (
    SELECT view_id, session_identifier, doc_width, doc_height, br_viewwidth, br_viewheight, hmin, hmax, vmin, vmax,
      round(100 * (greatest(hmin, 0) / CAST(doc_width AS DOUBLE))) AS relative_hmin,
      round(100 * (least(hmax + br_viewwidth, doc_width) / CAST(doc_width AS DOUBLE))) AS relative_hmax,
      round(100 * (greatest(vmin, 0) / CAST(doc_height AS DOUBLE))) AS relative_vmin,
      round(100 * (least(vmax + br_viewheight, doc_height) / CAST(doc_height AS DOUBLE))) AS relative_vmax,
      CAST(NULL AS INTEGER) AS last_list_item_index, CAST(NULL AS INTEGER) AS list_items_count,
      CAST(NULL AS DOUBLE) AS list_items_percentage_scrolled
    FROM sd_prep
    UNION ALL
    SELECT view_id, session_identifier, content_width, content_height, NULL, NULL,
      min_x_offset, max_x_offset, min_y_offset, max_y_offset,
      NULL, horizontal_percentage_scrolled, NULL, vertical_percentage_scrolled,
      last_item_index, items_count, list_items_percentage_scrolled
    FROM ssm)""",
    ]


VIEW_SPECIAL = {
    "start_tstamp": "derived_tstamp",
    "end_tstamp": "coalesce(_t_end, derived_tstamp)",
    "engaged_time_in_s": "coalesce(_t_eng, 0)",
    "absolute_time_in_s": "coalesce(_t_abs, CAST(datediff('second', derived_tstamp, coalesce(_t_end, derived_tstamp)) AS DOUBLE))",
    "views_in_session": "count(*) OVER (PARTITION BY session_identifier)",
    "content_group": "'other'",
    "br_colordepth": "CAST(browser__color_depth AS VARCHAR)",
    "stitched_user_id": "CAST(user_identifier AS VARCHAR)",
}


def views_ctes() -> list[str]:
    order = ", ".join(f"{x} NULLS LAST" for x in (
        "derived_tstamp", "dvce_created_tstamp", "event_id", "_t_eng", "_t_abs", "_t_end",
        "horizontal_pixels_scrolled", "vertical_pixels_scrolled", "horizontal_percentage_scrolled",
        "vertical_percentage_scrolled"))
    return [
        f"""v_prep AS (SELECT *, {channel_group_sql()} AS default_channel_group FROM events_m
    WHERE event_name IN ('page_view', 'screen_view') AND view_id IS NOT NULL AND {NOT_ROBOT}
    QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY derived_tstamp NULLS LAST, dvce_created_tstamp NULLS LAST) = 1)""",
        """v_join AS (SELECT p.*, t.end_tstamp AS _t_end, t.engaged_time_in_s AS _t_eng, t.absolute_time_in_s AS _t_abs,
      sd.hmax AS horizontal_pixels_scrolled, sd.vmax AS vertical_pixels_scrolled,
      sd.relative_hmax AS horizontal_percentage_scrolled, sd.relative_vmax AS vertical_percentage_scrolled
    FROM v_prep p
    LEFT JOIN eng t ON p.view_id = t.view_id AND p.session_identifier = t.session_identifier
    LEFT JOIN scroll sd ON p.view_id = sd.view_id AND p.session_identifier = sd.session_identifier)""",
        f"""v_idx AS (SELECT *, row_number() OVER (PARTITION BY session_identifier ORDER BY {order}) AS view_in_session_index
    FROM v_join)""",
    ]


def views_select(with_model_tstamp=False) -> str:
    cols = []
    for c in VIEWS_COLUMNS:
        if c == "model_tstamp":
            if with_model_tstamp:
                cols.append("current_timestamp AS model_tstamp")
            continue
        cols.append(f"{VIEW_SPECIAL[c]} AS {c}" if c in VIEW_SPECIAL else c)
    return "SELECT " + ", ".join(cols) + " FROM v_idx"


def _dim_dedup(name: str, src: str, key: str, cols: str) -> str:
    return (f"{name} AS (SELECT lower({key}) AS k, {cols} FROM {src} WHERE {key} IS NOT NULL "
            f"QUALIFY row_number() OVER (PARTITION BY lower({key}) ORDER BY name NULLS LAST) = 1)")


LAST_COLS = ("event_name", "geo_country", "geo_city", "geo_region_name", "page_url", "br_lang",
             "screen_view__name", "screen_view__transition_type", "screen_view__type", "page_title",
             "page_urlscheme", "page_urlhost", "page_urlpath", "page_urlquery", "page_urlfragment")


def sessions_ctes(hb=10, mvl=5) -> list[str]:
    pv = "event_name = 'page_ping' AND view_id IS NOT NULL"
    lcols = ", ".join(f"x.{c} AS l_{c}" for c in LAST_COLS)
    return [
        _dim_dedup("k_lang", "d_language", "lang_tag", "name"),
        _dim_dedup("k_country", "d_country", "alpha_2", "name, region"),
        _dim_dedup("k_iso1", "d_iso2t", "iso_639_1_code", "name"),
        _dim_dedup("k_iso2", "d_iso2t", "iso_639_2t_code", "name"),
        _dim_dedup("k_iso3", "d_iso3", "iso_639_3_code", "name"),
        f"""s_f0 AS (SELECT * FROM events_m
    WHERE event_name IN ('page_ping', 'page_view', 'screen_view') AND view_id IS NOT NULL AND {NOT_ROBOT}
    QUALIFY row_number() OVER (PARTITION BY session_identifier ORDER BY derived_tstamp NULLS LAST, event_id NULLS LAST) = 1)""",
        """s_f AS (SELECT f.*, l.name AS br_lang_name, g.name AS geo_country_name, g.region AS geo_continent,
      coalesce(i1.name, i2.name, i3.name, f.mobile__language) AS mobile_language_name
    FROM s_f0 f
    LEFT JOIN k_lang l ON lower(f.br_lang) = l.k
    LEFT JOIN k_country g ON lower(f.geo_country) = g.k
    LEFT JOIN k_iso1 i1 ON lower(f.mobile__language) = i1.k
    LEFT JOIN k_iso2 i2 ON lower(f.mobile__language) = i2.k
    LEFT JOIN k_iso3 i3 ON lower(f.mobile__language) = i3.k)""",
        f"""s_l0 AS (SELECT * FROM events_m
    WHERE event_name IN ('page_view', 'screen_view') AND view_id IS NOT NULL AND {NOT_ROBOT}
    QUALIFY row_number() OVER (PARTITION BY session_identifier ORDER BY derived_tstamp DESC NULLS LAST, event_id DESC NULLS LAST) = 1)""",
        f"""s_l AS (SELECT x.session_identifier, {lcols}, l.name AS l_br_lang_name,
      g.name AS l_geo_country_name, g.region AS l_geo_continent
    FROM s_l0 x LEFT JOIN k_lang l ON lower(x.br_lang) = l.k LEFT JOIN k_country g ON lower(x.geo_country) = g.k)""",
        f"""s_a AS (SELECT session_identifier, min(derived_tstamp) AS a_start, max(derived_tstamp) AS a_end,
      count(*) AS total_events, count(DISTINCT view_id) AS views,
      CAST(max(CASE WHEN event_name = 'page_view' THEN 1 ELSE 0 END) AS BOOLEAN) AS converted,
      datediff('second', min(derived_tstamp), max(derived_tstamp)) AS a_abs,
      CAST({hb} * (count(DISTINCT CASE WHEN {pv} THEN view_id || '|' || CAST(epoch_us(dvce_created_tstamp) // {hb * 1000000} AS VARCHAR) END)
                 - count(DISTINCT CASE WHEN {pv} THEN view_id END))
           + count(DISTINCT CASE WHEN {pv} THEN view_id END) * {mvl} AS BIGINT) AS a_eng,
      CAST(json(histogram(event_name)) AS VARCHAR) AS event_counts_string
    FROM events_m WHERE {NOT_ROBOT} GROUP BY session_identifier)""",
        f"""s_j AS (SELECT f.*, l.* EXCLUDE (session_identifier), a.* EXCLUDE (session_identifier) FROM s_f f
    LEFT JOIN s_l l ON f.session_identifier = l.session_identifier
    LEFT JOIN s_a a ON f.session_identifier = a.session_identifier)""",
    ]


def _lof(witness: str, last: str, first: str) -> str:
    return f"CASE WHEN {witness} IS NULL THEN coalesce({last}, {first}) ELSE {last} END"


def sessions_special(mvl=5) -> dict[str, str]:
    ping = "s_j.event_name = 'page_ping'"
    sp = {
        "first_event_name": "s_j.event_name",
        "last_event_name": "l_event_name",
        "session_identifier": "s_j.session_identifier",
        "stitched_user_id": "CAST(user_identifier AS VARCHAR)",
        "start_tstamp": f"CASE WHEN {ping} THEN a_start - INTERVAL '{mvl}' SECOND ELSE a_start END",
        "end_tstamp": "a_end",
        "first_geo_country": "geo_country", "first_geo_region_name": "geo_region_name",
        "first_geo_city": "geo_city", "first_geo_country_name": "geo_country_name",
        "first_geo_continent": "geo_continent",
        "is_engaged": "coalesce(CASE WHEN views >= 2 OR a_eng / 10 >= 2 OR converted THEN true END, false)",
        "engaged_time_in_s": "a_eng",
        "absolute_time_in_s": f"a_abs + CASE WHEN {ping} THEN {mvl} ELSE 0 END",
        "default_channel_group": "CAST(NULL AS VARCHAR)",
        "mkt_source_platform": "regexp_extract(page_urlquery, 'utm_source_platform=([^?&#]*)', 1)",
        "first_page_url": "page_url",
        "last_page_url": _lof("l_page_url", "l_page_url", "page_url"),
        "first_br_lang": "br_lang", "first_br_lang_name": "br_lang_name",
        "last_br_lang": _lof("l_br_lang", "l_br_lang", "br_lang"),
        "last_br_lang_name": _lof("l_br_lang", "l_br_lang_name", "br_lang_name"),
        "first_screen_view__name": "screen_view__name", "first_screen_view__type": "screen_view__type",
        "event_id": "s_j.event_id",
    }
    for x in ("geo_country", "geo_region_name", "geo_city", "geo_country_name", "geo_continent"):
        sp[f"last_{x}"] = _lof("l_geo_country", f"l_{x}", x)
    for x in ("title", "urlscheme", "urlhost", "urlpath", "urlquery", "urlfragment"):
        sp[f"first_page_{x}"] = f"page_{x}"
        sp[f"last_page_{x}"] = _lof("l_page_url", f"l_page_{x}", f"page_{x}")
    for x in ("name", "transition_type", "type"):
        sp[f"last_screen_view__{x}"] = _lof(f"l_screen_view__{x}", f"l_screen_view__{x}", f"screen_view__{x}")
    for x in ("latitude", "longitude", "latitude_longitude_accuracy", "altitude", "altitude_accuracy",
              "bearing", "speed"):
        sp[f"first_geo__{x}"] = f"geo__{x}"
    return sp


SESSIONS_CHECKED = [c for c in SESSIONS_COLUMNS if c not in ("model_tstamp", "event_counts")]


def sessions_select_cte(mvl=5) -> str:
    sp = sessions_special(mvl)
    cols = ", ".join(f"{sp.get(c, c)} AS {c}" for c in SESSIONS_CHECKED)
    return f"sess AS (SELECT {cols} FROM s_j)"


def users_ctes() -> list[str]:
    ls = ", ".join(
        {"last_platform": "platform AS last_platform", "last_os_type": "os_type AS last_os_type",
         "last_os_version": "os_version AS last_os_version",
         "last_screen_resolution": "screen_resolution AS last_screen_resolution",
         "last_mobile__carrier": "mobile__carrier AS last_mobile__carrier",
         "last_mobile__device_manufacturer": "mobile__device_manufacturer AS last_mobile__device_manufacturer",
         "last_mobile__device_model": "mobile__device_model AS last_mobile__device_model",
         "last_event_id": "event_id AS last_event_id"}.get(c, f"a.{c}") for c in USERS_LASTS_COLUMNS)
    return [
        """us AS (SELECT *,
      min(start_tstamp) OVER (PARTITION BY user_identifier) AS user_start_tstamp,
      max(end_tstamp) OVER (PARTITION BY user_identifier) AS user_end_tstamp,
      max(CASE WHEN platform = 'web' THEN true ELSE false END) OVER (PARTITION BY user_identifier) AS on_web,
      max(CASE WHEN platform <> 'web' THEN true ELSE false END) OVER (PARTITION BY user_identifier) AS on_mobile
    FROM sess)""",
        """ua AS (SELECT user_identifier, user_start_tstamp AS start_tstamp, user_end_tstamp AS end_tstamp,
      max(CASE WHEN start_tstamp = user_start_tstamp THEN session_identifier END) AS first_session_identifier,
      max(CASE WHEN end_tstamp = user_end_tstamp THEN session_identifier END) AS last_session_identifier,
      CAST(sum(views) AS BIGINT) AS views, count(DISTINCT session_identifier) AS sessions,
      count(DISTINCT date_trunc('day', start_tstamp)) AS active_days,
      CAST(sum(engaged_time_in_s) AS BIGINT) AS engaged_time_in_s,
      CAST(sum(absolute_time_in_s) AS BIGINT) AS absolute_time_in_s
    FROM us GROUP BY user_identifier, user_start_tstamp, user_end_tstamp)""",
        f"""ul AS (SELECT {ls} FROM us a JOIN ua b ON a.session_identifier = b.last_session_identifier)""",
    ]


USERS_FROM_LASTS = {"last_platform", "last_screen_resolution", "last_os_type", "last_os_version",
                    "last_mobile__device_manufacturer", "last_mobile__device_model", "last_mobile__carrier",
                    "last_geo_country", "last_geo_country_name", "last_geo_continent", "last_geo_city",
                    "last_geo_region_name", "last_page_title", "last_page_url", "last_page_urlscheme",
                    "last_page_urlhost", "last_page_urlpath", "last_page_urlquery", "last_page_urlfragment",
                    "last_br_lang", "last_br_lang_name", "last_screen_view__name",
                    "last_screen_view__transition_type", "last_screen_view__type", "last_event_id"}
USERS_FROM_AGGS = {"start_tstamp", "end_tstamp", "views", "sessions", "active_days", "engaged_time_in_s",
                   "absolute_time_in_s"}


def users_select() -> str:
    sp = {"user_identifier": "a.user_identifier", "stitched_user_id": "CAST(a.user_identifier AS VARCHAR)",
          "first_platform": "a.platform", "on_web": "CAST(a.on_web AS BOOLEAN)",
          "on_mobile": "CAST(a.on_mobile AS BOOLEAN)",
          "first_mobile__device_manufacturer": "a.mobile__device_manufacturer",
          "first_mobile__device_model": "a.mobile__device_model",
          "first_mobile__carrier": "a.mobile__carrier",
          "mobile_language_name": "CAST(NULL AS VARCHAR)", "first_event_id": "a.event_id"}
    cols = []
    for c in USERS_COLUMNS:
        if c == "model_tstamp":
            continue
        e = sp.get(c) or (f"c.{c}" if c in USERS_FROM_LASTS else f"b.{c}" if c in USERS_FROM_AGGS else f"a.{c}")
        cols.append(f"{e} AS {c}")
    return ("SELECT " + ", ".join(cols) + " FROM ua b JOIN us a ON a.session_identifier = b.first_session_identifier "
            "JOIN ul c ON b.user_identifier = c.user_identifier")


def users_aggs_select() -> str:
    return "SELECT " + ", ".join(USERS_AGGS_COLUMNS) + " FROM ua"


def users_lasts_select() -> str:
    return "SELECT " + ", ".join(USERS_LASTS_COLUMNS) + " FROM ul"
