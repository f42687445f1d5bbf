"""User-level rollups of sessions.

User totals come from ``groupBy(user_identifier)`` (map-side combine) and are
joined back to sessions, instead of whole-partition windows: a bot user owning
a third of all sessions then costs one pre-aggregated row per map task, and
the join back is split by AQE's skew handling.  NULL users form one group, as
in the window form, via a null-safe join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.contracts import USERS_AGGS_COLUMNS, USERS_COLUMNS, USERS_LASTS_COLUMNS

UID = "user_identifier"


def unified_users_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions plus user start/end and the on_web / on_mobile flags."""
    c = F.col
    per_user = sessions.groupBy(UID).agg(
        F.min("start_tstamp").alias("user_start_tstamp"),
        F.max("end_tstamp").alias("user_end_tstamp"),
        F.max(F.when(c("platform") == "web", True).otherwise(False)).alias("on_web"),
        F.max(F.when(c("platform") != "web", True).otherwise(False)).alias("on_mobile"),
    ).withColumnRenamed(UID, "__uid")
    j = sessions.join(per_user, sessions[UID].eqNullSafe(per_user["__uid"]), "inner")
    return j.select(*sessions.columns, "user_start_tstamp", "user_end_tstamp", "on_web", "on_mobile")


def unified_users_aggs(users_sessions: DataFrame) -> DataFrame:
    """M08 / A08 + A09.  Sessions are unique per identifier, so count() equals count(distinct)."""
    c = F.col
    g = users_sessions.groupBy(UID, "user_start_tstamp", "user_end_tstamp").agg(
        F.max(F.when(c("start_tstamp") == c("user_start_tstamp"), c("session_identifier")))
        .alias("first_session_identifier"),
        F.max(F.when(c("end_tstamp") == c("user_end_tstamp"), c("session_identifier")))
        .alias("last_session_identifier"),
        F.sum("views").alias("views"),
        F.count("session_identifier").alias("sessions"),
        F.countDistinct(F.date_trunc("day", c("start_tstamp"))).alias("active_days"),
        F.sum("engaged_time_in_s").alias("engaged_time_in_s"),
        F.sum("absolute_time_in_s").alias("absolute_time_in_s"),
    )
    return g.withColumnsRenamed({"user_start_tstamp": "start_tstamp", "user_end_tstamp": "end_tstamp"}) \
            .select(*USERS_AGGS_COLUMNS)


def unified_users_lasts(users_sessions: DataFrame, users_aggs: DataFrame) -> DataFrame:
    """The user's last session, joined on last_session_identifier."""
    a = users_sessions
    b = users_aggs.select(F.col("last_session_identifier").alias("__last"))
    j = a.join(b, a["session_identifier"] == b["__last"], "inner")
    ren = {"platform": "last_platform", "os_type": "last_os_type", "os_version": "last_os_version",
           "screen_resolution": "last_screen_resolution", "event_id": "last_event_id",
           "mobile__carrier": "last_mobile__carrier",
           "mobile__device_manufacturer": "last_mobile__device_manufacturer",
           "mobile__device_model": "last_mobile__device_model"}
    return j.select(*[F.col(_src(dst, ren)).alias(dst) for dst in USERS_LASTS_COLUMNS])


def _src(dst: str, ren: dict[str, str]) -> str:
    for s, d in ren.items():
        if d == dst:
            return s
    return dst


FROM_LASTS = {"last_platform", "last_screen_resolution", "last_os_type", "last_os_version",
              "last_mobile__device_manufacturer", "last_mobile__device_model", "last_mobile__carrier",
              "last_geo_country", "last_geo_country_name", "last_geo_continent", "last_geo_city",
              "last_geo_region_name", "last_page_title", "last_page_url", "last_page_urlscheme",
              "last_page_urlhost", "last_page_urlpath", "last_page_urlquery", "last_page_urlfragment",
              "last_br_lang", "last_br_lang_name", "last_screen_view__name",
              "last_screen_view__transition_type", "last_screen_view__type", "last_event_id"}
FROM_AGGS = {"start_tstamp", "end_tstamp", "views", "sessions", "active_days", "engaged_time_in_s",
             "absolute_time_in_s"}


def unified_users(users_sessions: DataFrame, users_aggs: DataFrame, users_lasts: DataFrame,
                  with_model_tstamp: bool = True) -> DataFrame:
    """First session (users_sessions) + totals (aggs) + last session (lasts)."""
    a = users_sessions.alias("a")
    b = users_aggs.alias("b")
    cc = users_lasts.alias("c")
    j = (b.join(a, F.col("a.session_identifier") == F.col("b.first_session_identifier"), "inner")
         .join(cc, F.col("b.user_identifier") == F.col("c.user_identifier"), "inner"))
    special = {
        "user_identifier": F.col("a.user_identifier"),
        "stitched_user_id": F.col("a.user_identifier").cast("string"),
        "model_tstamp": F.current_timestamp(),
        "first_platform": F.col("a.platform"),
        "on_web": F.col("a.on_web").cast("boolean"),
        "on_mobile": F.col("a.on_mobile").cast("boolean"),
        "first_mobile__device_manufacturer": F.col("a.mobile__device_manufacturer"),
        "first_mobile__device_model": F.col("a.mobile__device_model"),
        "first_mobile__carrier": F.col("a.mobile__carrier"),
        "mobile_language_name": F.lit(None).cast("string"),
        "first_event_id": F.col("a.event_id"),
    }
    cols = []
    for name in USERS_COLUMNS:
        if name == "model_tstamp" and not with_model_tstamp:
            continue
        if name in special:
            e = special[name]
        elif name in FROM_LASTS:
            e = F.col(f"c.{name}")
        elif name in FROM_AGGS:
            e = F.col(f"b.{name}")
        else:
            e = F.col(f"a.{name}")
        cols.append(e.alias(name))
    return j.select(*cols)
