"""Model traps on literal rows: NULL session/user (X11) and a view spanning two sessions."""

import datetime as dt

from pyspark.sql import functions as F

from trailmark.config import ModelConfig
from trailmark.plans.model import UnifiedModel
from trailmark.sources.dims import fixture_dims

UA = "Mozilla/5.0 (X11; Linux x86_64) Firefox/128.0"
SCHEMA = ("event_id string, app_id string, platform string, event_name string, collector_tstamp timestamp_ntz, "
          "dvce_created_tstamp timestamp_ntz, derived_tstamp timestamp_ntz, domain_userid string, "
          "domain_sessionid string, page_view__id string, useragent string")


def _rows():
    t = dt.datetime(2024, 1, 1, 12)
    s = lambda k: t + dt.timedelta(seconds=k)
    return [
        # view v1 starts in session s1 and continues (pings) in session s2
        ("e1", "a", "web", "page_view", s(0), s(0), s(0), "u1", "s1", "v1", UA),
        ("e2", "a", "web", "page_ping", s(10), s(10), s(10), "u1", "s1", "v1", UA),
        ("e3", "a", "web", "page_view", s(60), s(60), s(60), "u1", "s2", "v1", UA),
        ("e4", "a", "web", "page_ping", s(70), s(70), s(70), "u1", "s2", "v1", UA),
        ("e5", "a", "web", "page_ping", s(85), s(85), s(85), "u1", "s2", "v1", UA),
        # NULL session and NULL user
        ("e6", "a", "web", "page_view", s(5), s(5), s(5), None, None, "v9", UA),
        ("e7", "a", "web", "page_ping", s(20), s(20), s(20), None, None, "v9", UA),
    ]


def _model(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    return UnifiedModel(df, ModelConfig().with_all_entities(), fixture_dims(spark), materialized=False,
                        with_model_tstamp=False)


def test_view_spanning_two_sessions_keeps_one(spark):
    m = _model(spark)
    v = {r.view_id: r for r in m.views.collect()}
    # de-duplicated per view: the earliest page view (session s1) wins
    assert v["v1"].session_identifier == "s1" and v["v1"].event_id == "e1"
    # metrics are keyed on (view, session): only the s1 ping counts -> 5 s
    assert v["v1"].engaged_time_in_s == 5.0


def test_null_session_and_user(spark):
    m = _model(spark)
    sess = {r.session_identifier: r for r in m.sessions.collect()}
    # the NULL session forms one group but never joins its aggregates
    assert None in sess and sess[None].total_events is None and sess[None].is_engaged is False
    assert sess["s2"].total_events == 3 and sess["s2"].first_event_name == "page_view"
    users = {r.user_identifier for r in m.users.collect()}
    # a NULL user drops out of the users view
    assert users == {"u1"}
    counts = m.sessions.filter(F.col("session_identifier") == "s2").select("event_counts_string").first()[0]
    assert counts == '{"page_ping":2,"page_view":1}'
