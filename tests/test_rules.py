"""Scalar rules and semantic traps on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from trailmark.functions import rules
from trailmark.functions.timeutil import heartbeat_bucket, seconds_between
from trailmark.operators.enrich import anon_ip, campaign_attribution, event_fingerprint


def test_bot_filter_is_case_sensitive_full_match(spark):
    df = spark.createDataFrame([("Googlebot/2.1",), ("MY BOT",), (None,), ("Mozilla/5.0 Firefox",),
                                ("line1\nbot",)], "ua string")
    kept = [r.ua for r in df.filter(rules.is_not_bot(F.col("ua"))).collect()]
    # 'bot' anywhere drops; 'BOT' is kept (case-sensitive); NULL is dropped;
    # '.' does not cross a newline, so a bot word after one is not matched.
    assert sorted(kept) == ["MY BOT", "Mozilla/5.0 Firefox", "line1\nbot"]


def test_channel_rules_order(spark):
    rows = [("direct", "none", None, "Direct"), ("google", "cpc", "summer", "Paid Other"),
            ("x", "cpm", None, "Paid Other"),          # 'cpm' hits the paid rule before Display
            ("x", "paid", "eshop", "Paid Shopping"),   # 'e' is outside [a-df-z]
            ("x", "display", None, "Display"), (None, "social", "shoes", "Organic Social"),
            (None, "video-ad", None, "Organic Video"), ("x", "Email ", None, "Email"),
            (None, "web_push", None, "Mobile Push Notifications"), (None, None, None, "Unassigned")]
    df = spark.createDataFrame(rows, "s string, m string, c string, want string")
    got = df.select(rules.default_channel_group(F.col("s"), F.col("m"), F.col("c")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got), got


def test_datediff_counts_second_boundaries(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([(t("2024-01-01 00:00:00.900"), t("2024-01-01 00:00:01.100")),
                                (t("2024-01-01 00:00:00.100"), t("2024-01-01 00:00:00.900"))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r.d for r in df.select(seconds_between(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 0]


def test_heartbeat_bucket(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 19),), (dt.datetime(1970, 1, 1, 0, 0, 20),)],
                               "t timestamp_ntz")
    assert [r.b for r in df.select(heartbeat_bucket(F.col("t"), 10).alias("b")).collect()] == [1, 2]


def test_campaign_attribution_absent_vs_empty(spark):
    df = spark.createDataFrame([("utm_medium=&utm_source=a%20b",), ("x=1",), (None,)], "page_urlquery string")
    got = campaign_attribution(df).select("mkt_medium", "mkt_source").collect()
    assert (got[0].mkt_medium, got[0].mkt_source) == ("", "a b")
    assert (got[1].mkt_medium, got[2].mkt_medium) == (None, None)


def test_fingerprint_ignores_excluded_and_order(spark):
    df = spark.createDataFrame([("b=2&a=1&eid=9",), ("a=1&b=2&stm=5",)], "page_urlquery string")
    fps = [r.event_fingerprint for r in event_fingerprint(df).collect()]
    assert fps[0] == fps[1]


def test_anon_ip(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("::1",), (None,)], "user_ipaddress string")
    assert [r.user_ipaddress for r in anon_ip(df).collect()] == ["10.1.2.x", "::x", None]
