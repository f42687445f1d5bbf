"""Reading the driver tables and the ``atomic`` event fixture built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD_ROWS = 50_000  # of a table whose rows are dealt out before work on each of them


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows of ``df`` dealt out to tasks of about ``rows`` rows each.

    A scan has no more tasks than its files have row groups, which may hold a million narrow rows each; work that
    takes long per row comes after this.
    """
    n = df.count()
    parts = max(-(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // (rows // 10))), 1)
    return df.repartition(parts)


def _case(key: Column, cases: dict, default=None) -> Column:
    """CASE key WHEN k THEN v ... ELSE default END."""
    expr = None
    for k, v in cases.items():
        val = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    d = default if isinstance(default, Column) or default is None else F.lit(default)
    return expr.otherwise(d) if d is not None else expr


def _s(c: Column) -> Column:
    return c.cast("string")


def atomic_from_events(events: DataFrame) -> DataFrame:
    """Map the driver ``events`` table onto enriched-event columns.

    Every 50th event is delivered twice (one second later), which exercises
    de-duplication.  Rules are those of FIXTURES.md §3; timestamps stay
    ``timestamp_ntz`` as in the source.
    """
    b = (events
         .withColumn("wk", F.date_trunc("week", "ts").cast("date").cast("string"))
         .withColumn("iv", F.floor("value").cast("int")))
    dup = (b.withColumn("redelivery", F.lit(0))
           .unionByName(b.filter(F.col("event_id") % 50 == 0).withColumn("redelivery", F.lit(1))))
    eid, uid, et, iv, wk = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("iv"), F.col("wk")
    return dup.select(
        F.concat(F.lit("e"), _s(eid)).alias("event_id"),
        F.when(eid % 4 == 3, "other-app").otherwise("demo-app").alias("app_id"),
        _case(uid % 5, {0: "mob", 4: "tv"}, "web").alias("platform"),
        _case(et, {"view": "page_view", "click": "page_ping", "signup": "screen_view",
                   "error": "screen_end"}, "transaction").alias("event_name"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("redelivery"))).alias("collector_tstamp"),
        F.col("ts").alias("dvce_created_tstamp"),
        F.col("ts").alias("derived_tstamp"),
        F.when(uid % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("login"), _s(uid))).alias("user_id"),
        F.concat(F.lit("u"), _s(uid)).alias("domain_userid"),
        F.concat(F.lit("u"), _s(uid), F.lit("-"), wk).alias("domain_sessionid"),
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("v"), _s(uid), F.lit("-"), wk, F.lit("-"), _s(eid % 3)))
         .alias("page_view__id"),
        _case(eid % 20, {0: "Mozilla/5.0 (compatible; bingbot/2.0)", 1: F.lit(None).cast("string"),
                         2: "Twitterbot/1.0", 3: "US Robotics modem"},
              "Mozilla/5.0 (X11; Linux x86_64) Firefox/128.0").alias("useragent"),
        _case(eid % 40, {5: "true", 6: "false"}).alias("iab__spider_or_robot"),
        _case(uid % 6, {0: "GB", 1: "us", 2: "FR", 3: "ZZ"}).alias("geo_country"),
        _case(uid % 4, {0: "en-US", 1: "FR", 2: "de"}).alias("br_lang"),
        _case(uid % 4, {0: "en", 1: "fra", 2: "gsw"}).alias("mobile__language"),
        _case(eid % 9, {0: "utm_source=google&utm_medium=cpc&utm_campaign=summer_sale",
                        1: "utm_source=direct&utm_medium=none",
                        2: "utm_medium=Email&utm_source_platform=crm",
                        3: "utm_medium=social&utm_campaign=shoes",
                        4: "utm_medium=video-ad&utm_source=tube",
                        5: "utm_medium=web_push",
                        6: "utm_medium=paid&utm_campaign=eshop",
                        7: ""}).alias("page_urlquery"),
        _case(eid % 5, {
            0: F.concat(F.lit("10."), _s(uid % 256), F.lit("."), _s(eid % 256), F.lit(".7")),
            1: F.concat(F.lit("13.106.106."), _s(eid % 256)),
            2: F.concat(F.lit("149.6.126."), _s(eid % 256)),
            3: F.concat(F.lit("203.0.113."), _s(eid % 256))}).alias("user_ipaddress"),
        _case(eid % 6, {0: "Phone", 1: "Tablet", 2: "Desktop"}).alias("yauaa__device_class"),
        _case(uid % 3, {0: "android", 1: "ios"}).alias("mobile__os_type"),
        _s(eid % 9).alias("session__session_index"),
        F.concat(F.lit("https://shop.example.com/p/"), _s(eid % 17)).alias("page_url"),
        _case(eid % 4, {0: "www.google.com", 1: "shop.example.com", 2: "facebook.com"}).alias("refr_urlhost"),
        _case(eid % 4, {0: "GBP", 1: "USD", 2: "EUR"}).alias("tr_currency"),
        (iv * 20 - 200).alias("pp_xoffset_min"), (iv * 20).alias("pp_xoffset_max"),
        (iv * 30 - 300).alias("pp_yoffset_min"), (iv * 30).alias("pp_yoffset_max"),
        F.when(eid % 13 == 0, 0).otherwise(1200).alias("doc_width"),
        F.when(eid % 13 == 0, 0).otherwise(4000).alias("doc_height"),
        F.lit(1000).cast("int").alias("br_viewwidth"), F.lit(700).cast("int").alias("br_viewheight"),
        F.when(et == "purchase", F.col("value")).alias("tr_total_base"),
        F.when(et == "error", F.concat(_s(iv), F.lit(".5"))).alias("screen_summary__foreground_sec"),
        F.when(et == "error", _s(iv % 10)).alias("screen_summary__last_item_index"),
        F.when(et == "error", F.lit("10")).alias("screen_summary__items_count"),
        F.col("props"),
    )


def atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atomic_from_events(read_table(spark, sf_dir, "events"))


def atomic_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``atomic`` over more tasks than the table's file has row groups."""
    return atomic_from_events(spread(read_table(spark, sf_dir, "events")))
