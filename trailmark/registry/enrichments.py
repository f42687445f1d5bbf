"""Registered enrichment queries (E01-E13, J08-J11, P26) and their oracles.

Inputs the test tables lack (Cookie and header values, link decorations,
exchange rates, IP ranges) are derived from the tables by fixed rules, so
every query's work grows with the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.ip import IPV4_PATTERN
from trailmark.functions.timeutil import epoch_micros
from trailmark.operators import enrich as E
from trailmark.operators import enrich_config as C
from trailmark.operators import intervals
from trailmark.operators import lookups as L
from trailmark.registry.oracle_base import base_ctes, with_ctes
from trailmark.sources.tables import atomic, atomic_spread, read_table

ATOMIC = base_ctes()[:2]
_N = "CAST(substr(event_id, 2) AS BIGINT)"
IPV4_SQL = IPV4_PATTERN.replace("\\", "\\")
REFERERS = [("www.google.com", "search", "Google"), ("facebook.com", "social", "Facebook")]


def _n():
    return F.substring(F.col("event_id"), 2, 20).cast("bigint")


def _size(col: str):
    """Number of elements, NULL for a NULL array whatever the session's dialect."""
    return F.when(F.col(col).isNotNull(), F.size(col))


def referers(spark) -> DataFrame:
    return spark.createDataFrame(REFERERS, "host string, medium string, source string")


def with_headers(df: DataFrame) -> DataFrame:
    """Cookie header and header list derived from the event columns."""
    cookie = F.concat(F.lit("sp="), F.col("domain_userid"), F.lit("; theme="), F.col("platform"),
                      F.when(_n() % 7 == 0, F.lit("; dnt=1")).otherwise(F.lit("")))
    return df.withColumn("cookie", cookie).withColumn("headers", F.array(
        F.struct(F.lit("User-Agent").alias("name"), F.col("useragent").alias("value")),
        F.struct(F.lit("Host").alias("name"), E.url_host(F.col("page_url")).alias("value")),
        F.struct(F.lit("Cookie").alias("name"), F.col("cookie").alias("value"))))


def derived_rates(a: DataFrame) -> DataFrame:
    """One rate per currency and day seen in the data (fixed rule; EUR is the base)."""
    days = a.select(F.to_date("derived_tstamp").alias("rate_date")).distinct()
    d = F.dayofmonth("rate_date")
    return days.select(F.lit("GBP").alias("currency"), "rate_date", (F.lit(1.15) + (d % 5) / 100.0).alias("rate")) \
        .unionByName(days.select(F.lit("USD").alias("currency"), "rate_date",
                                 (F.lit(0.90) + (d % 7) / 100.0).alias("rate")))


def geo_ranges(spark, sf) -> DataFrame:
    """IP ranges from the nation table: nation k owns first octets 10k .. 10k+9."""
    n = read_table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("bigint")
    return n.select((F.shiftleft(k * 10, 24)).alias("lo"),
                    (F.shiftleft(k * 10 + 10, 24) - 1).alias("hi"), F.col("n_name").alias("geo_country"))


def _script(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_id": pdf["event_id"],
                         "script_context": pdf["event_name"].fillna("") + ":" + pdf["platform"].fillna("")})


STEPS = {
    "campaign_attribution": lambda df, p: E.campaign_attribution(df, p),
    "event_fingerprint": lambda df, p: E.event_fingerprint(df, p),
}


def q_event_pipeline(s, sf):
    steps = dict(STEPS, referer_parser=lambda df, p: E.referer_parser(df, referers(s), p))
    conf = {"campaign_attribution": {"enabled": True, "parameters": {"fields": E.CAMPAIGN_FIELDS}},
            "event_fingerprint": {"enabled": True, "parameters": {"excludeParameters": E.FINGERPRINT_EXCLUDE}},
            "referer_parser": {"enabled": True, "parameters": {"internalDomains": []}},
            "anon_ip": {"enabled": False, "parameters": {"anonOctets": 1}}}
    out = E.event_pipeline(atomic(s, sf), conf, steps)
    return out.select("event_id", "mkt_medium", "mkt_source", "mkt_campaign", "event_fingerprint",
                      "refr_medium", "refr_source")


def _pages_query():
    return F.regexp_extract(F.col("url"), r"\?([^#]*)", 1)


def overlapping_ranges(spark, sf) -> DataFrame:
    """Dense intervals of 0 .. 131071 from the orders, many of them nested, equally wide or the same."""
    o = read_table(spark, sf, "orders")
    lo = (F.col("o_orderkey") * 37) % 120000
    width = F.when(F.col("o_custkey") % 9 == 0, 4096).otherwise((F.col("o_custkey") % 5) * 3)
    return o.select(lo.cast("long").alias("lo"), (lo + width).cast("long").alias("hi"),
                    F.col("o_orderpriority").alias("owner"), F.col("o_orderkey").cast("long").alias("of"))


def q_interval_lookup(s, sf):
    points = read_table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    at = (F.col("l_partkey") * 61 + F.col("l_suppkey") * 7).cast("long") % 140000
    return intervals.lookup(points, overlapping_ranges(s, sf), at, ["owner", "of"], bits=17).select(
        "l_orderkey", "l_linenumber", "owner", "of")


def q_currency_items(s, sf):
    """Item prices in their own currency, transaction totals in theirs."""
    li = read_table(s, sf, "lineitem")
    money = F.array(F.lit("EUR"), F.lit("GBP"), F.lit("USD"), F.lit("CHF"))
    rows = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("ti_price"),
                     F.get(money, (F.col("l_orderkey") % 4).cast("int")).alias("ti_currency"),
                     F.col("l_quantity").cast("double").alias("tr_total"),
                     F.get(money, (F.col("l_linenumber") % 4).cast("int")).alias("tr_currency"),
                     F.col("l_shipdate").cast("timestamp_ntz").alias("derived_tstamp"))
    return L.currency_conversion(rows, derived_rates(rows)).select(
        "l_orderkey", "l_linenumber", F.round("ti_price_base", 4).alias("ti_price_base"),
        F.round("tr_total_base", 4).alias("tr_total_base"))


LOOKUP = {
    "inputs": [{"placeholder": 2, "pojo": {"field": "kind"}},
               {"placeholder": 1, "json": {"field": "unstruct_event", "schemaCriterion": "iglu:com.acme/order/jsonschema/1-*-*",
                                           "jsonPath": "$.order.customer"}}],
    "query": {"sql": "SELECT o_orderkey, o_orderstatus AS status FROM lookup_orders WHERE CAST(o_custkey AS STRING) = ? "
                     "AND o_orderpriority = ? AND o_comment_mark <> '?'"},
    "output": {"expectedRows": "AT_MOST_ONE", "json": {"schema": "iglu:com.acme/user/jsonschema/1-0-0"}},
}


def q_sql_json_path(s, sf):
    """Lookup by a value inside the event's own JSON (a schema criterion and a path) and by a column."""
    e = read_table(s, sf, "events")
    version = F.when(F.col("event_id") % 5 == 0, "2-0-0").otherwise("1-0-2")
    rows = e.select("event_id", F.lit("1-URGENT").alias("kind"), F.concat(
        F.lit('{"schema":"env","data":{"schema":"iglu:com.acme/order/jsonschema/'), version,
        F.lit('","data":{"order":{"customer":'), F.col("user_id").cast("string"), F.lit("}}}}")).alias("unstruct_event"))
    read_table(s, sf, "orders").withColumn("o_comment_mark", F.lit("-")).createOrReplaceTempView("lookup_orders")
    got = L.sql_query_enrichment(rows, LOOKUP, "found")
    return got.select("event_id", F.get("found", 0)["data"]["o_orderkey"].cast("long").alias("orderkey"),
                      F.get("found", 0)["data"]["status"].alias("status"), _size("found").alias("n"),
                      F.col("found_failure").alias("failure"))


def _file(spark, folder: str, name: str, text: str) -> None:
    """A text file of the shared folder, as a configuration store holds it."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")


def iab_folder(spark) -> str:
    """The robot lists of the fixture as files in their distributed format, with comments and escapes."""
    import uuid

    from trailmark.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark).rstrip('/')}/config/{uuid.uuid4().hex}"
    _file(spark, folder, "exclude_current.txt", "# robots\nBot|1|robotics|0|0|0\n\nspider|1||0|2|0\ntwitter|1||0|1|1\nmodem|0||0|0|0\n"
                                                "a%7Cb|1|x%2Cy|0|1|0")
    _file(spark, folder, "include_current.txt", "# browsers\nMozilla|1|1\ntwitter|1|0")
    _file(spark, folder, "ip_exclude_current_cidr.txt", "\n".join(
        r["cidr"] for r in L.fixture_iab_lists(spark)["cidr"].collect()))
    return folder


def q_iab_files(s, sf):
    return L.iab_spiders_robots(atomic(s, sf), L.read_iab_lists(s, iab_folder(s))).select(
        "event_id", "iab__spider_or_robot", "iab__category", "iab__reason", "iab__primary_impact")


def config_folder(spark) -> str:
    """A folder of the thirteen configurations, one JSON file each, and the files that they name."""
    import json

    folder = iab_folder(spark)
    _file(spark, folder, "referers.json", json.dumps({"search": {"Google": {"domains": ["www.google.com"]}},
                                                      "social": {"Facebook": {"domains": ["facebook.com"], "parameters": []}}}))
    params = {
        "campaign_attribution": {"mapping": "static", "fields": E.CAMPAIGN_FIELDS},
        "event_fingerprint_config": {"excludeParameters": E.FINGERPRINT_EXCLUDE, "hashAlgorithm": "SHA1"},
        "referer_parser": {"database": "referers.json", "internalDomains": [], "uri": folder},
        "cross_navigation_config": None,
        "cookie_extractor_config": {"cookies": ["sp", "dnt"]},
        "http_header_extractor_config": {"headersPattern": "User-Agent|Host"},
        "currency_conversion_config": {"baseCurrency": "EUR", "rateAt": "EOD_PRIOR"},
        "ip_lookups": {"geo": {"database": "ranges", "uri": folder}},
        "iab_spiders_and_robots_enrichment": {k: {"database": f, "uri": folder} for k, f in (
            ("ipFile", "ip_exclude_current_cidr.txt"), ("excludeUseragentFile", "exclude_current.txt"),
            ("includeUseragentFile", "include_current.txt"))},
        "sql_query_enrichment_config": {
            "inputs": [{"placeholder": 1, "pojo": {"field": "user_id"}}],
            "query": {"sql": "SELECT c_name FROM lookup_customers WHERE key = ? LIMIT 1"},
            "output": {"expectedRows": "AT_MOST_ONE", "json": {"schema": "iglu:com.acme/user/jsonschema/1-0-0"}}},
        "anon_ip": {"anonOctets": 1},
        "javascript_script_config": {"script": "="},
        "pii_enrichment_config": {"pii": [{"pojo": {"field": "user_id"}}],
                                  "strategy": {"pseudonymize": {"hashFunction": "SHA-1", "salt": "salty"}}},
    }
    for name, p in params.items():
        data = {"name": name, "vendor": "com.acme", "enabled": True} | ({} if p is None else {"parameters": p})
        _file(spark, f"{folder}/enrichments", f"{name}.json", json.dumps({"schema": "config", "data": data}, indent=4))
    return f"{folder}/enrichments"


def _script_text(pdf: pd.DataFrame) -> pd.Series:
    return pdf["event_name"].fillna("") + ":" + pdf["platform"].fillna("")


def q_pipeline_from_directory(s, sf):
    """All thirteen enrichments, loaded by name from a folder; one is then switched off by a newer file of its name."""
    a = with_headers(atomic_spread(s, sf)).withColumn("page_url", F.concat("page_url", F.when(_n() % 3 == 0, F.concat(
        F.lit("?_sp="), F.col("domain_userid"), F.lit(".1700000000000"))).otherwise(F.lit(""))))
    read_table(s, sf, "customer").withColumn(
        "key", F.concat(F.lit("login"), F.col("c_custkey").cast("string"))).createOrReplaceTempView("lookup_customers")
    configs = C.read_configs(s, config_folder(s))
    assert set(configs) == set(C.CONFIG_STEPS)
    configs = C.put_config(configs, {"data": {**configs["anon_ip"], "parameters": {"anonOctets": 2}}})
    a = a.withColumn("tr_total", F.col("tr_total_base"))
    done = C.run(a, configs, C.Resources(rates=derived_rates(a), ip_ranges=geo_ranges(s, sf), ip_outputs=["geo_country"],
                                         script=_script_text, script_inputs=["event_name", "platform"]))
    return done.select(
        "event_id", "mkt_medium", "mkt_source", "mkt_campaign", "event_fingerprint", "refr_medium", "refr_source",
        "refr_domain_userid", _size("cookie_context").alias("n_cookies"), _size("header_context").alias("n_headers"),
        F.round("tr_total_base", 6).alias("tr_total_base"), "geo_country", "iab__reason", "iab__primary_impact",
        F.get("sql_query_context", 0)["data"]["c_name"].alias("c_name"), "user_ipaddress", "script_context", "user_id")


QUERIES = {
    "interval_lookup_overlapping": q_interval_lookup,
    "currency_conversion_items": q_currency_items,
    "sql_lookup_json_path": q_sql_json_path,
    "iab_lists_from_files": q_iab_files,
    "event_pipeline_from_directory": q_pipeline_from_directory,
    "campaign_attribution": lambda s, sf: E.campaign_attribution(atomic(s, sf)).select(
        "event_id", "mkt_medium", "mkt_source", "mkt_term", "mkt_content", "mkt_campaign"),
    "campaign_attribution_pages": lambda s, sf: E.campaign_attribution(
        read_table(s, sf, "pages").withColumn("q", _pages_query()), query_col="q").select(
        "page_id", "mkt_medium", "mkt_source", "mkt_term", "mkt_content", "mkt_campaign"),
    "event_fingerprint": lambda s, sf: E.event_fingerprint(atomic(s, sf)).select("event_id", "event_fingerprint"),
    "event_fingerprint_pages": lambda s, sf: E.event_fingerprint(
        read_table(s, sf, "pages").withColumn("q", _pages_query()), query_col="q").select("page_id", "event_fingerprint"),
    "referer_parser": lambda s, sf: E.referer_parser(atomic(s, sf), referers(s)).select(
        "event_id", "refr_urlhost", "refr_medium", "refr_source"),
    "anon_ip": lambda s, sf: E.anon_ip(atomic(s, sf)).select("event_id", "user_ipaddress"),
    "anon_ip_two_octets": lambda s, sf: E.anon_ip(atomic(s, sf), {"anonOctets": 2}).select("event_id", "user_ipaddress"),
    "pii_pseudonymize": lambda s, sf: E.pii_pseudonymize(atomic(s, sf)).select("event_id", "user_id"),
    "pii_events": lambda s, sf: E.pii_events(atomic(s, sf)),
    "ip_in_cidr": lambda s, sf: L.ip_in_cidr(atomic(s, sf), L.fixture_iab_lists(s)["cidr"]).select(
        "event_id", "user_ipaddress", "ip_excluded"),
    "ua_pattern_join": lambda s, sf: (lambda lists: L.ua_pattern_flags(
        atomic(s, sf), lists["exclude"], lists["include"]).select(
        F.col("__ua").alias("useragent"), F.col("__included").alias("included"),
        F.col("__excluded").alias("excluded"), F.col("__impact").alias("impact")))(L.fixture_iab_lists(s)),
    "iab_spiders_robots": lambda s, sf: L.iab_spiders_robots(atomic(s, sf), L.fixture_iab_lists(s)).select(
        "event_id", "iab__spider_or_robot", "iab__category", "iab__reason", "iab__primary_impact"),
    "ip_geo_lookup": lambda s, sf: L.ip_range_lookup(atomic(s, sf), geo_ranges(s, sf), ["geo_country"]).select(
        "event_id", "user_ipaddress", "geo_country"),
    "sql_lookup_enrich": lambda s, sf: L.sql_lookup_enrich(
        read_table(s, sf, "events"), read_table(s, sf, "customer"), "user_id", "c_custkey",
        ["c_name", "c_mktsegment"]).select("event_id", "user_id", F.col("lookup_context.c_name").alias("c_name"),
                                           F.col("lookup_context.c_mktsegment").alias("c_mktsegment"),
                                           "lookup_context_failure"),
    "rate_lookup_join": lambda s, sf: (lambda a: L.rate_lookup(a, derived_rates(a), "tr_currency", "derived_tstamp")
                                       .select("event_id", "tr_currency", "rate"))(atomic(s, sf)),
    "currency_conversion": lambda s, sf: (lambda a: L.currency_conversion(
        a, derived_rates(a), fields={"tr_total_base": "tr_total_converted"}).select(
        "event_id", "tr_currency", "tr_total_base", "tr_total_converted"))(atomic(s, sf)),
    "cookie_extractor": lambda s, sf: E.cookie_extractor(with_headers(atomic(s, sf)), {"cookies": ["sp", "dnt"]})
        .select("event_id", F.explode("cookie_context").alias("c")).select("event_id", "c.name", "c.value"),
    "http_header_extractor": lambda s, sf: E.http_header_extractor(
        with_headers(atomic(s, sf)), {"headersPattern": "User-Agent|Host"})
        .select("event_id", F.explode("header_context").alias("h")).select("event_id", "h.name", "h.value"),
    "do_not_track_filter": lambda s, sf: E.do_not_track_filter(with_headers(atomic(s, sf))).select("event_id"),
    "cross_navigation": lambda s, sf: E.cross_navigation(atomic(s, sf).withColumn(
        "page_url", F.concat(F.col("page_url"), F.when(_n() % 3 == 0, F.concat(
            F.lit("?_sp="), F.col("domain_userid"), F.lit("."),
            (epoch_micros(F.col("derived_tstamp")) / 1000).cast("bigint").cast("string"))).otherwise(F.lit("")))))
        .select("event_id", "refr_domain_userid", "refr_dvce_tstamp"),
    "custom_script": lambda s, sf: E.custom_script(atomic(s, sf).select("event_id", "event_name", "platform"),
                                                   _script, "event_id string, script_context string"),
    "event_pipeline": q_event_pipeline,
}


def _qp(name, q):
    from trailmark.registry.oracle_base import qp
    return qp(name, q)


def _fp(q):
    """Pairs in order of key, then pair."""
    return (f"CASE WHEN {q} IS NOT NULL THEN sha1(array_to_string(list_transform(list_sort(list_transform("
            f"list_filter(string_split({q}, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('cv', 'eid', 'nuid', 'stm')), "
            f"lambda x: {{'k': split_part(x, '=', 1), 'p': x}})), lambda x: x.p), '&')) END")


HOST_SQL = "regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)"
REF_VALUES = "(VALUES " + ", ".join(f"('{h}', '{m}', '{s}')" for h, m, s in REFERERS) + ") r(host, medium, source)"
REFERER_SQL = (f"SELECT a.event_id, a.refr_urlhost, CASE WHEN a.refr_urlhost IS NULL THEN NULL "
               f"WHEN lower(a.refr_urlhost) = lower({HOST_SQL.replace('page_url', 'a.page_url')}) THEN 'internal' "
               f"ELSE coalesce(r.medium, 'unknown') END AS refr_medium, CASE WHEN a.refr_urlhost IS NULL OR "
               f"lower(a.refr_urlhost) = lower({HOST_SQL.replace('page_url', 'a.page_url')}) THEN NULL ELSE r.source END "
               f"AS refr_source FROM atomic a LEFT JOIN {REF_VALUES} ON lower(a.refr_urlhost) = lower(r.host)")


def _ip_long(col):
    parts = [f"CAST(regexp_extract({col}, '{IPV4_SQL}', {i}) AS BIGINT)" for i in range(1, 5)]
    return (f"CASE WHEN regexp_matches({col}, '{IPV4_SQL}') THEN "
            f"(({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]} END")


def _cidr_values():
    rows = []
    for c in ["10.0.0.0/8", "127.0.0.0/8", "13.106.106.0/24", "131.253.24.0/21", "149.6.126.128/27"]:
        ip, p = c.split("/")
        base = 0
        for o in ip.split("."):
            base = base * 256 + int(o)
        size = 1 << (32 - int(p))
        lo = base - base % size
        rows.append(f"({lo}, {lo + size - 1})")
    return "(VALUES " + ", ".join(rows) + ") c(lo, hi)"


EXC_VALUES = ("(VALUES ('bot', 1, 'robotics', 0, 0, 0), ('spider', 1, '', 0, 2, 0), ('twitter', 1, '', 0, 1, 1), "
              "('modem', 0, '', 0, 0, 0)) x(pattern, active, exceptions, two_pass_redundant, impact, starts_with)")
INC_VALUES = "(VALUES ('mozilla', 1, 1), ('twitter', 1, 0)) i(pattern, active, starts_with)"


def _match(ua, pat, sw):
    return f"CASE WHEN {sw} = 1 THEN starts_with(lower({ua}), lower({pat})) ELSE contains(lower({ua}), lower({pat})) END"


UA_FLAGS_CTE = f"""uaf AS (SELECT ua,
    coalesce((SELECT bool_or({_match('u.ua', 'i.pattern', 'i.starts_with')}) FROM {INC_VALUES} WHERE i.active = 1), false) AS included,
    (SELECT max(x.impact) FROM {EXC_VALUES} WHERE x.active = 1 AND {_match('u.ua', 'x.pattern', 'x.starts_with')}
       AND len(list_filter(string_split(lower(x.exceptions), ','), lambda e: e <> '' AND contains(lower(u.ua), e))) = 0) AS impact
  FROM (SELECT DISTINCT useragent AS ua FROM atomic) u)"""
IP_CTE = (f"ipf AS (SELECT event_id, useragent, user_ipaddress, EXISTS (SELECT 1 FROM {_cidr_values()} "
          f"WHERE {_ip_long('user_ipaddress')} BETWEEN c.lo AND c.hi) AS ipx FROM atomic)")
REASON = ("CASE WHEN ipx THEN 'FAILED_IP_EXCLUDE' WHEN NOT included THEN 'FAILED_UA_INCLUDE' "
          "WHEN impact IS NOT NULL THEN 'FAILED_UA_EXCLUDE' ELSE 'PASSED_ALL' END")
IAB_SQL = (f"SELECT event_id, reason <> 'PASSED_ALL' AS iab__spider_or_robot, CASE WHEN reason = 'PASSED_ALL' "
           f"THEN 'BROWSER' ELSE 'SPIDER_OR_ROBOT' END AS iab__category, reason AS iab__reason, "
           f"CASE WHEN reason = 'PASSED_ALL' THEN 'NONE' WHEN reason = 'FAILED_UA_EXCLUDE' THEN CASE impact WHEN 0 "
           f"THEN 'PAGE_IMPRESSIONS' WHEN 1 THEN 'AD_IMPRESSIONS' ELSE 'PAGE_AND_AD_IMPRESSIONS' END ELSE 'UNKNOWN' END "
           f"AS iab__primary_impact FROM (SELECT p.event_id, p.ipx, f.included, f.impact, {REASON} AS reason "
           f"FROM ipf p JOIN uaf f ON p.useragent IS NOT DISTINCT FROM f.ua)")

RATES_CTE = ("rates AS (SELECT cur AS currency, d AS rate_date, CASE cur WHEN 'GBP' THEN 1.15 + (day(d) % 5) / 100.0 "
             "ELSE 0.90 + (day(d) % 7) / 100.0 END AS rate FROM (SELECT DISTINCT CAST(derived_tstamp AS DATE) AS d "
             "FROM atomic) days, (VALUES ('GBP'), ('USD')) c(cur))")
RATE_SQL = ("SELECT a.event_id, a.tr_currency, CASE WHEN a.tr_currency = 'EUR' THEN 1.0 ELSE CAST(r.rate AS DOUBLE) END "
            "AS rate, a.tr_total_base FROM atomic a LEFT JOIN rates r ON a.tr_currency = r.currency AND "
            "CAST(a.derived_tstamp AS DATE) = r.rate_date + INTERVAL 1 DAY")

PAGES_Q = "regexp_extract(url, '\\?([^#]*)', 1)"
MKT = ("mkt_medium", "mkt_source", "mkt_term", "mkt_content", "mkt_campaign")
MKT_P = ("utm_medium", "utm_source", "utm_term", "utm_content", "utm_campaign")

def _rate(currency: str, day: str) -> str:
    """Rate of a currency at the close of the day before, where the data have that day."""
    prior = f"(CAST({day} AS DATE) - INTERVAL 1 DAY)"
    return (f"CASE WHEN {currency} = 'EUR' THEN 1.0::DOUBLE WHEN CAST({prior} AS DATE) NOT IN (SELECT d FROM days) THEN NULL "
            f"WHEN {currency} = 'GBP' THEN 1.15::DOUBLE + (day({prior}) % 5) / 100.0::DOUBLE "
            f"WHEN {currency} = 'USD' THEN 0.90::DOUBLE + (day({prior}) % 7) / 100.0::DOUBLE END")


_MONEY = "['EUR', 'GBP', 'USD', 'CHF']"
_URL3 = f"(a.page_url || CASE WHEN {_N.replace('event_id', 'a.event_id')} % 3 = 0 THEN '?_sp=' || a.domain_userid || '.1700000000000' ELSE '' END)"
DIRECTORY_SQL = with_ctes(ATOMIC + [IP_CTE, UA_FLAGS_CTE, RATES_CTE], f"""
SELECT a.event_id, {_qp('utm_medium', 'a.page_urlquery')} AS mkt_medium, {_qp('utm_source', 'a.page_urlquery')} AS mkt_source,
  {_qp('utm_campaign', 'a.page_urlquery')} AS mkt_campaign, {_fp('a.page_urlquery')} AS event_fingerprint,
  rf.refr_medium, rf.refr_source,
  CASE WHEN {_N.replace('event_id', 'a.event_id')} % 3 = 0 THEN a.domain_userid END AS refr_domain_userid,
  CASE WHEN a.domain_userid IS NULL OR a.platform IS NULL THEN NULL WHEN {_N.replace('event_id', 'a.event_id')} % 7 = 0 THEN 2 ELSE 1 END AS n_cookies,
  2 AS n_headers, round(rt.tr_total_base * rt.rate, 6) AS tr_total_base, n.n_name AS geo_country,
  ib.iab__reason, ib.iab__primary_impact, c.c_name,
  CASE WHEN regexp_matches(a.user_ipaddress, '{IPV4_SQL}') THEN regexp_replace(a.user_ipaddress, '\\.[0-9]+\\.[0-9]+$', '.x.x')
       ELSE a.user_ipaddress END AS user_ipaddress,
  coalesce(a.event_name, '') || ':' || coalesce(a.platform, '') AS script_context, sha1(a.user_id || 'salty') AS user_id
FROM atomic a JOIN (SELECT DISTINCT * FROM ({REFERER_SQL})) rf ON rf.event_id = a.event_id
JOIN (SELECT DISTINCT * FROM ({RATE_SQL})) rt ON rt.event_id = a.event_id
JOIN (SELECT DISTINCT * FROM ({IAB_SQL})) ib ON ib.event_id = a.event_id
LEFT JOIN nation n ON ({_ip_long('a.user_ipaddress')}) // 167772160 = n.n_nationkey
LEFT JOIN customer c ON 'login' || CAST(c.c_custkey AS VARCHAR) = a.user_id""")

ORACLE = {
    "interval_lookup_overlapping": """
WITH r AS (SELECT *, lo + CASE WHEN o_custkey % 9 = 0 THEN 4096 ELSE (o_custkey % 5) * 3 END AS hi
           FROM (SELECT (o_orderkey * 37) % 120000 AS lo, o_custkey, o_orderpriority AS owner, o_orderkey AS "of" FROM orders)),
p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 61 + l_suppkey * 7) % 140000 AS x FROM lineitem),
u AS (SELECT DISTINCT x FROM p),
b AS (SELECT x, min({'w': hi - lo, 'lo': lo, 'owner': owner, 'of': CAST("of" AS BIGINT)}) AS best FROM u JOIN r ON x BETWEEN lo AND hi GROUP BY x)
SELECT l_orderkey, l_linenumber, best.owner AS owner, best."of" AS "of" FROM p LEFT JOIN b USING (x)""",
    "currency_conversion_items": f"""
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(CAST(l_extendedprice AS DOUBLE) * {_rate(f"{_MONEY}[l_orderkey % 4 + 1]", "l_shipdate")}, 4) AS ti_price_base,
       round(CAST(l_quantity AS DOUBLE) * {_rate(f"{_MONEY}[l_linenumber % 4 + 1]", "l_shipdate")}, 4) AS tr_total_base
FROM lineitem""",
    "sql_lookup_json_path": """
WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS k, min(o_orderstatus) AS s FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 AND event_id % 5 <> 0 THEN k END AS orderkey,
       CASE WHEN n = 1 AND event_id % 5 <> 0 THEN s END AS status,
       CASE WHEN event_id % 5 = 0 OR n > 1 THEN NULL ELSE coalesce(n, 0) END AS n,
       CASE WHEN event_id % 5 <> 0 AND n > 1 THEN 'expected AT_MOST_ONE, found ' || n END AS failure
FROM events LEFT JOIN o ON o_custkey = user_id""",
    "iab_lists_from_files": with_ctes(ATOMIC + [IP_CTE, UA_FLAGS_CTE], IAB_SQL),
    "event_pipeline_from_directory": DIRECTORY_SQL,
    "campaign_attribution": with_ctes(ATOMIC, "SELECT event_id, " + ", ".join(
        f"{_qp(p, 'page_urlquery')} AS {c}" for c, p in zip(MKT, MKT_P)) + " FROM atomic"),
    "campaign_attribution_pages": f"SELECT page_id, " + ", ".join(
        f"{_qp(p, PAGES_Q)} AS {c}" for c, p in zip(MKT, MKT_P)) + " FROM pages",
    "event_fingerprint": with_ctes(ATOMIC, f"SELECT event_id, {_fp('page_urlquery')} AS event_fingerprint FROM atomic"),
    "event_fingerprint_pages": f"SELECT page_id, {_fp(PAGES_Q)} AS event_fingerprint FROM pages",
    "referer_parser": with_ctes(ATOMIC, REFERER_SQL),
    "anon_ip": with_ctes(ATOMIC, f"SELECT event_id, CASE WHEN regexp_matches(user_ipaddress, '{IPV4_SQL}') THEN "
                                 "regexp_replace(user_ipaddress, '\\.[0-9]+$', '.x') ELSE user_ipaddress END AS user_ipaddress FROM atomic"),
    "anon_ip_two_octets": with_ctes(ATOMIC, f"SELECT event_id, CASE WHEN regexp_matches(user_ipaddress, '{IPV4_SQL}') THEN "
                                    "regexp_replace(user_ipaddress, '\\.[0-9]+\\.[0-9]+$', '.x.x') ELSE user_ipaddress END "
                                    "AS user_ipaddress FROM atomic"),
    "pii_pseudonymize": with_ctes(ATOMIC, "SELECT event_id, sha1(user_id || 'salty') AS user_id FROM atomic"),
    "pii_events": with_ctes(ATOMIC, "SELECT event_id, 'user_id' AS field, user_id AS original, sha1(user_id || 'salty') "
                                    "AS hashed FROM atomic WHERE user_id IS NOT NULL"),
    "ip_in_cidr": with_ctes(ATOMIC + [IP_CTE], "SELECT event_id, user_ipaddress, ipx AS ip_excluded FROM ipf"),
    "ua_pattern_join": with_ctes(ATOMIC + [UA_FLAGS_CTE], "SELECT ua AS useragent, included, impact IS NOT NULL AS excluded, "
                                                          "impact FROM uaf"),
    "iab_spiders_robots": with_ctes(ATOMIC + [IP_CTE, UA_FLAGS_CTE], IAB_SQL),
    "ip_geo_lookup": with_ctes(ATOMIC, f"SELECT a.event_id, a.user_ipaddress, n.n_name AS geo_country FROM atomic a "
                                       f"LEFT JOIN nation n ON ({_ip_long('a.user_ipaddress')}) // 167772160 = n.n_nationkey"),
    "sql_lookup_enrich": "SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment, CAST(NULL AS VARCHAR) AS lookup_context_failure "
                         "FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey",
    "rate_lookup_join": with_ctes(ATOMIC + [RATES_CTE], f"SELECT event_id, tr_currency, rate FROM ({RATE_SQL})"),
    "currency_conversion": with_ctes(ATOMIC + [RATES_CTE], "SELECT event_id, tr_currency, tr_total_base, "
                                     f"tr_total_base * rate AS tr_total_converted FROM ({RATE_SQL})"),
    "cookie_extractor": with_ctes(ATOMIC, f"SELECT event_id, 'sp' AS name, domain_userid AS value FROM atomic UNION ALL "
                                          f"SELECT event_id, 'dnt', '1' FROM atomic WHERE {_N} % 7 = 0"),
    "http_header_extractor": with_ctes(ATOMIC, f"SELECT event_id, 'User-Agent' AS name, useragent AS value FROM atomic "
                                               f"UNION ALL SELECT event_id, 'Host', {HOST_SQL} FROM atomic"),
    "custom_script": with_ctes(ATOMIC, "SELECT event_id, coalesce(event_name, '') || ':' || coalesce(platform, '') "
                                       "AS script_context FROM atomic"),
    "do_not_track_filter": with_ctes(ATOMIC, f"SELECT event_id FROM atomic WHERE {_N} % 7 <> 0"),
    "cross_navigation": with_ctes(ATOMIC, f"SELECT event_id, CASE WHEN {_N} % 3 = 0 THEN domain_userid END AS refr_domain_userid, "
                                          f"CASE WHEN {_N} % 3 = 0 THEN make_timestamp((epoch_us(derived_tstamp) // 1000) * 1000) END "
                                          "AS refr_dvce_tstamp FROM atomic"),
    "event_pipeline": with_ctes(ATOMIC, REFERER_SQL.replace(
        "SELECT a.event_id, a.refr_urlhost,",
        f"SELECT a.event_id, {_qp('utm_medium', 'a.page_urlquery')} AS mkt_medium, "
        f"{_qp('utm_source', 'a.page_urlquery')} AS mkt_source, {_qp('utm_campaign', 'a.page_urlquery')} AS mkt_campaign, "
        f"{_fp('a.page_urlquery')} AS event_fingerprint,")),
}
