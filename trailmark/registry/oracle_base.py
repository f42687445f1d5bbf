"""DuckDB oracle SQL: the ``atomic`` fixture and the model layers as CTEs.

These statements are an independent formulation of each operator (windows
where the engine uses group-and-join, ``count(DISTINCT …)`` where it
pre-aggregates) run by DuckDB on the same parquet tables.
"""

from __future__ import annotations

from trailmark.functions import rules
from trailmark.functions.contracts import ATOMIC_FIELDS, ENTITY_FIELD_TYPES, TIMESTAMP_FIELDS, atomic_type, entity_columns
from trailmark.plans.events import DERIVED_COLUMNS

ATOMIC_SQL = """
SELECT
  'e' || CAST(event_id AS VARCHAR) AS event_id,
  CASE event_id % 4 WHEN 3 THEN 'other-app' ELSE 'demo-app' END AS app_id,
  CASE user_id % 5 WHEN 0 THEN 'mob' WHEN 4 THEN 'tv' ELSE 'web' END AS platform,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'page_ping'
       WHEN 'signup' THEN 'screen_view' WHEN 'error' THEN 'screen_end' ELSE 'transaction' END AS event_name,
  ts + INTERVAL '1' SECOND * redelivery AS collector_tstamp,
  ts AS dvce_created_tstamp,
  ts AS derived_tstamp,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'login' || CAST(user_id AS VARCHAR) END AS user_id,
  'u' || CAST(user_id AS VARCHAR) AS domain_userid,
  'u' || CAST(user_id AS VARCHAR) || '-' || wk AS domain_sessionid,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE 'v' || CAST(user_id AS VARCHAR) || '-' || wk || '-' || CAST(event_id % 3 AS VARCHAR) END AS page_view__id,
  CASE event_id % 20 WHEN 0 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 1 THEN NULL
       WHEN 2 THEN 'Twitterbot/1.0' WHEN 3 THEN 'US Robotics modem' ELSE 'Mozilla/5.0 (X11; Linux x86_64) Firefox/128.0' END AS useragent,
  CASE event_id % 40 WHEN 5 THEN 'true' WHEN 6 THEN 'false' ELSE NULL END AS iab__spider_or_robot,
  CASE user_id % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'us' WHEN 2 THEN 'FR' WHEN 3 THEN 'ZZ' ELSE NULL END AS geo_country,
  CASE user_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'FR' WHEN 2 THEN 'de' ELSE NULL END AS br_lang,
  CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fra' WHEN 2 THEN 'gsw' ELSE NULL END AS mobile__language,
  CASE event_id % 9 WHEN 0 THEN 'utm_source=google&utm_medium=cpc&utm_campaign=summer_sale'
       WHEN 1 THEN 'utm_source=direct&utm_medium=none' WHEN 2 THEN 'utm_medium=Email&utm_source_platform=crm'
       WHEN 3 THEN 'utm_medium=social&utm_campaign=shoes' WHEN 4 THEN 'utm_medium=video-ad&utm_source=tube'
       WHEN 5 THEN 'utm_medium=web_push' WHEN 6 THEN 'utm_medium=paid&utm_campaign=eshop' WHEN 7 THEN '' ELSE NULL END AS page_urlquery,
  CASE event_id % 5 WHEN 0 THEN '10.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) || '.7'
       WHEN 1 THEN '13.106.106.' || CAST(event_id % 256 AS VARCHAR)
       WHEN 2 THEN '149.6.126.' || CAST(event_id % 256 AS VARCHAR)
       WHEN 3 THEN '203.0.113.' || CAST(event_id % 256 AS VARCHAR) ELSE NULL END AS user_ipaddress,
  CASE event_id % 6 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Tablet' WHEN 2 THEN 'Desktop' ELSE NULL END AS yauaa__device_class,
  CASE user_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE NULL END AS mobile__os_type,
  CAST(event_id % 9 AS VARCHAR) AS session__session_index,
  'https://shop.example.com/p/' || CAST(event_id % 17 AS VARCHAR) AS page_url,
  CASE event_id % 4 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'shop.example.com' WHEN 2 THEN 'facebook.com' ELSE NULL END AS refr_urlhost,
  CASE event_id % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE NULL END AS tr_currency,
  iv * 20 - 200 AS pp_xoffset_min, iv * 20 AS pp_xoffset_max,
  iv * 30 - 300 AS pp_yoffset_min, iv * 30 AS pp_yoffset_max,
  CASE event_id % 13 WHEN 0 THEN 0 ELSE 1200 END AS doc_width,
  CASE event_id % 13 WHEN 0 THEN 0 ELSE 4000 END AS doc_height,
  CAST(1000 AS INT) AS br_viewwidth, CAST(700 AS INT) AS br_viewheight,
  CASE event_type WHEN 'purchase' THEN value ELSE NULL END AS tr_total_base,
  CASE WHEN event_type = 'error' THEN CAST(iv AS VARCHAR) || '.5' END AS screen_summary__foreground_sec,
  CASE WHEN event_type = 'error' THEN CAST(iv % 10 AS VARCHAR) END AS screen_summary__last_item_index,
  CASE WHEN event_type = 'error' THEN '10' END AS screen_summary__items_count,
  props
FROM (
  SELECT b.*, 0 AS redelivery FROM b
  UNION ALL
  SELECT b.*, 1 AS redelivery FROM b WHERE event_id % 50 = 0
) dup
"""

FIXTURE_COLUMNS = (
    "event_id", "app_id", "platform", "event_name", "collector_tstamp", "dvce_created_tstamp",
    "derived_tstamp", "user_id", "domain_userid", "domain_sessionid", "page_view__id", "useragent",
    "iab__spider_or_robot", "geo_country", "br_lang", "mobile__language", "page_urlquery",
    "user_ipaddress", "yauaa__device_class", "mobile__os_type", "session__session_index", "page_url",
    "refr_urlhost", "tr_currency", "pp_xoffset_min", "pp_xoffset_max", "pp_yoffset_min",
    "pp_yoffset_max", "doc_width", "doc_height", "br_viewwidth", "br_viewheight", "tr_total_base",
    "screen_summary__foreground_sec", "screen_summary__last_item_index", "screen_summary__items_count",
    "props",
)
MKT_COLUMNS = ("mkt_medium", "mkt_source", "mkt_term", "mkt_content", "mkt_campaign")

DUCK_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
              "bigint": "BIGINT", "timestamp_ntz": "TIMESTAMP"}


def spark_type_of(name: str) -> str:
    if name in TIMESTAMP_FIELDS:
        return "timestamp_ntz"
    if name in ATOMIC_FIELDS:
        return atomic_type(name)
    return ENTITY_FIELD_TYPES.get(name, "string")


def null_of(name: str) -> str:
    return f"CAST(NULL AS {DUCK_TYPES[spark_type_of(name)]}) AS {name}"


def qp(name: str, q: str = "page_urlquery") -> str:
    raw = f"regexp_extract({q}, '(?:^|&){name}=([^&#]*)', 1)"
    return (f"CASE WHEN regexp_matches({q}, '(^|&){name}=') "
            f"THEN coalesce(url_decode(replace({raw}, '+', ' ')), {raw}) END")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(sql_str(v) for v in vals) + ")"


def full_match(expr: str, pattern: str) -> str:
    return f"regexp_full_match({expr}, {sql_str(pattern)})"


def platform_name_sql(col: str = "platform") -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in rules.PLATFORM_NAMES.items())
    return f"CASE {col} {whens} END"


def channel_group_sql(s: str = "mkt_source", m: str = "mkt_medium", c: str = "mkt_campaign") -> str:
    s, m, c = f"lower(trim({s}))", f"lower(trim({m}))", f"lower(trim({c}))"
    shop = full_match(c, rules.SHOP_CAMPAIGN_PATTERN)
    return f"""CASE
      WHEN {s} = 'direct' AND {m} IN {in_list(rules.DIRECT_MEDIUMS)} THEN 'Direct'
      WHEN {m} LIKE '%cross-network%' THEN 'Cross-network'
      WHEN {full_match(m, rules.PAID_MEDIUM_PATTERN)} THEN CASE WHEN {shop} THEN 'Paid Shopping' ELSE 'Paid Other' END
      WHEN {m} IN {in_list(rules.DISPLAY_MEDIUMS)} THEN 'Display'
      WHEN {shop} THEN 'Organic Shopping'
      WHEN {m} IN {in_list(rules.SOCIAL_MEDIUMS)} THEN 'Organic Social'
      WHEN {full_match(m, rules.VIDEO_MEDIUM_PATTERN)} THEN 'Organic Video'
      WHEN {m} = 'organic' THEN 'Organic Search'
      WHEN {m} IN {in_list(rules.REFERRAL_MEDIUMS)} THEN 'Referral'
      WHEN {s} IN {in_list(rules.EMAIL_NAMES)} OR {m} IN {in_list(rules.EMAIL_NAMES)} THEN 'Email'
      WHEN {m} = 'affiliate' THEN 'Affiliates'
      WHEN {m} = 'audio' THEN 'Audio'
      WHEN {s} = 'sms' OR {m} = 'sms' THEN 'SMS'
      WHEN {m} LIKE '%push' OR {full_match(m, rules.PUSH_MEDIUM_PATTERN)} OR {s} = 'firebase' THEN 'Mobile Push Notifications'
      ELSE 'Unassigned' END"""


def _conformed_nulls() -> str:
    present = set(FIXTURE_COLUMNS) | set(MKT_COLUMNS)
    names = [n for n in list(ATOMIC_FIELDS) + entity_columns() if n not in present]
    return ",\n  ".join(null_of(n) for n in names)


EVENTS_OUTPUT = list(ATOMIC_FIELDS) + entity_columns() + list(DERIVED_COLUMNS) + ["props"]

DIM_VALUES = {
    "d_country": "SELECT * FROM (VALUES ('GB','United Kingdom','Europe'),('US','United States','Americas'),"
                 "('FR','France','Europe')) t(alpha_2, name, region)",
    "d_language": "SELECT * FROM (VALUES ('en-us','English (US)'),('fr','French'),('de','German')) t(lang_tag, name)",
    "d_iso2t": "SELECT * FROM (VALUES ('en','eng','English'),('fr','fra','French')) t(iso_639_1_code, iso_639_2t_code, name)",
    "d_iso3": "SELECT * FROM (VALUES ('gsw','Swiss German'),('gsw','Alemannic')) t(iso_639_3_code, name)",
}


def base_ctes(app_ids=("demo-app",), bot_filter=True) -> list[str]:
    """CTEs: b, atomic, enriched (campaign attribution), conf, events_m."""
    mkt = {"mkt_medium": "utm_medium", "mkt_source": "utm_source", "mkt_term": "utm_term",
           "mkt_content": "utm_content", "mkt_campaign": "utm_campaign"}
    enriched_cols = ",\n  ".join(f"{qp(p)} AS {c}" for c, p in mkt.items())
    app = f"WHERE app_id IN {in_list(app_ids)}" if app_ids else ""
    bot = f"WHERE NOT {full_match('useragent', rules.BOT_PATTERN)}" if bot_filter else ""
    dims = [f"{k} AS ({v})" for k, v in DIM_VALUES.items()]
    return [
        "b AS (SELECT e.*, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS wk, "
        "CAST(floor(value) AS INT) AS iv FROM events e)",
        f"atomic AS ({ATOMIC_SQL})",
        f"enriched AS (SELECT *,\n  {enriched_cols}\nFROM atomic)",
        f"conf AS (SELECT *,\n  {_conformed_nulls()}\nFROM enriched)",
        f"ev_a AS (SELECT *, domain_sessionid AS session_identifier, domain_userid AS user_identifier FROM conf {app})",
        "ev_d AS (SELECT * FROM ev_a QUALIFY row_number() OVER (PARTITION BY event_id "
        "ORDER BY collector_tstamp NULLS LAST, dvce_created_tstamp NULLS LAST) = 1)",
        f"""events_m AS (
  SELECT * REPLACE (TRY_CAST(iab__spider_or_robot AS BOOLEAN) AS iab__spider_or_robot),
    CAST(coalesce(page_view__id, screen_view__id, screen__id) AS VARCHAR) AS view_id,
    coalesce(TRY_CAST(session__session_index AS INTEGER), TRY_CAST(domain_sessionidx AS INTEGER)) AS device_session_index,
    deep_link__referrer AS referrer, deep_link__url AS url, mobile__resolution AS screen_resolution,
    coalesce(mobile__os_type, yauaa__operating_system_name, ua__os_family) AS os_type,
    coalesce(yauaa__operating_system_version, mobile__os_version, ua__os_version) AS os_version,
    coalesce(domain_userid, session__user_id) AS device_identifier,
    {platform_name_sql()} AS platform_name,
    CASE WHEN platform = 'web' THEN yauaa__device_class WHEN yauaa__device_class = 'Phone' THEN 'Mobile'
         WHEN yauaa__device_class = 'Tablet' THEN 'Tablet' ELSE {platform_name_sql()} END AS device_category
  FROM ev_d {bot})""",
    ] + dims


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
