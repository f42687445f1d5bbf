"""Enrichments: per-event column derivations, each a plain DataFrame transform.

Each function takes the ``parameters`` object of its JSON configuration.
Lookups against reference tables are equi-joins without hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import query_param

# --- FIXED VALUES: default parameters of the enabled enrichments --------------
CAMPAIGN_FIELDS = {
    "mktMedium": ["utm_medium"], "mktSource": ["utm_source"], "mktTerm": ["utm_term"],
    "mktContent": ["utm_content"], "mktCampaign": ["utm_campaign"],
}
FINGERPRINT_EXCLUDE = ["cv", "eid", "nuid", "stm"]
# -----------------------------------------------------------------------------

_CAMPAIGN_COLUMNS = {"mktMedium": "mkt_medium", "mktSource": "mkt_source", "mktTerm": "mkt_term",
                     "mktContent": "mkt_content", "mktCampaign": "mkt_campaign"}


def campaign_attribution(df: DataFrame, params: dict | None = None, query_col: str = "page_urlquery") -> DataFrame:
    """Marketing fields from the first listed query-string parameter that is present."""
    fields = (params or {}).get("fields", CAMPAIGN_FIELDS)
    q = F.col(query_col)
    out = {}
    for key, col in _CAMPAIGN_COLUMNS.items():
        names = fields.get(key, [])
        vals = [query_param(q, n) for n in names]
        out[col] = (F.coalesce(*vals) if len(vals) > 1 else vals[0]) if vals else F.lit(None).cast("string")
    return df.withColumns(out)


# --- E02 event fingerprint ----------------------------------------------------

def event_fingerprint(df: DataFrame, params: dict | None = None, query_col: str = "page_urlquery",
                      out: str = "event_fingerprint") -> DataFrame:
    """Hash of the query string's ``k=v`` pairs, excluded keys dropped, sorted by key (then by pair), joined with '&'."""
    excluded = (params or {}).get("excludeParameters", FINGERPRINT_EXCLUDE)
    algorithm = (params or {}).get("hashAlgorithm", "SHA1").upper().replace("-", "")
    q = F.col(query_col)
    pairs = F.transform(F.filter(F.split(q, "&"), lambda p: p != ""),
                        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
    kept = F.array_sort(F.filter(pairs, lambda x: ~x["k"].isin(*excluded)) if excluded else pairs)
    text = F.concat_ws("&", F.transform(kept, lambda x: x["p"]))
    return df.withColumn(out, F.when(q.isNotNull(), hashed(text, algorithm)))


def hashed(text: Column, algorithm: str) -> Column:
    """Hex digest by name: MD5, SHA1, SHA224, SHA256, SHA384 or SHA512."""
    if algorithm == "SHA1":
        return F.sha1(text)
    return F.md5(text) if algorithm == "MD5" else F.sha2(text, int(algorithm.replace("SHA", "")))


# --- E03 referer parser -------------------------------------------------------

def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


def referer_parser(df: DataFrame, referers: DataFrame, params: dict | None = None,
                   refr_host: str = "refr_urlhost", page_url: str = "page_url") -> DataFrame:
    """refr_medium / refr_source from a host lookup table.

    Own host or a listed internal domain -> 'internal'; unknown host -> 'unknown'.
    """
    from trailmark.operators.joins import dim_lookup

    internal = [d.lower() for d in (params or {}).get("internalDomains", [])]
    looked = dim_lookup(df, referers, refr_host, "host", {"medium": "__rm", "source": "__rs"},
                        order="host", prefix="__ref")
    h = F.lower(F.col(refr_host))
    is_internal = (h == F.lower(url_host(F.col(page_url)))) | (h.isin(*internal) if internal else F.lit(False))
    return (looked.withColumns({
        "refr_medium": F.when(h.isNull(), F.lit(None).cast("string")).when(is_internal, "internal")
        .otherwise(F.coalesce(F.col("__rm"), F.lit("unknown"))),
        "refr_source": F.when(h.isNull() | is_internal, F.lit(None).cast("string")).otherwise(F.col("__rs")),
    }).drop("__rm", "__rs"))


# --- E04 IP anonymisation -----------------------------------------------------

def anon_ip(df: DataFrame, params: dict | None = None, col: str = "user_ipaddress") -> DataFrame:
    """Replace the last ``anonOctets`` octets of an IPv4 address, or ``anonSegments`` segments of an IPv6
    address, by 'x'; values that are neither stay unchanged."""
    n = int((params or {}).get("anonOctets", 1))
    k = int((params or {}).get("anonSegments", 1))
    parts = F.split(F.col(col), r"\.")
    masked = F.concat_ws(".", F.transform(parts, lambda x, i: F.when(i >= 4 - n, F.lit("x")).otherwise(x)))
    from trailmark.functions.ip import IPV4_PATTERN, IPV6_PATTERN
    parts6 = F.split(F.col(col), ":")
    masked6 = F.concat_ws(":", F.transform(parts6, lambda x, i: F.when(i >= F.size(parts6) - k, F.lit("x")).otherwise(x)))
    return df.withColumn(col, F.when(F.col(col).rlike(IPV4_PATTERN), masked)
                         .when(F.col(col).rlike(IPV6_PATTERN), masked6).otherwise(F.col(col)))


# --- E05 PII pseudonymisation -------------------------------------------------

PII_DEFAULT = {"pii": [{"pojo": {"field": "user_id"}}],
               "strategy": {"pseudonymize": {"hashFunction": "SHA-1", "salt": "salty"}}}


def _pii_fields(params: dict) -> list[str]:
    return [p["pojo"]["field"] for p in params.get("pii", []) if "pojo" in p]


def _hash(col: Column, params: dict) -> Column:
    ps = params.get("strategy", {}).get("pseudonymize", {})
    salted = F.concat(col.cast("string"), F.lit(ps.get("salt", "")))
    return hashed(salted, ps.get("hashFunction", "SHA-1").upper().replace("-", ""))


def pii_pseudonymize(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Listed fields -> hash(value || salt); NULL stays NULL."""
    params = params or PII_DEFAULT
    return df.withColumns({f: _hash(F.col(f), params) for f in _pii_fields(params)})


def pii_events(df: DataFrame, params: dict | None = None, key: str = "event_id") -> DataFrame:
    """The emitted PII rows: (event id, field, original, hashed) for each non-NULL listed field."""
    params = params or PII_DEFAULT
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("original"),
                                 _hash(F.col(f), params).alias("hashed")) for f in _pii_fields(params)])
    return (df.select(key, F.explode(entries).alias("p"))
            .filter(F.col("p.original").isNotNull())
            .select(key, "p.field", "p.original", "p.hashed"))


# --- E09 / E10 header and cookie extraction ------------------------------------

def cookie_extractor(df: DataFrame, params: dict | None = None, cookie_col: str = "cookie",
                     out: str = "cookie_context") -> DataFrame:
    """The named cookies of the Cookie header as an array of (name, value)."""
    names = (params or {}).get("cookies", [])
    pairs = F.transform(F.filter(F.split(F.col(cookie_col), ";"), lambda x: F.trim(x) != ""),
                        lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("name"),
                                           F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("value")))
    return df.withColumn(out, F.filter(pairs, lambda p: p["name"].isin(*names)) if names
                         else F.array().cast("array<struct<name:string,value:string>>"))


def do_not_track_filter(df: DataFrame, cookie_name: str = "dnt", value_pattern: str = "^1$",
                        cookie_col: str = "cookie") -> DataFrame:
    """Drop requests carrying cookie ``cookie_name`` whose value matches ``value_pattern``."""
    named = cookie_extractor(df, {"cookies": [cookie_name]}, cookie_col, "__c")
    hit = F.exists(F.col("__c"), lambda p: p["value"].rlike(value_pattern))
    return named.filter(~F.coalesce(hit, F.lit(False))).drop("__c")


def http_header_extractor(df: DataFrame, params: dict | None = None, headers_col: str = "headers",
                          out: str = "header_context") -> DataFrame:
    """Headers (array of name/value structs) whose name fully matches ``headersPattern``."""
    pattern = (params or {}).get("headersPattern", ".*")
    return df.withColumn(out, F.filter(F.col(headers_col), lambda h: h["name"].rlike(f"^(?:{pattern})$")))


# --- E11 cross-navigation ---------------------------------------------------------

def cross_navigation(df: DataFrame, params: dict | None = None, url_col: str = "page_url",
                     param: str = "_sp") -> DataFrame:
    """refr_domain_userid / refr_dvce_tstamp from a ``_sp=<domain user id>.<epoch millis>`` link decoration."""
    from trailmark.functions.text import query_param

    q = F.regexp_extract(F.col(url_col), r"\?([^#]*)", 1)
    v = query_param(q, param)
    duid = F.regexp_extract(v, r"^(.*)\.([0-9]+)$", 1)
    ms = F.regexp_extract(v, r"^(.*)\.([0-9]+)$", 2).try_cast("bigint")
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return df.withColumns({
        "refr_domain_userid": F.when(v.rlike(r"^.+\.[0-9]+$"), duid),
        "refr_dvce_tstamp": F.when(v.rlike(r"^.+\.[0-9]+$"), F.timestamp_add("MILLISECOND", ms, epoch)),
    })


# --- E12 custom script --------------------------------------------------------------

def custom_script(df: DataFrame, fn, schema: str) -> DataFrame:
    """User code over Arrow batches (``fn(pandas.DataFrame) -> pandas.DataFrame``).

    Runs per partition with ``mapInPandas`` (vectorised); prefer a SQL
    expression via ``DataFrame.withColumn(name, F.expr(...))`` when possible.
    """
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


# --- E13 pipeline -------------------------------------------------------------------

DEFAULT_ORDER = ("campaign_attribution", "event_fingerprint", "referer_parser", "cross_navigation", "cookie_extractor",
                 "http_header_extractor", "currency_conversion", "ip_lookups", "iab_spiders_and_robots", "sql_query",
                 "anon_ip", "custom_script", "pii_enrichment")


def event_pipeline(df: DataFrame, enrichments: dict[str, dict], steps: dict) -> DataFrame:
    """Apply the enabled enrichments in a fixed order (script after currency/IP lookups, PII last).

    ``enrichments`` maps name -> configuration ``data`` object (``enabled`` +
    ``parameters``); ``steps`` maps name -> ``fn(df, parameters) -> df``.
    Configurations are replaced by name, as one JSON file per enrichment.  An
    enabled enrichment without a step (given or registered) raises: skipping it
    silently would, say, leave identifiers in clear.  Steps outside the fixed
    order run before the last one, pseudonymisation.
    """
    steps = _REGISTERED | steps
    enabled = [name for name, conf in enrichments.items() if conf and conf.get("enabled")]
    if lacking := sorted(set(enabled) - set(steps)):
        raise ValueError(f"enabled enrichments without a step: {', '.join(lacking)}")
    order = [*DEFAULT_ORDER[:-1], *[n for n in enabled if n not in DEFAULT_ORDER], DEFAULT_ORDER[-1]]
    for name in order:
        if name in enabled:
            df = steps[name](df, enrichments[name].get("parameters", {}))
    return df


_REGISTERED: dict = {}


def register_enrichment(name: str, fn) -> None:
    """Make ``fn(df, parameters) -> df`` the step of the enrichment called ``name``."""
    _REGISTERED[name] = fn
