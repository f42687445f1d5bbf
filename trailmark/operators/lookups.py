"""Lookups without a plain key: IP ranges / CIDR lists, user-agent pattern lists; dated rates, SQL-style lookups.

IP ranges become equal keys (``operators.intervals``), pattern lists column
expressions (``operators.patterns``); no join here lacks an equal key.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.ip import cidr_bounds, ipv4_to_long
from trailmark.operators import intervals
from trailmark.operators.joins import dealt
from trailmark.operators.patterns import UserAgentLists

# --- reference lists ----------------------------------------------------------

EXCLUDE_SCHEMA = "pattern string, active int, exceptions string, two_pass_redundant int, impact int, starts_with int"
INCLUDE_SCHEMA = "pattern string, active int, starts_with int"


def read_iab_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Parse an IAB/ABC user-agent list file ('|'-separated, '#' comments, URL-escaped reserved chars)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.col("value"), r"\|")

    def dec(c):
        return F.coalesce(F.try_url_decode(c), c)
    if kind == "exclude":
        return lines.select(dec(F.get(f, 0)).alias("pattern"), F.get(f, 1).try_cast("int").alias("active"),
                            F.coalesce(F.get(f, 2), F.lit("")).alias("exceptions"),  # decoded one by one, after the split
                            F.get(f, 3).try_cast("int").alias("two_pass_redundant"),
                            F.get(f, 4).try_cast("int").alias("impact"),
                            F.coalesce(F.get(f, 5).try_cast("int"), F.lit(0)).alias("starts_with"))
    return lines.select(dec(F.get(f, 0)).alias("pattern"), F.get(f, 1).try_cast("int").alias("active"),
                        F.coalesce(F.get(f, 2).try_cast("int"), F.lit(0)).alias("starts_with"))


def read_cidr_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.trim("value").alias("cidr"))


def read_iab_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three lists as they are distributed: exclude and include patterns, and excluded addresses."""
    base = folder.rstrip("/")
    return {"exclude": read_iab_list(spark, f"{base}/exclude_current.txt", "exclude"),
            "include": read_iab_list(spark, f"{base}/include_current.txt", "include"),
            "cidr": read_cidr_list(spark, f"{base}/ip_exclude_current_cidr.txt")}


def fixture_iab_lists(spark: SparkSession) -> dict[str, DataFrame]:
    """Small lists for tests and registered queries (FIXTURES.md §4)."""
    return {
        "exclude": spark.createDataFrame(
            [("bot", 1, "robotics", 0, 0, 0), ("spider", 1, "", 0, 2, 0), ("twitter", 1, "", 0, 1, 1),
             ("modem", 0, "", 0, 0, 0)], EXCLUDE_SCHEMA),
        "include": spark.createDataFrame([("mozilla", 1, 1), ("twitter", 1, 0)], INCLUDE_SCHEMA),
        # FIXED VALUES: the IP exclusion list shipped with the original configuration.
        "cidr": spark.createDataFrame([("10.0.0.0/8",), ("127.0.0.0/8",), ("13.106.106.0/24",),
                                       ("131.253.24.0/21",), ("149.6.126.128/27",)], "cidr string"),
    }


# --- J08 IP in CIDR -------------------------------------------------------------

def cidr_ranges(cidrs: DataFrame, col: str = "cidr") -> DataFrame:
    lo, hi = cidr_bounds(F.col(col))
    return cidrs.select(lo.alias("lo"), hi.alias("hi")).filter(F.col("lo").isNotNull())


def ip_in_cidr(df: DataFrame, cidrs: DataFrame, ip_col: str = "user_ipaddress", out: str = "ip_excluded") -> DataFrame:
    """Flag rows whose IPv4 address lies in any CIDR of the list (no address: FALSE)."""
    ranges = cidr_ranges(cidrs).withColumn(out, F.lit(True))
    return intervals.lookup(df, ranges, ipv4_to_long(F.col(ip_col)), [out]).withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))


# --- E07 IP range lookup (large range tables) --------------------------------------

def ip_range_lookup(df: DataFrame, ranges: DataFrame, outputs: list[str], ip_col: str = "user_ipaddress",
                    lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Left lookup of the narrowest range [lo, hi] containing the IP; ties: smaller lo, then the least outputs."""
    return intervals.lookup(df, ranges, ipv4_to_long(F.col(ip_col)), outputs, lo, hi)


# --- J09 / E06 user-agent lists ---------------------------------------------------

def ua_pattern_flags(df: DataFrame, exclude: DataFrame, include: DataFrame, ua_col: str = "useragent") -> DataFrame:
    """Per distinct user agent: include hit, exclude hit (exceptions honoured) and the strongest impact."""
    lists = UserAgentLists(exclude, include)
    ua = F.col("__ua")
    return df.select(F.col(ua_col).alias("__ua")).distinct().withColumn("__impact", lists.impact(ua)).select(
        "__ua", lists.included(ua).alias("__included"), F.col("__impact").isNotNull().alias("__excluded"), "__impact")


IMPACT_NAMES = {0: "PAGE_IMPRESSIONS", 1: "AD_IMPRESSIONS", 2: "PAGE_AND_AD_IMPRESSIONS"}


def iab_spiders_robots(df: DataFrame, lists: dict[str, DataFrame], ip_col: str = "user_ipaddress",
                       ua_col: str = "useragent") -> DataFrame:
    """IAB classification columns iab__spider_or_robot / category / reason / primary_impact.

    Checks in order: IP exclusion list, UA include list (must match), UA
    exclude list (must not match unless an exception matches).
    """
    flagged = ip_in_cidr(df, lists["cidr"], ip_col, "__ipx")
    compiled = UserAgentLists(lists["exclude"], lists["include"])
    j = flagged.withColumns({"__impact": compiled.impact(F.col(ua_col)), "__included": compiled.included(F.col(ua_col))}) \
        .withColumn("__excluded", F.col("__impact").isNotNull())
    impact = F.col("__impact")
    reason = (F.when(F.col("__ipx"), "FAILED_IP_EXCLUDE").when(~F.col("__included"), "FAILED_UA_INCLUDE")
              .when(F.col("__excluded"), "FAILED_UA_EXCLUDE").otherwise("PASSED_ALL"))
    imp = F.when(reason == "PASSED_ALL", "NONE").when(reason == "FAILED_UA_EXCLUDE", F.when(impact == 0, IMPACT_NAMES[0])
                                                      .when(impact == 1, IMPACT_NAMES[1]).otherwise(IMPACT_NAMES[2])) \
        .otherwise("UNKNOWN")
    return (j.withColumns({
        "iab__spider_or_robot": reason != "PASSED_ALL",
        "iab__category": F.when(reason == "PASSED_ALL", "BROWSER").otherwise("SPIDER_OR_ROBOT"),
        "iab__reason": reason,
        "iab__primary_impact": imp,
    }).drop("__ipx", "__included", "__excluded", "__impact"))


# --- J10 SQL-style lookup -------------------------------------------------------

def sql_lookup_enrich(df: DataFrame, table: DataFrame, df_key: str, table_key: str, columns: list[str],
                      out: str = "lookup_context") -> DataFrame:
    """Attach the row of ``table`` whose key equals ``df_key`` as a struct (AT_MOST_ONE rows).

    More than one matching row is a failure: the struct is NULL and
    ``<out>_failure`` says why.  Keys are de-duplicated by aggregation, so a
    hot key never fans out.
    """
    keyed = (table.groupBy(F.col(table_key).alias("__k"))
             .agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*columns), ignorenulls=False).alias("__row")))
    j = df.join(keyed, df[df_key] == keyed["__k"], "left")
    return (j.withColumns({
        out: F.when(F.col("__n") == 1, F.col("__row")),
        f"{out}_failure": F.when(F.col("__n") > 1, F.lit("expected at most one row")),
    }).drop("__k", "__n", "__row"))


def criterion_pattern(criterion: str) -> str:
    """Regular expression of a schema criterion: a key whose version parts may be ``*``."""
    head, _, version = criterion.rpartition("/")
    return "^" + re.escape(head) + "/" + "-".join(r"\d+" if v == "*" else re.escape(v) for v in version.split("-")) + "$"


def json_input(field: str, criterion: str, json_path: str) -> Column:
    """Text at ``json_path`` of the event's own data, or of the first entity of an array, that fits the criterion."""
    whole = F.try_variant_get(F.try_parse_json(F.col(field)), "$.data", "variant")
    pattern = criterion_pattern(criterion)
    if field == "unstruct_event":
        found = F.when(F.try_variant_get(whole, "$.schema", "string").rlike(pattern),
                       F.try_variant_get(whole, "$.data", "variant"))
    else:
        fits = F.filter(F.try_variant_get(whole, "$", "array<variant>"),
                        lambda x: F.coalesce(F.try_variant_get(x, "$.schema", "string").rlike(pattern), F.lit(False)))
        found = F.try_variant_get(F.get(fits, 0), "$.data", "variant")
    return F.try_variant_get(found, json_path, "string")


def query_input(conf: dict) -> Column:
    """An input of a lookup query: a column of the event, or a value inside its JSON."""
    if "pojo" in conf:
        return F.col(conf["pojo"]["field"])
    return json_input(conf["json"]["field"], conf["json"]["schemaCriterion"], conf["json"]["jsonPath"])


def sql_query_enrichment(df: DataFrame, params: dict, out: str = "sql_query_context") -> DataFrame:
    """E13's SQL lookup: the configured query, run for each different set of inputs, attached as entities.

    The query's ``?`` take the inputs by place; Spark plans it as a lateral join, an equi-join on the inputs.
    ``out`` is an array of (schema, data) entities, one a row; where the number of rows breaks ``expectedRows`` it is
    NULL and ``<out>_failure`` says so.  An event that lacks an input is not looked up.
    """
    spark = df.sparkSession
    names = [f"__p{i}" for i in range(1, len(params["inputs"]) + 1)]
    ordered = sorted(params["inputs"], key=lambda c: c["placeholder"])
    rows = df.withColumns({n: query_input(c) for n, c in zip(names, ordered)})
    keys = rows.select(*names).dropna().distinct()
    view = f"__inputs_{uuid.uuid4().hex}"
    keys.createOrReplaceTempView(view)
    place = iter(names)
    text = re.sub(r"'(?:[^']|'')*'|\?", lambda m: f"k.{next(place)}" if m.group() == "?" else m.group(), params["query"]["sql"])
    answers = spark.sql(f"SELECT k.*, struct(l.*) AS __row FROM {view} k JOIN LATERAL ({text}) l")
    output = params.get("output", {})
    expected = output.get("expectedRows", "AT_MOST_ONE")
    entity = F.struct(F.lit(output.get("json", {}).get("schema")).alias("schema"), F.col("__row").alias("data"))
    found = answers.groupBy(*names).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(entity)).alias("__found"))
    asked = F.lit(True)
    for n in names:
        asked = asked & F.col(n).isNotNull()
    # events that are not looked up are dealt out, not sent to one task; an answer's number is 0 (no constant, which
    # the optimizer would take out of the join's keys)
    rows = rows.withColumn("__deal", F.when(asked, F.lit(0).cast("long")).otherwise(dealt(rows)))
    found = found.withColumn("__deal", F.least(F.col("__n"), F.lit(0).cast("long")))
    j = rows.join(found, [*names, "__deal"], "left")
    n = F.coalesce("__n", F.lit(0))
    broken = {"EXACTLY_ONE": n != 1, "AT_MOST_ONE": n > 1, "AT_LEAST_ONE": n < 1}.get(expected, F.lit(False))
    none = F.array().cast(found.schema["__found"].dataType)
    return j.withColumns({
        out: F.when(asked & ~broken, F.coalesce("__found", none)),
        f"{out}_failure": F.when(asked & broken, F.concat(F.lit(f"expected {expected}, found "), n.cast("string"))),
    }).drop(*names, "__n", "__found", "__deal")


# --- J11 / E08 dated rates ----------------------------------------------------------

def rate_lookup(df: DataFrame, rates: DataFrame, currency_col: str, date_col: str, base_currency: str = "EUR",
                out: str = "rate") -> DataFrame:
    """Rate of ``currency`` at the close of the day before ``date_col`` (EOD_PRIOR); base currency = 1."""
    # one rate per currency and day (the smallest of several), so that a lookup cannot multiply rows
    r = rates.groupBy(F.col("currency").alias("__c"), F.date_add(F.col("rate_date"), 1).alias("__d")).agg(
        F.min("rate").alias("__r"))
    d = F.to_date(F.col(date_col))
    j = df.join(r, (df[currency_col] == r["__c"]) & (d == r["__d"]), "left")
    return j.withColumn(out, F.when(F.col(currency_col) == base_currency, F.lit(1.0)).otherwise(F.col("__r"))) \
        .drop("__c", "__d", "__r")


#: amount -> (converted amount, its currency)
AMOUNTS = {"tr_total": ("tr_total_base", "tr_currency"), "tr_tax": ("tr_tax_base", "tr_currency"),
           "tr_shipping": ("tr_shipping_base", "tr_currency"), "ti_price": ("ti_price_base", "ti_currency")}


def currency_conversion(df: DataFrame, rates: DataFrame, params: dict | None = None,
                        fields: dict[str, str] | None = None, currency_col: str = "tr_currency",
                        date_col: str = "derived_tstamp") -> DataFrame:
    """Amount columns converted to the base currency at the prior day's rate; missing rate -> NULL.

    Without ``fields`` the transaction's amounts use ``tr_currency`` and the item's price ``ti_currency``.
    """
    base = (params or {}).get("baseCurrency", "EUR")
    wanted = AMOUNTS if fields is None else {src: (dst, currency_col) for src, dst in fields.items()}
    for currency in dict.fromkeys(c for _, c in wanted.values()):
        of = {src: dst for src, (dst, c) in wanted.items() if c == currency and src in df.columns}
        if of and currency in df.columns:
            df = rate_lookup(df, rates, currency, date_col, base, "__rate").withColumns(
                {dst: F.col(src) * F.col("__rate") for src, dst in of.items()}).drop("__rate")
    return df
