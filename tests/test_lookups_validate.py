"""Lookups (CIDR, IP ranges, UA lists) and JSON-schema validation on literal rows."""

from pyspark.sql import functions as F

from trailmark.operators import lookups as L
from trailmark.operators import validate as V


def test_ip_in_cidr_and_ranges(spark):
    df = spark.createDataFrame([("10.9.9.9",), ("149.6.126.130",), ("149.6.126.2",), ("bad",), (None,)], "user_ipaddress string")
    lists = L.fixture_iab_lists(spark)
    got = {r.user_ipaddress: r.ip_excluded for r in L.ip_in_cidr(df, lists["cidr"]).collect()}
    assert got == {"10.9.9.9": True, "149.6.126.130": True, "149.6.126.2": False, "bad": False, None: False}
    ranges = spark.createDataFrame([(167772160, 184549375, "ten"), (167837696, 167903231, "ten-one")],
                                   "lo bigint, hi bigint, name string")
    out = {r.user_ipaddress: r.name for r in L.ip_range_lookup(df, ranges, ["name"]).collect()}
    assert out["10.9.9.9"] == "ten" and out["bad"] is None


def test_ua_lists_with_exception(spark):
    lists = L.fixture_iab_lists(spark)
    df = spark.createDataFrame([("Mozilla bingbot",), ("US Robotics modem",), ("Mozilla robotics bot",)],
                               "useragent string").withColumn("user_ipaddress", F.lit("1.2.3.4"))
    got = {r.useragent: r.iab__reason for r in L.iab_spiders_robots(df, lists).collect()}
    assert got == {"Mozilla bingbot": "FAILED_UA_EXCLUDE", "US Robotics modem": "FAILED_UA_INCLUDE",
                   "Mozilla robotics bot": "PASSED_ALL"}


def test_validate_json_keywords(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False,
              "properties": {"a": {"type": "string", "maxLength": 2}, "n": {"maximum": 3},
                             "e": {"enum": ["x", "y"]}}}
    docs = spark.createDataFrame([(1, '{"a":"ok"}'), (2, '{"n":4}'), (3, '{"a":"long","z":1}'),
                                  (4, '{"a":1,"e":"q"}'), (5, "{bad")], "id int, doc string")
    out = V.validate_json(docs, "doc", schema).select("id", F.explode_outer("errors").alias("e")) \
        .select("id", "e.path", "e.keyword").collect()
    got = sorted((r.id, r.path, r.keyword) for r in out if r.keyword)
    assert got == [(2, "$.a", "required"), (3, "$", "additionalProperties"), (3, "$.a", "maxLength"),
                   (4, "$.a", "type"), (4, "$.e", "enum"), (5, "$", "json")] or \
        sorted(got) == sorted([(2, "$.a", "required"), (2, "$.n", "maximum"), (3, "$", "additionalProperties"),
                               (3, "$.a", "maxLength"), (4, "$.a", "type"), (4, "$.e", "enum"), (5, "$", "json")])


def test_split_partitions_input(spark):
    """good and bad partition the input; incomplete is exactly the bad set."""
    docs = spark.createDataFrame([(1, '{"k": 10}'), (2, '{"k": 99}'), (3, '{"k": "x"}'), (4, "{bad")],
                                 "event_id int, props string")
    checked = V.validate_json(docs, "props", {"properties": {"k": {"type": "integer", "maximum": 50}}})
    out = V.split_good_bad_incomplete(checked)
    good = {r.event_id for r in out["good"].collect()}
    bad = {r.event_id for r in out["bad"].collect()}
    inc = {r.event_id for r in out["incomplete"].collect()}
    assert good | bad == {1, 2, 3, 4} and not good & bad and inc == bad == {2, 3, 4}
