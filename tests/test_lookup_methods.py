"""Interval blocks, compiled pattern lists, lookups by JSON path, configurations from a folder."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.operators import enrich as E
from trailmark.operators import enrich_config as C
from trailmark.operators import intervals as I
from trailmark.operators import lookups as L
from trailmark.operators import patterns as P


def test_blocks_partition_every_interval(spark):
    rows = [(0, 0), (0, 255), (5, 5), (3, 200), (254, 255), (7, 6), (-9, 3), (250, 999), (300, 400), (None, 3), (128, 191)]
    got = I.blocks(spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(rows)], "i int, lo int, hi int"), bits=8).collect()
    for i, (a, z) in enumerate(rows):
        held = []
        for r in got:
            if r["i"] == i:
                size = 1 << (8 - r["__len"])
                held += range(r["__prefix"] * size, (r["__prefix"] + 1) * size)
        want = [] if a is None else list(range(max(a, 0), min(z, 255) + 1))
        assert sorted(held) == want, (a, z)
        assert sum(r["i"] == i for r in got) <= 2 * 8


def test_interval_lookup_against_brute_force(spark):
    rng = random.Random(4)
    spans = [(0, 65535, "all"), (0, 65535, "also all"), (40, 40, "b"), (40, 40, "a")]
    spans += [(k, k + 255, f"dense {k}") for k in range(10_000, 12_000)]  # thousands around the same numbers
    for _ in range(400):
        lo = rng.randrange(65536)
        spans.append((lo, min(65535, lo + rng.choice([0, 1, 7, 300, 20_000])), f"r{rng.randrange(50)}"))
    points = [rng.randrange(65536) for _ in range(300)] + [0, 65535, 40, 11_000, 11_000, None, -1, 65536]
    rows = spark.createDataFrame(list(enumerate(points)), "i int, x long")
    got = {r["i"]: r["name"] for r in I.lookup(rows.withColumn("name", F.lit("old")), spark.createDataFrame(
        spans, "lo long, hi long, name string"), F.col("x"), ["name"], bits=16).collect()}
    assert len(got) == len(points)
    for i, x in enumerate(points):
        near = [(z - a, a, n) for a, z, n in spans if x is not None and a <= x <= z]
        assert got[i] == (min(near)[2] if near else None)
    none = I.lookup(rows, spark.createDataFrame([], "lo long, hi long, name string"), F.col("x"), ["name"]).collect()
    assert len(none) == len(points) and {r["name"] for r in none} == {None}


def test_lookups_join_on_equal_keys_only(spark):
    rows = spark.createDataFrame([("10.0.0.1", "Mozilla")], "user_ipaddress string, useragent string")
    done = L.iab_spiders_robots(rows, L.fixture_iab_lists(spark))
    plan = done._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pattern_trie_against_plain_search(spark):
    rng = random.Random(2)
    letters = "ab.(|\\$^é "
    patterns = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + [""]
    starts = ["(a", "b$", "é"]
    texts = ["".join(rng.choice(letters + "\n") for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", P.matches(F.col("t"), patterns).alias("a"),
                                                       P.matches(F.col("t"), [], starts).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (any(p in t for p in patterns if p), t.startswith(tuple(starts))), t
    tree = P.expression(P.trie(["bot", "bots", "bing", "spider"]))
    assert tree == "(?:b(?:ing|ot)|spider)" and re.search(tree, "a bots")
    assert df.select(P.matches(F.lit(None).cast("string"), ["a"])).first()[0] is None


def test_robot_lists_from_files(spark, tmp_path):
    (tmp_path / "exclude_current.txt").write_text(
        "# comment | here\n\nBot|1|robotics,two%2Cparts|0|0|0\nhttp%7Cx|1||0|2|1\ncrawl|1||0|1|0\nold|0||0|0|0\n")
    (tmp_path / "include_current.txt").write_text("#\nMozilla|1|1\nOpera|1|0\ngone|0|0\n")
    (tmp_path / "ip_exclude_current_cidr.txt").write_text("#\n10.0.0.0/8\n")
    lists = L.read_iab_lists(spark, str(tmp_path))
    cases = {"Mozilla bot": (True, 0), "mozilla ROBOTICS bot": (True, None), "Mozilla bot two,parts": (True, None),
             "HTTP|x Opera": (True, 2), "opera http|x": (True, None), "a mozilla": (False, None), "gone": (False, None),
             "Mozilla old": (True, None), "Mozilla bot crawl": (True, 1), None: (False, None), "": (False, None)}
    flags = L.ua_pattern_flags(spark.createDataFrame([(k,) for k in cases], "useragent string"), lists["exclude"], lists["include"])
    assert {r["__ua"]: (r["__included"], r["__impact"]) for r in flags.collect()} == cases
    rows = spark.createDataFrame([("10.1.1.1", "Mozilla"), ("11.1.1.1", "Mozilla"), (None, "x"), ("::1", "mozilla bot")],
                                 "user_ipaddress string, useragent string")
    got = [r["iab__reason"] for r in L.iab_spiders_robots(rows, lists).orderBy("useragent", "user_ipaddress").collect()]
    assert sorted(got) == sorted(["FAILED_IP_EXCLUDE", "PASSED_ALL", "FAILED_UA_INCLUDE", "FAILED_UA_EXCLUDE"])


def test_long_pattern_lists_are_refused(spark):
    many = spark.range(20).select(F.col("id").cast("string").alias("pattern"), F.lit(1).alias("active"),
                                  F.lit("").alias("exceptions"), F.lit(0).alias("impact"), F.lit(0).alias("starts_with"))
    with pytest.raises(ValueError, match="pattern list"):
        P.UserAgentLists(many, many, most=10)


def test_fingerprint_sorts_by_key(spark):
    df = spark.createDataFrame([("a-b=2&a=1&eid=9&a=0&&b",)], "page_urlquery string")
    sha = lambda t, h="sha1": hashlib.new(h, t.encode()).hexdigest()
    assert E.event_fingerprint(df).first()["event_fingerprint"] == sha("a=0&a=1&a-b=2&b")
    other = E.event_fingerprint(df, {"excludeParameters": [], "hashAlgorithm": "SHA-256"}).first()["event_fingerprint"]
    assert other == sha("a=0&a=1&a-b=2&b&eid=9", "sha256")


def test_currency_of_items_and_transactions(spark):
    rows = spark.sql("SELECT 10D tr_total, 2D ti_price, 'GBP' tr_currency, 'USD' ti_currency, TIMESTAMP_NTZ'2024-01-02 05:00:00' "
                     "derived_tstamp UNION ALL SELECT 10D, 2D, 'EUR', 'XXX', TIMESTAMP_NTZ'2024-01-02 05:00:00'")
    rates = spark.sql("SELECT 'GBP' currency, DATE'2024-01-01' rate_date, 1.5D rate UNION ALL SELECT 'USD', DATE'2024-01-01', 0.5D "
                      "UNION ALL SELECT 'USD', DATE'2024-01-02', 9D")
    got = L.currency_conversion(rows, rates).orderBy("tr_currency").collect()
    assert [(r["tr_total_base"], r["ti_price_base"]) for r in got] == [(10.0, None), (15.0, 1.0)]


def test_lookup_inputs_from_entities_and_expected_rows(spark):
    spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3)], "key string, v int").createOrReplaceTempView("answers")
    entity = lambda s, d: {"schema": s, "data": d}
    contexts = [entity("iglu:x/other/jsonschema/1-0-0", {"id": "k2"}), 7, entity("iglu:x/user/jsonschema/1-3-0", {"id": "k1"}),
                entity("iglu:x/user/jsonschema/1-0-0", {"id": "k2"})]
    rows = spark.createDataFrame([
        (1, json.dumps(entity("c", contexts))), (2, json.dumps(entity("c", [entity("iglu:x/user/jsonschema/1-0-9", {"id": "k2"})]))),
        (3, json.dumps(entity("c", [entity("iglu:x/user/jsonschema/2-0-0", {"id": "k1"})]))), (4, "no json"), (5, None),
        (6, json.dumps(entity("c", [entity("iglu:x/user/jsonschema/1-0-0", {"id": "none"})])))], "i int, contexts string")
    conf = {"inputs": [{"placeholder": 1, "json": {"field": "contexts", "schemaCriterion": "iglu:x/user/jsonschema/1-*-*",
                                                   "jsonPath": "$.id"}}],
            "query": {"sql": "SELECT v, 'a?' AS mark FROM answers WHERE key = ?"},
            "output": {"expectedRows": "AT_MOST_ONE", "json": {"schema": "s"}}}

    def run(expected, sql=None):
        c = {**conf, "output": {**conf["output"], "expectedRows": expected}}
        c = c if sql is None else {**c, "query": {"sql": sql}}
        return {r["i"]: (None if r["o"] is None else [(x["schema"], x["data"]["v"]) for x in r["o"]], r["o_failure"])
                for r in L.sql_query_enrichment(rows, c, "o").collect()}

    assert run("AT_MOST_ONE") == {1: ([("s", 1)], None), 2: (None, "expected AT_MOST_ONE, found 2"), 3: (None, None),
                                  4: (None, None), 5: (None, None), 6: ([], None)}
    assert run("AT_LEAST_ONE")[6] == (None, "expected AT_LEAST_ONE, found 0")
    assert run("AT_LEAST_ZERO")[2] == ([("s", 2), ("s", 3)], None)
    assert run("EXACTLY_ONE", "SELECT v FROM answers WHERE key = ? ORDER BY v DESC LIMIT 1")[2] == ([("s", 3)], None)


def test_configurations_are_replaced_by_name(spark, tmp_path):
    def put(file, name, enabled, **parameters):
        (tmp_path / file).write_text(json.dumps({"schema": "s", "data": {"name": name, "enabled": enabled, "parameters": parameters}}))

    put("a.json", "anon_ip", True, anonOctets=1)
    put("b.json", "anon_ip", True, anonOctets=3)
    put("c.json", "currency_conversion_config", False)
    put("notes.txt", "pii_enrichment_config", True)
    configs = C.read_configs(spark, str(tmp_path))
    assert {k: v["parameters"] for k, v in configs.items()} == {"anon_ip": {"anonOctets": 3}, "currency_conversion_config": {}}
    rows = spark.createDataFrame([("1.2.3.4",)], "user_ipaddress string")
    assert C.run(rows, configs).first()[0] == "1.x.x.x"
    off = C.put_config(configs, {"data": {"name": "anon_ip", "enabled": False}})
    assert C.run(rows, off).first()[0] == "1.2.3.4"
    with pytest.raises(ValueError, match="resource rates"):
        C.run(rows, C.put_config(off, {"data": {"name": "currency_conversion_config", "enabled": True}}))
    with pytest.raises(ValueError, match="yauaa"):
        C.run(rows, {"yauaa_enrichment_config": {"enabled": True}})
