"""JSON-Schema keywords on literal documents, and the streaming form of the latency view."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.operators.validate import compile_schema, validate_json
from trailmark.streaming.pipeline import latency_health

CASES = [
    ({"properties": {"e": {"enum": ["café", {"b": 1, "a": 2}]}}}, {"e": "café"}, []),
    ({"properties": {"e": {"enum": ["café", {"b": 1, "a": 2}]}}}, {"e": {"a": 2, "b": 1}}, []),
    ({"properties": {"e": {"const": "é"}}}, {"e": "e"}, ["const"]),
    ({"properties": {"l": {"uniqueItems": True}}}, {"l": [1, "1", [2]]}, []),
    ({"properties": {"l": {"uniqueItems": True}}}, {"l": [[2], 1, [2]]}, ["uniqueItems"]),
    ({"properties": {"a": {}}, "patternProperties": {"^x": {"type": "string"}, "^y": {}},
      "additionalProperties": {"type": "integer"}}, {"a": "s", "x1": "s", "y": 1.5, "z": 3}, []),
    ({"properties": {"a": {}}, "patternProperties": {"^x": {"type": "string"}},
      "additionalProperties": {"type": "integer"}}, {"x1": 2, "z": "3"}, ["additionalProperties", "patternProperties"]),
    ({"patternProperties": {"^x": {}, "^y": {}}, "additionalProperties": False}, {"x": 1, "y": 2}, []),
    ({"patternProperties": {"^x": {}, "^y": {}}, "additionalProperties": False}, {"x": 1, "z": 2},
     ["additionalProperties"]),
    ({"dependencies": {"a": ["b", "c"]}}, {"a": 1, "b": 2}, ["dependencies"]),
    ({"dependencies": {"a": {"required": ["c"]}}}, {"a": 1}, ["dependencies"]),
    ({"dependencies": {"a": ["b"]}}, {"c": 1}, []),
    ({"properties": {"t": {"items": [{"type": "string"}, {"type": "integer"}], "additionalItems": False}}},
     {"t": [1, 2, 3]}, ["additionalItems", "type"]),
    ({"properties": {"t": {"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}}}, {"t": ["a", 1, "b"]},
     ["additionalItems"]),
    ({"properties": {"t": {"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}}}, {"t": []}, []),
    *(({"properties": {"i": {"format": f}}}, {"i": x}, [] if ok else ["format"]) for f, x, ok in (
        ("ipv4", "10.0.255.1", True), ("ipv4", "256.1.1.1", False), ("ipv4", "1.2.3", False), ("ipv4", "1.2.3.4.", False),
        ("ipv6", "2001:db8::1", True), ("ipv6", "::", True), ("ipv6", "1::2::3", False), ("ipv6", "1:2:3:4:5:6:7:8", True),
        ("ipv6", "1:2:3", False), ("uri", "https://a.b/c", True), ("uri", "no uri", False))),
]


def test_keywords(spark):
    for schema, doc, expected in CASES:
        df = spark.createDataFrame([(json.dumps(doc, ensure_ascii=False),)], "j string")
        got = sorted(e["keyword"] for e in validate_json(df, "j", schema).first()["errors"])
        assert got == expected, (schema, doc, got)


@pytest.mark.parametrize("schema", [{"$ref": "#/definitions/a"}, {"properties": {"a": {"minLenght": 2}}},
                                    {"format": "hostname-of-mars"}])
def test_unknown_keywords_are_refused(spark, schema):
    with pytest.raises(ValueError):
        compile_schema(schema, F.col("v"))


def test_latency_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("""SELECT timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS done,
                        timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7 - id % 200) AS got
                        FROM range(400)""")
    rows.write.parquet(str(tmp_path / "in"))
    health = lambda df: latency_health(df, "done", "got", "1 minute").select(
        F.col("period_start").cast("string").alias("p"), "max_latency_s", "unhealthy")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = (health(stream).writeStream.format("memory").queryName("health").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("health").collect()}
    assert got == {tuple(r) for r in health(rows).collect()}
    assert {r[2] for r in got} == {True, False}
