"""Rows are dealt out before work on each of them, and a rendered event's fields are read without a search for each."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trailmark.functions.contracts import ATOMIC_FIELDS
from trailmark.registry import io
from trailmark.sources import tables


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """A folder whose events table has one row group, which a scan reads in one task."""
    n, d = 20_000, tmp_path_factory.mktemp("one-group")
    at = datetime(2024, 1, 1)
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()),
        "ts": pa.array([at + timedelta(seconds=i) for i in range(n)], pa.timestamp("us")),
        "user_id": pa.array([i % 150 for i in range(n)], pa.int64()),
        "event_type": ["view", "click", "signup", "error", "purchase"] * (n // 5),
        "value": [float(i % 490) for i in range(n)],
        "props": [f'{{"k": {i % 100}}}' for i in range(n)]}), f"{d}/events.parquet")
    return str(d)


def test_lines_and_routing_are_spread(spark, one_group):
    lines = io.enriched_lines(spark, one_group)
    assert lines.rdd.getNumPartitions() >= 4
    assert lines.count() == 20_400  # every 50th event comes twice


def test_spread_keeps_rows_and_grows_with_them(spark):
    rows = spark.range(0, 1000, 1, 1).selectExpr("case when id % 7 = 0 then null else id % 10 end as a", "id div 2 as b")
    out = tables.spread(rows, 100)
    assert out.rdd.getNumPartitions() >= 10
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))
    assert tables.spread(rows.limit(0)).count() == 0


def test_fields_of_a_document_come_from_one_parse(spark):
    df = spark.createDataFrame([('{"app_id":"a","txn_id":1.0,"br_cookies":true,"contexts":null}',), ('{"payload":"e5"}',),
                                ("{bad",), (None,)], "data string")
    held = df.select(io._held("data"))
    assert held.schema["held"].dataType.typeName() == "struct"  # a map is searched through for each of 131 keys
    rows = held.select(*io._json_texts(held["held"]), held["held"]["payload"].alias("payload")).collect()
    assert (rows[0]["app_id"], rows[0]["txn_id"], rows[0]["br_cookies"], rows[0]["contexts"]) == ("a", "1.0", "true", None)
    assert rows[1]["payload"] == "e5" and rows[2]["payload"] is None and rows[3]["payload"] is None
    assert len(held.select(*io._json_texts(held["held"])).columns) == len(ATOMIC_FIELDS)


def test_documents_to_validate_are_spread(spark, one_group):
    from trailmark.registry import validation

    docs = validation.documents(spark, one_group)
    assert docs.rdd.getNumPartitions() >= 4
    assert docs.select("id").distinct().count() == 20_000


def test_model_input_is_spread(spark, one_group):
    from trailmark.registry import models

    assert models.model_input(spark, one_group).rdd.getNumPartitions() >= 4


@pytest.fixture
def shuffled_joins(spark):
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_without_a_key_do_not_meet_in_one_task(spark, shuffled_joins):
    from pyspark.sql import functions as F

    from trailmark.operators import intervals
    from trailmark.operators import lookups as L

    spark.createDataFrame([(1, "a"), (2, "b")], "of int, name string").createOrReplaceTempView("round_four_names")
    params = {"inputs": [{"placeholder": 1, "pojo": {"field": "key"}}],
              "query": {"sql": "SELECT name FROM round_four_names WHERE CAST(of AS STRING) = ?"},
              "output": {"expectedRows": "AT_MOST_ONE", "json": {"schema": "s"}}}
    rows = spark.range(400).selectExpr("id", "case when id < 10 then string(id) end as key",
                                       "case when id < 10 then id end as number")
    got = L.sql_query_enrichment(rows, params, "found")
    assert {r["id"]: r["found"][0]["data"]["name"] for r in got.filter(F.size("found") > 0).collect()} == {1: "a", 2: "b"}
    assert got.columns == ["id", "key", "number", "found", "found_failure"] and got.count() == 400
    assert got.filter("key is null").select(F.spark_partition_id()).distinct().count() >= 4
    ranges = spark.createDataFrame([(0, 4, "low"), (-9000, -1, "none")], "lo long, hi long, owner string")
    near = intervals.lookup(rows, ranges, F.col("number"), ["owner"])
    assert {r["id"] for r in near.filter("owner is not null").collect()} == set(range(5)) and near.count() == 400
    assert near.filter("number is null").select(F.spark_partition_id()).distinct().count() >= 4
