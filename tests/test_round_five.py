"""Lookups by interval over rows of many computed columns; files of the routed streams."""

import os

from pyspark.sql import functions as F

from trailmark.operators import intervals
from trailmark.operators import lookups as L
from trailmark.registry import io
from trailmark.sources.tables import atomic_from_events
from trailmark.sources.tsv import route_by_stream
from trailmark.streaming.pipeline import stream_parse_route


def events(spark, n):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))


def test_only_the_rows_that_are_looked_up_are_hashed(spark):
    """The filter on the numbers asked for does not take in the whole row (it was pushed down and multiplied)."""
    rows = spark.range(6).select("id", F.when(F.col("id") % 2 == 0, F.col("id") * 10).alias("number"),
                                 F.concat(F.lit("x"), F.col("id")).alias("name"))
    ranges = spark.createDataFrame([(0, 25, "a"), (40, 40, "b")], "lo long, hi long, owner string")
    got = intervals.lookup(rows, ranges, F.col("number"), ["owner"], bits=8)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    assert {r["id"]: r["owner"] for r in got.collect()} == {0: "a", 1: None, 2: "a", 3: None, 4: "b", 5: None}


def test_lookups_over_events_can_be_planned(spark):
    a = atomic_from_events(events(spark, 40))
    ranges = spark.createDataFrame([(10 << 24, (11 << 24) - 1, "ten")], "lo long, hi long, name string")
    flags = {r["event_id"]: r["ip_excluded"] for r in L.ip_in_cidr(a, L.fixture_iab_lists(spark)["cidr"]).collect()}
    names = {r["event_id"]: r["name"] for r in L.ip_range_lookup(a, ranges, ["name"]).collect()}
    assert flags == {f"e{i}": i % 5 in (0, 1) for i in range(40)}
    assert names == {f"e{i}": "ten" if i % 5 == 0 else None for i in range(40)}


def test_streams_and_their_table_are_compressed(spark, tmp_path):
    """On disk they are the largest part of the query; the lines stay the same."""
    events(spark, 60).write.parquet(f"{tmp_path}/events.parquet")
    dirs = io._stream_dirs(spark, str(tmp_path))
    out = f"{tmp_path}/routed"
    stream_parse_route(spark, dirs, out, f"{tmp_path}/ck").awaitTermination()
    for folder, end in [*((d, ".txt.gz") for d in dirs.values()), (out, ".zstd.parquet")]:
        files = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert files and all(f.endswith(end) for f in files)
    lines = io.enriched_lines(spark, str(tmp_path))
    for name, folder in dirs.items():
        assert sorted(r[0] for r in spark.read.text(folder).collect()) == sorted(
            r["value"] for r in lines.filter(F.col("stream") == name).collect())
    assert sorted(spark.read.parquet(out).collect()) == sorted(route_by_stream(lines).collect())
