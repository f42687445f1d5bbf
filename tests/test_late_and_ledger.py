"""Late rows in side tables, batches replayed to sinks, start positions as source offsets."""

import time
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trailmark.session import checkpoint_dir
from trailmark.sources import lake
from trailmark.streaming import late, pipeline, start
from trailmark.streaming.ledger import Ledger

SCHEMA = "k string, ts timestamp_ntz, s string, v int"
T0 = datetime(2024, 1, 1)


def folder(spark):
    return f"{checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"


def at(second):
    return None if second is None else T0 + timedelta(seconds=second)


def put(spark, path, rows):
    """One file; files of later calls are newer."""
    spark.createDataFrame([(k, at(t), s, v) for k, t, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


BATCHES = [
    [("a", 5, "x", 1), ("b", 12, "x", 2), ("a", 30, "y", 3), ("z", None, "x", 4)],
    [("c", 95, "x", 5), ("d", 1, "y", 6)],  # not late: the watermark is still 30 - 60
    [("e", 21, "x", 7), ("f", 29, "x", 8), ("g", 34, "x", 9), ("h", 300, "y", 10)],  # behind 95 - 60 = 35: windows ended by 35
    [("i", 239, "y", 11), ("j", 241, "x", 12), ("k", None, "y", 13)],  # behind 300 - 60 = 240
]


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def source(spark):
    path = folder(spark)
    for rows in BATCHES:
        put(spark, path, rows)
    return path


def test_metrics_on_time_and_late_are_all_rows(spark, source):
    out, ck = folder(spark), folder(spark)
    late.pipeline_metrics(stream(spark, source), "ts", out, ck, "10 seconds", "s", "1 minute").awaitTermination()
    got = {(r["period_start"].replace(tzinfo=timezone.utc).timestamp(), r["s"]): r["n"] for r in late.result(spark, out, ("s",), {"n": "sum"}).collect()}
    missed = sorted((r["k"], r["watermark_us"]) for r in late.late_rows(spark, out).collect())
    base = T0.replace(tzinfo=timezone.utc).timestamp()
    w35, w240 = (int((base + x) * 1e6) for x in (35, 240))
    assert missed == [("e", w35), ("f", w35), ("i", w240), ("k", w240), ("z", None)]
    assert sum(got.values()) + len(missed) == sum(map(len, BATCHES))
    assert got == {(base + t, s): n for t, s, n in ((0, "x", 1), (0, "y", 1), (10, "x", 1), (30, "x", 1), (30, "y", 1),
                                                    (90, "x", 1), (300, "y", 1), (240, "x", 1))}


def test_a_replayed_batch_changes_nothing(spark, source):
    out, ck = folder(spark), folder(spark)
    run = lambda c: late.pipeline_metrics(stream(spark, source), "ts", out, c, "10 seconds", "s").awaitTermination()
    run(ck)
    first = sorted(map(repr, late.result(spark, out, ("s",), {"n": "sum"}).collect()))
    run(folder(spark))  # all batches once more, under their old ids
    assert sorted(map(repr, late.result(spark, out, ("s",), {"n": "sum"}).collect())) == first


def test_latency_of_late_rows_is_not_lost(spark, source):
    out, ck = folder(spark), folder(spark)
    src = stream(spark, source).withColumn("received", F.expr("ts - make_interval(0, 0, 0, 0, 0, 0, v)"))
    late.latency_health(src, "ts", "received", out, ck, "1 minute", "1 minute").awaitTermination()
    got = {int(r["period_start"].replace(tzinfo=timezone.utc).timestamp() - T0.replace(tzinfo=timezone.utc).timestamp()): (r["max_latency_s"], r["unhealthy"])
           for r in late.health(spark, out, 9).collect()}
    # one-minute windows: nothing of a window that ended after 35 is late; 239 lies in the window that ends at 240
    assert got == {0: (9.0, False), 60: (5.0, False), 300: (10.0, True), 240: (12.0, True)}
    assert sorted(r["k"] for r in late.late_rows(spark, out).collect()) == ["i", "k", "z"]


def test_dedupe_keeps_late_first_arrivals_aside(spark):
    path, out, ck = folder(spark), folder(spark), folder(spark)
    batches = [[("a", 0, "x", 1), ("a", 30, "x", 2), ("a", 100, "x", 3), ("b", 100, "x", 4), (None, 90, "x", 5)],
               [("a", 150, "y", 6), ("c", 10, "y", 7), ("d", 200, "y", 8), ("d", 200, "y", 8), (None, 95, "y", 9), ("e", None, "y", 10)],
               [("b", 139, "z", 11), ("b", 150, "z", 15), ("b", 170, "z", 12), ("a", 211, "z", 13), ("d", 261, "z", 14),
                ("q", 150, "z", 16), ("q", 200, "z", 17), ("q", 211, "z", 18), ("q", 290, "z", 19)]]
    for rows in batches:
        put(spark, path, rows)
    late.dedupe(stream(spark, path), out, ck, "k", "ts", "1 minute").awaitTermination()
    kept = sorted((r["k"] or "", r["v"]) for r in late.kept_rows(spark, out).collect())
    missed = sorted(r["v"] for r in late.late_rows(spark, out).collect())
    # a at 150 repeats a at 100; b at 139 lies behind 200 - 60, b at 150 repeats b at 100, b at 170 does not;
    # q at 200 repeats q at 150, and q at 211 is 61 after it
    assert kept == [("", 5), ("a", 1), ("a", 3), ("a", 13), ("b", 4), ("b", 12), ("d", 8), ("d", 14), ("q", 16), ("q", 18), ("q", 19)]
    assert missed == [7, 10, 11]
    counts = [Ledger(spark, f"{out}/ledger").get(f"counts-{b}") for b in range(3)]
    assert [c["rows"] for c in counts] == [5, 6, 9] and sum(c["kept"] for c in counts) == len(kept)


def test_fan_out_writes_a_replayed_batch_once_to_each_sink(spark):
    path, one, two, ledger, ck = (folder(spark) for _ in range(5))
    put(spark, path, BATCHES[0])
    put(spark, path, BATCHES[1])
    calls = []

    def appending(batch, batch_id):  # a sink that would double its rows if it got a batch twice
        calls.append(("one", batch_id))
        batch.write.mode("append").parquet(one)

    def failing(batch, batch_id):
        calls.append(("two", batch_id))
        if calls.count(("two", 1)) == 1 and batch_id == 1:
            raise RuntimeError("sink two is away")
        lake.write_batch(two)(batch, batch_id)

    def run():
        pipeline.stream_fan_out(stream(spark, path), {"one": appending, "two": failing}, ledger, ck).awaitTermination()

    with pytest.raises(StreamingQueryException, match="away"):
        run()
    run()
    assert calls == [("one", 0), ("two", 0), ("one", 1), ("two", 1), ("two", 1)]
    for out in (one, two):
        assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6]


def test_start_positions_are_source_offsets(spark):
    assert start.broker_options("TRIM_HORIZON") == {"startingOffsets": "earliest"}
    assert start.broker_options("latest") == {"startingOffsets": "latest"}
    assert start.broker_options("AT_TIMESTAMP", datetime(1970, 1, 1, 0, 0, 2))["startingTimestamp"] == "2000"
    with pytest.raises(ValueError):
        start.broker_options("MIDDLE")
    with pytest.raises(ValueError):
        start.broker_options("AT_TIMESTAMP")
    path = folder(spark)
    put(spark, path, BATCHES[0])
    time.sleep(1.1)
    between = datetime.now(timezone.utc)
    put(spark, path, BATCHES[1])
    time.sleep(1.1)
    cases = {"TRIM_HORIZON": folder(spark), "LATEST": folder(spark), "AT_TIMESTAMP": folder(spark)}

    def run(position):
        src = start.read_folder(spark, "parquet", path, position, f"{cases[position]}/state",
                                between if position == "AT_TIMESTAMP" else None, schema=SCHEMA)
        pipeline.stream_load(src, f"{cases[position]}/out", f"{cases[position]}/ck", "availableNow").awaitTermination()
        return sorted(r["v"] for r in spark.read.schema(SCHEMA).parquet(f"{cases[position]}/out").collect())

    assert [run(p) for p in cases] == [[1, 2, 3, 4, 5, 6], [], [5, 6]]
    time.sleep(1.1)
    put(spark, path, BATCHES[2])
    assert run("LATEST") == [7, 8, 9, 10]  # a restart keeps the start it wrote down
    assert run("AT_TIMESTAMP") == [5, 6, 7, 8, 9, 10]
