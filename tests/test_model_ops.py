"""Model operators on literal rows: dedupe, entities, sessions/users invariants on the fixture."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF
from trailmark.config import ModelConfig
from trailmark.operators.entities import extract_entities, session_identifier
from trailmark.operators.ranking import dedupe_events


def test_dedupe_keeps_earliest_and_one_null_id(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("e1", t + dt.timedelta(seconds=1), "late"), ("e1", t, "early"), (None, t, "n1"), (None, t, "n2")]
    df = spark.createDataFrame(rows, "event_id string, collector_tstamp timestamp_ntz, tag string") \
        .withColumn("dvce_created_tstamp", F.col("collector_tstamp"))
    out = {r.event_id: r.tag for r in dedupe_events(df).collect()}
    assert out["e1"] == "early" and len(out) == 2  # all NULL ids form one group


def test_entities_toggle_missing_and_array_read(spark):
    df = spark.createDataFrame(
        [([{"id": "v1"}], "d1"), ([], "d2")],
        "contexts_com_snowplowanalytics_snowplow_web_page_1 array<struct<id:string>>, domain_sessionid string")
    on = extract_entities(df, ModelConfig()).select("page_view__id", "yauaa__device_class").collect()
    assert [r.page_view__id for r in on] == ["v1", None]          # first element; empty array -> NULL
    assert all(r.yauaa__device_class is None for r in on)          # absent entity column -> NULL
    off = extract_entities(df, ModelConfig(flags={"enable_web_page": False})).collect()
    assert all(r.page_view__id is None for r in off)               # flag off -> NULL


def test_session_field_is_case_sensitive(spark):
    df = spark.createDataFrame([([{"session_id": "s-snake"}], "dsid")],
                               "contexts_com_snowplowanalytics_snowplow_client_session_1 "
                               "array<struct<session_id:string>>, domain_sessionid string")
    cfg = ModelConfig().with_all_entities()
    assert df.select(session_identifier(df, cfg).alias("s")).first().s == "dsid"
    from dataclasses import replace
    cfg2 = replace(cfg, session_field="session_id")
    assert df.select(session_identifier(df, cfg2).alias("s")).first().s == "s-snake"


def test_fixture_model_invariants(spark):
    from trailmark.registry.models import model
    m = model(spark, SF)
    s = m.sessions
    assert s.count() == s.select("session_identifier").distinct().count()
    bad = s.select("total_events", F.aggregate(F.map_values("event_counts"), F.lit(0).cast("bigint"),
                                               lambda a, x: a + x).alias("sum_counts")) \
        .filter(F.col("total_events") != F.col("sum_counts")).count()
    assert bad == 0
    u = m.users
    assert u.count() == u.select("user_identifier").distinct().count() > 0
    ev = m.events
    assert ev.count() == ev.select("event_id").distinct().count()


def test_rank_in_group_matches_row_number(spark):
    from pyspark.sql import Window

    from trailmark.operators.ranking import asc, rank_in_group
    base = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
        .alias("g"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=(F.col("id") * 7 % 5000).cast("int")))
        .cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("string").alias("k"))
    base = base.unionByName(base.limit(5).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
                            .withColumn("k", F.concat("k", F.lit("n"))))
    order = [asc("ts"), asc("k")]
    got = rank_in_group(base, "g", "ts", order, "r", count_out="n", bucket_seconds=60)
    want = base.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    j = got.join(want.drop("ts"), ["g", "k"])
    assert j.count() == base.count()
    assert j.filter(F.col("r") != F.col("r2")).count() == 0
    sizes = {r.g: r.c for r in base.groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert all(r.n == sizes[r.g] for r in got.select("g", "n").distinct().collect())


def test_rank_in_group_reads_its_input_once_and_splits_rows_without_time(spark):
    """Against row_number(), with hot groups, equal times and rows that lack one or both times."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from trailmark.operators.ranking import asc, rank_in_group

    rng = random.Random(6)
    t = lambda: None if rng.random() < 0.4 else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(600))
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), t(), t(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, dv timestamp_ntz, i int")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    counted = df.mapInPandas(count, df.schema)
    order = [asc("ts"), asc("dv"), asc("i")]
    got = rank_in_group(counted, "g", "ts", order, "rn", count_out="n", then_col="dv").collect()
    assert seen.value == 500
    w = Window.partitionBy("g")
    want = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    assert sorted((r["i"], r["rn"], r["n"]) for r in got) == sorted((r["i"], r["rn"], r["n"]) for r in want.collect())


def test_sessions_in_two_passes_equal_the_single_steps(spark):
    """Against session_firsts, session_lasts, session_aggs, pinged_time and event_counts, with rows that lack times,
    ids, views and sessions; the events are read twice."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from trailmark.config import fixture_config
    from trailmark.plans import sessions as S

    rng = random.Random(11)
    when = lambda p: None if rng.random() < p else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(90))
    rows = [(None if rng.random() < 0.05 else f"e{rng.randrange(300)}", rng.choice([None, "s1", "s2", "s3", "s3", "s3"]),
             rng.choice([None, "v1", "v2", "v3"]), rng.choice([None, "page_ping", "page_ping", "page_view", "screen_view", "other"]),
             when(0.1), when(0.1), rng.choice([None, 1.0, 2.5]), rng.choice([None, True, False, False]), k) for k in range(400)]
    rows += [(f"p{k}", "s4", "v1", "page_ping", when(0), when(0), None, None, k) for k in range(9)]  # no view: no last row
    rows += [("x", "s5", None, "other", when(0), when(0), None, None, 0)]  # neither first nor last
    events = spark.createDataFrame(rows, "event_id string, session_identifier string, view_id string, event_name string, "
                                         "derived_tstamp timestamp_ntz, dvce_created_tstamp timestamp_ntz, tr_total_base double, "
                                         "iab__spider_or_robot boolean, k int")
    cfg, key = fixture_config(), "session_identifier"

    def table(df, *cols):
        return sorted(repr((r[key], *[r[c] for c in cols])) for r in df.collect())

    numbers = S.session_numbers(S.session_parts(events, cfg), cfg)
    aggs = S.session_aggs(events)
    same = ["total_events", "views", "cv_view_page_volume", "cv_view_page_total", "cv_view_page_first_conversion", "cv_view_page_converted"]
    assert table(numbers, "a_start", "a_end", "a_abs", *same) == table(aggs, "start_tstamp", "end_tstamp", "absolute_time_in_s", *same)
    engaged = numbers.filter("engaged_time_in_s is not null")
    assert table(engaged, "engaged_time_in_s") == table(S.pinged_time(events, cfg), "engaged_time_in_s")
    named = numbers.filter(f"event_counts is not null and {key} is not null")
    assert table(named, "event_counts", "event_counts_string") == table(
        S.event_counts(events).filter(f"{key} is not null"), "event_counts", "event_counts_string")
    rows = S.first_and_last(events, ["event_id", "derived_tstamp"], ["event_id", "derived_tstamp"])
    assert table(rows.select(key, "first.*"), "event_id", "derived_tstamp") == table(
        S.session_firsts(events), "event_id", "derived_tstamp")
    assert table(rows.filter("last is not null").select(key, "last.*"), "event_id", "derived_tstamp") == table(
        S.session_lasts(events), "event_id", "derived_tstamp")
    assert rows.filter(F.col("last").isNull()).select(key).collect()[0][0] == "s4"


def test_sessions_read_the_events_twice(spark):
    from pyspark.sql import functions as F

    from conftest import SF
    from trailmark.plans.sessions import unified_sessions
    from trailmark.registry import models
    from trailmark.session import materialize
    from trailmark.sources.dims import fixture_dims

    events = materialize(models.events(spark, SF), "events_for_count")
    used = [f.name for f in events.schema.fields if f.dataType.simpleString() != "void"]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = events.select(*used).mapInArrow(count, events.select(*used).schema)
    got = unified_sessions(counted, models.CFG, fixture_dims(spark), with_model_tstamp=False)
    n = got.count()
    got.write.format("noop").mode("overwrite").save()
    first = seen.value
    assert n == unified_sessions(events, models.CFG, fixture_dims(spark), with_model_tstamp=False).count()
    # once for the parts, and once for each of the two runs of the result
    assert first == 3 * events.count()
    assert got.filter(F.col("total_events") > 0).count() > 0
