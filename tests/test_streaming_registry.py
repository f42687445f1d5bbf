"""Stream = batch for the streaming operators, and the driver contract."""

import uuid

from pyspark.sql import functions as F

from conftest import SF
from trailmark.session import checkpoint_dir
from trailmark.sources.tables import atomic
from trailmark.streaming import pipeline as T


def _paths(spark, n):
    base = checkpoint_dir(spark)
    return [f"{base}/test-{uuid.uuid4().hex}" for _ in range(n)]


def test_stream_dedupe_and_metrics_equal_batch(spark):
    src, out, ck = _paths(spark, 3)
    a = atomic(spark, SF).select("event_id", "collector_tstamp", "platform")
    a.write.parquet(src)
    st = T.stream_dedupe(spark.readStream.schema(a.schema).parquet(src))
    T.stream_load(st, out, ck, trigger="availableNow").awaitTermination()
    got = spark.read.parquet(out).select("event_id").distinct().count()
    assert got == spark.read.parquet(out).count() == a.select("event_id").distinct().count()

    out2, ck2 = _paths(spark, 2)
    m = T.pipeline_metrics(spark.readStream.schema(a.schema).parquet(src), "collector_tstamp", "10 minutes",
                           by="platform", watermark="1 hour")
    (m.writeStream.format("parquet").option("path", out2).option("checkpointLocation", ck2)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    streamed = spark.read.parquet(out2)
    batch = T.pipeline_metrics(a, "collector_tstamp", "10 minutes", by="platform")
    # windows still open at the end of the input are not emitted in append mode
    assert streamed.count() > 0
    assert streamed.join(batch, ["period_start", "platform"]).filter(streamed.n != batch.n).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    from trailmark.registry.catalog import all_oracles, all_queries
    q, o = all_queries(), all_oracles()
    assert set(o) == set(q)
    assert set(q) <= set(e.queries()) and set(o) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
