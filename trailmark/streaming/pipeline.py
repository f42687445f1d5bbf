"""Structured Streaming jobs (T01-T06).  The transforms are the batch functions unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.sources.tsv import route_by_stream, union_tagged_streams


def _trigger(writer, trigger: str | None):
    return writer.trigger(availableNow=True) if trigger in (None, "availableNow") else \
        writer.trigger(processingTime=trigger)


def read_stream_dirs(spark: SparkSession, dirs: dict[str, str], max_files: int | None = None) -> DataFrame:
    """Text record streams (one folder per origin stream) as one tagged stream."""
    streams = {}
    for name, d in dirs.items():
        r = spark.readStream.format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        streams[name] = r.load(d)
    return union_tagged_streams(streams)


def stream_parse_route(spark: SparkSession, dirs: dict[str, str], out: str, checkpoint: str,
                       trigger: str | None = None) -> StreamingQuery:
    """Parse and route the three enriched streams continuously into a (schema, data) table.

    Rendered documents repeat the names of all fields, so the table is packed closer than by default.
    """
    routed = route_by_stream(read_stream_dirs(spark, dirs))
    w = routed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .option("compression", "zstd")
    return _trigger(w.outputMode("append"), trigger).start()


def stream_load(src: DataFrame, out: str, checkpoint: str, trigger: str | None = "1 minute",
                partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Micro-batch append to a lake table every ``trigger``; resumes from the checkpoint."""
    w = src.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return _trigger(w.outputMode("append"), trigger).start()


def stream_fan_out(src: DataFrame, sinks: dict, ledger_dir: str, checkpoint: str,
                   trigger: str | None = None) -> StreamingQuery:
    """Every micro-batch to every sink, each once however often it is replayed (``lake.fan_out_batch``)."""
    from trailmark.sources.lake import fan_out_batch
    from trailmark.streaming.ledger import Ledger

    handle = fan_out_batch(sinks, Ledger(src.sparkSession, ledger_dir))
    return _trigger(src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint), trigger).start()


def pipeline_metrics(df: DataFrame, ts_col: str, period: str = "10 seconds", by: str = "stream",
                     watermark: str | None = "1 minute") -> DataFrame:
    """Record counts per reporting period and stream (tumbling window; watermark bounds state)."""
    if watermark and df.isStreaming:
        df = with_event_time(df, ts_col, watermark)
        return (df.groupBy(F.window(F.col("__event_time"), period).alias("w"), F.col(by))
                .agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("w.start").alias("period_start"), by, "n"))
    return (df.groupBy(F.window(F.col(ts_col), period).alias("w"), F.col(by))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("period_start"), by, "n"))


def latency_health(df: DataFrame, processed_col: str, received_col: str, period: str = "10 seconds",
                   threshold_s: float = 120.0, watermark: str | None = "1 minute") -> DataFrame:
    """Max latency (processed - received, seconds) per period and an unhealthy flag."""
    from trailmark.functions.timeutil import epoch_micros

    at = processed_col
    if watermark and df.isStreaming:
        df, at = with_event_time(df, processed_col, watermark), "__event_time"
    lat = (epoch_micros(F.col(processed_col)) - epoch_micros(F.col(received_col))) / 1e6
    return (df.groupBy(F.window(F.col(at), period).alias("w"))
            .agg(F.max(lat).alias("max_latency_s"))
            .select(F.col("w.start").alias("period_start"), "max_latency_s",
                    (F.col("max_latency_s") > threshold_s).alias("unhealthy")))


def incomplete_same_table(good: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Incomplete events go to the same table as good ones (append of the union)."""
    return good.unionByName(incomplete, allowMissingColumns=True)


def with_event_time(df: DataFrame, ts_col: str, delay: str, name: str = "__event_time") -> DataFrame:
    """Watermark on ``ts_col`` (wall-clock ``timestamp_ntz`` columns are read as UTC instants)."""
    from pyspark.sql import types as Ty

    if isinstance(df.schema[ts_col].dataType, Ty.TimestampType):
        return df.withColumn(name, F.col(ts_col)).withWatermark(name, delay)
    return df.withColumn(name, F.to_utc_timestamp(F.col(ts_col).cast("timestamp"), "UTC")).withWatermark(name, delay)


def stream_dedupe(df: DataFrame, key: str = "event_id", ts_col: str = "collector_tstamp",
                  delay: str = "1 hour") -> DataFrame:
    """Drop repeats of ``key`` arriving within ``delay`` of each other (bounded state)."""
    return with_event_time(df, ts_col, delay).dropDuplicatesWithinWatermark([key]).drop("__event_time")
