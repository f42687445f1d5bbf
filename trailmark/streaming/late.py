"""Windowed metrics and de-duplication that lose no late row.

Spark's own watermark drops what comes behind it.  Here each micro-batch reads
the watermark of the batches before it from a ledger, rows behind it go whole to
a side table, and the rest is aggregated or de-duplicated against tables kept by
batch id.  On time and late together are all rows that came in, and a replayed
batch overwrites its own output.

Nothing passes through the driver but the greatest event time of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.functions.timeutil import epoch_micros
from trailmark.operators.ranking import asc, top1_per_group
from trailmark.streaming.ledger import Ledger

_TIME = "__micros"


def seconds(delay: str) -> float:
    """Seconds of an interval such as '10 minutes'."""
    n, unit = delay.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def start(src: DataFrame, handle, checkpoint: str, trigger: str | None) -> StreamingQuery:
    w = src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger in (None, "availableNow") else w.trigger(processingTime=trigger)
    return w.start()


@dataclass
class Watermark:
    """Greatest event time of the batches before one, less the delay (microseconds; None before the first)."""

    ledger: Ledger
    delay_us: int

    def before(self, batch_id: int) -> int | None:
        last = self.ledger.get(f"batch-{batch_id - 1}") if batch_id else None
        return last["greatest"] - self.delay_us if last and last["greatest"] is not None else None

    def commit(self, batch_id: int, greatest: int | None) -> None:
        last = (self.ledger.get(f"batch-{batch_id - 1}") or {}).get("greatest") if batch_id else None
        known = [x for x in (last, greatest) if x is not None]
        self.ledger.put(f"batch-{batch_id}", {"greatest": max(known, default=None)})


def _keep(df: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """``df`` as the output of a batch, in place of what the batch wrote before."""
    path = f"{folder}/batch={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def windowed(src: DataFrame, ts_col: str, period: str, by: tuple[str, ...], parts: dict[str, tuple[Column, str]],
             out: str, checkpoint: str, delay: str = "1 minute", trigger: str | None = None) -> StreamingQuery:
    """Tumbling-window aggregates of a stream, kept as parts of each batch under ``out/parts``, and late rows whole
    under ``out/late``.

    ``parts``: name -> (aggregate of a batch, function that merges batches: sum, max or min).  A row is late if its
    window ended at or before the watermark, as Spark judges it; rows without event time go to the late table too.
    ``result`` merges the parts.
    """
    spark = src.sparkSession
    ledger = Ledger(spark, f"{out}/ledger")
    mark, length = Watermark(ledger, int(seconds(delay) * 1e6)), int(seconds(period) * 1e6)

    def handle(batch: DataFrame, batch_id: int) -> None:
        limit = mark.before(batch_id)
        rows = batch.withColumn(_TIME, epoch_micros(F.col(ts_col)))
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            end = F.expr(f"({_TIME} - pmod({_TIME}, {length})) + {length}")
            behind = F.col(_TIME).isNull() if limit is None else F.col(_TIME).isNull() | (end <= limit)
            grouped = rows.filter(~behind).groupBy((end - length).alias("__start"), *by).agg(
                *[c.alias(n) for n, (c, _) in parts.items()], F.max(_TIME).alias(_TIME))
            kept = _keep(grouped, f"{out}/parts", batch_id)
            _keep(rows.filter(behind).drop(_TIME).withColumn("watermark_us", F.lit(limit).cast("long")), f"{out}/late", batch_id)
            mark.commit(batch_id, kept.agg(F.max(_TIME)).first()[0])
        finally:
            rows.unpersist()

    return start(src, handle, checkpoint, trigger)


def result(spark: SparkSession, out: str, by: tuple[str, ...], merges: dict[str, str]) -> DataFrame:
    """``period_start`` (wall clock, UTC), ``by`` and the merged aggregates of all batches so far."""
    rows = spark.read.option("basePath", f"{out}/parts").parquet(f"{out}/parts")
    merged = rows.groupBy("__start", *by).agg(*[getattr(F, fn)(n).alias(n) for n, fn in merges.items()])
    start = F.timestamp_add("MICROSECOND", F.col("__start"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return merged.select(start.alias("period_start"), *by, *merges)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """All late rows so far, with the batch that brought them and the watermark they were behind."""
    return spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late")


def pipeline_metrics(src: DataFrame, ts_col: str, out: str, checkpoint: str, period: str = "10 seconds",
                     by: str = "stream", delay: str = "1 minute", trigger: str | None = None) -> StreamingQuery:
    """T03 with late rows: record counts per period and stream; read by ``result(spark, out, (by,), {"n": "sum"})``."""
    return windowed(src, ts_col, period, (by,), {"n": (F.count("*"), "sum")}, out, checkpoint, delay, trigger)


def latency_health(src: DataFrame, processed_col: str, received_col: str, out: str, checkpoint: str,
                   period: str = "10 seconds", delay: str = "1 minute", trigger: str | None = None) -> StreamingQuery:
    """T04 with late rows: greatest latency per period; read by ``health``."""
    lat = (epoch_micros(F.col(processed_col)) - epoch_micros(F.col(received_col))) / 1e6
    return windowed(src, processed_col, period, (), {"max_latency_s": (F.max(lat), "max")}, out, checkpoint, delay, trigger)


def health(spark: SparkSession, out: str, threshold_s: float = 120.0) -> DataFrame:
    return result(spark, out, (), {"max_latency_s": "max"}).withColumn("unhealthy", F.col("max_latency_s") > threshold_s)


def dedupe(src: DataFrame, out: str, checkpoint: str, key: str = "event_id", ts_col: str = "collector_tstamp",
           delay: str = "1 hour", trigger: str | None = None) -> StreamingQuery:
    """T06 with late rows: first arrivals under ``out/rows``; what comes behind the watermark whole under ``out/late``.

    A row on time is a repeat if a row of its key was kept within ``delay`` of it, in its own batch or an earlier
    one; of rows of one key within a batch the earliest is first.  Kept keys are looked up in the batches that can
    still matter: those whose greatest event time is not more than twice the delay behind.
    """
    spark = src.sparkSession
    mark = Watermark(Ledger(spark, f"{out}/ledger"), int(seconds(delay) * 1e6))

    def handle(batch: DataFrame, batch_id: int) -> None:
        limit = mark.before(batch_id)
        rows = batch.withColumn(_TIME, epoch_micros(F.col(ts_col)))
        held_frames = [rows.persist(StorageLevel.MEMORY_AND_DISK)]
        try:
            behind = F.col(_TIME).isNull() if limit is None else F.col(_TIME).isNull() | (F.col(_TIME) < limit)
            fresh = rows.filter(~behind)
            live = batches_since(mark, batch_id, limit)
            if live:
                held = spark.read.schema(rows.schema).parquet(*[f"{out}/rows/batch={b}" for b in live]).select(
                    F.col(key).alias("__key"), F.col(_TIME).alias("__at")).filter(F.col("__at") >= limit - mark.delay_us)
                near = fresh[key].eqNullSafe(held["__key"]) & (F.abs(fresh[_TIME] - held["__at"]) <= mark.delay_us)
                fresh = fresh.join(held, near, "left_anti")
            kept = _keep(apart(fresh, key, mark.delay_us, held_frames), f"{out}/rows", batch_id)
            _keep(rows.filter(behind).drop(_TIME).withColumn("watermark_us", F.lit(limit).cast("long")), f"{out}/late", batch_id)
            greatest = rows.filter(~behind).agg(F.max(_TIME)).first()[0]
            mark.commit(batch_id, greatest)
            mark.ledger.put(f"counts-{batch_id}", {"rows": rows.count(), "kept": kept.count()})
        finally:
            for frame in held_frames:
                frame.unpersist()

    return start(src, handle, checkpoint, trigger)


def batches_since(mark: Watermark, batch_id: int, limit: int | None) -> list[int]:
    """Earlier batches that may hold rows within the delay of a row on time, newest first."""
    live = []
    while limit is not None and batch_id > 0:
        batch_id -= 1
        greatest = mark.ledger.get(f"batch-{batch_id}")["greatest"]  # of all batches up to this, so it never falls
        if greatest is None or greatest < limit - mark.delay_us:
            break
        live.append(batch_id)
    return live


def apart(rows: DataFrame, key: str, delay_us: int, held_frames: list) -> DataFrame:
    """Of each key the earliest row, the earliest of those more than the delay after it, and so on.

    Equal times: the least row hash.  One round finds the next row of every key, so there are as many rounds as the
    rows span delays, mostly one; a round is an aggregate with map-side combine and a join, whatever a key's share.
    What it persists it adds to ``held_frames``.
    """
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    rest, kept = top1_per_group(rows, [key, _TIME], [asc(F.xxhash64(*plain))]), None
    while True:
        first = rest.groupBy(F.col(key).alias("__key")).agg(F.min(_TIME).alias("__first"))
        timed = rest.join(first, rest[key].eqNullSafe(first["__key"])).drop("__key").persist(StorageLevel.MEMORY_AND_DISK)
        held_frames.append(timed)
        now = timed.filter(F.col(_TIME) == F.col("__first")).drop("__first")
        kept = now if kept is None else kept.unionByName(now)
        rest = timed.filter(F.col(_TIME) - F.col("__first") > delay_us).drop("__first")
        if rest.isEmpty():
            return kept


def kept_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop(_TIME, "batch")
