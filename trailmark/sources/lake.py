"""Lake sources and sinks (S06-S17): scans, appends, fan-out, batching, start positions, skip lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_lake_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The table at its current snapshot.  Iceberg/Delta/Hudi only need their format name and jar."""
    return spark.read.format(fmt).options(**options).load(path)


def write_events(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet",
                 partition_by: Sequence[str] = (), compression: str = "snappy") -> None:
    """Append (or overwrite) a table; parquet with snappy by default."""
    w = df.write.mode(mode).format(fmt).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_schema_data(df: DataFrame, path: str) -> None:
    """Append ``(schema, data)`` rows to the debug/events table."""
    write_events(df.select("schema", "data"), path, mode="append")


def sink_fan_out(df: DataFrame, sinks: Sequence[Callable[[DataFrame], None]]) -> None:
    """Write one batch to several outputs, computing it once (persisted for the duration)."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()


def fan_out_batch(sinks: dict[str, Callable[[DataFrame, int], None]], ledger):
    """``foreachBatch`` callback that writes each micro-batch once to each named sink.

    A sink that has taken a batch is noted in the ledger, so a batch replayed after another sink failed goes only to
    the sinks that lack it.  Sinks get the batch id: one that fails half-way must overwrite by it, or pass it on as
    its own transaction id, as ``write_batch`` does.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        lacking = [name for name in sinks if ledger.get(f"{name}-{batch_id}") is None]
        if not lacking:
            return
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in lacking:
                sinks[name](batch, batch_id)
                ledger.put(f"{name}-{batch_id}", {"done": True})
        finally:
            batch.unpersist()
    return handle


def write_batch(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a partition of its own, which a replay overwrites."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
    return sink


def batch_by_size_or_delay(df: DataFrame, ts_col: str, size: Column, max_bytes: int, max_delay: str,
                           order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Assign each record to an emitted batch: a new batch starts every ``max_delay`` window or
    when the running byte count inside the window exceeds ``max_bytes``.

    The running byte count is computed per one-second slice of each window
    and shifted by the window's earlier slices (``running_total_in_group``),
    so even a window holding a large share of all records is spread over tasks.
    """
    from trailmark.operators.ranking import asc, running_total_in_group

    df = df.withColumn("batch_window", F.window(F.col(ts_col), max_delay).start)
    df = running_total_in_group(df, "batch_window", ts_col, [asc(ts_col), *[asc(c) for c in order]],
                                size.cast("bigint"), "__cum")
    return df.withColumn("batch_no", F.floor((F.col("__cum") - 1) / F.lit(max_bytes)).cast("bigint")).drop("__cum")


def start_position(df: DataFrame, position: str, ts_col: str = "collector_tstamp", at=None) -> DataFrame:
    """S12 over a stored table: TRIM_HORIZON = everything, LATEST = nothing already stored, AT_TIMESTAMP = from ``at`` on.

    Streams begin at source offsets: ``streaming.start``.
    """
    p = position.upper()
    if p == "TRIM_HORIZON":
        return df
    if p == "LATEST":
        return df.limit(0)
    if p == "AT_TIMESTAMP":
        return df.filter(F.col(ts_col) >= F.lit(at))
    raise ValueError(position)


PARTITION_KEYS = ("event_id", "event_fingerprint", "domain_userid", "network_userid", "user_ipaddress",
                  "domain_sessionid", "user_fingerprint")


def partition_output(df: DataFrame, key: str | None = None, n: int | None = None) -> DataFrame:
    """Hash-partition the output by one of the allowed keys, else round-robin."""
    n = n or df.sparkSession.sparkContext.defaultParallelism
    if key is None:
        return df.repartition(n)
    if key not in PARTITION_KEYS:
        raise ValueError(f"partition key must be one of {PARTITION_KEYS}")
    return df.repartition(n, key)


SCHEMA_KEY = r"^iglu:([^/]+)/([^/]+)/([^/]+)/([0-9]+)-([0-9]+)-([0-9]+)$"


def schema_matches(key: Column, criteria: Sequence[str]) -> Column:
    """TRUE when the schema key matches any criterion ``iglu:v/n/f/M-R-A`` where parts may be ``*``."""
    import re
    cond = F.lit(False)
    for c in criteria:
        m = re.match(r"^iglu:([^/]+)/([^/]+)/([^/]+)/([0-9*]+)-([0-9*]+)-([0-9*]+)$", c)
        if not m:
            raise ValueError(f"bad schema criterion {c}")
        one = F.lit(True)
        for i, part in enumerate(m.groups(), start=1):
            if part != "*":
                one = one & (F.regexp_extract(key, SCHEMA_KEY, i) == part)
        cond = cond | (key.rlike(SCHEMA_KEY) & one)
    return cond


def skip_schemas(df: DataFrame, schema_col: str, criteria: Sequence[str]) -> DataFrame:
    """Drop rows whose schema key matches a skip criterion."""
    return df.filter(~F.coalesce(schema_matches(F.col(schema_col), criteria), F.lit(False)))


def skip_schema_entities(entities: Column, criteria: Sequence[str], field: str = "schema") -> Column:
    """S15 for entity arrays: keep the elements whose schema does not match."""
    return F.filter(entities, lambda e: ~F.coalesce(schema_matches(e[field], criteria), F.lit(False)))


def dead_letter_split(df: DataFrame, failure_col: str = "failure") -> tuple[DataFrame, DataFrame]:
    """Rows a loader can process, and the rest for its bad output."""
    return df.filter(F.col(failure_col).isNull()), df.filter(F.col(failure_col).isNotNull())
