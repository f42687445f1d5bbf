"""Where a stream begins (S12), as offsets of its source.

For a message broker these are its reader's options.  For a folder of files the
start is a time: files that were there before it are never read.  It is written
down at the first start, so that a restart does not move it.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.streaming.ledger import Ledger

POSITIONS = ("TRIM_HORIZON", "LATEST", "AT_TIMESTAMP")


def _millis(at: datetime | None) -> int:
    if at is None:
        raise ValueError("AT_TIMESTAMP needs a time")
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def broker_options(position: str, at: datetime | None = None) -> dict[str, str]:
    """Reader options of a Kafka-like source."""
    p = position.upper()
    if p not in POSITIONS:
        raise ValueError(f"start position must be one of {', '.join(POSITIONS)}")
    if p == "AT_TIMESTAMP":
        return {"startingTimestamp": str(_millis(at)), "startingOffsetsByTimestampStrategy": "latest"}
    return {"startingOffsets": "earliest" if p == "TRIM_HORIZON" else "latest"}


def read_folder(spark: SparkSession, fmt: str, path: str, position: str, state: str, at: datetime | None = None,
                schema=None, **options) -> DataFrame:
    """A stream of the files of ``path`` from ``position`` on; ``state`` is a folder beside the stream's checkpoint.

    Files are told apart by modification time, which Spark prunes by before it opens them.
    """
    broker_options(position, at)  # checks the arguments
    p = position.upper()
    now = {"TRIM_HORIZON": None, "LATEST": int(time.time() * 1000), "AT_TIMESTAMP": _millis(at) if p == "AT_TIMESTAMP" else None}[p]
    since = Ledger(spark, state).first("start", {"position": p, "since": now})["since"]
    reader = spark.readStream.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if since is None:
        return df
    return df.filter(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(since)))
