"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that nothing refers to any more.

    It drops them when the driver collects its garbage, which a driver with a
    large heap may not do before a job of many steps ends.  What the last step
    left is only let go by a first collection and found by a second.
    """
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    Cuts the lineage: later steps read shared storage, so a lost executor costs
    no recomputation of what came before, and the shuffle files of the steps
    before can go.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(run: Callable) -> Callable:
    """``run``, a function over batches, after which the worker gives its free memory back to the system.

    Workers stay for later tasks, beside steps that need no Python at all.
    """
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def returning(run: Callable) -> Callable:
    """``run``, a function over a group's table, after which the worker gives its free memory back to the system."""
    def whole(group):
        out = run(group)
        give_back()
        return out

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def put_aside(df: DataFrame, names: list[str]):
    """``df`` with its own columns of these names under others, and a function that gives a later frame ``df``'s columns back."""
    aside = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c in names}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in df.columns])

    return df.withColumnsRenamed(aside), back


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (one small aggregate, from which task counts are derived)."""
    row = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(n_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // per_part))


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut (between rows, without copying) so that each holds about ``most_bytes`` of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        ends = text_ends(col)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, base + most_bytes, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def text_ends(col: pa.Array) -> np.ndarray:
    """Running ends of the texts in bytes (null: no bytes)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(sizes.astype(np.int64))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets of n + 1 texts); null texts are empty."""
    import pyarrow.compute as pc

    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    ends = np.concatenate([[0], text_ends(col)])
    if len(col) == 0 or ends[-1] == 0:
        return np.zeros(0, np.uint8), ends
    start = int(np.frombuffer(col.buffers()[1], np.int64)[col.offset])
    data = np.frombuffer(col.buffers()[2], np.uint8)
    return data[start:start + int(ends[-1])], ends


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list array from flat values and the number of values of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# --- hashing of words and byte strings ---------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd
_BYTE = np.random.default_rng(1).integers(0, 2 ** 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64 (grown as needed, kept by the worker)."""
    while len(_powers[0]) < n:
        have = len(_powers[0])
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2 ** 64))):
            step = np.uint64(pow(base, have, 2 ** 64))
            _powers[i] = np.concatenate([_powers[i], _powers[i] * step])
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the bytes, from which any substring's hash follows."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[1:], out=out[1:])
    return out


def word_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each substring buf[start:stop]."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    sums = prefix_hash(buf)
    _, down = powers(len(buf) + 1)
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
