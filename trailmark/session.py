"""SparkSession helpers: a local builder for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "trailmark", extra: dict | None = None) -> SparkSession:
    """Session for local runs.  On a cluster, pass the cluster's own session instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRAILMARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set to shared storage by the deployment.  Only a
    local session without the setting (tests) gets a fresh scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="trailmark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def constant_null_columns(df) -> dict[str, str]:
    """Output columns that the optimizer folded to a NULL literal (name -> type)."""
    out = {}
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        if plan.nodeName() != "Project":
            return out
        plist = plan.projectList()
        for i in range(plist.size()):
            e = plist.apply(i)
            if e.nodeName() == "Alias" and e.child().nodeName() == "Literal" and e.child().value() is None:
                out[e.name()] = e.dataType().catalogString()
    except Exception:  # noqa: BLE001 - plan introspection is an optimisation only
        return {}
    return out


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Cuts the lineage at a reuse point: later branches scan the table (with
    column pruning) instead of re-running the shuffles that produced it, and a
    lost executor re-reads shared storage instead of recomputing.  Columns the
    optimizer proved constant NULL are not stored; they are re-added as typed
    literals on read, so the result has the same schema and values.
    """
    import uuid

    from pyspark.sql import functions as F

    spark = df.sparkSession
    cols = df.columns
    nulls = constant_null_columns(df)
    if len(nulls) == len(cols):
        nulls = {}
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.drop(*nulls).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if nulls:
        back = back.withColumns({n: F.lit(None).cast(t) for n, t in nulls.items()})
    return back.select(*cols)
