"""Session defaults: UTC, ANSI SQL, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fieldlark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults.

    Partition counts and memory are left to the cluster's own configuration
    unless given; ``conf`` keys use ``__`` for dots.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it, if they have no copy of their own.

    Arrow batches come in fewer rows than Spark's default, unless the session
    says otherwise: a row may hold a whole text or a set of thousands of hashes, and each
    batch is held several times on its way to Python.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (env.get("PYTHONPATH"), root) if p)
    if spark.conf.get(ROWS) == "10000":  # as Spark has it
        spark.conf.set(ROWS, "2000")
    return spark


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def spread(df: DataFrame, *keys) -> DataFrame:
    """The rows dealt to three tasks a core by their keys. For work that is heavy for its bytes: a small file is read by one task,
    and adaptive execution would join small partitions again."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share, ``spark.checkpoint.dir``. Only a local session, as in tests, gets
    one of its own where none is set."""
    import tempfile
    import uuid

    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        d = f"file://{tempfile.mkdtemp(prefix='fieldlark-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
