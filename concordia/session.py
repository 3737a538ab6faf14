"""SparkSession construction and shared-storage helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "concordia",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for the audit jobs: AQE with skew-join splitting, UTC, no UI."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("CONCORDIA_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CONCORDIA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder in use: the one already registered, else the shared
    folder the session names in ``spark.checkpoint.dir``; only when it names none (local
    tests) a scratch folder is created and registered."""
    sc = spark.sparkContext
    registered = sc.getCheckpointDir()
    if registered:
        return registered
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="concordia-ckpt-")  # one machine, no folder named (tests)
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001 - a session may refuse runtime changes of core settings
        pass
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


ROWS = 100_000  # rows a task sorts, where their number decides


def partitions(df: DataFrame) -> int:
    """Partitions of at most about ROWS rows of ``df`` each, one a core at least. Partitions joined by
    their compressed bytes hold ever more rows, and a task that sorts them ever more memory."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


TEXTS = 10_000  # rows with a whole text that a task takes apart


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by its columns ``by`` to tasks of about TEXTS rows, one a core at least: a table of
    few bytes is read by one task or two, and what its rows become would be their work alone."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TEXTS))
    return df.repartition(tasks, *by)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# generated methods above the JVM's own limit stay interpreted: plans with such run operator by operator, in small methods
HUGE_METHOD, HUGE_METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of an intermediate that several later stages read: Parquet under the shared
    ``spark.checkpoint.dir`` (survives executor loss). Its plan runs once (a checkpoint runs the
    last stage twice) and its shuffle files go with it. Columns are written without dictionaries,
    so that file sizes stay near those of the rows and nothing large passes for small in a join."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut/{uuid.uuid4().hex}"
    before = {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, "false"), HUGE_METHOD: spark.conf.get(HUGE_METHOD)}
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(HUGE_METHOD, HUGE_METHOD_BYTES)
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
