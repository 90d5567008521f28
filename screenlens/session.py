"""Where intermediate tables go, and the session settings the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with the executor, so the setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="screenlens-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/screenlens/{app}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far. Call it when the results of a query are stored; DataFrames made
    before cannot be read any more. What is left when the session ends goes then."""
    context = spark.sparkContext
    for path in _written.pop(context.applicationId, []):
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan.

    Later branches then see one fixed assignment of rows (a recomputed range partitioning may
    choose other bounds), read only the columns they need, and do not depend on executors that
    held the shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _delete_when_session_ends(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_when_session_ends(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def local_session(cpus: int | str = 8, name: str = "screenlens") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
