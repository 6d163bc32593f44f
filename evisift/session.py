"""Session helpers: builder for local runs, checkpoint folder, checked size estimates."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 32 << 20
SPREAD_LIMIT_BYTES = 1 << 30


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evisift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Call-site capture costs about a millisecond per Column call; our expressions are generated.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Workers on other machines, or started from another folder, cannot import it otherwise. The archive is written to the
    shared checkpoint folder, from where Spark hands it to the executors; without such a folder the package has to
    be given with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.master.startswith("local")):
        return
    ensure_checkpoint_dir(spark)
    top, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = f"{sc.getCheckpointDir()}/{top.name}-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; fall back to a fresh one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it back; survives executor loss.

    Unlike a checkpointed RDD the table has column pruning, filters at the scan and a known size, so joins after it
    are planned on what is really there.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate proves it small; otherwise leave it to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input (few row groups) every core.

    Large inputs already arrive in many splits and pass through untouched, so no
    shuffle is added at scale. Hashing on ``key`` lets a later group-by reuse it.
    """
    if estimated_bytes(df) > SPREAD_LIMIT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
