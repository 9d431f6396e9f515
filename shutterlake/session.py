"""Session set-up and the shared working folder of a job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "shutterlake", cpus: str | int = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.config(CHECKPOINT_KEY, checkpoint_dir) if checkpoint_dir else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHUTTERLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once a session, unless PYTHONPATH already leads to them."""
    root, app = Path(__file__).resolve().parent, spark.sparkContext.applicationId
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(root.parent) in on_path:
        return
    archive = Path(tempfile.mkdtemp(prefix="shutterlake-")) / "shutterlake_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


#: A union that claims its inputs' partitioning loses rows of a later window or aggregate when adaptive execution
#: coalesces the inputs differently (seen in Spark 4.1.2), so it is switched off.
SAFE_SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def prepare(spark: SparkSession) -> None:
    """What every query needs of its session."""
    ship_package(spark)
    for k, v in SAFE_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path for one run of an operator, below the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, local
    benches) a temporary one is made and kept in the session, so later calls reuse it.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shutterlake/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back: cuts lineage and survives lost executors."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove a folder of one run when it ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def cut(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Materialise an intermediate result in the shared folder, until the driver ends or ``discard`` is called on ``held``."""
    path = shared_dir(df.sparkSession, name)
    out = write_table(df, path, "errorifexists")
    drop_at_exit(df.sparkSession, path)
    if held is not None:
        held.append(path)
    return out


def discard(spark: SparkSession, held: list[str]) -> None:
    """Remove intermediate results that nothing reads any more."""
    for path in held:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    held.clear()
