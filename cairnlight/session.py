"""Session set-up and the two ways of cutting lineage that survive a lost executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cairnlight", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; further settings by keyword.

    The master is that of the submitter; cores asks for a local one. The number of shuffle partitions isn't set here: it belongs to the cluster's or the caller's settings.
    The package is sent to workers that can't import it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and the master is local, one of our own (local runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cairnlight-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that no lineage and no executor is needed to read it."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: compact, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context, unless their path or working folder has it anyway."""
    package = Path(__file__).resolve().parent
    seen = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    context = spark.sparkContext
    if package.parent in seen or getattr(context, "_cairnlight_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="cairnlight-")) / "cairnlight.zip"  # served by the driver, not read by others
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cairnlight_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan whose few files would leave most cores idle, over all cores; a scan with enough splits as it is. For work that costs far more than a shuffle."""
    cores, execution = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df  # not a mere scan: asking for its partitions would run it
    return df.repartition(cores) if 2 * execution.toRdd().getNumPartitions() <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
