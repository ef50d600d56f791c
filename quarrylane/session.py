"""Session set-up, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes by the optimizer's estimate, that a join here may broadcast.
BROADCAST_BYTES = 16 << 20


def local_session(cores: str | int = "*", memory: str = "8g", name: str = "quarrylane") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's own, or a new one where none is set (tests, one machine)."""
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quarrylane-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, once: they may run where it is not on the path."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrylane_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    folder = folder.removeprefix("file://")
    if not folder.startswith("/"):
        folder = tempfile.mkdtemp(prefix="quarrylane-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"quarrylane-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("quarrylane", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._quarrylane_shipped = True


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its estimated size is within the limit; else leave the choice to Spark."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
