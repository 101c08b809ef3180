"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "cuegrid", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and give checkpoints a home.

    The folder in ``spark.checkpoint.dir`` is used as it is; only where it is unset and everything runs on one machine
    (tests) a temporary one is chosen.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_cuegrid_ready", False):
        if not _local(spark):
            sc.addPyFile(_zipped(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
        sc._cuegrid_ready = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or getattr(sc, "_cuegrid_dir", "")
    if not found:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._cuegrid_dir = tempfile.mkdtemp(prefix="cuegrid-ckpt-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: its lineage ends there, and each use reads its own columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _zipped(root: str) -> str:
    """The package as a zip archive for executors that do not share the driver's file system."""
    import zipfile

    out = os.path.join(tempfile.mkdtemp(prefix="cuegrid-"), "cuegrid_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "cuegrid")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
