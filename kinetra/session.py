"""Sessions, table loading and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "kinetra", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_kinetra_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kinetra-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "kinetra.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.join("kinetra", os.path.relpath(path, root)))
    context.addPyFile(name)
    context._kinetra_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent in a local session (as in tests) a temporary folder is made and removed at exit; a
    cluster without the setting is an error, since its executors would not see such a folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(context, "_kinetra_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="kinetra-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context._kinetra_dir = own
    return f"file://{own}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    This cuts the lineage: what follows survives the loss of executors without computing df again, and the
    rows do not depend on a second evaluation. The tables stay until release() or the end of the cluster's folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every durable table of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
